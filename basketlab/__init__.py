"""basketlab: retail basket analytics and next-basket recommendation on PySpark.

Layers
------
sources    read invoice lines / driver tables, write pipeline tables
functions  Column-level helpers (safe ratios, hash keys, basket F1)
operators  DataFrame -> DataFrame steps: cleansing, order sequencing,
           features, candidates, ranking and scoring
plans      whole analyses built from operators (EDA, statistics, models)
           and the registry of named queries
streaming  none: the workload is batch only (see README)
"""

__version__ = "0.1.0"
