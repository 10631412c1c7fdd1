"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from basketlab.llm.annsearch import op1_neighbours
from basketlab.llm.ctw import op7_context_tree
from basketlab.llm.decontaminate import ORACLE_SQL as DECONTAMINATE_SQL, op8_decontaminate
from basketlab.llm.fim import ORACLE_SQL as FIM_SQL, op12_fill_in_middle
from basketlab.llm.mixing import ORACLE_SQL as MIXING_SQL, op6_mixing
from basketlab.llm.neardup import op2_near_duplicates
from basketlab.llm.paragraphs import op5_paragraphs
from basketlab.llm.phrases import ORACLE_SQL as PHRASES_SQL, op11_collocations
from basketlab.llm.quality import op10_quality
from basketlab.llm.secrets import op3_secrets
from basketlab.llm.substring import op4_suffix_array
from basketlab.llm.toxicity import op9_toxicity
from basketlab.llm.voronoi import op13_jaccard_join

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secrets": op3_secrets,
    "op4_suffix_array": op4_suffix_array,
    "op5_paragraphs": op5_paragraphs,
    "op6_mixing": op6_mixing,
    "op7_context_tree": op7_context_tree,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_jaccard_join": op13_jaccard_join,
}

SQL = {
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op6_mixing": MIXING_SQL,
    "op11_collocations": PHRASES_SQL,
    "op12_fill_in_middle": FIM_SQL,
}
