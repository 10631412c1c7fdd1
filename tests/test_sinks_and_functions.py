"""Sinks (A4-A6) and the array form of the basket F1."""

from pyspark.sql import functions as F

from basketlab.functions.columns import basket_f1
from basketlab.plans.pipeline import RetailPipeline
from basketlab.sources.raw import lines_from_rows
from basketlab.sources.sinks import metric_frame, read_tables, write_recommendations, write_tables
from tests.test_fixture import ROWS


def test_write_and_read_tables(spark, tmp_path):
    p = RetailPipeline(lines_from_rows(spark, ROWS), codes=["POST"], share=1.0)
    tables = p.tables()
    write_tables(tables, str(tmp_path), partition_by={"order_products": ["eval_set"]})
    back = read_tables(spark, str(tmp_path), list(tables))
    assert {k: v.count() for k, v in back.items()} == {k: v.count() for k, v in tables.items()}
    prior = back["order_products"].filter(F.col("eval_set") == "prior")
    assert prior.count() == 5


def test_recommendations_sink(spark, tmp_path):
    rep = spark.createDataFrame([(104, [0, 1], [2, 1], 0.5)],
                                "order_id long, recommendations array<long>, ordered_products array<long>, f1_score double")
    write_recommendations(rep, str(tmp_path / "rec"), fmt="json")
    back = spark.read.json(str(tmp_path / "rec")).collect()[0]
    assert list(back.recommendations) == [0, 1] and back.f1_score == 0.5


def test_metric_frame(spark):
    row = metric_frame(spark, mean_f1=0.25, n_orders=2).collect()[0]
    assert (row.mean_f1, row.n_orders) == (0.25, 2)


def test_basket_f1_array_form(spark):
    df = spark.createDataFrame([([0, 1], [2, 1]), ([1], [0]), ([1, 1, 2], [1, 2])],
                               "pred array<long>, truth array<long>")
    got = [r.f1 for r in df.select(basket_f1("pred", "truth").alias("f1")).collect()]
    assert got == [0.5, 0.0, 1.0]


def test_release_deletes_stage_tables(spark):
    import os
    p = RetailPipeline(lines_from_rows(spark, ROWS), codes=["POST"], share=1.0)
    p.order_products
    paths = list(p.written)
    assert paths and all(os.path.exists(x.replace("file:", "")) for x in paths)
    p.release()
    assert not p.written and not any(os.path.exists(x.replace("file:", "")) for x in paths)
