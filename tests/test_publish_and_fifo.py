"""Publishing a set of tables at once; cancellations in time order; the
command line."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketlab.operators.cleanse import net_cancellations
from basketlab.operators.sequence import number_within
from basketlab.sources import sinks


def frames(spark, k):
    return {"a": spark.range(k).withColumnRenamed("id", "x"), "b": spark.range(k, 2 * k).withColumn("part", F.col("id") % 2)}


def read(spark, out, names=None):
    return {n: sorted(r[0] for r in df.collect()) for n, df in sinks.read_published(spark, out, names).items()}


def test_publish_switches_and_keeps_the_former_version(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, out)
    versions = [sinks.publish_tables(frames(spark, k), out, {"b": ["part"]}, keep=2) for k in (3, 4, 5)]
    assert read(spark, out) == {"a": [0, 1, 2, 3, 4], "b": [5, 6, 7, 8, 9]}
    assert sorted(os.listdir(f"{out}/versions")) == sorted(versions[1:])
    with pytest.raises(KeyError):
        sinks.read_published(spark, out, ["c"])
    assert not [f for f in os.listdir(out) if f.startswith(".MANIFEST") and not f.endswith(".crc")]


def test_a_job_that_dies_leaves_the_former_set(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    sinks.publish_tables(frames(spark, 3), out)
    before = read(spark, out)
    broken = frames(spark, 4)
    broken["b"] = broken["b"].withColumn("part", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(0))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_tables(broken, out)
    assert read(spark, out) == before

    def killed(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "switch_manifest", killed)              # all tables written, not yet switched
    with pytest.raises(KeyboardInterrupt):
        sinks.publish_tables(frames(spark, 6), out)
    monkeypatch.undo()
    assert read(spark, out) == before
    assert len(sinks.remove_unpublished(spark, out)) == 2 and read(spark, out) == before
    sinks.publish_tables(frames(spark, 2), out)
    assert read(spark, out) == {"a": [0, 1], "b": [2, 3]}


def test_running_sums_over_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.8 else f"g{rng.randrange(20)}", k, rng.randint(-5, 9) if rng.random() < 0.9 else None)
            for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(6)
    got = {r.k: (r.nth, r.before, r.last) for r in
           number_within(df, ["g"], ["k"], "nth", prev={"k": "last"}, sums={"v": "before"}).collect()}
    seen, total, last = defaultdict(int), defaultdict(int), {}
    for g, k, v in rows:
        seen[g] += 1
        assert got[k] == (seen[g], total[g], last.get(g))
        total[g] += v or 0
        last[g] = k


LINES = "user_id long, stock string, order_date long, order_id long, line_no long, quantity long"


def by_hand(rows):
    cancelled, out = defaultdict(int), {}
    for u, s, *_, q in rows:
        if q < 0:
            cancelled[u, s] -= q
    for u, s, d, o, n, q in sorted(rows, key=lambda r: r[:5]):
        if q > 0:
            gone = min(q, cancelled[u, s])
            cancelled[u, s] -= gone
            if q > gone:
                out[o, n] = q - gone
    return out


def test_fifo_gives_cancelled_units_out_in_time_order(spark):
    """A reseller holds most lines; ties in time go by order and line."""
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(2, 30), rng.choice("AB"), rng.randrange(40), o, n,
             rng.choice([-7, -1, 0, 1, 2, 3, 10, 40])) for o in range(500) for n in range(3)]
    rows += [(99, "A", 1, 9000, 0, 5), (99, "A", 2, 9001, 0, -50), (98, "A", 1, 9002, 0, -3)]
    df = spark.createDataFrame(rows, LINES).repartition(5)
    got = {(r.order_id, r.line_no): (r.quantity, r.copies) for r in net_cancellations(df, "fifo").collect()}
    assert got == {k: (q, 1) for k, q in by_hand(rows).items()}


def test_only_lines_with_a_cancellation_meet_a_window(spark):
    rows = [(u, "A", 1, u, 0, 5) for u in range(200)] + [(3, "A", 2, 500, 0, -2)]
    df = spark.createDataFrame(rows, LINES)
    out = net_cancellations(df)
    got = {r.order_id: (r.quantity, r.copies) for r in out.collect()}
    assert got == {u: ((3, 1) if u == 3 else (5, 1)) for u in range(200)}
    assert net_cancellations(df.where("quantity > 0")).count() == 200
    with pytest.raises(ValueError):
        net_cancellations(df, "lifo")


HEAD = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def test_command_line_on_the_original_file(spark, tmp_path, capsys):
    """CSV with the original names, line order named, rejects kept, published."""
    from basketlab.__main__ import main
    lines = [f"{100 * u + k},P{k % 3}{x},thing,{k + 1},2011-01-{k + 1:02d} 10:00:00,1.50,{u},UK"
             for u in range(1, 6) for k in range(5) for x in "ab"]
    lines += ["C999,P0a,thing,-1,2011-02-01 10:00:00,1.50,1,UK", "77,P0a,thing,many,2011-02-01 10:00:00,1.50,1,UK",
              "78,POST,post,1,2011-02-01 10:00:00,1.50,1,UK"]
    (tmp_path / "in.csv").write_text(HEAD + "\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        main(["tables", "--input", str(tmp_path / "in.csv"), "--lines", "--format", "csv", "--line-order", "StockCode",
              "--rejects", str(tmp_path / "rejects"), "--out", out, "--publish", "--mode", "fifo"])
    assert "lines left out: 1" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "rejects")).first().reject_reason == "quantity"
    back = sinks.read_published(spark, out)
    assert back["orders"].count() == 25 and back["clean"].where("product_id_original = 'POST'").count() == 0
    assert "all_products" in back["user_features"].columns and back["order_products"].count() == 50 - 1
