"""Orders as they arrive: order numbers, gaps, cart positions and reordered
marks kept up batch by batch (E1, E2, E5, E6).

Ranking windows are not allowed on streaming DataFrames, and a state per
customer would tie a reseller with a third of all lines to one task. So the
stream is processed with ``foreachBatch``, and the state is two tables: the last
order of each customer (number, time, id) and the products each has bought. A
batch joins its own orders to them, numbers them with the operators of
the batch pipeline, and writes its results and the next state. All of it
becomes visible by one switch of a manifest (``sources.sinks``), which also
holds the batch's number: a batch that is run again after a failure is
skipped if it was published, and starts over if it was not.

Rules for late data: an order is late when its customer already has an order
at the same or a later (order_date, order_id); so is a line of an order that an
earlier batch has seen, since all lines of an order arrive in one batch.
Late lines are not numbered; they are kept in ``late``.

Defined results: an empty batch changes nothing; lines repeated within a batch
are the caller's to consolidate (``cleanse.consolidate_lines``); before the
first batch the tables are empty.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketlab.functions.columns import whole_days_between
from basketlab.operators.orders import cart_position, holdout_split, orders_from_lines
from basketlab.operators.sequence import number_within
from basketlab.session import delete_paths, materialize, owned_by
from basketlab.sources.sinks import read_manifest, switch_manifest

LINES = ("order_id long, product_id long, order_date timestamp_ntz, unit_price decimal(12,2), user_id long, "
         "quantity long, line_no long")
ORDERS = ("user_id long, order_id long, order_date timestamp_ntz, order_number long, order_dow long, "
          "order_hour_of_day long, days_since_prior_order long")
ORDER_LINES = ("order_id long, product_id long, quantity long, unit_price decimal(12,2), add_to_cart_order long, "
               "reordered long, user_id long, order_number long")
LAST = "user_id long, last_number long, last_date timestamp_ntz, last_id long"
BOUGHT = "user_id long, product_id long"
_TABLES = {"orders": ORDERS, "order_lines": ORDER_LINES, "late": LINES, "last": LAST, "bought": BOUGHT}
_GROWING = ("orders", "order_lines", "late")        # one folder for each batch; the others are replaced


def _names(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema).fields]


class OrderStream:
    """The tables under ``out_dir`` and how a batch changes them."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.base = spark, out_dir.rstrip("/")

    def _state(self) -> dict:
        return read_manifest(self.spark, self.base) or {"batch": -1, "parts": {t: [] for t in _TABLES}}

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        """``orders``, ``order_lines``, ``late``, ``last`` or ``bought`` as of
        the batch last published."""
        parts = (state or self._state())["parts"][name]
        if not parts:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*[f"{self.base}/{p}" for p in parts])

    def orders(self, share: float, seed: int) -> DataFrame:
        """Q19 as of now: each customer's last order so far is held out."""
        return holdout_split(self.table("orders"), share, seed)

    def order_products(self, share: float, seed: int) -> DataFrame:
        """Q20 as of now."""
        held = self.orders(share, seed).select("order_id", "eval_set")
        return self.table("order_lines").join(held, "order_id").select(
            "order_id", "product_id", "quantity", "unit_price", "add_to_cart_order", "eval_set", "reordered",
            "user_id", "order_number")

    def process(self, lines: DataFrame, batch_id: int) -> None:
        """Add one batch of consolidated order lines."""
        state = self._state()
        if batch_id <= state["batch"] or lines.isEmpty():
            return
        on_the_way: list[str] = []
        made: dict[str, str] = {}
        folder = f"parts/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

        def write(name: str, df: DataFrame) -> DataFrame:
            made[name] = f"{folder}/{name}"
            df.write.parquet(f"{self.base}/{made[name]}")
            return self.spark.read.schema(_TABLES[name]).parquet(f"{self.base}/{made[name]}")

        with owned_by(on_the_way):
            last, bought = self.table("last", state), self.table("bought", state)
            lines = lines.select(*_names(LINES))
            first = orders_from_lines(lines).join(last, "user_id", "left")
            known = self.table("orders", state).select("order_id", F.lit(True).alias("_known"))
            first = first.join(known, "order_id", "left")
            later = (F.col("order_date") > F.col("last_date")) | (
                (F.col("order_date") == F.col("last_date")) & (F.col("order_id") > F.col("last_id")))
            on_time = F.col("_known").isNull() & (F.col("last_number").isNull() | later)
            first = materialize(first.withColumn("_fresh", F.coalesce(on_time, F.lit(False))), "arrived")
            # a table of its own: its size is known, so few late orders are looked up without moving the lines
            late_ids = materialize(first.where(~on_time).select("order_id"), "late_orders")
            write("late", lines.join(late_ids, "order_id", "left_semi"))
            fresh = first.where("_fresh").select("user_id", "order_id", "order_date", "last_number", "last_date")
            seq = number_within(fresh, ["user_id"], ["order_date", "order_id"], "_nth", prev={"order_date": "_prev"})
            before = F.coalesce("_prev", "last_date")
            orders = write("orders", seq.select(
                "user_id", "order_id", "order_date",
                (F.coalesce("last_number", F.lit(0)) + F.col("_nth")).cast("long").alias("order_number"),
                F.weekday("order_date").cast("long").alias("order_dow"), F.hour("order_date").cast("long").alias("order_hour_of_day"),
                whole_days_between(before, F.col("order_date")).cast("long").alias("days_since_prior_order")))

            mine = cart_position(lines.join(late_ids, "order_id", "left_anti")).drop("user_id").join(
                orders.select("order_id", "user_id", "order_number"), "order_id")
            pair = ["user_id", "product_id"]
            opening = mine.groupBy(*pair).agg(F.min("order_number").alias("_first")).join(
                bought.withColumn("_had", F.lit(True)), pair, "left")
            opening = materialize(opening, "opening")
            marked = mine.join(opening, pair).withColumn(
                "reordered", (F.col("_had").isNotNull() | (F.col("order_number") > F.col("_first"))).cast("long"))
            write("order_lines", marked.select(*_names(ORDER_LINES)))

            newest = orders.groupBy("user_id").agg(F.max(F.struct("order_number", "order_date", "order_id")).alias("n")).select(
                "user_id", F.col("n.order_number").alias("last_number"), F.col("n.order_date").alias("last_date"),
                F.col("n.order_id").alias("last_id"))
            write("last", last.join(newest, "user_id", "left_anti").unionByName(newest))
            write("bought", bought.unionByName(opening.where("_had is null").select(*pair).na.drop()))

        parts = {t: [*state["parts"][t], made[t]] if t in _GROWING else [made[t]] for t in _TABLES}
        switch_manifest(self.spark, self.base, {"batch": batch_id, "parts": parts})
        replaced = [f"{self.base}/{p}" for t in _TABLES if t not in _GROWING for p in state["parts"][t]]
        delete_paths(self.spark, on_the_way + replaced)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start the query that feeds ``stream`` (a streaming DataFrame of
        lines) to ``process``; ``trigger`` as for ``DataStreamWriter.trigger``."""
        return (stream.writeStream.foreachBatch(lambda df, i: self.process(df, i))
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def replay(spark: SparkSession, lines: DataFrame, folder: str, batches: int = 3) -> OrderStream:
    """Run a finished table of lines through the stream in ``batches`` files
    by order time, as if it had arrived so."""
    days = lines.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b")).first()
    out = OrderStream(spark, f"{folder}/out")
    if days.a is None:
        return out
    step = (days.b - days.a) / batches
    for k in range(batches):
        inside = (F.col("order_date") >= F.lit(days.a + step * k)) & (F.lit(k == batches - 1) | (F.col("order_date") < F.lit(days.a + step * (k + 1))))
        lines.where(inside).select(*_names(LINES)).write.parquet(f"{folder}/in/{k}")
        arrived = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        out.follow(arrived, f"{folder}/checkpoint").awaitTermination()     # one query, gone on with as files come
    return out
