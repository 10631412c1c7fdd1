"""Invoice-line sources.

The library works on one table of invoice lines (schema ``RAW_SCHEMA``):
order_id, stock, description, quantity, order_date, unit_price, user_id,
country, line_no. ``line_no`` is the position of the line inside its order
and is the tie-break the reference takes from row order.

``invoice_lines_from_tables`` maps the star-schema test tables to that shape
(one line in six becomes a cancellation, one order in 97 anonymous).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.operators.sequence import window_within
from basketlab.sources.tables import read_table

RAW_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("stock", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("quantity", T.LongType(), False),
    T.StructField("order_date", T.TimestampNTZType(), False),
    T.StructField("unit_price", T.DecimalType(12, 2), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("country", T.StringType(), False),
    T.StructField("line_no", T.LongType(), False),
])

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# How the test tables become invoice lines.
ANONYMOUS_ORDER_MODULUS = 97
CANCEL_RETURNFLAG = "R"
CANCEL_LINESTATUS = "F"


# Column names of the original invoice file.
SOURCE_NAMES = {"InvoiceNo": "order_id", "StockCode": "stock", "Description": "description", "Quantity": "quantity",
                "InvoiceDate": "order_date", "UnitPrice": "unit_price", "CustomerID": "user_id", "Country": "country"}
REQUIRED = [f.name for f in RAW_SCHEMA.fields if not f.nullable]


def read_invoice_lines(spark: SparkSession, path: str, fmt: str = "parquet",
                       line_order: list[str] | None = None) -> DataFrame:
    """Ingest invoice lines (A1): the rows that conform. ``split_lines`` also
    gives the rows that do not."""
    return split_lines(load_lines(spark, path, fmt), line_order)[0]


def load_lines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The file as it is; text formats are read by column name, all as text."""
    reader = spark.read.format(fmt)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


def split_lines(df: DataFrame, line_order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(conforming lines, rejects) of a loaded frame (B2).

    Columns are found by name, the original file's names included. Values are
    cast with ``try_cast``; an invoice number may carry a letter in front (the
    mark of a cancellation), which is dropped. A frame without ``line_no``
    needs ``line_order``, columns that order the lines of an invoice. Rejects
    keep their columns as text and name the required columns that are missing
    or unreadable in ``reject_reason``."""
    df = df.select(*[F.col(f"`{c}`").alias(SOURCE_NAMES.get(c, c)) for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns and c != "line_no"]
    if missing:
        raise ValueError(f"invoice lines without columns {missing}")
    if "line_no" not in df.columns:
        if not line_order:
            raise ValueError("invoice lines need line_no, or line_order to make it")
        df = window_within(df, ["order_id"], [SOURCE_NAMES.get(c, c) for c in line_order], "line_no")
    texts = {c: F.col(c).cast("string") for c in df.columns}
    texts["order_id"] = F.regexp_replace(texts["order_id"], "^[A-Za-z]", "")
    texts["user_id"] = F.regexp_replace(texts["user_id"], r"\.0$", "")
    typed = [texts[f.name].try_cast(f.dataType).alias(f.name) if f.name in texts
             else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]
    both = df.select(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]).alias("_as_read"), *typed)
    bad = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    # a customer that is given but unreadable is an error, a missing one is an anonymous line
    given = F.col("_as_read.user_id").isNotNull() if "user_id" in df.columns else F.lit(False)
    bad.append(F.when(F.col("user_id").isNull() & given & (F.trim("_as_read.user_id") != ""), F.lit("user_id"))
               if "user_id" in df.columns else F.lit(None).cast("string"))
    both = both.withColumn("reject_reason", F.concat_ws(",", *bad))
    return (both.where("reject_reason = ''").select(*RAW_COLUMNS),
            both.where("reject_reason <> ''").select("_as_read.*", "reject_reason"))


def invoice_lines_from_tables(spark: SparkSession, base_dir: str) -> DataFrame:
    """Invoice lines from lineitem, orders, part, customer and nation.

    Plan shape: lineitem is numbered per order (a window hash-partitioned by
    order key; an order holds the lines of one invoice) and joined to orders on the same key, so that window and join share one
    exchange. Orders are enriched with customer and nation first (orders are a
    quarter of lineitem), nation is the fixed 25-row dimension and is
    broadcast; part and customer joins are left to the planner and AQE, which
    broadcast them only when their measured size allows it.
    """
    li = read_table(spark, base_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_returnflag", "l_linestatus"])
    cancelled = (F.col("l_returnflag") == CANCEL_RETURNFLAG) & (F.col("l_linestatus") == CANCEL_LINESTATUS)
    li = li.withColumn("_cancelled", cancelled).drop("l_returnflag", "l_linestatus")     # two strings less to shuffle
    li = window_within(li, ["l_orderkey"],
                       ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "line_no")

    nation = read_table(spark, base_dir, "nation", ["n_nationkey", "n_name"])
    customer = read_table(spark, base_dir, "customer", ["c_custkey", "c_nationkey"])
    orders = read_table(spark, base_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    orders = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
              .select("o_orderkey", "o_custkey", "o_orderdate", "n_name"))
    part = read_table(spark, base_dir, "part", ["p_partkey", "p_name", "p_type", "p_retailprice"])

    lines = (li.join(orders, li.l_orderkey == orders.o_orderkey)
             .join(part, li.l_partkey == part.p_partkey))
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("p_name").alias("stock"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("description"),
        F.when(F.col("_cancelled"), -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long").alias("quantity"),
        F.col("o_orderdate").alias("order_date"),
        F.col("p_retailprice").cast(T.DecimalType(12, 2)).alias("unit_price"),
        F.when(F.col("o_orderkey") % ANONYMOUS_ORDER_MODULUS == 0, F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("user_id"),
        F.col("n_name").alias("country"),
        F.col("line_no"),
    )


def lines_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Small in-memory invoice-line table, for unit fixtures."""
    return spark.createDataFrame(rows, RAW_SCHEMA)
