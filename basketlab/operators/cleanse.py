"""Invoice-line cleansing (Q18): anonymous rows, cancellations, non-product
codes, product encoding, active customers, one row per (invoice, product)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.operators.indexing import dense_index
from basketlab.operators.sequence import number_within

_NET_KEY = ["user_id", "stock"]


def drop_anonymous(lines: DataFrame) -> DataFrame:
    """B1: lines without a customer are dropped."""
    return lines.filter(F.col("user_id").isNotNull())


def net_cancellations(lines: DataFrame, mode: str = "reference") -> DataFrame:
    """Net purchase lines against the customer's cancellations of the code.

    mode='reference' keeps the reference's many-to-many rule: a purchase line
    of q is paired with every cancellation c of the same (customer, code), in
    any invoice, and each pair q + c that stays positive survives as a copy;
    with no cancellation the line stays as is. Copies of a line differ only in
    quantity and are summed later, so each line is returned once with
    ``quantity`` = sum of its surviving copies and ``copies`` = their number.

    No pair is materialised. Lines are first left-joined with the totals of
    their (customer, code); those without a cancellation, nearly all, are done.
    For the others, cancellations are pre-aggregated per (customer, code,
    magnitude), merged with the distinct purchase quantities of the same
    (customer, code), and a running count and sum over magnitudes gives, for
    each purchase quantity q, the cancellations with |c| < q. The window
    partitions hold distinct quantity values only, so a customer-code with a
    huge number of lines does not make a big partition.

    mode='net_total' subtracts the total cancelled quantity of the
    (customer, code) from every purchase line (one copy each).

    mode='fifo' gives that total out over the purchase lines of the (customer,
    code) in time order (order_date, order_id, line_no): the units bought
    are numbered through by a running sum, the first ones are the cancelled
    ones, and a line keeps its units beyond them. Only lines with a
    cancellation are numbered, by ``number_within``, so a reseller may hold
    any share of them.

    Lines with quantity <= 0 never survive in any mode.
    """
    if mode not in ("reference", "net_total", "fifo"):
        raise ValueError(f"unknown cancellation mode {mode!r}")
    q = F.col("quantity")
    cancels = lines.filter(q < 0)
    totals = cancels.groupBy(*_NET_KEY).agg(F.sum("quantity").alias("_cancelled"))
    purchases = lines.filter(q > 0).join(totals, _NET_KEY, "left")
    if mode == "net_total":
        return (purchases.withColumn("quantity", q + F.coalesce(F.col("_cancelled"), F.lit(0)))
                .withColumn("copies", F.lit(1).cast("long"))
                .filter(F.col("quantity") > 0)
                .drop("_cancelled"))
    clear = purchases.filter(F.col("_cancelled").isNull()).drop("_cancelled").withColumn("copies", F.lit(1).cast("long"))
    touched = purchases.filter(F.col("_cancelled").isNotNull())
    if mode == "fifo":
        numbered = number_within(touched, _NET_KEY, ["order_date", "order_id", "line_no"], "_nth",
                                 sums={"quantity": "_before"})
        gone = F.greatest(F.lit(0), F.least(q, -F.col("_cancelled") - F.col("_before")))
        netted = numbered.withColumn("quantity", (q - gone).cast("long")).filter(F.col("quantity") > 0)
        return clear.unionByName(netted.drop("_cancelled", "_nth", "_before").withColumn("copies", F.lit(1).cast("long")))

    by_size = (cancels.groupBy(*_NET_KEY, (-q).alias("_k"))
               .agg(F.count(F.lit(1)).alias("_n"), F.sum("quantity").alias("_s"))
               .withColumn("_kind", F.lit(1)))
    sizes = (touched.select(*_NET_KEY, q.alias("_k")).distinct()
             .select(*_NET_KEY, "_k", F.lit(0).cast("long").alias("_n"),
                     F.lit(0).cast("long").alias("_s"), F.lit(0).alias("_kind")))
    running = (Window.partitionBy(*_NET_KEY).orderBy("_k", "_kind")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prefix = (sizes.unionByName(by_size)
              .select(*_NET_KEY, F.col("_k").alias("quantity"), "_kind",
                      F.sum("_n").over(running).alias("copies"), F.sum("_s").over(running).alias("_cs"))
              .filter((F.col("_kind") == 0) & (F.col("copies") > 0)).drop("_kind"))
    netted = (touched.drop("_cancelled").join(prefix, [*_NET_KEY, "quantity"])
              .withColumn("quantity", (F.col("copies") * q + F.col("_cs")).cast("long")).drop("_cs"))
    return clear.unionByName(netted)


def drop_codes(lines: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Keep net-positive product lines (codes compared case-sensitively)."""
    codes = K.NON_PRODUCT_CODES if codes is None else codes
    return lines.filter((F.col("quantity") > 0) & ~F.col("stock").isin(list(codes)))


def product_codes(lines: DataFrame) -> DataFrame:
    """Dense code 0..n-1 for each distinct stock code, in code-point order."""
    stocks = lines.select("stock").distinct()
    return dense_index(stocks, ["stock"], out="product_id")


def encode_products(lines: DataFrame) -> DataFrame:
    """E8 + C2: attach ``product_id`` to each line."""
    return lines.join(product_codes(lines), "stock", "left")


def active_customer_ids(lines: DataFrame, more_than: int = K.MIN_INVOICES_EXCLUSIVE) -> DataFrame:
    """D3: customers with more than ``more_than`` invoices, with their count.

    Distinct (customer, invoice) pairs are formed first, so partial
    aggregation spreads a heavy customer over many tasks.
    """
    return (lines.select("user_id", "order_id").distinct()
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_invoices"))
            .filter(F.col("n_invoices") > more_than))


def active_customers(lines: DataFrame, more_than: int = K.MIN_INVOICES_EXCLUSIVE) -> DataFrame:
    """D3 + C15: keep lines of active customers (semi join; AQE splits
    skewed partitions of the line side)."""
    return lines.join(active_customer_ids(lines, more_than).select("user_id"), "user_id", "left_semi")


def active_lines(lines: DataFrame, more_than: int = K.MIN_INVOICES_EXCLUSIVE) -> DataFrame:
    """The lines of ``active_customers``, dealt by invoice (``order_id`` is not
    null): the customers are looked up from their invoices, one row for each,
    and the lines meet those. What is grouped by invoice next needs no
    exchange of its own, so the wide lines move once instead of twice."""
    known = lines.where(F.col("user_id").isNotNull() & F.col("order_id").isNotNull())   # one plan, hence one exchange, for both uses
    pairs = known.select("user_id", "order_id").distinct()
    users = active_customer_ids(known, more_than).select("user_id")
    mine = pairs.join(users, "user_id", "left_semi").select(F.col("order_id").alias("_order"), F.col("user_id").alias("_user"))
    # the customer as a range, not as a key: lines are to be dealt by invoice alone
    same = (F.col("order_id") == F.col("_order")) & (F.col("user_id") <= F.col("_user")) & (F.col("user_id") >= F.col("_user"))
    return lines.hint("merge").join(mine, same, "left_semi")


def consolidate_lines(lines: DataFrame) -> DataFrame:
    """D15 (+C3): one row per (invoice, product).

    Quantity is summed; every other attribute comes from the first line of
    the pair (lowest ``line_no``), as the reference keeps the first row.
    """
    first = F.min_by(F.struct("stock", "description", "order_date", "unit_price", "user_id",
                              "country", "line_no"), F.col("line_no"))
    return (lines.groupBy("order_id", "product_id")
            .agg(F.sum("quantity").cast("long").alias("quantity"), first.alias("_f"))
            .select("order_id", "product_id",
                    F.col("_f.stock").alias("product_id_original"),
                    F.col("_f.description").alias("description"),
                    F.col("_f.order_date").alias("order_date"),
                    F.col("_f.unit_price").alias("unit_price"),
                    F.col("_f.user_id").alias("user_id"),
                    F.col("_f.country").alias("country"),
                    "quantity",
                    F.col("_f.line_no").alias("line_no")))
