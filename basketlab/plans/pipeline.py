"""The reference's batch pipeline as one lazy DAG of DataFrames.

raw -> clean -> orders -> order_products -> (user, product) base ->
product / user / user x product features -> candidates -> feature frames.

Every attribute is a lazily built DataFrame; properties are memoised so a
query that uses a table twice shares one plan (and Spark reuses its
exchanges).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.operators import candidates as C
from basketlab.operators import cleanse, features, orders as O
from basketlab.plans import models
from basketlab.session import delete_paths, materialize, materialize_by, owned_by
from basketlab.sources.raw import invoice_lines_from_tables

# Deny list used with the star-schema test tables (their codes are product
# names; none of the reference's codes occur there).
TEST_TABLE_CODES = ["red bolt"]
# Stage tables are wide and read a few times: fewer bytes are worth the compression.
STAGE_CODEC = "zstd"


class RetailPipeline:
    def __init__(self, raw: DataFrame, mode: str = "reference", codes: list[str] | None = None,
                 share: float = K.TRAIN_SHARE, seed: int = K.SEED,
                 checkpoint_stages: bool = True, customer_buckets: int | None = None):
        """``customer_buckets``: store the tables that later steps join or group
        by customer (orders, order lines, the (customer, product) base and the
        customer features) in so many buckets by user_id. Everything from the
        order lines to the feature frames then runs without an exchange on
        user_id, as long as the session does not ask for all keys of a join
        to be co-partitioned (spark.sql.requireAllClusterKeysForCoPartition =
        false). A bucket is one task, so leave it unset where one customer may hold a
        large share of the lines: exchanges can be split, buckets cannot."""
        self.raw = raw
        self.customer_buckets = customer_buckets
        self.checkpoint_stages = checkpoint_stages
        self.written: list[str] = []
        self.released = False
        self.mode = mode
        self.deny_codes = K.NON_PRODUCT_CODES if codes is None else codes
        self.share = share
        self.seed = seed

    @classmethod
    def from_dir(cls, spark: SparkSession, base_dir: str, **kw) -> "RetailPipeline":
        """Pipeline over the star-schema test tables; the invoice lines they
        map to are ingested (written once) before any step reads them."""
        kw.setdefault("codes", TEST_TABLE_CODES)
        raw = invoice_lines_from_tables(spark, base_dir)
        written: list[str] = []
        if kw.get("checkpoint_stages", True):
            raw = materialize(raw, "invoice_lines", written, STAGE_CODEC)
        pipe = cls(raw, **kw)
        pipe.written.extend(written)
        return pipe

    def owned(self):
        """Context in which tables that operators write belong to this
        pipeline (``release`` deletes them)."""
        return owned_by(self.written)

    def _stage(self, build: Callable[[], DataFrame], label: str, by_customer: bool = False) -> DataFrame:
        """The frame of ``build`` as a stage table. Tables that operators
        wrote on the way are deleted once the stage is written."""
        on_the_way: list[str] = []
        with owned_by(on_the_way):
            df = build()
        if not self.checkpoint_stages:
            self.written += on_the_way
            return df
        if by_customer and self.customer_buckets:
            out = materialize_by(df, "user_id", self.customer_buckets, label, self.written)
        else:
            out = materialize(df, label, self.written, STAGE_CODEC)
        delete_paths(out.sparkSession, on_the_way)
        return out

    def release(self) -> None:
        """Delete the stage tables this pipeline wrote. The pipeline and the
        DataFrames taken from it must not be used afterwards."""
        delete_paths(self.raw.sparkSession, self.written)
        self.released = True
        for name in [k for k, v in type(self).__dict__.items() if isinstance(v, cached_property)]:
            self.__dict__.pop(name, None)
        self.raw = None

    # --- wrangling -------------------------------------------------------
    @cached_property
    def kept(self) -> DataFrame:
        """Net-positive product lines (cancellations netted, codes dropped)."""
        return self._stage(lambda: cleanse.drop_codes(cleanse.net_cancellations(
            cleanse.drop_anonymous(self.raw), self.mode), self.deny_codes), "kept")

    @cached_property
    def product_codes(self) -> DataFrame:
        return self._stage(lambda: cleanse.product_codes(self.kept), "product_codes")

    @cached_property
    def lines(self) -> DataFrame:
        """Kept lines with product codes (before the customer filter)."""
        return self.kept.join(self.product_codes, "stock", "left")

    @cached_property
    def clean(self) -> DataFrame:
        return self._stage(lambda: cleanse.consolidate_lines(cleanse.active_lines(self.lines)), "clean")

    @cached_property
    def orders(self) -> DataFrame:
        return self._stage(lambda: O.build_orders(self.clean, self.share, self.seed), "orders", by_customer=True)

    @cached_property
    def order_products(self) -> DataFrame:
        return self._stage(lambda: O.build_order_products(self.clean, self.orders), "order_products", by_customer=True)

    @cached_property
    def products(self) -> DataFrame:
        return O.products_dimension(self.clean)

    @cached_property
    def customers(self) -> DataFrame:
        return O.customers_dimension(self.clean)

    # --- features ----------------------------------------------------------
    @cached_property
    def priors(self) -> DataFrame:
        return features.prior_lines(self.order_products)

    @cached_property
    def up_base(self) -> DataFrame:
        return self._stage(lambda: features.user_product_base(self.priors), "up_base", by_customer=True)

    @cached_property
    def product_features(self) -> DataFrame:
        return self._stage(lambda: features.product_features(self.up_base, self.products), "product_features")

    @cached_property
    def user_features(self) -> DataFrame:
        return self._stage(lambda: features.user_features(self.up_base, self.priors, self.orders), "user_features", by_customer=True)

    @cached_property
    def up_features(self) -> DataFrame:
        return features.user_product_features(self.up_base)

    def candidates(self, eval_set: str) -> DataFrame:
        return C.candidates(self.orders, self.up_features, eval_set)

    def feature_frame(self, eval_set: str) -> DataFrame:
        """Q15: candidates of one held-out set with features (and labels for 'train')."""
        return C.feature_frame(self.orders, self.user_features, self.product_features, self.up_features,
                               self.order_products, eval_set, with_labels=eval_set == "train")

    @cached_property
    def train_frame(self) -> DataFrame:
        return self._stage(lambda: self.feature_frame("train"), "train_frame")

    @cached_property
    def test_frame(self) -> DataFrame:
        return self._stage(lambda: self.feature_frame("test"), "test_frame")

    # --- models --------------------------------------------------------------
    @cached_property
    def recommendations(self) -> DataFrame:
        """Q16: the report of the fitted blend for the test orders; the models
        are fitted once."""
        return self._stage(lambda: models.test_recommendations(self.train_frame, self.test_frame, self.truth("test")),
                           "recommendations")

    @cached_property
    def validation(self) -> DataFrame:
        """Q17: mean F1 of the blend on held-out users of the train frame."""
        return self._stage(lambda: models.validation_f1(self.train_frame, self.order_products), "validation")

    def truth(self, eval_set: str) -> DataFrame:
        return (self.order_products.filter(F.col("eval_set") == eval_set)
                .select("order_id", "product_id", "add_to_cart_order"))

    def tables(self) -> dict[str, DataFrame]:
        """The six wrangled tables and four feature frames, for the sinks."""
        return {
            "clean": self.clean.drop("line_no"), "orders": self.orders, "products": self.products,
            "customers": self.customers,
            "order_products": self.order_products.drop("user_id", "order_number"),
            "order_products_compact": O.baskets(self.order_products),
            "train_transformed": self.train_frame, "test_transformed": self.test_frame,
            "product_features": self.product_features,
            "user_features": features.with_product_lists(self.user_features, self.up_base),
        }
