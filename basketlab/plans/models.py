"""Scoring models and their evaluation.

Four ``pyspark.ml`` classifiers stand in for the reference's four libraries:
logistic regression (14 features), two gradient-boosted tree settings and a
random forest (23 features). Scores are blended with the reference weights
and cut into baskets by ``operators.evaluate``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.operators import evaluate as E
from basketlab.operators.indexing import hash_split
from basketlab.session import delete_paths, ensure_checkpoint_dir, materialize

ASSEMBLED = ["label", "_tree_vec", "_lr_vec"]
CHECKPOINT_ROUNDS = 10
# From so many rows on, a fit's time goes into its passes over the rows, not into the jobs around them.
MANY_ROWS = 1_000_000
# Most rows of one task then.
TASK_ROWS = 2_000_000
# Node statistics that a pass of the forest fills then: about what a core's own cache holds.
FOREST_GROUP_MB = 1


@dataclass
class ModelSettings:
    gbt_leafwise: dict = field(default_factory=lambda: dict(K.GBT_LEAFWISE))
    gbt_depthwise: dict = field(default_factory=lambda: dict(K.GBT_DEPTHWISE))
    forest: dict = field(default_factory=lambda: dict(K.FOREST))
    logistic_c: float = K.LOGISTIC_C
    seed: int = K.SEED

    def with_rounds(self, rounds: int, trees: int | None = None) -> "ModelSettings":
        s = ModelSettings(dict(self.gbt_leafwise), dict(self.gbt_depthwise), dict(self.forest),
                          self.logistic_c, self.seed)
        s.gbt_leafwise["maxIter"] = rounds
        s.gbt_depthwise["maxIter"] = rounds
        if trees:
            s.forest["numTrees"] = trees
        return s


def _assemble(df: DataFrame) -> DataFrame:
    df = VectorAssembler(inputCols=K.TREE_FEATURES, outputCol="_tree_vec").transform(df)
    return VectorAssembler(inputCols=K.LOGISTIC_FEATURES, outputCol="_lr_vec").transform(df)


def _evenly(train: DataFrame, n: int, written: list[str]) -> DataFrame:
    """The ``n`` rows of ``train`` assembled, in as many equal files as there
    are cores (or a multiple), each read by one task.

    A fit runs two stages of these tasks for each level of each tree, and a task sends
    its node statistics however few rows it has, so tasks cut by bytes, some
    of them empty because a row group is not split, shuffle more than one a core.
    Rows of a customer stay together: they take the same ways through a tree.
    How files are split is a setting of the session, so they are read in one of their own."""
    spark = train.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * -(-n // (cores * TASK_ROWS))
    keys = [c for c in ("user_id", "product_id") if c in train.columns]
    dealt = train.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys) if keys else train.repartition(tasks)
    materialize(_assemble(dealt).select(*ASSEMBLED), "assembled", written)
    whole_files = spark.newSession()
    for size in ("maxPartitionBytes", "openCostInBytes"):       # no file is split, no two are read together
        whole_files.conf.set(f"spark.sql.files.{size}", "1t")
    return whole_files.read.parquet(written[-1])


def fit_models(train: DataFrame, settings: ModelSettings | None = None) -> dict:
    """M6-M9: fit the four models on a labelled feature frame.

    The assembled vectors are written once and all four fits read them, side by
    side: a fit is a chain of some thousand short jobs, one for each level of
    each tree, that leaves the executors idle between them. From MANY_ROWS rows
    on a job keeps the executors busy, and what the fits cache no longer
    fits into memory together: then two run at a time, the boosted trees first,
    on rows dealt evenly to the cores, and the forest takes fewer nodes in a
    pass. pyspark.ml draws rows by task and features in the order of the
    passes, so the trees are those of other draws there. Boosting
    checkpoints its lineage every CHECKPOINT_ROUNDS trees in the shared
    checkpoint folder; a row's node is found by walking the few levels of the
    one tree in work, which is quicker than keeping node ids."""
    s = settings or ModelSettings()
    ensure_checkpoint_dir(train.sparkSession)
    written: list[str] = []
    train = train.withColumn("label", F.col("labels").cast("double"))
    n = train.count()
    many = n >= MANY_ROWS
    data = (_evenly(train, n, written) if many
            else materialize(_assemble(train).select(*ASSEMBLED), "assembled", written))
    # scikit-learn minimises 1/2|w|^2 + C * sum(loss); Spark mean(loss) + reg/2 |w|^2.
    lr = LogisticRegression(featuresCol="_lr_vec", labelCol="label", regParam=1.0 / (s.logistic_c * n),
                            elasticNetParam=0.0, standardization=False, maxIter=100)
    boosting = {"checkpointInterval": CHECKPOINT_ROUNDS, "maxMemoryInMB": 512}
    g1 = GBTClassifier(featuresCol="_tree_vec", labelCol="label", seed=s.seed, **boosting, **s.gbt_leafwise)
    g2 = GBTClassifier(featuresCol="_tree_vec", labelCol="label", seed=s.seed, **boosting, **s.gbt_depthwise)
    rf = RandomForestClassifier(featuresCol="_tree_vec", labelCol="label", seed=s.seed,
                                **({"maxMemoryInMB": FOREST_GROUP_MB} if many else {}), **s.forest)
    for est, tag in ((lr, "lr"), (g1, "g1"), (g2, "g2"), (rf, "rf")):
        est.setProbabilityCol(f"_p_{tag}").setRawPredictionCol(f"_r_{tag}").setPredictionCol(f"_y_{tag}")
    estimators = {"logistic": lr, "gbt_leafwise": g1, "gbt_depthwise": g2, "forest": rf}
    order = ["gbt_leafwise", "gbt_depthwise", "logistic", "forest"] if many else list(estimators)
    fit = inheritable_thread_target(train.sparkSession)(lambda e: e.fit(data))
    with ThreadPool(2 if many else len(order)) as pool:
        fitted = dict(zip(order, pool.map(fit, [estimators[name] for name in order], chunksize=1)))
    delete_paths(train.sparkSession, written)
    return {name: fitted[name] for name in estimators}


def score(models: dict, frame: DataFrame) -> DataFrame:
    """Add the four probabilities and their blend as ``pred``."""
    df = _assemble(frame)
    for name in ("logistic", "gbt_leafwise", "gbt_depthwise", "forest"):
        df = models[name].transform(df)
    probs = {"logistic": "_p_lr", "gbt_leafwise": "_p_g1", "gbt_depthwise": "_p_g2", "forest": "_p_rf"}
    cols = {name: vector_to_array(F.col(c))[1] for name, c in probs.items()}
    df = df.select(*frame.columns, *[cols[nm].alias(f"p_{nm}") for nm in probs])
    return df.withColumn("pred", E.blend({nm: F.col(f"p_{nm}") for nm in probs}))


def predictions_for_cut(scored: DataFrame) -> DataFrame:
    return scored.select("order_id", "product_id", "pred",
                         F.col("user_order_size_max").alias("prior_size_max"))


def test_recommendations(train: DataFrame, test: DataFrame, truth: DataFrame,
                         settings: ModelSettings | None = None, threshold: float = K.THRESHOLD) -> DataFrame:
    """Fit on the train frame, recommend for the test orders."""
    models = fit_models(train, settings)
    scores = predictions_for_cut(score(models, test))
    kept = materialize(E.cut_baskets(E.rank_predictions(scores), threshold), "kept_predictions")    # read twice below
    return E.recommendation_report(E.f1_by_order(kept, truth), kept, truth)


def split_users(frame: DataFrame, share: float = K.VALIDATION_TRAIN_SHARE, seed: int = K.SEED) -> DataFrame:
    """User-level split of a feature frame; floor(share·n) users train."""
    users = hash_split(frame.select("user_id").distinct(), ["user_id"], f"validation:{seed}", share,
                       "split", "train", "validation", rounding="floor")
    return frame.join(users, "user_id")


def validation_f1(frame: DataFrame, order_products: DataFrame, settings: ModelSettings | None = None,
                  threshold: float = K.THRESHOLD) -> DataFrame:
    """Q17: mean F1 on held-out users of the training frame."""
    split = split_users(frame)
    models = fit_models(split.filter(F.col("split") == "train").drop("split"), settings)
    val = split.filter(F.col("split") == "validation").drop("split")
    truth = order_products.join(val.select("order_id").distinct(), "order_id", "left_semi")
    per_order, _ = E.recommend(predictions_for_cut(score(models, val)), E.true_baskets(truth), threshold)
    return E.mean_f1(per_order)


def threshold_sweep(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Mean F1 of one set of scores at each threshold (threshold, mean_f1,
    n_orders), to tune the cut on the validation users. Predictions are
    ranked once; a prediction counts for every threshold below its score."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    ranked = E.rank_predictions(scores).where(F.col("pred_rank") < F.col("prior_size_max"))
    kept = ranked.select("order_id", "product_id", "pred_rank", "pred", at).where(
        (F.col("pred_rank") == 0) | (F.col("pred") > F.col("threshold")))
    hit = truth.select("order_id", "product_id", F.lit(1).alias("_hit"))
    n_true = truth.groupBy("order_id").agg(F.count(F.lit(1)).alias("_true"))
    per_order = (kept.join(hit, ["order_id", "product_id"], "left").groupBy("threshold", "order_id")
                 .agg(F.count(F.lit(1)).alias("_pred"), F.count("_hit").alias("_tp")).join(n_true, "order_id", "left"))
    f1 = F.coalesce(F.try_divide(F.col("_tp") * 2.0, F.col("_pred") + F.col("_true")), F.lit(0.0))
    return per_order.groupBy("threshold").agg(F.avg(f1).alias("mean_f1"), F.count(F.lit(1)).alias("n_orders"))
