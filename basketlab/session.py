"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (pass as ``extra`` or in spark-defaults):
# many shuffle partitions that AQE coalesces to ~256 MB, skew splitting on,
# 256 MB input splits.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "basketlab", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster, pass no master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("BASKETLAB_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only a local-mode session with no setting (tests, laptops)
    gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="basketlab-ckpt-"))
    return sc.getCheckpointDir()


_WRITTEN: list[str] = []
_OWNERS: list[list[str]] = []
_TABLE = "table:"           # marks the name of a catalog table among the paths


@contextmanager
def owned_by(written: list[str]):
    """Tables that ``materialize`` writes inside, also those of operators
    called there, are appended to ``written``, so that their owner can delete
    them with ``delete_paths``."""
    _OWNERS.append(written)
    try:
        yield written
    finally:
        _OWNERS.pop()


def materialize(df, label: str = "stage", written: list[str] | None = None, codec: str | None = None):
    """Cut lineage: write ``df`` as Parquet under the checkpoint folder and
    read it back.

    Used at stage boundaries, where one table feeds several branches: later
    plans start from the written files (with column pruning and filter
    pushdown) instead of re-planning and recomputing the whole lineage. The
    folder is the cluster's shared checkpoint folder, so a lost executor
    never loses a finished stage. The path is appended to ``written`` (else to
    the list of the innermost ``owned_by``) so the owner can delete it with
    ``delete_paths``. ``codec``: Parquet compression, if not the session's.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _WRITTEN.append(path)
    if written is None and _OWNERS:
        written = _OWNERS[-1]
    if written is not None:
        written.append(path)
    return spark.read.parquet(path)


def materialize_by(df, key: str, buckets: int, label: str = "stage", written: list[str] | None = None):
    """``materialize`` with the rows dealt to ``buckets`` files by the hash of
    ``key`` and sorted by it. Two such tables of one number of buckets meet in
    a join on ``key``, and are grouped by it, without an exchange.

    Spark knows a table's buckets from its catalog only, so it is an external
    table there, under a name of its own, which ``delete_paths`` drops."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet")
     .saveAsTable(name))
    if written is None and _OWNERS:
        written = _OWNERS[-1]
    for owner in (_WRITTEN, *([] if written is None else [written])):
        owner += [f"{_TABLE}{name}", path]
    return spark.table(name)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete written stage tables (recursively) through Hadoop's FileSystem,
    and their names from the catalog where they have one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in list(paths):
        if p.startswith(_TABLE):
            spark.sql(f"DROP TABLE IF EXISTS {p[len(_TABLE):]}")
            if paths is not _WRITTEN and p in _WRITTEN:
                _WRITTEN.remove(p)
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if paths is not _WRITTEN and p in _WRITTEN:
            _WRITTEN.remove(p)
    paths.clear()


def file_listing(spark: SparkSession, path: str) -> tuple:
    """(path, size, time of change) of every file under ``path``, from its
    own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


_RELEASES = [0]


def release_count() -> int:
    """How often ``release_all`` ran in this process."""
    return _RELEASES[0]


def release_all(spark: SparkSession) -> None:
    """Delete every table ``materialize`` wrote in this process (stage,
    index and heavy-group tables). Frames built on them become unusable."""
    delete_paths(spark, _WRITTEN)
    _RELEASES[0] += 1
