"""Sinks: named pipeline tables, feature frames, recommendations, metrics.

``publish_tables`` replaces a set of tables at once. The set is written to a
folder of its own; only when all of it is there does one rename put
the manifest in place that names the folder. Readers go by the manifest, so
they see the former set or the new one, and a job that dies on the way leaves
the former one as it was.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.session import delete_paths

MANIFEST = "MANIFEST.json"


def write_tables(tables: dict[str, DataFrame], out_dir: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Write each named table as Parquet under ``out_dir/<name>`` (A4, A5)."""
    partition_by = partition_by or {}
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{out_dir.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, out_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Read tables written by ``write_tables`` (A2, A3)."""
    return {n: spark.read.parquet(f"{out_dir.rstrip('/')}/{n}") for n in names}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, out_dir: str) -> dict | None:
    """The manifest under ``out_dir``; None where nothing is published."""
    jvm, path, fs = _file_system(spark, f"{out_dir.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def switch_manifest(spark: SparkSession, out_dir: str, manifest: dict) -> None:
    """Put ``manifest`` in place of the former one by one rename."""
    base = out_dir.rstrip("/")
    jvm, new, fs = _file_system(spark, f"{base}/.{MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{base}/{MANIFEST}")), how)


def publish_tables(tables: dict[str, DataFrame], out_dir: str, partition_by: dict[str, list[str]] | None = None,
                   keep: int = 2) -> str:
    """Write the tables as the new version of the set under ``out_dir`` and
    switch to it (A4, A5). The last ``keep`` published versions stay on disk,
    so that a reader of the one before can finish; older ones are deleted.
    Returns the version."""
    if not tables:
        raise ValueError("no table to publish")
    spark = next(iter(tables.values())).sparkSession
    base, version = out_dir.rstrip("/"), f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_tables(tables, f"{base}/versions/{version}", partition_by)
    former = read_manifest(spark, base)
    published = [version, *(former["published"] if former else [])]
    switch_manifest(spark, base, {"version": version, "tables": sorted(tables), "published": published[:max(1, keep)]})
    delete_paths(spark, [f"{base}/versions/{v}" for v in published[max(1, keep):]])
    return version


def read_published(spark: SparkSession, out_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the version last published under ``out_dir``."""
    manifest = read_manifest(spark, out_dir)
    if manifest is None:
        raise FileNotFoundError(f"nothing is published under {out_dir}")
    missing = sorted(set(names or []) - set(manifest["tables"]))
    if missing:
        raise KeyError(f"tables {missing} are not part of the published set")
    return read_tables(spark, f"{out_dir.rstrip('/')}/versions/{manifest['version']}", names or manifest["tables"])


def remove_unpublished(spark: SparkSession, out_dir: str) -> list[str]:
    """Delete what jobs left that died before they published; not to be run
    while another job is writing. Returns the versions removed."""
    base, manifest = out_dir.rstrip("/"), read_manifest(spark, out_dir)
    _, path, fs = _file_system(spark, f"{base}/versions")
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    left = sorted(set(found) - set(manifest["published"] if manifest else []))
    delete_paths(spark, [f"{base}/versions/{v}" for v in left])
    return left


def write_recommendations(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the per-order recommendation report (A6); list columns stay arrays."""
    report.write.mode("overwrite").format(fmt).save(path)


def metric_frame(spark: SparkSession, **values) -> DataFrame:
    """One-row frame of named scalar metrics."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
