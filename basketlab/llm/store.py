"""Stage tables of the operators, and the block form of a text table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import ROW_BYTES, row_blocks
from basketlab.session import materialize

CHUNK_SCHEMA = "chunk long, rows long, bytes long, body binary"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` as a written table of chunks: each row holds at most
    ``max_bytes`` of whole texts (ROW_BYTES more counted for each; a longer
    text is a chunk of its own) as one compressed Arrow stream with columns
    ``id`` and ``text``. A document is named by (chunk, position in it), also
    when ids repeat or are null. The table is written once, so every later
    pass sees the same chunks."""

    def build(batches):
        from pyspark import TaskContext
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq], pa.int64()), pa.array([t.num_rows], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([pack(t)], pa.binary())],
                ["chunk", "rows", "bytes", "body"])

        for b in batches:
            for x in row_blocks(b, "text", max_bytes):
                n = (pc.sum(pc.binary_length(x.column("text"))).as_py() or 0) + ROW_BYTES * x.num_rows
                if held and size + n > max_bytes:
                    yield emit()
                    seq, held, size = seq + 1, [], 0
                held.append(x)
                size += n
        if held:
            yield emit()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(plain.mapInArrow(build, CHUNK_SCHEMA), "chunks")


def binary_arrays(**arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed Arrow stream."""
    return pack(pa.table({k: pa.array(v) for k, v in arrays.items()}))


def to_arrays(body: bytes) -> dict[str, np.ndarray]:
    t = unpack(body)
    return {c: t.column(c).to_numpy() for c in t.column_names}


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], share: int = 10_000, count: str = "m") -> DataFrame:
    """``rows`` joined with the written table ``keys``, one row for each key,
    whose column ``count`` says how many of ``rows`` have it (left out of the
    result). A key with more than 1 / ``share`` of all those rows, of which
    there are fewer than ``share`` whatever the input, is broadcast, so its
    rows stay where they are; the others are joined by a shuffle, in which no
    key has more than that part."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * share > total
    hot = keys.where(often).drop(count)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(keys.where(~often).drop(count), on))
