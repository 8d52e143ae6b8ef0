"""What the operators share: inputs, written intermediates and packed columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LAST_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local session (tests) takes a temporary one;
    on a cluster that is an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="momentlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups_for(total_bytes: int, each: int = 8 << 20, least: int = 64) -> int:
    """How many hash groups keep a group at about ``each`` bytes; the number grows with the data."""
    return max(least, -(-int(total_bytes) // each))


def identified(docs: DataFrame) -> tuple[DataFrame, int]:
    """(did, rank, doc_id, text) of every row, and the bytes of all texts.

    ``did`` orders the documents; rows without doc_id come last. Rows that share a doc_id are ranked by their text, and
    rows equal in both are one document that is returned as often as it came. The ranking sorts texts, so it is only
    planned where the ids do repeat.
    """
    rows = docs.select("doc_id", "text").withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)))
    per_id = rows.groupBy("did").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total, most = per_id.agg(F.sum("bytes"), F.max("n")).first()
    if (most or 0) > 1:
        from pyspark.sql import Window

        order = Window.partitionBy("did").orderBy(F.col("text").asc_nulls_first())
        rows = rows.withColumn("rank", F.dense_rank().over(order) - 1)
    else:
        rows = rows.withColumn("rank", F.lit(0))
    return rows.select("did", F.col("rank").cast("long").alias("rank"), "doc_id", "text"), int(total or 0)


_FAST = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(_level: int = 4, **columns) -> bytes:
    """Columns of equal length as one compressed binary; sorted integers are stored as differences, texts at a level of zstd."""
    arrays = {}
    for k, v in columns.items():
        if isinstance(v, np.ndarray) and k.startswith("d_") and len(v):
            v = np.concatenate([v[:1], np.diff(v)])
        arrays[k] = v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v)
    table = pa.table(arrays)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", _level)) if "text" in arrays else _FAST) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(data) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def unpack(data) -> dict[str, np.ndarray]:
    table = unpack_table(data)
    out = {}
    for k in table.column_names:
        v = table[k].to_numpy()
        out[k] = np.cumsum(v) if k.startswith("d_") else v
    return out


_CODEC = pa.Codec("zstd", 1)


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Unsigned columns as one compressed binary without names: a byte of each number together, then the next byte."""
    head = np.array([len(columns), *[x for c in columns for x in (c.dtype.itemsize, len(c))]], np.uint32)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.dtype.itemsize).T).tobytes() for c in columns]
    return head.tobytes() + _CODEC.compress(b"".join(planes), asbytes=True)


def unpack_numbers(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    head = np.frombuffer(data, np.uint32, 2 * n, 4).reshape(-1, 2).astype(np.int64)
    raw = _CODEC.decompress(data[4 + 8 * n :], int((head[:, 0] * head[:, 1]).sum()), asbytes=True)
    out, at = [], 0
    for size, count in head.tolist():
        planes = np.frombuffer(raw, np.uint8, size * count, at).reshape(size, count)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").reshape(-1))
        at += size * count
    return out


def id_groups(did: np.ndarray, n: int) -> np.ndarray:
    from momentlens.llm.text import mix

    return (mix(did.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)


def split_by(groups: np.ndarray):
    """(group, row numbers) for each group that occurs; rows keep their order."""
    if not len(groups):
        return
    small = 0 <= int(groups.min()) and int(groups.max()) < 1 << 16
    order = np.argsort(groups.astype(np.uint16) if small else groups, kind="stable")  # 16 bits are sorted by digits
    ordered = groups[order]
    cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        yield int(groups[order[a]]), order[a:b]


def packed_documents(docs: DataFrame, n: int, level: int = 4) -> DataFrame:
    """(bucket, data): the identified documents, many to a compressed row, dealt by a hash of their id."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            did = table["did"].to_numpy()
            buckets, rows = [], []
            for g, at in split_by(id_groups(did, n)):
                part = table.take(pa.array(at))
                buckets.append(g)
                rows.append(pack(level, **{c: part[c] for c in part.column_names}))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "data"])

    return docs.mapInArrow(run, "bucket int, data binary")
