"""Shared steps of the operators that move whole blocks of sorted keys: packed rows, reliable cuts of lineage.

A block is a run of documents that one task reads together. Its distinct keys go to buckets by their
top bits, one packed row per (block, bucket) instead of one row per key, so a very frequent key
costs each block one entry. Answers come back to the block in the order of its sorted keys. What
only the block itself needs again travels on beside them under a negative slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text import by_size, give_back, lean, lean_group, small_batches

BLOCK_CHARS = 6 << 20
ROW_GROUP_BYTES = 16 << 20
FIELDS = 6
ROW = "slot int, block long, part int, " + ", ".join(f"f{i} binary" for i in range(FIELDS))
COLUMNS = ["slot", "block", "part", *[f"f{i}" for i in range(FIELDS)]]


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir as the cluster names it; only where none is set (tests, one
    machine) a folder under this session's warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", "")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def settled(frame: DataFrame) -> DataFrame:
    """The frame computed once, read again from files in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


BROADCAST_ROWS = 200_000


def with_keys(docs: DataFrame, keys: DataFrame, how: str, **on: Column) -> DataFrame:
    """left_semi or left_anti join of documents with narrow, settled rows of keys (column name: document's
    expression), nulls equal. Up to BROADCAST_ROWS keys are broadcast; more are joined by shuffle."""
    keys = keys.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(on)])
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    condition = None
    for i, column in enumerate(on.values()):
        part = column.eqNullSafe(keys[f"_key_{i}"])
        condition = part if condition is None else condition & part
    return docs.join(keys, condition, how)


def pack(values: np.ndarray) -> bytes:
    """An array compressed, byte planes apart."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences."""
    steps = keys.astype(np.uint64)
    steps[1:] -= keys[:-1].astype(np.uint64)
    return pack(steps)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 by the top 32 bits; ascending keys have ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split_points(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins among sorted keys, and the end."""
    return np.searchsorted(bucket_of(sorted_keys, n), np.arange(n + 1))


def buckets_for(docs: DataFrame, per_bucket: int) -> int:
    """One bucket per `per_bucket` bytes of text, at least the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per_bucket))


def row(slot: int, block: int, part: int, *fields: bytes) -> tuple:
    return (slot, block, part, *fields, *[None] * (FIELDS - len(fields)))


def own_row(n: int, block: int, *fields: bytes) -> tuple:
    """A row that the buckets hand on unread, for the block itself."""
    return row(-1 - block % n, block, -1, *fields)


def blocks(docs: DataFrame, make: Callable[[int, list, list], Iterator[tuple]], *extra: str,
           chars: int = BLOCK_CHARS) -> DataFrame:
    """make(block number, ids, texts, ...) -> rows, over blocks of about `chars` characters.

    Block numbers hold the task's partition number, so a task that runs again makes the same blocks.
    """
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch[c].to_numpy(dtype=object) for c in batch.columns), strict=True)

        for i, group in enumerate(by_size(rows(), lambda r: len(r[1]) if isinstance(r[1], str) else 0, chars)):
            ids = [None if r[0] is None or r[0] != r[0] else int(r[0]) for r in group]
            texts = [r[1] if isinstance(r[1], str) else None for r in group]
            others = [[r[k] for r in group] for k in range(2, 2 + len(extra))]
            made = list(make(first + i, ids, texts, *others))
            yield pd.DataFrame(made, columns=COLUMNS)
            del group, ids, texts, others, made
            give_back()

    small_batches(docs)
    return docs.select(F.col("doc_id").cast("string").alias("i"), F.col("text").alias("t"), *extra).mapInPandas(run, ROW)


def at_buckets(frame: DataFrame, answer: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """answer(rows of one bucket) -> the fields of each row's answer, in the same order."""
    @lean_group
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["slot"].iloc[0] < 0:
            return rows
        asked = list(rows[COLUMNS[3:]].itertuples(index=False, name=None))
        out = [row(s, b, p, *fields) for s, b, p, fields in zip(
            rows["slot"], rows["block"], rows["part"], answer(asked), strict=True)]
        return pd.DataFrame(out, columns=COLUMNS)

    return frame.groupBy("slot").applyInPandas(run, ROW)


def at_blocks(frame: DataFrame, finish: Callable[[tuple, list[tuple]], pd.DataFrame], schema: str) -> DataFrame:
    """finish(the block's own fields, the answers' fields in bucket order) -> result rows."""
    @lean_group
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        fields = list(rows[COLUMNS[3:]].itertuples(index=False, name=None))
        return finish(fields[0], fields[1:])

    return frame.groupBy("block").applyInPandas(run, schema)


def id_array(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids as 64-bit integers and which of them are null."""
    null = np.array([i is None for i in ids], dtype=bool)
    return np.array([0 if i is None else i for i in ids], dtype=np.int64), null


def written(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read again: columns that a later pass does
    not use are not read by it. The files live as long as the folder, like checkpoints."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # Small row groups: a writer holds one in memory, and rows may be packed blocks of megabytes.
    frame.write.options(**options).option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
