"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

1. Texts are tokenised; each task cuts the ids it makes into sequences of equal length and numbers them.
   They are written once, so that numbers hold; counts by task make the numbers global.
2. A keyed Feistel permutation of the next power of four, walked until it falls below the number of
   sequences, gives each sequence its slot: no sort by random keys and no table of the order.
3. Sequences are partitioned by ranges of slots, one for each shard, and written by Spark's own committer, one file per
   shard. A record is the sequence's ids (little-endian, 2 bytes each) and one end byte, so slot s is
   record s % shard_records of shard s // shard_records, at a known byte: readers start anywhere, read
   on in order, and go on from a slot number alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from togglelog.llm.packing import token_cache
from togglelog.llm.storage import texts_of, written
from togglelog.llm.words import mixed

SEQUENCE = 2048
SHARD_RECORDS = 4096
ROUNDS = 6


def feistel_slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 that the key chooses, at the given places."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        x = (left << half) | right
        out[walking] = x
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def sequence_writer(tokenizer_path: str, end_id: int, pad_id: int, length: int) -> Callable:
    names = ["part", "number", "ids", "n_tokens", "first_doc", "n_docs", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, width = token_cache(tokenizer_path), 2 * length
        end = np.array([end_id], "<u2").tobytes()
        rest, docs, number, part = b"", [], 0, 0

        def rows(found: list) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32())
            columns = [pa.array(x, t) for x, t in zip(zip(*found), kinds)]
            return pa.record_batch([*columns, pa.array([crc32(x[2]) for x in found], pa.int64())], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, out = batch.slice(at, 500), []
                part = some.column(2)[0].as_py()
                for doc, ids in zip(some.column(0).to_pylist(), cache.encode(some.column(1).to_pylist())):
                    data = np.frombuffer(ids, "<u4")
                    if len(data) and int(data.max()) > 0xFFFF:
                        raise ValueError("an id needs more than 2 bytes")
                    data = rest + data.astype("<u2").tobytes() + end
                    docs.append(doc)
                    full = len(data) // width
                    for i in range(full):
                        out.append((part, number, data[i * width : (i + 1) * width], length, docs[0], len(docs)))
                        number, docs = number + 1, [doc]
                    rest = data[full * width :]
                    if not rest:
                        docs = []
                if out:
                    yield rows(out)
        if rest:
            pad = np.full(length - len(rest) // 2, pad_id, "<u2").tobytes()
            yield rows([(part, number, rest + pad, len(rest) // 2, docs[0], len(docs))])

    return run


def materialise(
    docs: DataFrame, path: str, tokenizer_path: str, key: int, end_id: int = 1, pad_id: int = 0,
    length: int = SEQUENCE, shard_records: int = SHARD_RECORDS,
) -> DataFrame:
    """Write docs (doc_id, text) as shards below `path`; returns the table of their sequences.

    slot, shard, offset (bytes in the shard's file), n_tokens (padding left out), first_doc (the
    document of the first id), n_docs, ids_crc32 (of the record without its end byte). A null or empty
    text is `end_id` alone; repeated rows are written as often as they come; a null doc_id stays null.
    Other columns are ignored. An empty table writes no shard and gives an empty result.
    """
    numbered = texts_of(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part")
    ).mapInArrow(
        sequence_writer(tokenizer_path, end_id, pad_id, length),
        "part int, number long, ids binary, n_tokens int, first_doc long, n_docs int, ids_crc32 long",
    )
    numbered = written(numbered, "sequences", compression="zstd")
    counts = numbered.groupBy("part").count().orderBy("part").toPandas()  # one row for each task
    total = int(counts["count"].sum())
    first = counts["count"].cumsum() - counts["count"]
    before = docs.sparkSession.createDataFrame(
        [(int(p), int(n)) for p, n in zip(counts["part"], first)], "part int, before long"
    )
    # one row for each task that read texts, which the driver has at hand
    ordered = numbered.join(F.broadcast(before), "part").withColumn("slot", slot_of(F.col("before") + F.col("number"), total, key))
    ordered = ordered.withColumn("shard", F.floor(F.col("slot") / shard_records))
    partitions = max(1, -(-total // shard_records))
    # a shard's number is its partition's: nothing to sample, one task a shard
    shards = ordered.select("shard", "slot", "ids").repartitionById(partitions, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    record = F.col("ids").cast("string").alias("value")  # bytes as they are; the writer doesn't decode them
    shards.select("shard", record).write.partitionBy("shard").text(path, compression="none", lineSep="\n")
    return ordered.select(
        "slot",
        "shard",
        (F.pmod("slot", F.lit(shard_records)) * stride(length)).alias("offset"),
        "n_tokens",
        "first_doc",
        "n_docs",
        "ids_crc32",
    )


def stride(length: int) -> int:
    """Bytes of a record."""
    return 2 * length + 1


def slot_of(index: Column, total: int, key: int) -> Column:
    def slots(values):
        import pandas as pd

        return pd.Series(feistel_slots(values.to_numpy(), total, key))

    return F.pandas_udf(slots, "long")(index)


def read_slots(
    spark: SparkSession, path: str, start: int, stop: int, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS
) -> DataFrame:
    """(slot, ids): the sequences from slot `start` to before `stop`; reads only their shards."""
    if stop <= start:
        return spark.createDataFrame([], "slot long, ids array<int>")
    shards = range(start // shard_records, (stop - 1) // shard_records + 1)
    files = spark.read.format("binaryFile").load([f"{path}/shard={s}" for s in shards])
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * length + 1
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = number * shard_records
                slots = [s for s in range(max(start, base), min(stop, base + len(data) // width))]
                ids = [np.frombuffer(data, "<u2", length, (s - base) * width).astype(np.int32) for s in slots]
                yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["slot", "ids"])

    return files.select(shard.alias("shard"), "content").mapInArrow(cut, "slot long, ids array<int>").orderBy("slot")
