"""Token count rollups kept up to date by signed deltas.

Totals by (source, lang, tokenizer_version) are sums, so a batch of changes only needs its own rows: an
insert counts +1, a delete -1, and a revised count is the new one minus the old one. A batch's deltas are
summed by key and written to a folder of its own; the folder's success marker is the commit. A
batch that comes again is left alone, and one that failed midway is overwritten, so each counts exactly
once however often it is sent. `compact` sums all batches into a new folder that remembers their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from togglelog.llm.packing import token_cache
from togglelog.llm.storage import texts_of
from togglelog.llm.words import kept

KEYS = ("source", "lang", "tokenizer_version")
# Committed batches have success markers; no batch_id of a caller has the first letter of a base's.
MARK, BASE = "mapreduce.fileoutputcommitter.marksuccessfuljobs", "@base-"
DELTAS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def count_tokens(docs: DataFrame, word_tokenizer: str, byte_ranks: str, pattern: str) -> DataFrame:
    """docs' source and lang with words, word_tokens and byte_tokens of their whole texts.

    `word_tokenizer` is the file of a tokenizer as `packing.TokenCache` takes it, `byte_ranks` one of byte-level ranks with
    the `pattern` that it splits texts by. No special token is added or recognised. A null text has none; halves of
    surrogate pairs count as question marks. One row for each of docs, in no order; other columns are left out.
    """

    def encoding():
        import base64

        import tiktoken

        with open(byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ranks = token_cache(word_tokenizer), kept(f"ranks:{byte_ranks}", encoding)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = ["" if t is None else t.encode("utf-8", "replace").decode() for t in texts]
            counts = (
                [len(t.encode().split()) for t in known],
                [len(ids) // 4 for ids in cache.encode(texts)],
                [len(ranks.encode_ordinary(t)) for t in known],
            )
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.record_batch(columns, ["source", "lang", "words", "word_tokens", "byte_tokens"])

    rows = texts_of(docs).select(*[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.mapInArrow(run, "source string, lang string, words long, word_tokens long, byte_tokens long")


def changes_to_deltas(changes: DataFrame) -> DataFrame:
    """Deltas of changes (source, lang, tokenizer_version, kind, tokens, old_tokens).

    kind: insert (+tokens), delete (-tokens) or revise (tokens - old_tokens, same document). Any other
    kind, a null kind included, is an error when the batch is written. Null counts are 0; null
    keys are keys of their own; equal rows count one by one; other columns are ignored.
    """
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("tokens", "old_tokens"))
    keyed = changes.select(
        *(F.col(k).cast("string").alias(k) for k in KEYS),
        sign.cast("long").alias("docs"),
        F.when(sign == 0, new - old).otherwise(sign * new).alias("tokens"),
    )
    return _summed(keyed)


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _hadoop_path(spark: SparkSession, path: str):
    """A path, and the file system that holds it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def is_committed(spark: SparkSession, path: str, batch_id: str) -> bool:
    marker, store = _hadoop_path(spark, f"{path}/batch={batch_id}/_SUCCESS")
    return store.exists(marker)


def apply_batch(spark: SparkSession, path: str, batch_id: str, changes: DataFrame) -> bool:
    """Commit a batch of changes to the rollup at `path`; False if it was committed before.

    One writer per batch_id at a time. Batches of different ids may be written in any order, or at once.
    """
    if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
        raise ValueError("a batch_id has letters, digits, '-', '_' and '.' only")
    if is_committed(spark, path, batch_id) or is_folded(spark, path, batch_id):
        return False
    deltas = changes_to_deltas(changes)
    deltas.write.mode("overwrite").option(MARK, "true").parquet(f"{path}/batch={batch_id}")
    return True


def is_folded(spark: SparkSession, path: str, batch_id: str) -> bool:
    marker, store = _hadoop_path(spark, f"{path}/folded/{batch_id}")
    return store.exists(marker)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed batches, as names."""
    top, store = _hadoop_path(spark, path)
    if not store.exists(top):
        return []
    names = sorted(f.getPath().getName() for f in store.listStatus(top))
    found = [n for n in names if n.startswith("batch=") and is_committed(spark, path, n.removeprefix("batch="))]
    if "folded" in names and not any(n.startswith(f"batch={BASE}") for n in found):
        raise RuntimeError(f"the compaction to {path} did not end; do it again")
    return found


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(source, lang, tokenizer_version, docs, tokens) over all committed batches; empty keys are left out."""
    names = committed(spark, path)
    if not names:
        return spark.createDataFrame([], DELTAS)
    deltas = spark.read.schema(DELTAS).parquet(*(f"{path}/{n}" for n in names))
    return _summed(deltas).where("docs <> 0 OR tokens <> 0")


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """Start a rollup at `new_path` with the totals of `path`; it knows the batches that it holds.

    The names of these are written first and the totals last, whose success marker is the commit: a
    rollup that has names without totals can't be read, and the compaction can be done again.
    """
    names = [n.removeprefix("batch=") for n in committed(spark, path)]
    top, store = _hadoop_path(spark, f"{path}/folded")
    names += [f.getPath().getName() for f in store.listStatus(top)] if store.exists(top) else []
    for name in names:
        marker, store = _hadoop_path(spark, f"{new_path}/folded/{name}")
        store.create(marker).close()
    base = totals(spark, path).write.mode("overwrite").option(MARK, "true")
    base.parquet(f"{new_path}/batch={BASE}{len(names)}")
