"""Removal of repeated passages by seed and extend.

A passage is repeated when a window of `window` consecutive words starts at two or more places, in
one document or in several. Every word that such a window covers is removed, at all its places.

- Seeds. Each window is anchored on its smallest hashed run of `seed` words (winnowing, leftmost of
  equals). Equal windows have equal anchors at equal places, so joining on anchors loses none. The
  windows that share one anchor occurrence are consecutive.
- Whole extension. An anchor occurrence carries a hash of all words its windows cover, from the start
  of the first to the end of the last. Occurrences with the same anchor and the same hash match both
  ways as far as their windows reach: all their windows are repeated.
- Partial extension. Where the same anchor occurs with other surroundings (the ends of a passage), one
  occurrence of each kind is extended word by word: its windows are hashed and met one by one.
- Maximal repeats. The repeated windows of a document are merged; the longest runs remain.

Occurrences are counted with partial sums before they are shuffled, and never listed by group: the
work for n copies of a passage grows with n. Hash equality (128 bits: anchor and surroundings, or two
hashes of a window) stands for word equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from togglelog.llm.storage import as_row, from_row, texts_of, written
from togglelog.llm.words import as_long, gram_hashes, in_pieces, mixed, span_hashes, text_words, word_hashes

SEED_WORDS = 12


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = SEED_WORDS) -> DataFrame:
    """docs with n_words, n_removed, spans (array of repeated word ranges) and kept_text.

    kept_text has the kept words joined by one space. A null text has no words and an empty kept_text;
    texts with fewer than `window` words lose none. Rows are told apart by (doc_id, text), nulls
    included, and a row that is there twice repeats itself. Other columns are passed on; those named
    like a new column are replaced. An empty table gives an empty result.
    """
    if not 0 < seed <= window:
        raise ValueError("seed must have 1 to `window` words")
    spans = repeated_spans(texts_of(docs), window, seed)
    made = ("n_words", "n_removed", "spans", "kept_text")
    rest = [c for c in docs.columns if c not in made]
    keyed = _keyed(docs.select(as_row(rest), "doc_id", "text"), ["row", "doc_id", "text"])
    joined = keyed.join(
        spans.withColumnsRenamed({"doc_id": "span_doc", "text_crc": "span_crc"}),
        keyed["doc_id"].eqNullSafe(F.col("span_doc")) & (keyed["text_crc"] == F.col("span_crc")),
        "left",
    ).select("row", "text", "spans")
    cut = F.pandas_udf(cut_words, "n_words long, n_removed long, kept_text string")
    return joined.withColumn("cut", cut("text", "spans")).select(*from_row(rest), "spans", "cut.*")


def repeated_spans(docs: DataFrame, window: int = 35, seed: int = SEED_WORDS) -> DataFrame:
    """(doc_id, text_crc, spans): the merged ranges [start, end) of repeated windows, in words."""
    keyed = _keyed(docs, ["doc_id", "text"])
    found = keyed.mapInArrow(
        seed_writer(window, seed), "doc_id long, text_crc long, seed long, around long, first int, last int"
    )
    repeated = found.groupBy("seed").count().where("count > 1").select("seed")
    found = written(found.join(repeated, "seed", "left_semi"), "anchors")
    place = F.struct("doc_id", "text_crc", "first", "last")
    kinds = found.groupBy("seed", "around").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    kinds = written(kinds, "kinds")
    # whole extension
    whole = found.join(kinds.where("n > 1").select("seed", "around"), ["seed", "around"], "left_semi")
    whole = whole.select("doc_id", "text_crc", "first", "last")
    # partial extension
    mixed_seeds = kinds.groupBy("seed").count().where("count > 1").select("seed")
    part = kinds.join(mixed_seeds, "seed", "left_semi").select("place.*", (F.col("n") == 1).alias("open"))
    part = part.groupBy("doc_id", "text_crc").agg(F.collect_list(F.struct("first", "last", "open")).alias("parts"))
    part = part.withColumnsRenamed({"doc_id": "part_doc", "text_crc": "part_crc"})
    on = keyed["doc_id"].eqNullSafe(F.col("part_doc")) & (keyed["text_crc"] == F.col("part_crc"))
    # one of the rows that are equal in all: their windows are counted once by `place`
    texts = keyed.join(part, on).select(keyed["doc_id"], "text_crc", "text", "parts").dropDuplicates(["doc_id", "text_crc"])
    windows = texts.mapInArrow(
        window_writer(window), "doc_id long, text_crc long, a long, b long, first int, open boolean"
    )
    windows = written(windows, "windows")
    met = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open"))
    met = met.where("n > 1 AND open").select("a", "b")
    single = windows.where("open").join(met, ["a", "b"], "left_semi")
    single = single.select("doc_id", "text_crc", "first", F.col("first").alias("last"))
    # maximal repeats
    starts = whole.union(single).groupBy("doc_id", "text_crc").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("s"))
    merge = F.pandas_udf(merged_spans(window), "array<struct<start: int, stop: int>>")
    return starts.select("doc_id", "text_crc", merge("s").alias("spans"))


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return docs.select(*columns, F.coalesce(F.crc32("text"), F.lit(-1).cast("long")).alias("text_crc"))


def anchors(word_hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and the last window of each."""
    reach = window - seed + 1
    grams = gram_hashes(word_hashes, seed)
    if len(grams) < reach:
        return (np.empty(0, np.int64),) * 3
    starts = np.arange(len(grams) - reach + 1)
    place = starts + np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, starts[-1:]))
    return place[first], first, last


def seed_writer(window: int, seed: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1000):
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                hashes = word_hashes(text)
                place, first, last = anchors(hashes, window, seed)
                if len(place):
                    grams = gram_hashes(hashes, seed)[place]
                    # the anchor's place in the span is part of what must agree
                    around = mixed(span_hashes(hashes, first, last + window) ^ (place - first).astype(np.uint64))
                    out.append((np.full(len(place), row), grams, around, first, last))
            if out:
                row, grams, around, first, last = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(row)),
                        batch.column(2).take(pa.array(row)),
                        pa.array(as_long(grams)),
                        pa.array(as_long(around)),
                        pa.array(first.astype(np.int32)),
                        pa.array(last.astype(np.int32)),
                    ],
                    ["doc_id", "text_crc", "seed", "around", "first", "last"],
                )

    return write


def window_writer(window: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1000):
            out = []
            for row, (text, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                hashes = word_hashes(text)
                first = np.concatenate([np.arange(p["first"], p["last"] + 1) for p in parts])
                is_open = np.concatenate([np.full(p["last"] + 1 - p["first"], p["open"]) for p in parts])
                a = gram_hashes(hashes, window)[first]
                b = gram_hashes(mixed(hashes), window)[first]
                out.append((np.full(len(first), row), a, b, first, is_open))
            if out:
                row, a, b, first, is_open = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(row)),
                        batch.column(1).take(pa.array(row)),
                        pa.array(as_long(a)),
                        pa.array(as_long(b)),
                        pa.array(first.astype(np.int32)),
                        pa.array(is_open),
                    ],
                    ["doc_id", "text_crc", "a", "b", "first", "open"],
                )

    return write


def merged_spans(window: int) -> Callable:
    import pandas as pd

    def merge(starts):
        out = []
        for row in starts:
            spans: list[dict] = []
            for x in row:
                if spans and x["first"] <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], x["last"] + window)
                else:
                    spans.append({"start": x["first"], "stop": x["last"] + window})
            out.append(spans)
        return pd.Series(out)

    return merge


def cut_words(texts, spans):
    import pandas as pd

    out = []
    for text, row in zip(texts, spans):
        words = text_words(text)
        kept, at, removed = [], 0, 0
        for x in row if row is not None else ():
            kept += words[at : x["start"]]
            removed += x["stop"] - x["start"]
            at = x["stop"]
        kept += words[at:]
        out.append((len(words), removed, b" ".join(kept).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])
