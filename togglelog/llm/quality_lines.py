"""Quality rules: text statistics, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits to 0, words joined by one space) and hashed; for each
host the number of documents that hold a line is counted. Lines above the limits are boilerplate and
are removed; a document that keeps too little of its words is rejected, as is one that fails the
base rules.

Only hashes and lengths of lines are shuffled, each distinct line of a document once, with partial
counts before the shuffle; texts stay where they are read. Equal hashes (64 bits, within a host) stand
for equal lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from togglelog.llm.storage import texts_of, written
from togglelog.llm.words import as_long, gram_hashes, in_pieces, text_words, word_hashes

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
LINES = "array<struct<hash: long, words: int, lines: int>>"


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate on a host if more than `docs` documents there hold it, or if at least
    `share_docs` do and these are more than `share` (in thousandths) of the host's documents.
    A document is depleted if fewer than `left_words` words stay, or fewer than `left_percent` percent."""

    docs: int = 50
    share_docs: int = 10
    share: int = 50
    left_words: int = 50
    left_percent: int = 50


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def text_figures(text: str | None) -> tuple[dict[str, int], list[tuple[int, int, int]]]:
    """Statistics of a text, and its distinct normalised lines: (hash, words, times met)."""
    words = text_words(text)
    figures = {
        "n_words": len(words),
        "word_chars": 0 if text is None else len(text) - sum(map(text.count, " \t\n\v\f\r")),
        "n_symbols": 0 if text is None else len(_SYMBOLS.findall(text)),
        "n_dup_lines": 0,
        "n_repeat_words": repeat_words(text),
    }
    seen, lines = set(), {}
    for line in () if text is None else text.encode("utf-8", "surrogatepass").split(b"\n"):
        normal = normal_line(line)
        if normal:
            figures["n_dup_lines"] += line in seen
            seen.add(line)
            n, times = lines.get(normal, (0, 0))
            lines[normal] = (normal.count(b" ") + 1, times + 1)
    hashed = [(int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True), *v) for x, v in lines.items()]
    return figures, hashed


def repeat_words(text: str | None, window: int = 3) -> int:
    """Words covered by windows that are found twice or more in the text."""
    hashes = word_hashes(text)
    grams = gram_hashes(hashes, window)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(hashes), bool)
    for k in range(window):
        covered[at + k] = True
    return int(covered.sum())


def figures_writer() -> Callable:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1000):
            found = [text_figures(t) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *(len(x[1]) for x in found)], dtype=np.int32)
            flat = [line for x in found for line in x[1]]
            parts = zip(*flat) if flat else ((), (), ())
            kinds = (pa.int64(), pa.int32(), pa.int32())
            lines = pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ["hash", "words", "lines"])
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array([x[0][n] for x in found], pa.int64()) for n in names),
                    pa.ListArray.from_arrays(pa.array(ends), lines),
                ],
                ["doc_id", "host", *names, "lines"],
            )

    return write


def line_quality(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """One row for each row of docs (doc_id, text, the host column): statistics and verdicts.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with a
    word), n_removed_lines, n_left_words, removed_lines (hashes of normalised lines), kept.
    Each row counts as a document of its host, also one with a null or repeated doc_id; a null host
    is a host. A null or empty text has no words and fails the base rules. Other columns are ignored;
    an empty table gives an empty result.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")]
    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines " + LINES
    found = texts_of(docs).select(*columns).mapInArrow(figures_writer(), schema)
    # written with its row numbers, so that these hold however often the table is read
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "line-figures")
    lines = found.select("row", "host", F.inline("lines"))
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs"))
    often = counts.where(F.col("docs") >= min(limits.docs + 1, limits.share_docs))
    often = often.join(sizes.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).where(
        (F.col("docs") > limits.docs) | (1000 * F.col("docs") > limits.share * F.col("host_docs"))
    )
    often = often.select(F.col("host").alias("_host"), F.col("hash").alias("_hash"))
    removed = (
        lines.join(often, lines["host"].eqNullSafe(F.col("_host")) & (lines["hash"] == F.col("_hash")), "left_semi")
        .groupBy("row")
        .agg(
            F.sum("lines").alias("n_removed_lines"),
            F.sum(F.col("words").cast("long") * F.col("lines")).alias("removed_words"),
            F.collect_list("hash").alias("removed_lines"),
        )
    )
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = (left < limits.left_words) | (100 * left < limits.left_percent * F.col("n_words"))
    n_lines = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["lines"])
    return found.join(removed, "row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        n_lines.alias("n_lines"),
        F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"),
        left.alias("n_left_words"),
        F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
        (~base_failed & ~depleted).alias("kept"),
    )


def without_lines(text, removed_lines):
    """Column of texts without the lines whose hashes are given; other lines stay as they are."""

    def cut(texts, removed):
        import pandas as pd

        out = []
        for value, hashes in zip(texts, removed):
            gone = set(() if hashes is None else hashes)
            if value is not None and gone:
                lines = value.split("\n")
                value = "\n".join(
                    x
                    for x in lines
                    if int.from_bytes(blake2b(normal_line(x.encode("utf-8", "surrogatepass")), digest_size=8).digest(), "little", signed=True) not in gone
                )
            out.append(value)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(cut, "string")(text, removed_lines)
