"""Hard-negative mining with Fagin's threshold algorithm over exact integer scores.

A row's components become floor(256 * x); its score for an anchor is their integer inner product. Rows
are dealt into blocks by a hash, and every block keeps one list of its rows for each dimension, sorted by
that component. An anchor reads the lists side by side, from the high end where its own component is positive
and from the low end where it is negative (where it is zero the list can't matter), and scores each row it
meets for the first time in full. The threshold, the anchor's product with the components last read, bounds
the scores of all rows not met yet; reading stops when it lies strictly below the kth score found, so that
rows with an equal score and a smaller id can't be missed.

Two searches of that kind run one after the other: an anchor's positives among the rows of its label, and
then, under the scores of these, its negatives among the others, in one window of scores for each
positive. The blocks' few best rows meet in a ranking for each anchor.

Rows equal in label and vector are one entry of a list and stand for as many ids as a search could return.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from togglelog.llm.storage import written

SCALE = 256
# Entries of a block at most about this many, and of small tables about LEAST_BLOCK, so that cores are busy.
BLOCK_ENTRIES = 16_384
LEAST_BLOCK = 2_048
BATCH_ANCHORS = 2_048
# Rows read from each list in the first step; every step doubles the depth.
FIRST_DEPTH = 16
# A window reaches from LOW/HIGH of the positive's score to the score itself.
LOW, HIGH = 80, 100
LONG = 2**63 - 1
# Doubles hold all integers up to this; a block that counts in doubles has no score that comes near.
EXACT = 2**53
# What a block finds for an anchor, which is told by its row: ids may repeat. Scores of any size as `sortable` bytes.
FOUND = "row long, anchor_id long, target binary, vec_id long, score binary, as_long long"


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def sortable(x: int) -> bytes:
    """An integer of any size as bytes that have its order."""
    size = (abs(x).bit_length() + 7) // 8
    if x < 0:
        return (2**15 - size).to_bytes(2) + (256**size - 1 + x).to_bytes(size)
    return (2**15 + size).to_bytes(2) + x.to_bytes(size)


def unsorted(data: bytes) -> int:
    """The integer again."""
    x = int.from_bytes(data[2:])
    return x if data[0] >> 7 else x + 1 - 256 ** (len(data) - 2)


def mine(
    rows: DataFrame, anchors: Column, k: int = 5, positives: int = 5,
    block_entries: int = BLOCK_ENTRIES, batch_anchors: int = BATCH_ANCHORS, least_block: int = LEAST_BLOCK,
    every_row: bool = False,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, embedding, label).

    `anchors` is a condition on vec_id that says which rows are anchors. An anchor's positives are its first
    `positives` other rows of the same label, by higher score, then smaller vec_id; for each of them come
    the first `k` rows of other labels, in that order, whose score is from 80 % to 100 % of the positive's. Rows with a
    null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows with the
    same vec_id the one with the smallest (label, vector) counts. With `every_row` each of them counts, for itself and
    for the others, and so do rows with a null vec_id, which come last among equal scores. Vectors of different lengths
    meet as if the shorter one were filled up with zeros; an empty one scores 0. Scores outside the range of a long are
    ordered exactly and reported as its nearest end. Other columns are ignored; an empty table gives an empty result.
    """
    whole = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector")
    ).where(F.col("label").isNotNull() & usable(F.col("vector")))
    if not every_row:
        whole = whole.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least"))
        whole = whole.select("vec_id", "least.label", "least.vector")
    # written, and so a row keeps its number
    one = written(whole.select("*", anchors.alias("asks"), F.monotonically_increasing_id().alias("row")), "anchored")

    # No search returns more ids of equal rows than these; the limit of the rank cuts them before the shuffle.
    most, by_id = max(k, positives) + 1, F.col("vec_id").asc_nulls_last()
    rank = F.row_number().over(Window.partitionBy("label", "vector").orderBy(by_id))
    first = one.withColumn("rank", rank).where(F.col("rank") <= most)
    entries = first.groupBy("label", "vector").agg(F.collect_list(F.struct("vec_id", "row")).alias("all"))
    entries = entries.select("label", "vector", F.col("all.vec_id").alias("ids"), F.col("all.row").alias("rows"))
    entries = written(entries.withColumn("h", F.xxhash64(F.array_min("rows"))), "entries")
    asking = one.where("asks").select("row", "vec_id", "label", "vector", F.xxhash64("row").alias("h"))
    n_entries, n_anchors = entries.count(), asking.count()
    blocks = max(-(-n_entries // block_entries), min(32, -(-n_entries // least_block)), 1)
    batches = max(1, -(-n_anchors // batch_anchors))
    deal = (entries, blocks, batches)

    score = F.col("score")
    best = Window.partitionBy("row").orderBy(score.desc(), by_id)
    found = _search(*deal, asking.withColumn("targets", F.lit(None).cast("array<binary>")), positives_of(positives))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    names = {"vec_id": "positive_id", "score": "positive", "as_long": "positive_score"}
    found = written(found.drop("rank", "target").withColumnsRenamed(names), "positives")

    # a window of scores is above zero or at zero, never below
    targets = found.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("positive")).alias("targets"))
    negatives = _search(*deal, asking.join(targets, "row"), negatives_of(k))
    best = Window.partitionBy("row", "target").orderBy(score.desc(), by_id)
    negatives = negatives.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    same = (found["row"] == negatives["row"]) & (found["positive"] == negatives["target"])
    return found.join(negatives, same).select(
        found["anchor_id"], "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("as_long").alias("negative_score"),
    )


def _search(entries: DataFrame, blocks: int, batches: int, asking: DataFrame, search: Callable) -> DataFrame:
    """What each block has for each anchor (FOUND). Anchors meet blocks batch by batch."""

    # One type on both sides: a cogroup doesn't make keys alike, and an int and a long hash to different partitions.
    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod("h", F.lit(n)).cast("int")

    listed = entries.select(dealt(blocks).alias("block"), spread(batches).alias("batch"), "label", "vector", "ids", "rows")
    asked = asking.select(
        spread(blocks).alias("block"), dealt(batches).alias("batch"), "row", "vec_id", F.col("label").alias("own"),
        F.col("vector").alias("anchor"), "targets",
    )
    keys = ["block", "batch"]
    met = listed.groupBy(*keys).cogroup(asked.groupBy(*keys))
    return met.applyInArrow(search, FOUND)


class Lists:
    """Entries of one block, with the order of each dimension. Their ids are any values that sort; rows are told apart by them."""

    def __init__(self, data: np.ndarray, labels: np.ndarray, ids: list[list]):
        self.data, self.labels, self.ids = data, labels, ids
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.orders = np.argsort(data, axis=0, kind="stable").astype(np.int32)

    def part(self, rows: np.ndarray) -> Lists:
        return Lists(self.data[rows], self.labels[rows], [self.ids[i] for i in rows.tolist()])

    def read(self, anchor: np.ndarray, enough: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Rows met and their scores, read until enough(rows, scores, threshold) or until all are met."""
        n = len(self.data)
        dims = np.flatnonzero(anchor != 0)
        if not len(dims):  # all scores are zero
            return np.arange(n), self.data @ anchor
        up = anchor[dims] > 0
        met, depth, step = np.zeros(n, bool), 0, FIRST_DEPTH
        rows, scores = np.empty(0, np.int64), np.empty(0, self.data.dtype)
        while depth < n:
            end = min(n, depth + step)
            read = np.concatenate((self.orders[n - end : n - depth, dims[up]].ravel(), self.orders[depth:end, dims[~up]].ravel()))
            new = np.zeros(n, bool)
            new[read] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self.data[new] @ anchor))
            last = np.where(up, self.orders[n - end, dims], self.orders[end - 1, dims])
            threshold = (self.data[last, dims] * anchor[dims]).sum()
            depth, step = end, end
            if len(rows) == n or enough(rows, scores, threshold):
                break
        return rows, scores

    def kth(self, rows: np.ndarray, scores: np.ndarray, k: int):
        """The score of the kth of these rows' ids; None if there are fewer."""
        if self.sizes[rows].sum() < k:
            return None
        top = np.argsort(-scores, kind="stable")[:k] if len(scores) <= 64 else _top(scores, k)
        return scores[top[np.searchsorted(np.cumsum(self.sizes[rows[top]]), k)]]

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int, but: tuple) -> list[tuple[int, tuple]]:
        """(score, id) of the first k ids by score, then id, without the id `but`."""
        kth = self.kth(rows, scores, k + 1)
        if kth is not None:
            rows, scores = rows[scores >= kth], scores[scores >= kth]
        found = [(-int(s), i) for r, s in zip(rows.tolist(), scores.tolist()) for i in self.ids[r] if i != but]
        return [(-s, i) for s, i in sorted(found)[:k]]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    some = np.argpartition(-scores, k)[:k]
    return some[np.argsort(-scores[some], kind="stable")]


def integers(vectors: list[np.ndarray], width: int, exact: bool) -> np.ndarray:
    """floor(256 * x) of vectors, filled up with zeros; as Python integers where doubles aren't exact."""
    out = np.zeros((len(vectors), width), object if exact else np.float64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = [_whole(v) for v in x.tolist()] if exact else np.floor(SCALE * x)
    return out


def _whole(x: float) -> int:
    top, bottom = x.as_integer_ratio()
    return SCALE * top // bottom


def _block(entries: pa.Table, asked: pa.Table) -> tuple[Lists, np.ndarray]:
    """The lists of a block and the anchors' vectors, in numbers whose products and sums are exact."""
    sides = [[np.array(x, np.float64) for x in t.column(c).to_pylist()] for t, c in ((entries, "vector"), (asked, "anchor"))]
    width = max((len(x) for side in sides for x in side), default=0)
    largest = max((float(np.abs(x).max()) for side in sides for x in side if len(x)), default=0.0)
    # products, sums and hundredfold sums below 2**53 are exact in doubles
    exact = not SCALE * largest + 1 < (EXACT / (HIGH * max(width, 1))) ** 0.5
    data, anchors = (integers(side, width, exact) for side in sides)
    labels = np.array(entries.column("label").to_pylist(), object)
    ids = [list(map(_id, *x)) for x in zip(entries.column("ids").to_pylist(), entries.column("rows").to_pylist())]
    return Lists(data, labels, ids), anchors


def _id(vec_id: int | None, row: int) -> tuple[bool, int, int]:
    """A row's place among equal scores: null ids last."""
    return vec_id is None, vec_id or 0, row


def _rows(found: list[tuple[tuple, int | None, int, tuple]]) -> pa.Table:
    """FOUND of (anchor's id, target, score, id)."""

    def vec_id(x: tuple) -> int | None:
        return None if x[0] else x[1]

    columns = [
        pa.array([a[2] for a, *_ in found], pa.int64()),
        pa.array([vec_id(a) for a, *_ in found], pa.int64()),
        pa.array([None if t is None else sortable(t) for _, t, _, _ in found], pa.binary()),
        pa.array([vec_id(i) for *_, i in found], pa.int64()),
        pa.array([sortable(s) for _, _, s, _ in found], pa.binary()),
        pa.array([max(-LONG - 1, min(LONG, s)) for _, _, s, _ in found], pa.int64()),
    ]
    return pa.table(columns, [x.split()[0] for x in FOUND.split(", ")])


def _own(asked: pa.Table) -> list[tuple]:
    return list(map(_id, asked.column("vec_id").to_pylist(), asked.column("row").to_pylist()))


def positives_of(k: int) -> Callable:
    """Search a block for the first k other rows with each anchor's label."""

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        if not (entries.num_rows and asked.num_rows):
            return _rows([])
        lists, anchors = _block(entries, asked)
        parts: dict = {}
        found = []
        for anchor, own_id, label in zip(anchors, _own(asked), asked.column("own").to_pylist()):
            if label not in parts:
                parts[label] = lists.part(np.flatnonzero(lists.labels == label))
            part = parts[label]

            def enough(rows, scores, threshold) -> bool:
                kth = part.kth(rows, scores, k + 1)  # one of them may be the anchor itself
                return kth is not None and threshold < kth

            found += [(own_id, None, s, i) for s, i in part.first(*part.read(anchor, enough), k, own_id)]
        return _rows(found)

    return run


def negatives_of(k: int) -> Callable:
    """Search a block for the first k rows with another label in each window of an anchor."""

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        if not (entries.num_rows and asked.num_rows):
            return _rows([])
        lists, anchors = _block(entries, asked)
        columns = (asked.column(c).to_pylist() for c in ("own", "targets"))
        found = []
        for anchor, own_id, label, targets in zip(anchors, _own(asked), *columns):
            other, targets = lists.labels != label, list(map(unsorted, targets))
            bounds = targets if anchors.dtype == object else [min(t, EXACT) for t in targets]

            def inside(rows, scores, target) -> tuple[np.ndarray, np.ndarray]:
                some = other[rows] & (HIGH * scores >= LOW * target) & (scores <= target)
                return rows[some], scores[some]

            def done(rows, scores, threshold, target) -> bool:
                if HIGH * threshold < LOW * target:
                    return True  # all rows not met lie below the window
                kth = lists.kth(*inside(rows, scores, target), k)
                return kth is not None and threshold < kth

            def enough(rows, scores, threshold) -> bool:
                return all(done(rows, scores, threshold, t) for t in bounds)

            rows, scores = lists.read(anchor, enough)
            for target, bound in zip(targets, bounds):
                best = lists.first(*inside(rows, scores, bound), k, own_id)
                found += [(own_id, target, s, i) for s, i in best]
        return _rows(found)

    return run
