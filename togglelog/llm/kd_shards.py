"""Sharding by a k-d tree: documents that are alike in their metadata come to the same shard, and shards are near
equal in bytes.

A node of the tree with more than one shard to fill is split in two along the dimension that is widest in
it, measured against the width of the whole table, at the weighted median: the point up to which the
documents, in the order (dimension, text, doc_id), hold the first half of the node's bytes (with an
uneven number of shards, their share of it). All nodes of a level are split together.

The median is found by distributed counting, without sorting: a pass sums the bytes of BUCKETS equal ranges
of the order's key in each node and finds the range that the median lies in, the next pass divides that
range, from the first to the last key that is in it. It ends when a range's bytes are within TOLERANCE of a shard, and the cut goes to the nearer end of the
range. So equal texts stay together, unless a group of copies that is larger than that lies across the
cut; then documents of this one group are divided by doc_id.

Only light rows are shuffled (hash, bytes, dimensions), never texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from togglelog.llm.storage import written

BUCKETS = 4096
# Bytes, as a share of a shard's, that a cut may be off at each split.
TOLERANCE = 0.01
# Parts of a shard that are numbered side by side.
CELLS = 4096
# The tree has a node for each shard, which the driver holds and sends to the tasks.
MOST_SHARDS = 100_000
# The key of the order: a dimension, then hashes of the text and of the document.
TEXT, DOC = "gid", "did"
_TOP = (1 << 63) - 1


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def place_of(text: Column) -> Column:
    """Texts as numbers in the order of their first 7 bytes; null comes first."""
    head = F.rpad(F.substring(F.hex(F.encode(text, "utf-8")), 1, 14), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long") + 1, F.lit(0).cast("long"))


def _unsigned(h: Column) -> Column:
    return F.shiftrightunsigned(h, 1)


def default_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Bytes of the text and, as far as docs has them, source and language."""
    found = {"dim_bytes": byte_size(F.col("text").cast("string"))}
    for name in ("source", "lang"):
        if name in docs.columns:
            found[f"dim_{name}"] = place_of(F.col(f"`{name}`").cast("string"))
    return found


@dataclass
class _Node:
    """A node to be split: where its median is still looked for."""

    number: int
    shards: int  # leaves below
    dim: str
    left: int  # leaves of the left child
    weight: int
    wanted: float  # bytes of the left child still to be found in the range
    low: int = 0  # range of the part of the key that is looked at
    high: int = 0
    fixed: list[int] = field(default_factory=list)  # values of the parts before
    cut: tuple[int, int, int] | None = None  # the first key of the right child

    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BUCKETS)

    def set_cut(self, value: int) -> None:
        self.cut = (*self.fixed, value, *[0] * (2 - len(self.fixed)))


def shard_documents(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs (doc_id, text) with its shard, from 0.

    Give the number of shards, or the bytes that a shard should hold at most. `size` is the UTF-8 bytes of the
    text and 1; a null text is an empty one. `slot` numbers a shard's documents from 0. `dimensions` are
    non-negative longs by name (default: `default_dimensions`); of documents with equal texts the least
    value of each holds for all. Rows that are equal in doc_id and text are never divided: a shard may be larger by
    such a group, and empty if there are fewer groups than shards. A null doc_id is a value like others. Other columns are
    ignored; an empty table gives an empty result. Reruns agree, whatever the partitions.
    """
    spark, (units, tree, dims) = docs.sparkSession, kd_tree(docs, shards, target_bytes, dimensions, tolerance)
    placed = _place(units, tree, spark)
    placed = written(placed.select("doc_id", "size", "crc", "n", "node", TEXT, DOC, F.pmod(DOC, F.lit(CELLS)).alias("cell")), "sharded")

    # Numbers: rows of a shard by cell, then by hash. Sums of cells are at most CELLS rows a shard.
    before = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("node", "cell").agg(F.sum("n").alias("rows"))
    cells = cells.select("node", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("node", "cell").orderBy(DOC, TEXT, "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(cells, ["node", "cell"])
    start = F.col("before") + F.col("start")
    return numbered.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.col("node").cast("int").alias("shard"),
        F.explode(F.sequence(start, start + F.col("n") - 1)).alias("slot"),
    )


def kd_tree(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None, tolerance: float = TOLERANCE,
) -> tuple[DataFrame, list[list[_Node]], list[str]]:
    """The distinct documents with hashes, sizes and dimensions; the splits by level; the dimensions' names."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    dimensions = default_dimensions(docs) if dimensions is None else dimensions
    dims = list(dimensions)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(
        "doc_id", byte_size(text).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("crc"), _unsigned(F.xxhash64(text)).alias(TEXT),
        *[value.cast("long").alias(name) for name, value in dimensions.items()],
    )
    light = hashed.groupBy("doc_id", TEXT, "size", "crc").agg(F.count(F.lit(1)).alias("n"), *[F.min(d).alias(d) for d in dims])
    light = written(light.withColumn(DOC, _unsigned(F.xxhash64("doc_id", TEXT))), "documents")
    groups = light.groupBy(TEXT).agg(*[F.coalesce(F.min(d), F.lit(0)).alias(d) for d in dims])
    units = light.drop(*dims).join(groups, TEXT).withColumn("weight", F.col("size") * F.col("n"))
    units = written(units, "kd-units")

    spans = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]
    whole = units.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), *spans).first()
    if target_bytes is not None:
        shards = max(1, -(-whole["weight"] // target_bytes))
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}")
    width = {d: max(1, (whole[f"high_{d}"] or 0) - (whole[f"low_{d}"] or 0)) for d in dims}
    slack = tolerance * whole["weight"] / shards
    leaves, tree, spark = {0: shards}, [], docs.sparkSession
    while any(n > 1 for n in leaves.values()):
        placed = _place(units, tree, spark)
        found = placed.groupBy("node").agg(F.sum("weight").alias("weight"), *spans).collect()  # a row for each node
        sums, level = {r["node"]: r for r in found}, []
        for number, n in sorted(leaves.items()):
            r = sums.get(number)
            if n > 1 and r is not None:
                dim = max(dims, key=lambda d: ((r[f"high_{d}"] - r[f"low_{d}"]) / width[d], d == dims[0], d))
                share = r["weight"] * (n // 2) / n
                level.append(_Node(number, n, dim, n // 2, r["weight"], share, r[f"low_{dim}"], r[f"high_{dim}"]))
            elif n > 1:  # no document comes here
                level.append(_Node(number, n, dims[0], n // 2, 0, 0.0, cut=(0, 0, 0)))
        _find_cuts(placed, level, slack)
        tree.append(level)
        leaves = {k: n for k, n in leaves.items() if n == 1} | {
            k: n for x in level for k, n in ((x.number, x.left), (x.number + x.left, x.shards - x.left))
        }
    return units, tree, dims


def _find_cuts(placed: DataFrame, level: Sequence[_Node], slack: float) -> None:
    """Narrow the ranges of all nodes of a level, pass by pass, until each has its cut."""
    while some := [x for x in level if x.cut is None]:
        spark = placed.sparkSession
        rows = [(x.number, x.dim, len(x.fixed), x.low, x.high, x.width(), x.wanted, *(x.fixed + [0, 0])[:2]) for x in some]
        names = ["node", "dim", "step", "low", "high", "width", "wanted", "fixed0", "fixed1"]
        looked = placed.join(F.broadcast(_small(spark, rows, names)), "node")  # at most a row for each shard
        dim = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in sorted({x.dim for x in some})])
        key = F.when(F.col("step") == 0, dim).when(F.col("step") == 1, F.col(TEXT)).otherwise(F.col(DOC))
        fixed = ((F.col("step") < 1) | (dim == F.col("fixed0"))) & ((F.col("step") < 2) | (F.col(TEXT) == F.col("fixed1")))
        inside = looked.withColumn("key", key).where(fixed & F.col("key").between(F.col("low"), F.col("high")))
        bucket = F.expr("(key - low) div width").alias("bucket")
        ends = F.min("key").alias("first"), F.max("key").alias("last")
        sums = inside.groupBy("node", "wanted", bucket).agg(F.sum("weight").alias("weight"), *ends)
        upto = sums.withColumn("upto", F.sum("weight").over(Window.partitionBy("node").orderBy("bucket")))
        # the range with the median in it: the first that reaches it, or else the last
        reach = F.struct("bucket", "weight", "upto", "first", "last")
        at = upto.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("wanted"), reach)), F.max(reach)).alias("at"))
        found = {r["node"]: r["at"] for r in at.collect()}  # a row for each node
        for x in some:
            _, weight, upto, low, high = found[x.number]
            before = upto - weight
            if weight <= slack or (low == high and len(x.fixed) == 2):
                x.set_cut(low if x.wanted - before < upto - x.wanted else min(high + 1, _TOP))
                continue
            x.wanted -= before
            if low < high:
                x.low, x.high = low, high
            else:  # one value: go on with the next part of the key
                x.fixed.append(low)
                x.low, x.high = 0, _TOP


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table that the driver has at hand."""
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows)], names))


def _place(units: DataFrame, tree: Sequence[Sequence[_Node]], spark: SparkSession) -> DataFrame:
    """units with their node so far. A node's number is that of its first shard."""
    placed = units.withColumn("node", F.lit(0).cast("long"))
    for level in tree:
        rows = [(x.number, x.dim, x.left, *x.cut) for x in level]
        splits = _small(spark, rows, ["node", "dim", "left", "cut0", "cut1", "cut2"])
        dim = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in sorted({x.dim for x in level})])
        right = F.struct(dim.alias("a"), F.col(TEXT).alias("b"), F.col(DOC).alias("c")) >= F.struct(
            F.col("cut0").alias("a"), F.col("cut1").alias("b"), F.col("cut2").alias("c")
        )
        # at most a row for each shard
        placed = placed.join(F.broadcast(splits), "node", "left")
        node = F.col("node") + F.when(F.col("left").isNotNull() & right, F.col("left")).otherwise(0)
        placed = placed.select(*units.columns, node.alias("node"))
    return placed
