"""Device tables and edge tables of device topologies.

`devices` has device_id, position and first_ord. Edge tables (src, dst) are simple undirected graphs
with src <= dst. Connection lists (source, target, edge_ord) are the editable form: directed as they
were entered, in the order they were added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from togglelog.operators.skew import ROWS_PER_GROUP, rank_all
from togglelog.schema import normalise

TOPOLOGIES = ("daisy", "star", "ring", "mesh", "custom")
ORDERS = {"position": ("position", "first_ord", "device_id"), "appearance": ("first_ord", "device_id")}

# Devices of a mesh that come as one row: a pair of such rows unfolds to 262,144 edges.
MESH_BLOCK = 512

# Up to this degree a node counts as the tier; above the last one it is "high".
DEGREE_TIERS = (("isolated", 0), ("low", 2), ("medium", 4))


def device_table(log: DataFrame) -> DataFrame:
    """Per device: most common position (the lowest on ties), first appearance, and the number of
    distinct rising-edge rows (rows are compared on everything but `ord`)."""
    rows = normalise(log).where(F.col("device_id").isNotNull())
    seen = rows.groupBy("device_id", "position").agg(
        F.count("*").alias("_n"), F.min("ord").alias("_first")
    )
    # known positions first, then the most frequent, then the lowest
    choice = F.struct(F.col("position").isNull(), -F.col("_n"), F.col("position"))
    devices = seen.groupBy("device_id").agg(
        F.min_by("position", choice).alias("position"), F.min("_first").alias("first_ord")
    )
    source_columns = [c for c in rows.columns if c != "ord"]
    rising = (
        rows.where("toggled")
        .select(source_columns)
        .distinct()
        .groupBy("device_id")
        .agg(F.count("*").alias("rising_edges"))
    )
    return devices.join(rising, "device_id", "left").fillna(0, ["rising_edges"])


def device_count(log: DataFrame) -> DataFrame:
    return normalise(log).agg(F.count_distinct("device_id").alias("devices"))


def _undirected(pairs: DataFrame) -> DataFrame:
    """Edges without direction; a pair with a missing end is none."""
    pairs = pairs.where("source IS NOT NULL AND target IS NOT NULL")
    low, high = F.least("source", "target"), F.greatest("source", "target")
    return pairs.select(low.alias("src"), high.alias("dst"))


def simple_edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges of a list of pairs (source, target), each once."""
    return _undirected(pairs).distinct()


def build_topology(
    devices: DataFrame,
    mode: str,
    order_by: str = "position",
    connections: DataFrame | None = None,
    rows_per_group: int | None = ROWS_PER_GROUP,
) -> DataFrame:
    """Edges of a daisy chain, star, ring or full mesh over the ordered devices, or of a custom
    connection list. The order is by position or by first appearance."""
    if mode == "custom":
        if connections is None:
            raise ValueError("a custom topology needs connections")
        return simple_edges(connections)
    if mode == "star":
        # only the centre's place matters: nothing is ranked
        centre = devices.agg(F.min_by("device_id", F.struct(*ORDERS[order_by]))).scalar()
        others = devices.where(F.col("device_id") != centre)
        return _undirected(others.select(centre.alias("source"), F.col("device_id").alias("target")))
    if mode == "mesh":
        # every pair, whatever the order: no place is needed but one to cut blocks by
        return _mesh_edges(devices, rows_per_group)
    pairs = _placed_pairs(devices, mode, order_by, rows_per_group)
    # only a ring of two devices names an edge twice
    return simple_edges(pairs) if mode == "ring" else _undirected(pairs)


def _mesh_edges(devices: DataFrame, rows_per_group: int | None, block: int = MESH_BLOCK) -> DataFrame:
    """Each pair of rows once. Devices are cut into blocks by their order, and pairs of blocks are shuffled, not
    edges: a task unfolds its pairs of blocks as it goes, the source's below the target's."""
    known = devices.where(F.col("device_id").isNotNull()).select("device_id")
    ordered = rank_all(known, ("device_id",), "place", rows_per_group)
    number = F.floor((F.col("place") - 1) / block).alias("block")
    blocks = ordered.groupBy(number).agg(F.sort_array(F.collect_list("device_id")).alias("ids"))
    total = known.agg(F.ceil(F.count("*") / block)).scalar()
    later = F.explode(F.sequence(F.col("block"), total - 1))
    left = blocks.select(F.col("block").alias("_low"), F.col("ids").alias("_left"), later.alias("_high"))
    right = blocks.select(F.col("block").alias("_high"), F.col("ids").alias("_right"))
    # by number, as few bytes become many edges
    tasks = int(devices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.join(right, "_high").repartition(tasks, "_low", "_high")
    sources = pairs.select("_low", "_high", "_right", F.posexplode("_left").alias("_at", "src"))
    rest = F.when(F.col("_low") == F.col("_high"), F.slice("_right", F.col("_at") + 2, block)).otherwise(F.col("_right"))
    return sources.select("src", F.explode(rest).alias("dst"))


def _placed_pairs(devices: DataFrame, mode: str, order_by: str, rows_per_group: int | None) -> DataFrame:
    """Pairs (source, source_place, target, target_place) of a topology over the ordered devices."""
    if mode not in TOPOLOGIES:
        raise ValueError(f"unknown topology {mode!r}")

    ordered = rank_all(devices, ORDERS[order_by], "place", rows_per_group)
    ordered = ordered.select("device_id", "place")
    if mode == "star":
        centre = ordered.where("place = 1").select("device_id").scalar()
        return ordered.where("place > 1").select(
            centre.alias("source"),
            F.lit(1).cast("long").alias("source_place"),
            F.col("device_id").alias("target"),
            F.col("place").cast("long").alias("target_place"),
        )

    place, total = F.col("place"), F.col("_total")
    counted = ordered.withColumn("_total", devices.agg(F.count("*")).scalar())
    if mode == "daisy":
        meets = F.array(place + 1)
    elif mode == "ring":
        meets = F.array(place % total + 1)
    else:
        # Every device meets the half of the others that follows it, counted round: each pair once,
        # and the same work for every device.
        steps = F.when(place * 2 <= total, F.floor(total / 2)).otherwise(F.floor((total - 1) / 2))
        steps = steps.cast("long")
        meets = F.when(
            steps > 0,
            F.transform(F.sequence(F.lit(1).cast("long"), steps), lambda s: (place - 1 + s) % total + 1),
        )
    left = counted.select(
        F.col("device_id").alias("source"), F.col("place").alias("source_place"), F.explode(meets).alias("target_place")
    )
    right = ordered.select(F.col("device_id").alias("target"), F.col("place").alias("target_place"))
    return left.join(right, "target_place").select("source", "source_place", "target", "target_place")


def mesh_summary(devices: DataFrame) -> DataFrame:
    """Devices, degree of each, and edges of a full mesh, without listing its n(n-1)/2 edges."""
    counted = devices.agg(F.count("*").alias("devices"))
    return counted.select("devices", F.expr("greatest(devices - 1, 0L) AS degree"), F.expr("devices * (devices - 1) DIV 2 AS edges"))


def connection_list(
    devices: DataFrame, mode: str, order_by: str = "position", rows_per_group: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """The editable connection list (source, target, edge_ord) of a built topology, numbered from 1.

    The device with the earlier place is the source. Connections go by the place of their source, then
    by that of their target, so the one that closes a ring follows the first."""
    pairs = _placed_pairs(devices, mode, order_by, rows_per_group)
    swap = F.col("source_place") > F.col("target_place")
    directed = pairs.select(
        F.when(swap, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(swap, F.col("source")).otherwise(F.col("target")).alias("target"),
        F.least("source_place", "target_place").alias("_first"),
        F.greatest("source_place", "target_place").alias("_second"),
    ).distinct()
    ranked = rank_all(directed, ["_first", "_second"], "edge_ord", rows_per_group)
    return ranked.select("source", "target", "edge_ord")


def add_connections(
    connections: DataFrame, new: DataFrame, rows_per_group: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Append connections (source, target, edge_ord) in their order. One that leads back to its own
    source or has a missing end is left out, as is one that is in the list in the same direction."""
    wanted = (
        new.where((F.col("source") != F.col("target")) & (F.col("source") != "") & (F.col("target") != ""))
        .groupBy("source", "target")
        .agg(F.min("edge_ord").alias("_given"))
        .join(connections, ["source", "target"], "left_anti")
    )
    last = connections.agg(F.coalesce(F.max("edge_ord"), F.lit(0))).scalar()
    order = ["_given", "source", "target"]
    added = rank_all(wanted, order, "_place", rows_per_group)
    return connections.select("source", "target", "edge_ord").unionByName(
        added.select("source", "target", (last + F.col("_place")).alias("edge_ord"))
    )


def remove_last_connection(connections: DataFrame) -> DataFrame:
    """Drop the connection that was added last."""
    return connections.where(F.col("edge_ord") < connections.agg(F.max("edge_ord")).scalar())


def topology_nodes(devices: DataFrame, edges: DataFrame) -> DataFrame:
    """Devices, and edge ends that are no known device."""
    return (
        devices.select("device_id")
        .union(edges.select("src"))
        .union(edges.select("dst"))
        .where("device_id IS NOT NULL")
        .distinct()
    )


def node_degree(devices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and connectivity tier of every node. An edge from a node to itself counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("device_id")).where("device_id IS NOT NULL")
    marks = devices.select("device_id", F.lit(0).alias("_end")).unionByName(
        ends.withColumn("_end", F.lit(1))
    )
    nodes = marks.groupBy("device_id").agg(F.sum("_end").alias("degree"))
    tier = F.lit("high")
    for name, most in reversed(DEGREE_TIERS):
        tier = F.when(F.col("degree") <= most, name).otherwise(tier)
    return nodes.withColumn("tier", tier)


def placed_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges whose two ends have a known position (`positions` has device_id)."""
    placed = positions.select("device_id")
    return edges.join(placed, edges["src"] == placed["device_id"], "left_semi").join(
        placed, edges["dst"] == placed["device_id"], "left_semi"
    )


def topology_size(devices: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes and of edges."""
    marks = topology_nodes(devices, edges).select(F.lit(1).alias("_node")).unionByName(
        edges.select(F.lit(1).alias("_edge")), allowMissingColumns=True
    )
    return marks.agg(F.count("_node").alias("nodes"), F.count("_edge").alias("edges"))
