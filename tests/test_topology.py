import itertools

import pytest
from fleet import fleet_rows, log_of, rows_of

from togglelog.operators import (
    add_connections,
    build_topology,
    connection_list,
    device_count,
    device_table,
    mesh_summary,
    node_degree,
    placed_edges,
    remove_last_connection,
    simple_edges,
    topology_nodes,
    topology_size,
)

DEVICES = "device_id string, position double, first_ord long"


def devices_of(spark, n):
    """Positions run against the order of appearance."""
    return spark.createDataFrame([(f"d{i:02}", float(n - i), i) for i in range(n)], DEVICES)


def edges_by_hand(names, mode):
    n = len(names)
    if mode == "daisy":
        pairs = zip(names, names[1:])
    elif mode == "star":
        pairs = ((names[0], other) for other in names[1:])
    elif mode == "ring":
        pairs = ((names[i], names[(i + 1) % n]) for i in range(n))
    else:
        pairs = itertools.combinations(names, 2)
    return sorted({tuple(sorted(pair)) for pair in pairs})


@pytest.mark.parametrize("mode", ["daisy", "star", "ring", "mesh"])
def test_builders(spark, mode):
    for n in (1, 2, 3, 6, 7):
        devices = devices_of(spark, n)
        names = [f"d{i:02}" for i in range(n)]
        for order, ordered in (("appearance", names), ("position", names[::-1])):
            for rows_per_group in (None, 2):
                got = build_topology(devices, mode, order, rows_per_group=rows_per_group)
                assert rows_of(got, "src", "dst") == edges_by_hand(ordered, mode)


def test_fleet_topologies(spark):
    devices = device_table(log_of(spark, fleet_rows()))
    counts = {mode: build_topology(devices, mode).count() for mode in ("daisy", "star", "ring", "mesh")}
    assert counts == {"daisy": 3, "star": 3, "ring": 4, "mesh": 6}
    assert topology_size(devices, build_topology(devices, "ring")).first().asDict() == {"nodes": 4, "edges": 4}


def test_mesh_summary(spark):
    sizes = [tuple(mesh_summary(devices_of(spark, n)).first()) for n in (0, 1, 2, 7)]
    assert sizes == [(0, 0, 0), (1, 0, 0), (2, 1, 1), (7, 6, 21)]


def test_device_table(spark):
    got = rows_of(device_table(log_of(spark, fleet_rows())), "device_id", "position", "first_ord", "rising_edges")
    assert got == [("east", 1.0, 4, 5), ("tank", 7.0, 2, 5), ("well", 4.0, 6, 6), ("west", 2.0, 0, 5)]


def test_device_table_rules(spark):
    log = log_of(
        spark,
        [
            ("e", 1, True, "tie", 7.0, None),
            ("e", 2, True, "tie", 3.0, None),
            ("e", 2, True, "tie", 3.0, None),  # the same row again: one rising edge
            ("e", 3, True, "tie", 7.0, None),
            ("e", 1, False, "off", None, None),
            ("e", 1, False, "off", None, None),
            ("e", 1, False, "off", 2.0, None),
            ("e", 1, True, "nowhere", None, None),
            ("e", 1, True, None, 1.0, None),
        ],
    )
    got = rows_of(device_table(log), "device_id", "position", "first_ord", "rising_edges")
    assert got == [("nowhere", None, 7, 1), ("off", 2.0, 4, 0), ("tie", 3.0, 0, 3)]
    assert device_count(log).first()["devices"] == 3


def test_connections(spark):
    pairs = "source string, target string, edge_ord long"
    start = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], pairs)
    new = spark.createDataFrame(
        [("b", "a", 1), ("a", "b", 2), ("c", "c", 3), (None, "c", 4), ("", "c", 5), ("c", "d", 6), ("b", "a", 7)], pairs
    )
    for rows_per_group in (None, 1):
        added = add_connections(start, new, rows_per_group)
        # the reverse of a connection is a new one, but the same edge
        assert rows_of(added, "edge_ord", "source", "target") == [
            (1, "a", "b"), (2, "b", "c"), (3, "b", "a"), (4, "c", "d")
        ]
    custom = build_topology(devices_of(spark, 1), "custom", connections=added)
    assert rows_of(custom) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert rows_of(remove_last_connection(added), "edge_ord") == [(1,), (2,), (3,)]
    # a missing end is no edge and no node
    holes = spark.createDataFrame([("a", None, 1), (None, "b", 2), (None, None, 3), ("b", "a", 4)], pairs)
    assert rows_of(simple_edges(holes)) == [("a", "b")]
    assert rows_of(topology_nodes(devices_of(spark, 0), holes.toDF("src", "dst", "edge_ord"))) == [("a",), ("b",)]
    none = start.where("false")
    assert remove_last_connection(none).count() == 0
    assert rows_of(add_connections(none, new), "edge_ord") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("rows_per_group", [None, 2])
def test_connection_lists_go_by_place(spark, rows_per_group):
    rows = [("z", 1.0, 5), ("m", 2.0, 0), ("a", 3.0, 1), ("k", 4.0, 2)]  # names sort against positions
    devices = spark.createDataFrame(rows, DEVICES)

    def listed(mode, order="position", some=devices):
        got = connection_list(some, mode, order, rows_per_group)
        return [r[1:] for r in rows_of(got, "edge_ord", "source", "target")]

    assert listed("daisy") == [("z", "m"), ("m", "a"), ("a", "k")]
    assert listed("star", "appearance") == [("m", "a"), ("m", "k"), ("m", "z")]
    assert listed("ring") == [("z", "m"), ("z", "k"), ("m", "a"), ("a", "k")]
    assert listed("mesh") == [("z", "m"), ("z", "a"), ("z", "k"), ("m", "a"), ("m", "k"), ("a", "k")]
    assert listed("ring", some=devices.where("position < 3")) == [("z", "m")]
    chain = connection_list(devices, "daisy")
    assert rows_of(remove_last_connection(chain), "source", "target") == [("m", "a"), ("z", "m")]
    ring = connection_list(devices, "ring")
    assert ("a", "k") not in rows_of(remove_last_connection(ring), "source", "target")
    new = spark.createDataFrame([("z", "m", 1), ("m", "z", 2)], "source string, target string, edge_ord long")
    # the same direction is there already; the reverse one is new
    assert rows_of(add_connections(chain, new), "edge_ord", "source", "target")[3:] == [(4, "m", "z")]


def test_degree(spark):
    devices = devices_of(spark, 7)
    star = build_topology(devices, "star", "appearance")
    loop = spark.createDataFrame([("d01", "d01"), ("d02", "new"), ("new", "d02"), ("d03", "d02")], "source string, target string")
    degrees = node_degree(devices.union(spark.createDataFrame([("alone", 1.0, 9)], DEVICES)), star.union(simple_edges(loop)))
    assert rows_of(degrees, "device_id", "degree", "tier") == [
        ("alone", 0, "isolated"), ("d00", 6, "high"), ("d01", 3, "medium"), ("d02", 3, "medium"),
        ("d03", 2, "low"), ("d04", 1, "low"), ("d05", 1, "low"), ("d06", 1, "low"), ("new", 1, "low"),
    ]
    assert topology_nodes(devices, simple_edges(loop)).count() == 8
    assert rows_of(placed_edges(simple_edges(loop), devices)) == [("d01", "d01"), ("d02", "d03")]


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="unknown topology"):
        build_topology(devices_of(spark, 2), "tree")
    with pytest.raises(ValueError, match="connections"):
        build_topology(devices_of(spark, 2), "custom")


def test_mesh_shuffles_blocks(spark):
    """Edges are unfolded after the last exchange; nulls have no edge, a device that is there twice one with itself."""
    import togglelog.operators.topology as topology

    ids = [f"d{i}" for i in range(23)] + ["d3", None, "Ä", "z"]
    devices = spark.createDataFrame([(d, 1.0, i) for i, d in enumerate(ids)], "device_id string, position double, first_ord long")
    known = [d for d in ids if d is not None]
    want = sorted(tuple(sorted((a, b), key=str.encode)) for i, a in enumerate(known) for b in known[:i])
    for block in (1, 4, 512):
        edges = topology._mesh_edges(devices, None, block)
        assert sorted(map(tuple, edges.collect())) == want
    plan = build_topology(devices, "mesh")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Generate posexplode") < min(plan.index("Repartition"), plan.index("Join"))
    assert build_topology(devices.where("false"), "mesh").count() == 0
