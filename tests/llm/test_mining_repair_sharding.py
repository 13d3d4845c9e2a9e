"""Hard negatives, conversation repair and k-d tree shards against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from togglelog.llm import hard_negatives, kd_shards, turn_repair
from togglelog.llm.queries import QUERIES

VECTORS = "vec_id long, label int, embedding array<double>, rank int, score long, h long, block int, ids string"
TURNS = "conv_id long, turn long, role string, text string, symbol string, part long, place long, n string"
DOCS = "doc_id long, text string, source string, lang string, node long, gid string, weight double, slot string"


# --- hard negatives ---------------------------------------------------------------------------


def by_hand_negatives(rows, is_anchor, k=5, positives=5):
    kept = {}
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, vector)
        kept[vec_id] = min(kept.get(vec_id, row), row)
    whole = {i: (label, [256 * p // q for p, q in (x.as_integer_ratio() for x in v)]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in whole.items():
        if not is_anchor(a):
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a)
        for p, positive, _ in [r for r in ranked if r[2] == label][:positives]:
            found = [(n, i) for n, i, other in ranked if other != label and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a, positive, r, i, -p, -n) for r, (n, i) in enumerate(found[:k], 1)]
    clip = 2**63 - 1
    return sorted(tuple(max(-clip - 1, min(clip, x)) for x in row) for row in out)


def vector_rows(rng, n=260, dims=6):
    common = [rng.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        vector = common if rng.random() < 0.35 else [rng.gauss(0, 1) for _ in range(dims)]
        if rng.random() < 0.1:
            vector = [round(x) / 2 for x in vector]  # ties
        rows.append((i, rng.randrange(3), vector))
    odd = [(None, 1, common), (n, None, common), (n + 1, 1, None), (n + 2, 1, [float("nan"), *common[1:]]), (n + 3, 1, [None, *common[1:]])]
    odd += [(n + 4, 1, [float("inf"), *common[1:]]), (n + 5, 1, [0.0] * dims), (n + 6, 2, []), (n + 7, 2, common[:3]), rows[3], rows[3], (5, 0, common)]
    return [(*r, 1, 2, 3, 4, "x") for r in rows + odd]


@pytest.mark.parametrize("least_block,batch", [(2048, 2048), (40, 7)])
def test_hard_negatives(spark, least_block, batch):
    rows = vector_rows(random.Random(5))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, least_block=least_block, batch_anchors=batch)
    assert sorted(map(tuple, got.collect())) == by_hand_negatives(rows, lambda i: i % 4 == 0)


def test_hard_negatives_in_many_partitions(spark):
    """Lists and anchors of a block meet, whatever the partitions are: not only where adaptive execution joins them all."""
    rows = vector_rows(random.Random(8))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        got = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, least_block=40, batch_anchors=7).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(map(tuple, got)) == by_hand_negatives(rows, lambda i: i % 4 == 0)


def test_hard_negatives_of_large_numbers(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.choice([1e15, -3.5e9, 2.0**50 + 0.25, 1e-5, 0.5]) for _ in range(3)], 1, 2, 3, 4, "x") for i in range(40)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0)
    # beyond the long range the order is still exact; scores are reported at its end
    assert sorted(map(tuple, got.collect())) == by_hand_negatives(rows, lambda i: i % 3 == 0)
    rows = [(i, i % 2, [1e300 * (-1) ** i, float(i)], 1, 2, 3, 4, "x") for i in range(12)]
    assert hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).count() == 0


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0], 1, 2, 3, 4, "x")], VECTORS)
    assert hard_negatives.mine(alone, F.col("vec_id") == 0).count() == 0


def by_hand_of_every_row(rows, k=5):
    """The contract of op11, row by row: ids that repeat are rows of their own, null ids come last among equal scores."""
    whole = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        whole.append((vec_id, label, [256 * p // q for p, q in (x.as_integer_ratio() for x in vector)]))
    out = []
    for n, (a, label, v) in enumerate(whole):
        if a is None or a % 100:
            continue
        others = [(sum(x * y for x, y in zip(v, w)), i, l) for m, (i, l, w) in enumerate(whole) if m != n]
        others.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for p, positive, _ in [r for r in others if r[2] == label][:k]:
            found = [(s, i) for s, i, other in others if other != label and 80 * p <= 100 * s <= 100 * p][:k]
            out += [(a, positive, r, i, p, s) for r, (s, i) in enumerate(found, 1)]
    clip = 2**63 - 1
    return Counter(tuple(x if x is None else max(-clip - 1, min(clip, x)) for x in row) for row in out)


def repeating_rows(rng):
    common = [rng.gauss(0, 0.2) for _ in range(4)]
    vectors = [common if rng.random() < 0.3 else [rng.gauss(0, 0.2) for _ in range(4)] for _ in range(700)]
    rows = [(rng.choice([i % 250, i, None]), v, rng.randrange(4)) for i, v in enumerate(vectors)]
    # anchors that repeat, whole or with another label, and the largest label
    return rows + 3 * [(100, common, 1)] + [(100, common, 2), (100, vectors[5], 1), (200, common, 1), (7, common, 2**31 - 1)]


def numbers_beyond_decimals(rng):
    return [(i, [rng.gauss(0, 1) * rng.choice([1, 1e18, 1e300]) for _ in range(3)], i % 2) for i in range(250)]


@pytest.mark.parametrize("make", [repeating_rows, numbers_beyond_decimals])
def test_hard_negatives_of_every_row(spark, tmp_path, make):
    rows = make(random.Random(15))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == by_hand_of_every_row(rows)


def test_sortable_integers():
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, -257, 2**63, -(2**63), 10**400, -(10**400), -(10**400) - 1])
    assert sorted(map(hard_negatives.sortable, numbers)) == list(map(hard_negatives.sortable, numbers))
    assert [hard_negatives.unsorted(hard_negatives.sortable(x)) for x in numbers] == numbers


def test_reading_stops_early():
    """The lists are not read to their end where scores are spread out."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = np.floor(rng.normal(size=(4000, 3)) * 256)
    lists = hard_negatives.Lists(data, np.zeros(4000), [[i] for i in range(4000)])
    anchor = data[17]
    k = 5
    rows, scores = lists.read(anchor, lambda r, s, t: lists.kth(r, s, k) is not None and t < lists.kth(r, s, k))
    assert len(rows) < 2000
    assert sorted(scores)[-k:] == sorted(data @ anchor)[-k:]


def test_reading_stops_when_all_rows_are_met():
    import numpy as np

    data, asked = np.floor(np.random.default_rng(4).normal(size=(500, 64)) * 256), []
    lists = hard_negatives.Lists(data, np.zeros(500), [[i] for i in range(500)])
    rows, scores = lists.read(data[3], lambda r, s, t: asked.append(len(r)))
    assert sorted(rows) == list(range(500)) and (scores == data[rows] @ data[3]).all()
    assert all(n < 500 for n in asked)


# --- conversation repair ------------------------------------------------------------------------


def cheapest_by_search(symbols):
    """Least (cost, edits, roles kept) over every way to edit a short sequence of (initial, must go, truncated)."""
    best = None
    gaps = [("", "", 0), ("I", "u", 5), ("I", "a", 5)]
    for choice in itertools.product(*itertools.chain.from_iterable((gaps, "KuaD") for _ in symbols), gaps):
        cost, edits, roles = 0, "", ""
        for i, (initial, gone, cut) in enumerate(symbols):
            (name, role, more), edit = choice[2 * i], choice[2 * i + 1]
            if gone and edit != "D":
                break
            edits += name + {"K": "K", "D": "D"}.get(edit, "R")
            roles += role + {"K": initial, "D": ""}.get(edit, edit)
            cost += more + {"K": 0, "D": 2}.get(edit, 1) + (5 if cut and edit != "D" else 0)
        else:
            name, role, more = choice[-1]
            edits, roles, cost = edits + name, roles + role, cost + more
            if re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, edits) < best):
                best = cost, edits
    return best


def cheapest_row_by_row(symbols):
    """The same for sequences of any length, state by state."""
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def step(states, edits):
        out = {}
        for state, (cost, text) in states.items():
            for role, more, name in edits:
                to = state if role is None else after.get(role, {}).get(state)
                if to is not None:
                    new = (cost + more, text + name)
                    out[to] = min(out.get(to, new), new)
        return out

    def inserted(states):
        for _ in range(3):
            new = step(states, [("u", 5, "I"), ("a", 5, "I")])
            states = {s: min(x for x in (states.get(s), new.get(s)) if x is not None) for s in {*states, *new}}
        return states

    states = {0: (0, "")}
    for initial, gone, cut in symbols:
        extra = 5 if cut else 0
        edits = [(None, 2, "D")] + ([] if gone else [(initial, extra, "K"), ("u", 1 + extra, "R"), ("a", 1 + extra, "R")])
        states = step(inserted(states), edits)
    states = inserted(states)
    return min(states[s] for s in (0, 3) if s in states)


def test_matrices():
    rng = random.Random(8)
    matrices = turn_repair.symbol_matrices()
    for n in (0, 1, 2, 3, 3, 4):
        for _ in range(12 if n < 4 else 5):
            symbols = [(rng.choice("suao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            letters = ["x" if gone else i.upper() if cut else i for i, gone, cut in symbols]
            got = turn_repair.best_repair(turn_repair.product_of([matrices[x] for x in letters]))
            assert got == cheapest_by_search(symbols) == cheapest_row_by_row(symbols)
    for n in (30, 300):
        symbols = [(rng.choice("suuaao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        letters = ["x" if gone else i.upper() if cut else i for i, gone, cut in symbols]
        assert turn_repair.best_repair(turn_repair.product_of([matrices[x] for x in letters])) == cheapest_row_by_row(symbols)


def by_hand_repair(rows, everyone):
    """conv_id: figures, from rows (conv_id, turn, role, text) in order."""
    out = {}
    for conv in everyone:
        mine = [r[1:4] for r in rows if r[0] == conv]
        seen, symbols, count = set(), [], Counter()
        for turn, role, text in mine:
            blank = re.search(r"[^\x20\x09-\x0D]", text) is None
            duplicate, cut = (role, text) in seen, re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) is None
            seen.add((role, text))
            fault = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else ""
            count[fault] += 1
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits = cheapest_row_by_row(symbols)
        repaired, left = [], iter(mine)
        for e in edits:
            last = repaired[-1][0][:1] if repaired else ""
            other = "assistant" if last == "u" else "user"
            if e == "I":
                repaired.append((other, ""))
            else:
                _, role, text = next(left)
                repaired += {"K": [(role, text)], "R": [(other, text)], "D": []}[e]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, digest)
    return out


def conversation_rows(rng):
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\n", "Long. " * 2000 + "end", "é。", "a.\x0b", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u", None]
    rows = []
    for conv in [*range(40), None]:
        for i in range(rng.choice([0, 1, 2, 5, 9, 30]) if conv != 7 else 400):
            role = roles[i % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"{rng.choice(texts)}{i}." if rng.random() < 0.6 else rng.choice([*texts, None])
            rows.append((conv, None if rng.random() < 0.03 else i + (rng.random() < 0.1) * 2, role, text, "x", 1, 2, "y"))
    return rows + rows[:5] + rows[3:4] * 3


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def in_order(rows):
    """Rows with their nulls filled, as ordered_rows documents it."""
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    return sorted(filled, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))


@pytest.mark.parametrize("piece,rounds", [(65_536, 8), (3, 8), (1, 0)])
def test_repair(spark, piece, rounds):
    rows = conversation_rows(random.Random(9))
    df = turn_repair.ordered_rows(spark.createDataFrame(rows, TURNS).repartition(5))
    figures = turn_repair.repair(df, piece, rounds).cache()
    digests = {r[0]: r[1] for r in turn_repair.repaired_digests(df, figures).collect()}
    got = {r["conv_id"]: (*[r[c] for c in FIGURES], digests[r["conv_id"]]) for r in figures.collect()}
    want = by_hand_repair(in_order(rows), {r[0] for r in rows})
    assert got == want
    lines = defaultdict(list)
    for r in turn_repair.edited_rows(df, figures).orderBy("place").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, (*_, digest) in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == digest


def test_damage(spark, tmp_path):
    """The registered query on a table with odd rows."""
    rows = [r[:4] for r in conversation_rows(random.Random(10))] + [(1000 + i, t, "user", "Hi.") for i in range(30) for t in (None, 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged, everyone = [], {r[0] for r in rows}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or " ") if r[2] is not None else " ", hashlib.md5((" " if r[3] is None else r[3]).encode()).digest()))
    for conv, turn, role, text in ordered:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r["conv_id"]: tuple(r[c] for c in (*FIGURES, "repaired_sha256")) for r in QUERIES["op12_turn_repair"](spark, str(tmp_path)).collect()}
    assert got == by_hand_repair(damaged, everyone)


def test_repair_of_nothing(spark):
    df = turn_repair.ordered_rows(spark.createDataFrame([], TURNS))
    figures = turn_repair.repair(df)
    assert figures.count() == turn_repair.repaired_digests(df, figures).count() == turn_repair.edited_rows(df, figures).count() == 0


# --- shards ----------------------------------------------------------------------------------------


def document_rows(rng, n=600):
    copy, rows = "copy " * 20, []
    for i in range(n):
        text = copy if i % 3 == 0 else f"{i} " + "word é " * rng.randrange(1, 60)
        rows.append((i, text, rng.choice(["web", "book", None]), rng.choice(["en", "fr"]), 1, "x", 1.0, "y"))
    odd = [(None, None, "web", "en"), (None, "", None, None), (n, "long " * 3000, "web", "en"), (n + 1, None, None, None), rows[1][:4], rows[1][:4]]
    return rows + [(*r, 1, "x", 1.0, "y") for r in odd]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_kd_shards(spark, shards):
    rows = document_rows(random.Random(11))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = kd_shards.shard_documents(df, shards=shards).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got)
    slots, sizes, places = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        places[r["text_crc32"]].add(r["shard"])
    assert set(slots) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one very long text can't be divided; the rest is near equal
    assert max(sizes.values()) - min(sizes.values()) < 16_000
    assert sum(len(p) > 1 for p in places.values()) <= shards - 1
    again = kd_shards.shard_documents(df.repartition(2), shards=shards).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_kd_tree_by_hand(spark):
    """Even sizes: the tree cuts the widest dimension at its median, then the other."""
    rows = [(i, f"{i:04d}", i % 16, i // 16) for i in range(256)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x long, y long")
    got = kd_shards.shard_documents(df, shards=4, dimensions={"x": F.col("x") * 1, "y": F.col("y")}, tolerance=0.001)
    found = defaultdict(list)
    for r in got.join(df, "doc_id").collect():
        found[r["shard"]].append((r["x"], r["y"]))
    assert sorted(len(v) for v in found.values()) == [64] * 4
    boxes = sorted((min(x for x, _ in v), max(x for x, _ in v), min(y for _, y in v), max(y for _, y in v)) for v in found.values())
    assert boxes == [(0, 7, 0, 7), (0, 7, 8, 15), (8, 15, 0, 7), (8, 15, 8, 15)]


def test_kd_target_bytes(spark):
    df = spark.createDataFrame([(i, "abc") if i < 3 else (i, f"text {i}") for i in range(50)], "doc_id long, text string")
    got = kd_shards.shard_documents(df, target_bytes=100).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    total = sum(r["n"] for r in got)
    assert len(got) == -(-total // 100) and max(r["n"] for r in got) <= 120
    with pytest.raises(ValueError):
        kd_shards.shard_documents(df)


def test_kd_shards_of_little(spark):
    empty = spark.createDataFrame([], DOCS)
    assert kd_shards.shard_documents(empty, shards=8).count() == 0
    few = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, None)], "doc_id long, text string")
    got = kd_shards.shard_documents(few, shards=8).collect()
    assert len(got) == 4 and all(0 <= r["shard"] < 8 for r in got)
    assert len({(r["shard"], r["slot"]) for r in got}) == 4
