"""The registered training-data queries, and the pipeline, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from togglelog.llm.oracles import ORACLES
from togglelog.llm.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="tables not present")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(SF_DIR))
    order = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(order)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*order).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, str(SF_DIR)).cache()
        assert docs.columns == columns and docs.count() > 0
        if name != "mixture":
            assert docs.count() <= before
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(SF_DIR)).count() == 0


STAGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, copies string, row string, id string, again string, n_removed string, _copy string"


def stage_rows():
    import random

    rng = random.Random(12)

    def prose(n):
        return " ".join(f"w{rng.randrange(500)}" for _ in range(n))

    base, passage = prose(120), prose(50)
    texts = [(0, base), (1, base), (2, base.replace("w1", "x1", 1)), (3, prose(30) + " " + passage), (4, passage + " " + prose(40)), (5, passage)]
    texts += [(6, None), (7, ""), (8, prose(60)), (8, prose(60)), (None, prose(70)), (None, base), (9, prose(3)), (9, prose(3)), (10, base), (10, base)]
    texts += [(20 + i, prose(40)) for i in range(30)]
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), *"abcdefgh") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def stage_docs(spark):
    return spark.createDataFrame(stage_rows(), STAGE_DOCS).repartition(3).cache()


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_stage_near_duplicates(spark, stage_docs):
    """One row of each group that five-word shingles join stays; rows of one doc_id with other texts are others."""
    rows = sorted({tuple(r) for r in stage_rows()}, key=repr)
    sets = []
    for r in rows:
        words = (r[1] or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, stage_docs, "").collect()]
    assert len(got) == len(set(got)) and {group[rows.index(r)] for r in got} == set(group) and len(got) == len(set(group))
    assert rows_of(corpus_pipeline.near_duplicates(spark, stage_docs.repartition(5), "")) == sorted(map(repr, got))
    # without nulls and repeats the smallest doc_id stays
    plain = stage_docs.where("doc_id < 8 OR doc_id >= 20")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, plain, "").collect()) == [0, *range(3, 8), *range(20, 50)]


def test_stage_substring(spark, stage_docs):
    rows = stage_rows()
    words = [(r[1] or "").split() for r in rows]
    from collections import Counter

    counts = Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    want = []
    for r, w in zip(rows, words):
        gone = {s + k for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for k in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone:
            want.append(r)
        elif kept:
            want.append((r[0], kept, *r[2:4], len(kept), *r[5:]))
    assert rows_of(corpus_pipeline.substring(spark, stage_docs, "")) == sorted(map(repr, want))


def test_stage_mixture(spark, stage_docs):
    """Whole epochs, then documents by key while they fit; every column as it came."""
    import hashlib
    import math
    from collections import Counter, defaultdict

    from togglelog.llm.mixing import JUNK

    rows, sources = stage_rows(), defaultdict(Counter)
    for r in rows:
        text = r[1] or ""
        clean = len([c for c in text if c not in JUNK]) / len(text) if text else 0.0
        digest = int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16)
        key = -math.log((digest + 0.5) / (1 << 52)) / max(clean * clean, 0.01)
        sources[r[3]][key, r[0] or 0, len(text.split())] += 1
    sizes = {s: sum(n * k[2] for k, n in units.items()) for s, units in sources.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * level > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weights[s] * level for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - set(full) if full else set()
    want = Counter()
    for s, units in sources.items():
        epochs = int(target[s] // sizes[s])
        gap = target[s] - epochs * sizes[s]
        over = gap > 0
        for (key, doc, size), n in sorted(units.items()):
            taken = over and n * size <= gap
            gap -= n * size if taken else 0
            want[s, doc, size] += n * (epochs + taken)
    got = Counter((r["source"], r["doc_id"] or 0, len((r["text"] or "").split())) for r in corpus_pipeline.mixture(spark, stage_docs, "").collect())
    assert got == +want
    assert {repr(tuple(r)) for r in corpus_pipeline.mixture(spark, stage_docs, "").collect()} <= {repr(r) for r in rows}


def test_stage_language_id_and_packed(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert set(rows_of(kept)) <= set(rows_of(docs)) and kept.columns == docs.columns
    gone = docs.join(kept.select("doc_id"), "doc_id", "left_anti")
    assert gone.where("lang IS NOT NULL AND length(text) > 200").count() <= 0.02 * docs.count()
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_doc) == docs.select("doc_id").distinct().count()
    for found in by_doc.values():
        assert sum(n for _, n, _ in found) == found[0][2] * len({x for x in found if x[0] == 0})
    for found in by_sequence.values():
        place = 0
        for offset, n in sorted(found):
            assert offset == place
            place += n
        assert place <= 2048
