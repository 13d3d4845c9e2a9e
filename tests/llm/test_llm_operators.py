"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from togglelog.llm import (
    jaccard_join,
    lang_id,
    mixing,
    packing,
    permutation_index,
    quality_lines,
    substring_dedup,
    token_rollup,
    tool_calls,
    training_order,
)
from togglelog.llm.components import connected_components
from togglelog.llm.queries import QUERIES, tokenizer
from togglelog.llm.storage import new_path
from togglelog.llm.words import gram_hashes, span_hashes, text_words, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_words string, spans string, size string"
RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Copies, near copies, shared passages, periodic text, nulls, repeats, a very long text."""
    base, passage = prose(120), prose(60)
    texts = [base, base, base.upper(), base.replace("w1", "x1", 1), prose(20) + " " + passage, passage + "\n" + prose(90)]
    texts += [prose(15) + " " + passage + " " + prose(15), "ra " * 100, "ra " * 34, None, "", " \t\n", "one", "one", prose(4)]
    texts += [prose(5000), prose(34), prose(35), "a b\x0bc   d", "日本 語 " * 30]
    rows = [(i, t, "en", f"s{i % 3}", "x", "y", "z") for i, t in enumerate(texts)]
    return [*rows, (None, base, None, None, "x", "y", "z"), (0, base, "en", "s0", "x", "y", "z"), (0, prose(80), "en", "s0", "x", "y", "z")]


ROWS = odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


def test_word_hashes():
    for text in ("a bb  a\tbb\n", "", "  ", "é ü é", prose(300)):
        words = text_words(text)
        hashes = word_hashes(text)
        assert [words.index(w) for w in words] == [hashes.tolist().index(h) for h in hashes]
        for n in (1, 2, 5, 35):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            assert len(set(gram_hashes(hashes, n).tolist())) == len(set(grams))
    hashes = word_hashes("a b c a b c")
    found = span_hashes(hashes, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert found[0] == found[1] != found[2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (7, 7), (900, 900), (None, 3)]
    RNG.shuffle(chain)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500, 900: 900}


def by_hand_components(rows):
    sets, parent = [], {}
    for doc, text, *_ in rows:
        if doc is not None:
            words = text_words(text, lower=True)
            sets.append((doc, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
            parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("block_sets", [4096, 2])
def test_jaccard_components(spark, docs, block_sets):
    rows = ROWS
    near = [(100 + i, " ".join(w if RNG.random() > 0.02 * (i % 4) else "new" for w in rows[0][1].split()), *rows[0][2:]) for i in range(12)]
    got = jaccard_join.similarity_components(docs.union(spark.createDataFrame(near, DOCS)), block_sets=block_sets).collect()
    want = by_hand_components(rows + near)
    assert len(got) == len(rows) + len(near)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    assert jaccard_join.similarity_components(docs.where("false")).count() == 0


def test_components_by_rounds_and_in_one_task(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(150)] + [(1000 - i, 999 - i) for i in range(60)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    by_rounds, at_once = (sorted(map(tuple, connected_components(edges, alone).collect())) for alone in (0, 10**6))
    assert by_rounds == at_once and len(at_once) == len({x for p in pairs for x in p})


def posted_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jaccard_join._candidates(docs, 80, 5, np.empty(0, np.uint64)).collect()))


def test_copies_are_posted_once(spark):
    """Six copies of a corpus post what one posts, and texts without another near copy nothing."""
    rng = random.Random(12)
    texts = [prose(80, rng) for _ in range(30)]
    texts += [t + " more" for t in texts[:5]]
    once = posted_rows(spark, list(enumerate(texts)))
    assert len({r[0] for r in once}) == 10
    assert posted_rows(spark, [(100 * k + i, t) for k in range(6) for i, t in enumerate(texts)]) == once


def test_pipeline_posts_copies_once(spark, monkeypatch):
    """The pipeline's stage over six copies: about as many postings as over one, and one document of each text stays."""
    import corpus_pipeline

    rng, seen, edges = random.Random(16), [], jaccard_join._group_edges
    texts = [prose(60, rng) for _ in range(10)]
    texts += [texts[0] + " more"]
    monkeypatch.setattr(jaccard_join, "_group_edges", lambda posted, percent: seen.append(posted.count()) or edges(posted, percent))
    for copies in (1, 6):
        rows = [(100 * k + i, t) for k in range(copies) for i, t in enumerate(texts)]
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(10))
    assert 0 < seen[1] < 2 * seen[0]  # copies change the order of shingles


def test_shared_lines_are_no_candidates(spark):
    """A text made of lines of as many others, which share too little each, meets no bucket often enough."""
    rng = random.Random(13)
    lines = [prose(20, rng) for _ in range(16)]
    texts = [" ".join(lines)] + [" ".join([line, *(prose(20, rng) for _ in range(15))]) for line in lines]
    assert posted_rows(spark, list(enumerate(texts))) == []


@pytest.mark.parametrize("most", [10**6, 8])
def test_streams_of_postings_keep_what_links(most, monkeypatch):
    """Over batches of any size, shingles of any frequency: what the two streams keep holds all that linked sets share."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "SOLVE_ROWS", 7)
    rng = random.Random(14)
    sets = {}
    for i in range(60):  # (id, n): shingles; families of near copies, and shingles that all have
        family = [10_000 * (i // 6) + k for k in range(40)]
        own = set(family[: 38 + i % 3]) | ({5, 6} if i % 2 else set())
        sets[rng.randrange(-(2**63), 2**63), len(own)] = own
    rows = sorted((t, n, i) for (i, n), own in sets.items() for t in own for _ in range(1 + i % 2))

    def batches(rows, names):
        for at in range(0, len(rows), 5):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 5])], names)

    met = jaccard_join.partner_writer(80, most)(batches([(i, n, t) for t, n, i in rows], ["id", "n", "token"]))
    met = sorted(tuple(r.values()) for b in met for r in b.to_pylist())
    kept = jaccard_join.enough_writer(80)(batches(met, ["id", "n", "token", "partners"]))
    kept = {(r["id"], r["token"]) for b in kept for r in b.to_pylist()}
    for (a, _), x in sets.items():
        for (b, _), y in sets.items():
            if a != b and 100 * len(x & y) >= 80 * len(x | y):
                assert all((a, t) in kept for t in x & y)


def test_signature_tree_prunes_no_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(1, 60, 60)]
    sets += [np.sort(rng.choice(s, max(1, int(len(s) * 0.9)), replace=False)) for s in sets]
    tree, links = jaccard_join.SignatureTree(sets, 1024), jaccard_join.Links(len(sets))
    jaccard_join.traverse(tree, tree, sets, links, 80)
    want = jaccard_join.Links(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.similar(sets[i], sets[j], 80):
                want.join(i, j)
    assert [links.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_blocks_of_a_group_meet_in_rounds(spark, monkeypatch):
    """A group in many blocks that is not one component: no step shuffles a text more than twice, all links are found."""
    rng = random.Random(15)
    first, steps = prose(60, rng).split(), []
    texts = [" ".join(first[: 60 - k] + [f"t{k}x{j}" for j in range(k)]) for k in range(0, 40, 4)]
    rows = [(10 * i + j, t + f" e{j}") for i, t in enumerate(texts) for j in range(2)]
    by_key = jaccard_join._by_key

    def counted(keyed, *args):
        steps.append(keyed.count())
        return by_key(keyed, *args)

    monkeypatch.setattr(jaccard_join, "_by_key", counted)
    monkeypatch.setattr(jaccard_join, "_group_edges", lambda posted, percent: posted.selectExpr("id AS a", "min(id) OVER () AS b"))
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=2).collect()
    want = by_hand_components(rows)
    assert len(set(want.values())) > 3 and len(steps) > 4
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert max(steps) <= 2 * len(rows)


def test_substring_dedup(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [text_words(t) for _, t in rows]
    counts = Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    want = []
    for (doc, _), w in zip(rows, words):
        keep = [True] * len(w)
        for s in range(len(w) - 34):
            if counts[tuple(w[s : s + 35])] > 1:
                keep[s : s + 35] = [False] * 35
        want.append((doc, len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    found = substring_dedup.remove_repeats(docs)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "lang" in found.columns
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0


def test_line_quality(spark, docs):
    menu = "Home | About 2019 | Contact"
    rows = [(i, f"{prose(60)}\n{menu.replace('2019', str(2000 + i))}\n{prose(60)}\n\n{'dup line here' if i else ''}", "h1") for i in range(60)]
    pages = spark.createDataFrame([*rows, (99, menu, "h2"), (98, None, None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_lines.line_quality(pages).collect()}
    assert all(got[i]["n_removed_lines"] == (2 if i else 1) and got[i]["kept"] for i in range(60))
    assert got[99]["n_removed_lines"] == 0 and got[99]["base_failed"] and not got[98]["kept"]
    cleaned = pages.join(quality_lines.line_quality(pages).select("doc_id", "removed_lines"), "doc_id")
    cleaned = cleaned.withColumn("t", quality_lines.without_lines("text", "removed_lines"))
    assert cleaned.where("doc_id < 60 AND (t LIKE '%About%' OR length(t) < 200)").count() == 0
    assert quality_lines.repeat_words("a b c x a b c d") == 6
    assert quality_lines.line_quality(docs).count() == docs.count()
    assert quality_lines.line_quality(docs.where("false")).count() == 0


def test_language_model(spark, docs):
    texts = {"xx": "the cat of the house and the dog ", "yy": "der hund und das haus mit einer katze "}
    rows = [(i, texts[k] * (i % 5 + 1) + str(i), k) for i in range(60) for k in texts]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(labelled, tokenizer("piece_bpe_32k.model"))
    got = lang_id.predict(labelled, model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = {r["text"]: r for r in lang_id.predict(docs, model).collect()}
    assert odd[None]["lang_pred"] == odd[""]["lang_pred"] == "und"
    none = lang_id.train(labelled.where("false"), tokenizer("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in lang_id.predict(docs, none).collect()} == {"und"}
    assert lang_id.predict(docs.where("false"), model).count() == 0


def test_language_bounds():
    pieces = lang_id.vocabulary(tokenizer("piece_bpe_32k.model"))
    assert len(pieces) == 25_628 and "▁accommodation" in pieces  # long ones too
    assert lang_id.TRAIN_DOCS == 2000


def test_language_sample(spark, monkeypatch):
    """Copies neither use up the sample of a language nor outweigh its other texts."""
    rows = [("copied text", "xx")] * 3000 + [(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}", "xx") for i in range(60)]
    rows += [(f"{i}", "yy") for i in range(3000)] + [("einzig", "yy"), ("123", "zz"), (None, "xx"), ("text", None)]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    kept, real = [], lang_id.written
    monkeypatch.setattr(lang_id, "written", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])

    def words(train_docs):
        kept.clear()
        model = lang_id.train(labelled, tokenizer("piece_bpe_32k.model"), rounds=1, train_docs=train_docs)
        counted = {(r["lang"], r["word"]): r["n"] for r in dict(kept)["lang-words"].collect()}
        return model.languages, counted

    languages, all_words = words(100)
    assert languages == ["xx", "yy"]  # zz has no text with a letter
    assert all_words == {**{("xx", "▁" + t): 1 for t in {w for t, k in rows[:3060] for w in t.split()}}, ("yy", "▁einzig"): 1}
    _, some = words(20)
    copied = ("xx", "▁copied") in some
    assert len([k for k in some if k[0] == "xx"]) == 20 + copied and set(some.values()) == {1}


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    p = np.array([[0.3], [0.2], [0.1], [0.15], [0.25], [1e-9], [0]])
    table = lang_id.PieceTable(pieces)

    def total(word):
        if not word:
            return 1.0
        found = sum(p[pieces[word[:n]], 0] * total(word[n:]) for n in (1, 2, 3) if word[:n] in pieces and len(word) >= n)
        return found if found or word[0] in pieces else 1e-9 * total(word[1:])

    for word in ("a", "ab", "aba", "abab", "babab", "axb"):
        got = lang_id.Lattices([word], table).log_probability(p)[0, 0]
        assert got == pytest.approx(np.log(total(word)))
    long = lang_id.Lattices(["ab" * 400], table)
    assert np.isfinite(long.log_probability(p)).all()
    uses = lang_id.Lattices(["abab" * 20], table).expected(p, np.array([3.0]))
    assert uses @ np.array([1, 1, 2, 2, 3, 1, 0]) == pytest.approx(3 * 80)  # pieces cover all characters


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40, pool_pieces=8)])
def test_packing(docs, limits):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = [r.asDict() for r in packing.pack_texts(docs, tokenizer("word_bpe_49k.json"), limits=limits, prompt_tokens=F.lit(3)).collect()]
    want = Counter((r["doc_id"], tuple(model.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    sequences = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        assert r["loss_tokens"] == r["length"] - max(0, min(r["length"], 3 - r["start"]))
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= limits.tokens
        assert len(pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss_tokens
    pieces = Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got)
    expected = Counter()
    for (doc, ids), n in want.items():
        for r in (r for r in got if r["doc_id"] == doc and r["doc_tokens"] == len(ids)):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            if part == bytes(r["ids"]):
                expected[doc, r["start"], part] = pieces[doc, r["start"], part]
    assert expected == pieces
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack_texts(docs.where("false"), tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_goes_on_with_what_a_worker_knows(monkeypatch):
    import pyarrow as pa

    rng, learned, learn = random.Random(21), [], packing.TokenCache.learn
    monkeypatch.setattr(packing.TokenCache, "learn", lambda self, parts: (learned.append(len(parts)), learn(self, parts)))
    texts = [" ".join("".join(rng.choices("qxzjw", k=9)) for _ in range(60)) for _ in range(20)] + [None, "caf\u00e9 \u4e16", ""]
    zeros = [0] * len(texts)
    batch = pa.record_batch([list(range(len(texts))), texts, zeros, zeros], ["doc_id", "text", "prompt", "part"])

    def task(**how):
        found = packing.packer(tokenizer("word_bpe_49k.json"), 1, packing.Limits(), **how)(iter([batch]))
        return pa.Table.from_batches(found).to_pylist()

    alone = task()
    assert task(keep_cache=True) == task(keep_cache=True) == alone
    assert learned[0] == learned[1] > 1000 and learned[2:] == [0]


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights, caps = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 200, "b": 2000, "c": 2000, "d": 0, None: 20}
    want, open_ones, left = {}, set(weights), 1.5 * 2110
    while True:
        level = left / sum(weights[s] for s in open_ones)
        over = {s for s in open_ones if level * weights[s] > caps[s]}
        if not over:
            break
        want |= {s: caps[s] for s in over}
        left, open_ones = left - sum(caps[s] for s in over), open_ones - over
    want |= {s: level * weights[s] for s in open_ones}
    assert got == pytest.approx(want)


def test_mixing(spark, docs):
    rows = [(i, prose(RNG.randrange(1, 80)), f"s{i % 4 if i % 3 else 0}") for i in range(600)]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(some, cells=64).collect()
    again = mixing.mix(some.repartition(5), cells=64).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    taken, target = Counter(), {}
    for r in first:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    for s, t in target.items():
        assert t - 40 <= taken[s] <= t
    found = mixing.mix(docs)
    assert found.count() == docs.count() and mixing.mix(docs.where("false")).count() == 0


def test_mixing_oversized(spark):
    """Documents behind some longer than `near` at the cut get their turn."""
    def key(doc):
        digest = int(hashlib.md5(f"mix:{doc}".encode()).hexdigest()[:13], 16)
        return -math.log((digest + 0.5) / (1 << 52))

    order = sorted(range(400), key=key)
    # for a budget of 10,000: one too long for it, two too long for what is left when they come, and small ones
    sizes = [20_000, 10, 9_995, 20, 9_975, 30] + [50] * 394
    rows = [(doc, " ".join(["w"] * n), "s") for doc, n in zip(order, sizes)]
    rows.append((order[10], *rows[10][1:]))
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = 10_000.5 / (sum(sizes) + 50)
    for cells, fold_rows in ((1, 0), (64, 0), (65_536, 0), (64, 200_000)):
        got = mixing.mix(some, quality=F.lit(1.0), share=share, cells=cells, fold_rows=fold_rows).collect()
        assert len(got) == 401
        copies = {r["doc_id"]: r["copies"] for r in got}
        left, want = 10_000.5, {}
        for i, (doc, n) in enumerate(zip(order, sizes)):
            unit = 2 * n if i == 10 else n
            want[doc] = int(unit <= left)
            left -= unit * want[doc]
        assert left < 50 and copies == want


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(900, 16)).astype(np.float32)
    data[300:340] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1100, [None] * 16), (1200, [1.0]), (None, data[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = permutation_index.nearest(vectors, F.col("vec_id") % 100 == 0, pivots=64, places=32, rerank_share=0.3, block_vectors=250, block_queries=4)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits, exact = 0, data.astype(np.float64)
    assert sorted(found) == list(range(0, 900, 100))
    for q, answers in found.items():
        far = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(900), far))[:10]
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 11))
        assert all(s == pytest.approx(far[v]) for _, v, s in answers)
        hits += len(set(best.tolist()) & {a[1] for a in answers})
    assert hits / (10 * len(found)) >= 0.9
    assert [a[1] for a in found[0]] == list(range(300, 310))  # ties go to smaller ids
    assert permutation_index.nearest(vectors.where("false"), F.lit(True)).count() == 0
    assert permutation_index.nearest(vectors.where("vec_id < 4"), F.lit(True)).count() == 12


def test_neighbours_of_copies(spark):
    """A vector that a third of the rows hold takes one place among those compared."""
    rng = np.random.default_rng(5)
    data = 0.2 * rng.normal(size=(1200, 16)) + np.eye(16)[0]
    data = (data / np.linalg.norm(data, axis=1)[:, None]).astype(np.float32)
    data[rng.permutation(1200)[:400]] = 4 * np.eye(16)[0]  # pivots in the order of the middle, but far away
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = permutation_index.nearest(vectors, F.col("vec_id") % 10 == 0, pivots=64, places=32).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact, hits = data.astype(np.float64), 0
    alone = [q for q in found if data[q, 0] < 2]
    for q in alone:
        answers = found[q]
        far = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(answers & set(np.lexsort((np.arange(1200), far))[:10].tolist()))
    assert len(found) == 120 and hits / (10 * len(alone)) >= 0.95


def test_feistel():
    for n in (1, 2, 3, 5, 64, 1000):
        slots = training_order.feistel_slots(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.feistel_slots(np.arange(1000), 1000, 8) != slots).any()


def test_shards(spark, docs):
    path = new_path(spark, "test-shards")
    found = training_order.materialise(docs, path, tokenizer("word_bpe_49k.json"), key=5, length=64, shard_records=10)
    rows = sorted(found.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    read = training_order.read_slots(spark, path, 0, len(rows), 64, 10).collect()
    assert [r["slot"] for r in read] == list(range(len(rows)))
    import zlib

    for r, x in zip(rows, read):
        assert r["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u2").tobytes())
        assert (r["shard"], r["offset"]) == (r["slot"] // 10, r["slot"] % 10 * 129)
    assert training_order.read_slots(spark, path, 13, 27, 64, 10).count() == min(27, len(rows)) - 13
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    tokens = Counter(i for r in docs.collect() for i in [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    got = Counter(i for r, x in zip(rows, read) for i in x["ids"][: r["n_tokens"]])
    assert got == tokens
    empty = training_order.materialise(docs.where("false"), new_path(spark, "none"), tokenizer("word_bpe_49k.json"), key=5)
    assert empty.count() == 0


MESSAGES = "conv_id long, turn long, kind string, call_id string, name string, arguments string, after string, content string"
SCHEMAS = {"add": {"properties": {"a": "integer", "b": "number"}, "required": ["a"]}}


def test_tool_calls(spark):
    rows = [
        (1, 1, "call", "c", "add", '{"b": 2.5, "a": 1}', "b", None),
        (1, 2, "call", "b", "add", '{"a": true}', "a", None),
        (1, 3, "call", "a", "add", '{"z": 1}', None, None),
        (1, 4, "result", "c", None, None, None, "é\n"),
        (1, 5, "result", "c", None, None, None, "again"),
        (1, 6, "result", "lost", None, None, None, "x"),
        (1, 7, "call", "p", "none", "{}", "q", None),
        (1, 8, "call", "q", "add", "[1]", "p", None),
        (2, 1, "call", "c", "add", "{", "missing", None),
        (2, 2, "call", "c", "add", '{"a": 9}', None, None),
        (None, 1, "call", "c", "add", "{}", None, None),
        (2, 3, "other", "c", None, None, None, None),
        (2, 4, "call", None, "add", "{}", None, None),
    ]
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(spark.createDataFrame(rows, MESSAGES), SCHEMAS).collect()}
    assert len(got) == 7
    c = got[1, "c"]
    assert (c["status"], c["depth"], c["valid"]) == ("linked", 2, True)
    assert c["json"] == '{"arguments":{"a":1,"b":2.5},"id":"c","name":"add","result":"é\\n"}'
    assert got[1, "b"]["errors"] == ["a is not integer"] and got[1, "a"]["errors"] == ["missing a", "unexpected z"]
    assert got[1, "lost"]["status"] == "no_call" and got[1, "p"]["cyclic"] and got[1, "q"]["depth"] is None
    places = sorted((r["position"], k[1]) for k, r in got.items() if k[0] == 1)
    assert [k for _, k in places[:3]] == ["a", "b", "c"]
    assert got[2, "c"]["errors"] == ["not JSON"] and got[2, "c"]["depth"] == 0
    assert tool_calls.link_tool_calls(spark.createDataFrame([], MESSAGES), SCHEMAS).count() == 0


def test_rollup(spark):
    schema = "source string, lang string, tokenizer_version string, kind string, tokens long, old_tokens long"
    path = new_path(spark, "test-rollup")
    one = spark.createDataFrame([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None)], schema)
    two = spark.createDataFrame([("a", "en", "v1", "delete", 5, None), ("a", "en", "v1", "revise", 12, 10)], schema)
    assert token_rollup.totals(spark, path).count() == 0
    assert token_rollup.apply_batch(spark, path, "2", two) and token_rollup.apply_batch(spark, path, "1", one)
    assert not token_rollup.apply_batch(spark, path, "1", one)
    # a batch that failed midway has no marker: it doesn't count, and is written again
    token_rollup.changes_to_deltas(one).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=3")

    def totals(where):
        return sorted(map(tuple, token_rollup.totals(spark, where).collect()), key=str)

    want = [("a", "en", "v1", 1, 12), (None, None, "v1", 1, 0)]
    assert totals(path) == want
    new = new_path(spark, "test-rollup")
    token_rollup.compact(spark, path, new)
    assert totals(new) == want and not token_rollup.apply_batch(spark, new, "2", two)
    with pytest.raises(Exception, match="unknown kind"):
        token_rollup.apply_batch(spark, path, "4", one.withColumn("kind", F.lit("move")))


def test_compaction_that_fails_midway(spark):
    schema = "source string, lang string, tokenizer_version string, kind string, tokens long, old_tokens long"
    path, new = new_path(spark, "test-rollup"), new_path(spark, "test-rollup")
    one = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], schema)
    token_rollup.apply_batch(spark, path, "base-1", one)
    marker, store = token_rollup._hadoop_path(spark, f"{new}/folded/base-1")
    store.create(marker).close()  # the names are there, the totals are not
    with pytest.raises(RuntimeError, match="do it again"):
        token_rollup.totals(spark, new)
    token_rollup.compact(spark, path, new)
    assert not token_rollup.apply_batch(spark, new, "base-1", one)
    assert [r["tokens"] for r in token_rollup.totals(spark, new).collect()] == [10]
    again = new_path(spark, "test-rollup")
    token_rollup.compact(spark, new, again)
    assert not token_rollup.apply_batch(spark, again, "base-1", one)
    assert [r["tokens"] for r in token_rollup.totals(spark, again).collect()] == [10]


def test_rollup_of_tokens(spark, tmp_path):
    """The registered query against tokenizers called text by text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [(r[1], r[2], r[3]) for r in ROWS if r[1] is None or len(r[1]) < 4000] + [("<|endoftext|> " * 60, None, "web")]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    words, small = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    assert public_tokenizers.PATTERN
    small.encode_special_tokens = True
    want = Counter()
    for text, lang, source in texts:
        text = text or ""
        if len(text_words(text)) >= 50:
            for version, n in (("word-49k", len(words.encode(text, add_special_tokens=False).ids) + 1), ("byte-50k", len(small.encode(text, add_special_tokens=False).ids))):
                want[source, lang, version, "docs"] += 1
                want[source, lang, version, "tokens"] += n
    got = QUERIES["op10_rollup"](spark, str(tmp_path)).collect()
    assert {(*r[:3], k): r[k] for r in got for k in ("docs", "tokens")} == want


@pytest.mark.parametrize("sizes, target", [([80_000, 1, 10_000, 1, 9_999, *[5] * 200], 50_000)])
def test_mixing_goes_on_while_something_fits(spark, sizes, target):
    """Documents that don't fit are passed over as often as it takes."""
    rows = [(i, "word " * n, "s") for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(sizes)
    for share in (target / total, 1.5):
        for seed in ("a", "b", "c"):
            got = mixing.mix(df, quality=F.lit(1.0), share=share, seed=seed, fold_rows=50 if seed == "a" else 200_000).collect()
            left = got[0]["target"] - sum(r["taken"] for r in got)
            epochs = got[0]["target"] // total
            assert left >= 0
            assert all(r["size"] > left for r in got if r["copies"] == epochs)


CLASHES = (
    "row doc_ text_crc span_doc span_crc cut guess _guess _key _cell _source epochs full chosen budget_left unit gap words place part spans_ "
    "lang_pred_ seed around first last"
).split()


def test_names_that_operators_use_themselves(spark):
    """Extra columns pass through op2, op3, op7 under any name."""
    values = {c: f"v-{c}" for c in CLASHES}
    rows = [(i, prose(80), "en", f"s{i % 2}", *values.values()) for i in range(6)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {', '.join(f'`{c}` string' for c in CLASHES)}")
    model = lang_id.train(df.select("text", "lang"), tokenizer("piece_bpe_32k.model"))
    for found in (lang_id.predict(df, model), substring_dedup.remove_repeats(df), mixing.mix(df)):
        got = found.select(*CLASHES).collect()
        assert len(got) == 6 and all(r.asDict() == values for r in got)


NESTED = {
    "properties": {
        "mode": {"type": "string", "enum": ["a", "b"]},
        "level": {"type": "integer", "minimum": 1, "maximum": 3},
        "ids": {"type": "array", "items": {"type": "number", "maximum": 9}},
        "where": {"type": "object", "properties": {"x": "number", "deep": {"properties": {"y": "boolean"}, "required": ["y"]}}, "required": ["x"]},
        "flag": {"enum": [1, None]},
    },
    "required": ["mode"],
}


@pytest.mark.parametrize(
    "text, errors",
    [
        ('{"mode": "a", "level": 3, "ids": [1, 2.5], "where": {"x": 1, "deep": {"y": true}}, "flag": null}', []),
        ('{"mode": "c", "level": 0}', ["level is below 1", "mode is none of its values"]),
        ('{"level": 4, "ids": [1, "2", 10], "flag": true}', ["missing mode", "flag is none of its values", "ids[1] is not number", "ids[2] is above 9", "level is above 3"]),
        ('{"mode": "a", "where": {"deep": {"z": 1}}}', ["missing where.x", "missing where.deep.y", "unexpected where.deep.z"]),
        ('{"mode": 1, "level": true, "other": 1}', ["level is not integer", "mode is not string", "unexpected other"]),
        ('{"mode": "a", "level": 1e999}', ["number out of range", "level is not integer"]),
        ('{"mode": "\\ud800"}', ["half of a surrogate pair", "mode is none of its values"]),
        ('{"\\udfff": 1, "mode": "a"}', ["half of a surrogate pair"]),
        ("[1]", ["not an object"]),
        (None, ["not JSON"]),
    ],
)
def test_nested_schemas(text, errors):
    value, found = tool_calls.argument_errors(text, NESTED)
    assert found == errors
    if value is not None:
        tool_calls.canonical_json(value).encode()


def test_calls_that_cannot_be_written_again(spark):
    """They are errors of their rows: the arguments are kept as text."""
    texts = ['{"a": 1e999}', '{"a": "\\ud800"}', '{"a": 1}', '{"a": ' + "[" * 100_000 + "}", '{"a": ' + "9" * 5000 + "}", "x" * 300_000]
    rows = [(1, i, "call", f"c{i}", "add", t, None, None, "extra") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, MESSAGES + ", errors string").repartition(2)
    got = {r["call_id"]: r for r in tool_calls.link_tool_calls(df, SCHEMAS).collect()}
    assert len(got) == 6 and [got[f"c{i}"]["valid"] for i in range(6)] == [False, False, True, False, False, False]
    import json

    for i in (0, 1, 5):
        assert json.loads(got[f"c{i}"]["json"])["arguments"] == texts[i]
