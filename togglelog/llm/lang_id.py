"""Language identification with segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities: a forward
algorithm over the word's characters gives it without listing the ways. A text's log probability is
the sum over its words, and its score is the posterior of the best language under equal priors.

Training is expectation maximisation: the same lattice, read forward and backward, gives the expected
number of times each piece is used. Each round is one Spark job over the word counts of a bounded sample
of labelled documents; its result has at most (languages x pieces) rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from togglelog.llm.storage import as_row, from_row, texts_of, written
from togglelog.llm.words import BASE, mixed

# Bounds of the training sample: distinct texts of each language, and languages.
TRAIN_DOCS = 2000
MAX_LANGUAGES = 1000
ROUNDS = 2
# Characters of the longest piece of the vocabulary (for the size of arrays only), and the share of a
# character that no piece covers.
LONGEST_PIECE = 16
UNKNOWN = 1e-9
# Pseudo-count of every piece in every language.
SMOOTHING = 0.1
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, pieces to rows, and probabilities (piece rows x languages).

    The last two rows are for characters that no piece covers and for places that are no piece.
    """

    languages: list[str]
    pieces: dict[str, int]
    probability: np.ndarray


def vocabulary(model_path: str) -> dict[str, int]:
    """Lower-cased pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kinds = range(model.get_piece_size())
    pieces = (
        model.id_to_piece(i).lower()
        for i in kinds
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )
    return {p: i for i, p in enumerate(sorted({p for p in pieces if p}))}


def text_parts(text: str) -> list[str]:
    """What is scored: lower-cased white-space separated parts in NFC, marked where they start."""
    return ["▁" + w for w in unicodedata.normalize("NFC", text).lower().split()]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class PieceTable:
    """Rows of pieces by hashes of their characters, looked up for whole arrays at once."""

    bits = 20

    def __init__(self, pieces: dict[str, int]):
        self.unknown, self.no_piece = len(pieces), len(pieces) + 1
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(p)
        self.longest = max(by_length, default=1)
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for size, some in by_length.items():
            h = np.zeros(len(some), np.uint64)
            for column in characters(some, size).T:
                h = self.extended(h, column)
            hashes.append(mixed(h))
            rows.append(np.array([pieces[p] for p in some], np.int32))
        self.hashes, self.rows = np.concatenate(hashes), np.concatenate(rows)
        # two tables by different bits of the hash; the few pieces that share a place in both are sorted
        self.tables, rest = [], np.arange(len(self.hashes))
        for shift in (0, self.bits):
            table = np.full(1 << self.bits, -1, np.int32)
            at = self.place(self.hashes[rest], shift)
            table[at] = rest
            self.tables.append(table)
            rest = rest[table[at] != rest]
        self.rest = rest[np.argsort(self.hashes[rest])]

    @staticmethod
    def extended(h: np.ndarray, column: np.ndarray) -> np.ndarray:
        return h * np.uint64(BASE) + column.astype(np.uint64) + np.uint64(1)

    def place(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of substrings with these (unmixed) hashes; `no_piece` for others."""
        h = mixed(h)
        out = np.full(len(h), self.no_piece, np.int32)
        if not len(self.hashes):
            return out
        for shift, table in zip((0, self.bits), self.tables):
            at = table[self.place(h, shift)]
            hit = (at >= 0) & (self.hashes[at] == h)
            out[hit] = self.rows[at[hit]]
        if len(self.rest):
            sorted_hashes = self.hashes[self.rest]
            at = np.minimum(np.searchsorted(sorted_hashes, h), len(self.rest) - 1)
            hit = sorted_hashes[at] == h
            out[hit] = self.rows[self.rest[at[hit]]]
        return out


def characters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length (words x length)."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class Lattices:
    """All ways to cut words of one length into pieces, and sums over them.

    rows[size - 1][:, start] has the piece row of each word's substring. Sums are kept as logarithms of
    scaled numbers, so that words of any length are exact enough.
    """

    def __init__(self, words: list[str], table: PieceTable):
        self.length, self.count = len(words[0]), len(words)
        codes, h, self.rows = characters(words, self.length), None, []
        for size in range(1, min(self.length, table.longest) + 1):
            n = self.length - size + 1
            h = table.extended(np.zeros((self.count, n), np.uint64) if h is None else h[:, :n], codes[:, size - 1 :])
            found = table.find(h.ravel()).reshape(h.shape)
            if size == 1:
                found[found == table.no_piece] = table.unknown
            self.rows.append(found)

    def forward(self, probability: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums over the segmentations of each prefix (scaled: words x languages), and log scales."""
        alpha = [np.ones((self.count, probability.shape[1]))]
        scale = np.zeros((self.length + 1, self.count))
        for end in range(1, self.length + 1):
            total = np.zeros_like(alpha[0])
            for size in range(1, min(len(self.rows), end) + 1):
                part = alpha[end - size] * probability[self.rows[size - 1][:, end - size]]
                if size > 1:
                    shift = scale[end - size] - scale[end - 1]
                    if shift.any():
                        part *= np.exp(shift)[:, None]
                total += part
            scale[end] = scale[end - 1]
            if end % 16 == 0:
                top = np.maximum(total.max(axis=1), 1e-300)
                total /= top[:, None]
                scale[end] += np.log(top)
            alpha.append(total)
        return alpha, scale

    def log_probability(self, probability: np.ndarray) -> np.ndarray:
        alpha, scale = self.forward(probability)
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one language (probability: one column), summed over words."""
        alpha, scale = self.forward(probability)
        p = probability[:, 0]
        log_all = np.log(np.maximum(alpha[-1][:, 0], 1e-300)) + scale[-1]
        # beta[i]: scaled sums over the segmentations of what follows place i
        beta, back = [np.ones(self.count)] * (self.length + 1), np.zeros((self.length + 1, self.count))
        used, shares = [], []
        for start in range(self.length - 1, -1, -1):
            total = np.zeros(self.count)
            for size in range(1, min(len(self.rows), self.length - start) + 1):
                rows = self.rows[size - 1][:, start]
                through = p[rows] * beta[start + size]
                total += through * np.exp(back[start + size] - back[start + 1])
                log_rest = scale[start] + back[start + size] - log_all
                used.append(rows)
                shares.append(np.minimum(alpha[start][:, 0] * through * np.exp(np.minimum(log_rest, 700)), 1) * counts)
            back[start] = back[start + 1]
            if (self.length - start) % 16 == 0:
                top = np.maximum(total, 1e-300)
                total = total / top
                back[start] = back[start] + np.log(top)
            beta[start] = total
        return np.bincount(np.concatenate(used), np.concatenate(shares), len(p))


def by_length(words: list[str], cells: int = 1_000_000) -> Iterator[np.ndarray]:
    """Indexes of words in groups of one length, none too large to be worked on at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(words) else ():
        rows = max(1, cells // (int(lengths[group[0]]) * LONGEST_PIECE))
        for at in range(0, len(group), rows):
            yield group[at : at + rows]


def train(docs: DataFrame, model_path: str, rounds: int = ROUNDS, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fit a model on docs (text, lang): rows with a lang and a letter in the text.

    Of each language `train_docs` distinct texts are used, or all if there are fewer, each once however
    often it is repeated: those with the least hashes. Without any such row the model has no language.
    """
    labelled = texts_of(docs).where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    distinct = written(labelled.select("lang", "hash").distinct(), "lang-texts")
    sizes = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes, key=lambda x: x.encode("utf-8", "surrogatepass"))
    pieces = vocabulary(model_path)
    shape = (len(pieces) + 2, len(languages))
    probability = np.full(shape, 1 / max(1, len(pieces)))
    probability[-2], probability[-1] = UNKNOWN, 0
    if not languages:
        return LanguageModel(languages, pieces, probability)
    place = {x: i for i, x in enumerate(languages)}
    # a share of the hashes that holds the least `train_docs` of them for sure, and those
    grid = 1 << 30
    share = {x: min(grid, int((2 * train_docs + 200) / n * grid)) for x, n in sizes.items()}
    part = F.create_map(*[F.lit(y) for x in languages for y in (x, share[x])])
    drawn = F.pmod("hash", F.lit(grid))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "hash"))
    least = distinct.where(drawn < part[F.col("lang")]).withColumn("turn", turn).where(F.col("turn") <= train_docs)
    least = written(least.select("lang", "hash"), "lang-sample")
    sample = labelled.where(drawn < part[F.col("lang")]).join(F.broadcast(least), ["lang", "hash"], "left_semi")
    sample = sample.select("lang", "hash", "text").mapInArrow(first_of_each, "lang string, hash long, text string")
    sample = sample.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")
    counted = written(sample.mapInArrow(count_words(), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    for _ in range(rounds):
        found = counted.mapInArrow(expectation(pieces, place, probability), "lang int, piece int, n double")
        table = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        uses = np.zeros(shape)
        uses[table["piece"], table["lang"]] = table["n"]
        uses = uses[:-2] + SMOOTHING
        probability = np.concatenate((uses / uses.sum(axis=0), np.full((1, shape[1]), UNKNOWN), np.zeros((1, shape[1]))))
    return LanguageModel(languages, pieces, probability)


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (lang, hash) that a task meets; it remembers no more than the sample has."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        new = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if new:
            yield batch.take(pa.array(new, pa.int64()))


def count_words() -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    found.setdefault(lang, Counter()).update(text_parts(text))
            for lang, words in found.items():
                yield pa.record_batch([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    return count


def expectation(pieces: dict[str, int], place: dict[str, int], probability: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = PieceTable(pieces), np.zeros(probability.shape)
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            words, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            for k in np.unique(langs):
                own = np.flatnonzero(langs == k)
                mine = [words[i] for i in own]
                for group in by_length(mine):
                    lattices = Lattices([mine[i] for i in group], table)
                    total[:, k] += lattices.expected(probability[:, [k]], counts[own[group]])
        piece, lang = np.nonzero(total)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])], ["lang", "piece", "n"])

    return run


class WordScores:
    """Log probabilities of words in all languages, remembered for at most `limit` words, `numbers` in all."""

    limit, numbers = 200_000, 4_000_000

    def __init__(self, model: LanguageModel):
        self.languages, self.probability = model.languages, model.probability
        self.table = PieceTable(model.pieces)
        self.rows: dict[str, int] = {}
        self.limit = min(self.limit, max(2000, self.numbers // max(1, len(model.languages))))
        self.scores = np.empty((self.limit, len(model.languages)))

    def of(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        """Rows of the words, and the scores by row."""
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.limit:
            self.rows, new = {}, list(words)
        start = len(self.rows)
        if start + len(new) > len(self.scores):  # more words at once than are remembered
            self.scores = np.empty((start + len(new), len(self.languages)))
        for group in by_length(new):
            some = [new[i] for i in group]
            self.scores[start + group] = Lattices(some, self.table).log_probability(self.probability)
        self.rows.update(zip(new, range(start, start + len(new))))
        return self.rows, self.scores


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred (string) and score (double, 0 to 1: the posterior of lang_pred).

    A null text, or one without a letter, is `und` with score 0, as is every text if the model has no
    language. Only the text is looked at. Ties go to the first language in code point order. Other
    columns are passed on, those named like the new ones are replaced; an empty table stays empty.
    """
    import pandas as pd

    # at most languages x pieces numbers
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probability))

    def run(batches):
        scorer = WordScores(LanguageModel(*shared.value))
        languages = scorer.languages
        for texts in batches:
            out: list[tuple[str, float]] = []
            values = texts.tolist()
            for at in range(0, len(values), 500):
                split = [text_parts(t) if languages and has_letter(t) else [] for t in values[at : at + 500]]
                rows, scores = scorer.of(set().union(*split))
                for words in split:
                    if not words:
                        out.append((UNDETERMINED, 0.0))
                        continue
                    total = scores[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    out.append((languages[best], float(1 / np.exp(total - total[best]).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    guess = F.pandas_udf(run, "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    guessed = texts_of(docs).select(as_row(rest), guess(F.col("text").cast("string")).alias("guess"))
    return guessed.select(*from_row(rest), "guess.*")
