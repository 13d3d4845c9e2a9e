"""Vector bin packing of tokenised examples into fixed-length training sequences.

Each task packs the examples it reads, so nothing is shuffled and no state is shared. Examples
longer than a sequence are cut into full sequences; what remains is placed a pool at a time. A
sequence has limits on tokens, on segments and on loss-bearing tokens. The dot-product heuristic opens
a sequence and keeps adding the piece whose demand vector has the largest dot product with what is
left of the capacities, each dimension weighed by how scarce it is in the pool. A hole that no
piece fits is filled with a part of a longer piece, if pieces may be cut. The sequences that stay
short at the end of a task, one or a few, are cut at powers of two, where they need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from togglelog.llm.storage import texts_of
from togglelog.llm.words import kept

SCHEMA = (
    "doc_id long, start long, length long, loss_tokens long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


@dataclass(frozen=True)
class Limits:
    """Of one sequence. A pool holds at most `pool_tokens` tokens or `pool_pieces` pieces."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool_tokens: int = 500_000
    pool_pieces: int = 8192


def pack_texts(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), prompt_tokens: Column | None = None,
    keep_cache: bool = False,
) -> DataFrame:
    """Pieces of tokenised texts and their places: SCHEMA, one row for each piece.

    `ids` are little-endian unsigned 32-bit ids; a document's pieces together are its ids and
    `end_id`. `start` counts from the document's first id, `offset` from the sequence's. The first
    `prompt_tokens` ids of a document bear no loss (default: all bear loss; null or negative: none
    are prompt). A null or empty text is `end_id` alone. Repeated rows are packed one by one; a null
    doc_id is passed on; other columns are ignored; an empty table gives an empty result.
    Tokens, segments and loss-bearing tokens stay within the limits in every sequence. With `keep_cache`
    a worker's tasks share the ids they have looked up (see `token_cache`), which saves time and takes memory.
    """
    prompt = F.lit(0) if prompt_tokens is None else F.greatest(F.coalesce(prompt_tokens, F.lit(0)), F.lit(0))
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        prompt.cast("long").alias("prompt"),
        # tells tasks apart in sequence_id; a task that is repeated has the same number
        F.spark_partition_id().cast("long").alias("part"),
    ]
    return texts_of(docs).select(*columns).mapInArrow(packer(tokenizer_path, end_id, limits, keep_cache), SCHEMA)


# The tokenizer's own split of lower-cased text, spelled out for characters below U+0180,
# where composing changes nothing and lower case is a character's own. Others, and what may be a
# special token, are left to the tokenizer.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\t-\r \u0085\u00a0"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_OTHER = re.compile("[\u0130\u0180-\U0010ffff]|<\\|")


class TokenCache(dict):
    """Ids (as bytes) of parts of texts, for a word tokenizer that lower-cases and drops white space.

    Such a tokenizer's ids of a text are those of the parts it splits the text into, one after the
    other. At most `limit` parts are remembered.
    """

    limit = 250_000

    def __init__(self, path: str):
        self.tokenizer = kept(f"tokenizer:{path}", lambda: read_tokenizer(path))

    def learn(self, parts: set[str]) -> None:
        new = list(parts)
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            # one call for many parts: white space keeps them apart
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            words = np.array(found.word_ids, np.int64)
            cuts = np.flatnonzero(np.diff(words)) + 1
            if len(cuts) + 1 == len(some):
                data, at_byte = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
                self.update(zip(some, map(data.__getitem__, map(slice, at_byte, at_byte[1:]))))
            else:
                for x in some:
                    self[x] = self.whole(x)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        unknown = set().union(*split).difference(self)
        if self and len(self) + len(unknown) > self.limit:
            self.clear()
            unknown = set().union(*split)
        self.learn(unknown)
        return [b"".join(map(self.__getitem__, parts)) for parts in split]

    def parts(self, text: str | None) -> list[str]:
        if text is None:
            return []
        if not _OTHER.search(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for word in text.encode("utf-8", "replace").decode().split(" "):
            if not _OTHER.search(word):
                out += _PARTS.findall(word.lower())
            else:
                if word not in self:
                    self[word] = self.whole(word)
                out.append(word)
        return out


def token_cache(path: str) -> TokenCache:
    """The cache of this Python worker, which goes on from task to task and holds twice as much.

    It takes memory for as long as the worker lives: not for a pipeline whose other stages have caches of their own.
    """
    cache = kept(f"tokens:{path}", lambda: TokenCache(path))
    cache.limit = 2 * TokenCache.limit
    return cache


def read_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Packer:
    """Packs pieces (document row, start, tokens, loss tokens) pool by pool."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.pool: list[tuple[int, int, int, int]] = []
        self.pooled = 0

    def add(self, doc: int, tokens: int, prompt: int) -> Iterator[list[tuple[int, int, int, int]]]:
        """Full sequences cut from a document; the rest goes to the pool."""
        most, start = self.limits.tokens, 0
        while start < tokens:
            size = min(most, tokens - start)
            bare = max(0, min(size, prompt - start))
            size = min(size, bare + self.limits.loss_tokens)
            piece = (doc, start, size, size - bare)
            start += size
            if size == most:
                yield [piece]
            else:
                self.pool.append(piece)
                self.pooled += size

    def full(self) -> bool:
        return self.pooled >= self.limits.pool_tokens or len(self.pool) >= self.limits.pool_pieces

    def pack(self, prompts: dict[int, int], last: bool) -> Iterator[list[tuple[int, int, int, int]]]:
        """Pack the pool into sequences. Parts left over, and a short last sequence, stay in it.

        If it is the last pool, repeated calls empty it.
        """
        pieces, self.pool, self.pooled = self.pool, [], 0
        if not pieces:
            return
        demand = np.array([(p[2], 1, p[3]) for p in pieces], np.float64) / self.capacity
        scarce = demand.sum(axis=0)
        weight = scarce / scarce.sum()
        # pieces of equal demand are one kind; a sequence then looks at kinds, not at pieces
        kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
        stacks: list[list[int]] = [[] for _ in range(len(kinds))]
        for i, k in enumerate(kind_of.tolist()):
            stacks[k].append(i)
        left = np.array([len(s) for s in stacks])
        weighed = kinds * weight
        total = int(left.sum())
        while total:
            free, sequence = np.ones(3), []
            while total:
                fits = (left > 0) & (kinds <= free + 1e-9).all(axis=1)
                if not fits.any():
                    break
                k = int(np.where(fits, weighed @ free, -1.0).argmax())
                piece = pieces[stacks[k].pop()]
                left[k] -= 1
                total -= 1
                sequence.append(piece)
                free = free - kinds[k]
            hole = self.limits.tokens - sum(p[2] for p in sequence)
            loss = self.limits.loss_tokens - sum(p[3] for p in sequence)
            if hole and total and len(sequence) < self.limits.segments:
                # a part of the shortest longer piece fills the hole
                longer = np.flatnonzero(left > 0)
                k = int(longer[np.argmin(kinds[longer, 0])])
                doc, start, size, _ = pieces[stacks[k][-1]]
                bare = max(0, min(size, prompts[doc] - start))
                part = min(hole, size - 1, bare + loss)
                if part > 0:
                    stacks[k].pop()
                    left[k] -= 1
                    total -= 1
                    in_bare = min(part, bare)
                    sequence.append((doc, start, part, part - in_bare))
                    rest = (doc, start + part, size - part, size - part - (bare - in_bare))
                    self.pool.append(rest)  # waits for the next pool, or for the next round below
                    self.pooled += rest[2]
            size = sum(p[2] for p in sequence)
            if total or size == self.limits.tokens or (last and not self.pool):
                yield sequence
            else:
                self.pool += sequence
                self.pooled += size


def at_powers_of_two(sequence: list[tuple[int, int, int, int]], prompts: dict[int, int]) -> Iterator[list]:
    """Cut a short sequence into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in sequence)
    pieces = sequence[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            doc, start, length, loss = pieces.pop()
            part = min(size, length)
            bare = max(0, min(length, prompts[doc] - start))
            in_bare = min(part, bare)
            out.append((doc, start, part, part - in_bare))
            if part < length:
                pieces.append((doc, start + part, length - part, loss - (part - in_bare)))
            size -= part
        yield out


def packer(tokenizer_path: str, end_id: int, limits: Limits, keep_cache: bool = False) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer_path) if keep_cache else TokenCache(tokenizer_path)
        state = Packer(limits)
        # of the documents with pieces in the pool
        doc_ids: dict[int, int | None] = {}
        ids: dict[int, bytes] = {}
        prompts: dict[int, int] = {}
        seen, sequences, out = 0, 0, []

        def place(sequence: list[tuple[int, int, int, int]]) -> None:
            nonlocal sequences
            offset = 0
            for doc, start, size, loss in sequence:
                data = ids[doc]
                out.append(
                    (doc_ids[doc], start, size, loss, data[4 * start : 4 * (start + size)], len(data) // 4, base + sequences, offset)
                )
                offset += size
            sequences += 1

        def forget() -> None:
            alive = {p[0] for p in state.pool}
            for table in (doc_ids, ids, prompts):
                for doc in table.keys() - alive:
                    del table[doc]

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out), 5000):
                some = zip(*out[at : at + 5000])
                yield pa.record_batch(
                    [pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(some)], names
                )
            out.clear()

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        base = 0
        for batch in batches:
            base = batch.column(3)[0].as_py() << 36 if batch.num_rows else base
            for first in range(0, batch.num_rows, 500):
                doc_column, text, prompt, _ = (batch.column(k).slice(first, 500).to_pylist() for k in range(4))
                for doc_id, data, n in zip(doc_column, cache.encode(text), prompt):
                    ids[seen], doc_ids[seen], prompts[seen] = data + end, doc_id, n
                    for sequence in state.add(seen, len(ids[seen]) // 4, n):
                        place(sequence)
                    seen += 1
                    if state.full():
                        for sequence in state.pack(prompts, last=False):
                            place(sequence)
                        forget()
                        yield from rows()
                forget()
                yield from rows()
        while state.pool:
            for sequence in state.pack(prompts, last=True):
                total = sum(p[2] for p in sequence)
                for part in [sequence] if total == limits.tokens else at_powers_of_two(sequence, prompts):
                    place(part)
        yield from rows()

    return run
