"""Repair of conversations by a grammar-compressed dynamic program.

A row is one symbol: the initial of its role (s, u, a or another) with whether its text is truncated, or the
symbol of a row that must go (blank or duplicate). A repair edits the symbols until the initials match
(s?(ua)+)?: Keep 0, Rerole to user or assistant 1, Delete 2, Insert a user or an assistant 5, and 5 for
every truncated row that stays. Among the cheapest the one with the least string of edit initials counts.

An edit moves between four states (nothing yet, after s, after u, after a). So a symbol is a min-plus matrix:
for each pair of states the least cost and the edits, and a sequence of symbols is the product of theirs. Two
different strings of edits for the same rows, states and cost are never one the prefix of the other (it would
differ by insertions only, which cost), so the least string of a product is made of the least strings
of its factors, and the product may be taken in any grouping. That is used three times:

1. Long conversations are cut into pieces, each worked on by itself; the pieces' matrices are multiplied.
2. Pieces with the same symbols, in any conversations, are one shape, which is worked out once.
3. Shapes are compressed by Re-Pair: the most frequent pairs of symbols, counted over all shapes, become rules,
   round by round. A rule's matrix is the product of its two symbols' matrices, made once, bottom-up. Its
   strings are ropes: they point to the parts they are made of and share these.

The order of rows comes from range partitions of light rows (a hash of the text, no text). The texts
follow the edits at the end, in one sorted stream.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import Column, DataFrame, Window, functions as F

from togglelog.llm.storage import texts_of, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Symbols of rows: the initial, in upper case if the text is truncated; o is any other initial, x must go.
ROLES, GONE = "suao", "x"
FIRST_RULE = 0x100
# Re-Pair: rounds, and rules a round, each of other symbols; a pair becomes a rule if it is met so often.
ROUNDS, RULES_A_ROUND, LEAST_COUNT = 8, 16, 4
# Symbols of a piece.
PIECE = 65_536

Rope = str | tuple
Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


# --- the min-plus matrices ---------------------------------------------------------------------


def leaves(rope: Rope) -> Iterator[str]:
    """The strings of a rope, from left to right."""
    todo = [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            yield part
        else:
            todo += (part[1], part[0])


def flat(rope: Rope) -> str:
    return "".join(leaves(rope))


def joined(a: Rope, b: Rope) -> Rope:
    """A rope of both; short ones are written out."""
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64:
        return a + b
    return (a, b)


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    """The cheaper of two entries; of equally cheap ones that with the least string."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or flat(a[1]) <= flat(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Entry | None] = [None] * 4
        for first, rest in zip(row, b):
            if first is not None:
                for j, last in enumerate(rest):
                    if last is not None:
                        cost = first[0] + last[0]
                        if line[j] is None or cost <= line[j][0]:
                            line[j] = better(line[j], (cost, joined(first[1], last[1])))
        out.append(line)
    return out


def product_of(matrices: list[Matrix]) -> Matrix:
    """The product of a sequence, neighbours first, so that ropes stay shallow."""
    if not matrices:
        return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    while len(matrices) > 1:
        pairs = [product(*matrices[i : i + 2]) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


# The state after a user or an assistant, from each state that may be followed by it.
AFTER = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}


def insertions() -> Matrix:
    """Any number of insertions; the empty string is the cheapest way to stay."""
    found: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    one: Matrix = [[None] * 4 for _ in range(4)]
    for initial in "ua":
        for before, after in AFTER[initial].items():
            one[before][after] = (INSERT, "I")
    for _ in range(3):
        more = product(found, one)
        found = [[better(x, y) for x, y in zip(*rows)] for rows in zip(found, more)]
    return found


def symbol_matrices() -> dict[str, Matrix]:
    """One matrix for each symbol of a row, with the insertions before the row."""
    before, out = insertions(), {}
    for symbol in [*ROLES, *ROLES.upper(), GONE]:
        edits: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
        if symbol != GONE:
            extra = TRUNCATED if symbol.isupper() else 0
            for i in range(4):
                for initial, cost, name in ((symbol.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                    j = AFTER.get(initial, {}).get(i)
                    if j is not None:
                        edits[i][j] = better(edits[i][j], (cost + extra, name))
        out[symbol] = product(before, edits)
    return out


def best_repair(matrix: Matrix) -> tuple[int, str]:
    """Cost and edits from the whole conversation's matrix."""
    last = product(matrix, insertions())
    cost, rope = better(last[0][0], last[0][3])
    return cost, flat(rope)


# --- Re-Pair --------------------------------------------------------------------------------------


def compressed(symbols: str, rules: list[str]) -> str:
    """Symbols with each rule's pair replaced, in the order of the rules."""
    for i, pair in enumerate(rules):
        if pair[0] in symbols:
            symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


def pair_counts(symbols: str) -> Counter:
    """How often each pair of neighbours could be replaced."""
    found = Counter(map("".join, zip(symbols, symbols[1:])))
    for pair in [p for p in found if p[0] == p[1]]:
        found[pair] = symbols.count(pair)
    return found


def learn_rules(shapes: DataFrame, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> list[str]:
    """Rules for shapes (symbols, n): at most rounds * a_round pairs. A round reads the shapes once."""
    rules: list[str] = []
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for pair, k in pair_counts(compressed(symbols, rules)).items():
                        total[pair] += n * k
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        counted = shapes.select("symbols", "n").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        # pairs of a round share no symbol, so one rule takes nothing from another
        used, found = set(), []
        for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(4 * a_round).collect():
            if not used & set(r["pair"]) and len(found) < a_round:
                used |= set(r["pair"])
                found.append(r["pair"])
        if not found:
            break
        rules += found
    return rules


def grammar_matrices(rules: list[str]) -> dict[str, Matrix]:
    """Matrices of all symbols, the rules' bottom-up."""
    found = symbol_matrices()
    for i, pair in enumerate(rules):
        found[chr(FIRST_RULE + i)] = product(found[pair[0]], found[pair[1]])
    return found


# --- rows ---------------------------------------------------------------------------------------


SPACE = r"[\x20\x09-\x0D]"


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def order_key() -> list[Column]:
    """The order of a conversation's rows: by turn (null first); equal turns by role and text as they come in."""
    return [F.col("turn").asc_nulls_first(), F.col("role0").asc(), F.col("digest0").asc()]


def faults(rows: DataFrame) -> DataFrame:
    """Light rows (conv_id, turn, role0, digest0, first, n, symbol, repeated, role) of rows (conv_id, turn, role,
    text, role0, digest0, copies).

    Rows equal in all are one with their number n: the first of them has `symbol`, or is a duplicate of an
    earlier row where `first` is false; the others are duplicates of it. `blank` rows are blank all."""
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = ~text.rlike(rf"(?s)[.!?]{SPACE}*\z")
    same = ["conv_id", "turn", "role0", "digest0", "role", "digest", "blank", "cut"]
    light = rows.select(
        "conv_id", "turn", "role0", "digest0", "role", F.unhex(F.md5(text)).alias("digest"), blank.alias("blank"), cut.alias("cut"), "copies"
    )
    light = written(light.groupBy(*same).agg(F.sum("copies").alias("n")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"), "role0", "digest0")
    group = ["conv_id", "role", "digest"]
    earliest = light.groupBy(*group).agg(F.min(place).alias("earliest")).withColumnsRenamed({c: f"_{c}" for c in group})
    both = light.join(earliest, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    letter = F.when(initial(F.col("role")).isin(*"sua"), initial(F.col("role"))).otherwise(F.lit("o"))
    symbol = F.when(F.col("blank"), F.lit(GONE)).when(F.col("cut"), F.upper(letter)).otherwise(letter)
    return both.select("conv_id", "turn", "role0", "digest0", "role", "n", "blank", "cut", symbol.alias("symbol"), (place == F.col("earliest")).alias("first"))


def _pieces(piece: int) -> Callable:
    """From light rows in order: one row for each piece of a conversation, with the figures that add up."""
    names = ["conv_id", "part", "piece", "symbols", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(at: list) -> list:
            return [*at[:3], "".join(at[3]), *at[4:]]

        def batch_of(found: list, kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, k or kind) for c, k in zip(zip(*found), kinds)]
            return pa.record_batch(columns, names)

        now, number, kind, size = None, 0, None, 0
        for batch in batches:
            out = []
            kind = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "n", "blank", "cut", "symbol", "first"))
            for conv, part, turn, role, n, blank, cut, symbol, first in zip(*columns):
                head = role[:1]
                while n:
                    if now is None or conv != now[0] or size >= piece:
                        if now is not None:
                            out.append(row(now))
                        number, size = number + 1, 0
                        now = [conv, part, number, [], 0, 0, 0, 0, head, None, None, None, 0]
                    k = min(n, piece - size)
                    if blank:
                        new = GONE * k
                        now[4] += k
                    else:
                        new = (symbol if first else GONE) + GONE * (k - 1)
                        now[5] += k - bool(first)
                        now[6] += bool(first and cut)
                    now[3].append(new)
                    if now[9] is not None:
                        now[7] += (now[9] + head) not in LEGAL
                    now[7] += (k - 1) * ((head + head) not in LEGAL)
                    now[9] = head
                    if turn is not None:
                        if now[10] is None:
                            now[10] = turn
                        now[12] += turn != now[11]
                        now[11] = turn
                    n, size, first = n - k, size + k, False
            if out:
                yield batch_of(out, kind)
        if now is not None:
            yield batch_of([row(now)], kind)

    return run


LEGAL = ("su", "ua", "au")


def _evaluator(rules: list[str]) -> Callable:
    """Shapes with their repair, if a shape is a whole conversation, and their matrix as texts and costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = grammar_matrices(rules)
        for batch in batches:
            out = []
            for symbols, alone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matrix = product_of([matrices[c] for c in compressed(symbols, rules)])
                cost, audit = best_repair(matrix) if alone else (None, None)
                entries = None if alone else [(i, j, x[0], flat(x[1])) for i, line in enumerate(matrix) for j, x in enumerate(line) if x is not None]
                out.append({"symbols": symbols, "alone": alone, "cost": cost, "audit": audit, "entries": entries})
            yield pa.RecordBatch.from_pylist(out, schema=SHAPE)

    return run


ENTRY = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
SHAPE = pa.schema([("symbols", pa.string()), ("alone", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("entries", pa.list_(ENTRY))])
SHAPE_DDL = "symbols string, alone boolean, cost long, audit string, entries array<struct<i:int,j:int,cost:long,edits:string>>"


def _combine(key: tuple, pieces: pa.Table) -> pa.Table:
    """The repair of a conversation from its pieces' matrices."""
    matrices = []
    for r in sorted(pieces.select(["part", "piece", "entries"]).to_pylist(), key=lambda r: (r["part"], r["piece"])):
        matrix: Matrix = [[None] * 4 for _ in range(4)]
        for x in r["entries"]:
            matrix[x["i"]][x["j"]] = (x["cost"], x["edits"])
        matrices.append(matrix)
    cost, audit = best_repair(product_of(matrices))
    return pa.table([pieces.column("conv_id").slice(0, 1), pa.array([cost], pa.int64()), pa.array([audit])], ["conv_id", "cost", "audit"])


def repair(rows: DataFrame, piece: int = PIECE, rounds: int = ROUNDS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows as `ordered_rows` gives them.

    There is a row for each conv_id, null among them; an empty table gives none. Texts are whole, of any length;
    repeated rows are duplicates. `edited_rows` and `repaired_digests` take rows and result on to the repaired texts.
    """
    light = written(faults(rows), "faults")
    sort = ["conv_id", *order_key()]
    ranged = light.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id().cast("long"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = "blank long, duplicate long, truncated long, illegal long"
    turns = "first_turn long, last_turn long, turns long"
    pieces = ranged.mapInArrow(
        _pieces(piece), f"conv_id {kind}, part long, piece long, symbols string, {counts}, first_role string, last_role string, {turns}"
    )
    pieces = written(pieces, "pieces")

    by_conv = Window.partitionBy("conv_id").orderBy("part", "piece")
    border = F.concat(F.lag("last_role").over(by_conv), "first_role")
    # the last turn before a piece, over pieces without turns
    turn = F.last("last_turn", ignorenulls=True).over(by_conv.rowsBetween(Window.unboundedPreceding, -1))
    linked = pieces.withColumn("across", F.coalesce((~border.isin(*LEGAL)).cast("long"), F.lit(0)))
    linked = linked.withColumn("again", F.coalesce((turn == F.col("first_turn")).cast("long"), F.lit(0)))
    spread = F.max("last_turn") - F.min("first_turn") + 1 - (F.sum("turns") - F.sum("again"))
    figures = linked.groupBy("conv_id").agg(
        F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("across")).alias("illegal"),
    )
    sized = written(pieces.select("conv_id", "part", "piece", "symbols").withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("conv_id")) == 1), "shaped")
    shapes = written(sized.groupBy("symbols", "alone").agg(F.count(F.lit(1)).alias("n")), "shapes")
    rules = learn_rules(shapes, rounds)
    solved = written(shapes.select("symbols", "alone").mapInArrow(_evaluator(rules), SHAPE_DDL), "solved")
    on = ["symbols", "alone"]
    alone = sized.where("alone").join(solved, on).select("conv_id", "cost", "audit")
    cut = sized.where("NOT alone").join(solved, on).select("conv_id", "part", "piece", "entries")
    several = cut.groupBy("conv_id").applyInArrow(_combine, f"conv_id {kind}, cost long, audit string")
    repairs = written(alone.unionByName(several), "repairs")
    figures = figures.withColumnRenamed("conv_id", "_conv").join(repairs, F.col("_conv").eqNullSafe(F.col("conv_id")))
    return figures.drop("_conv")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with what their order needs.

    conv_id may be null, which is a conversation like others; a null role or text is one space; rows are in the
    order of turn (null first), equal turns by role and text (by its hash). A row with `copies` k (default 1) stands k times
    in its place; `role0` and `digest0`, where given, are ordered by instead. Other columns are dropped.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    text = space["text"]
    role0 = F.col("role0") if "role0" in rows.columns else space["role"]
    digest0 = F.col("digest0") if "digest0" in rows.columns else F.unhex(F.md5(text))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), space["role"].alias("role"), text.alias("text"), role0.alias("role0"),
        digest0.alias("digest0"), copies.cast("long").alias("copies"),
    )


def _with_edits(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows in order, each conversation's edits in front of them."""
    nothing = F.lit(None).cast("string")
    lines = rows.withColumn("edits", nothing).withColumn("side", F.lit(1))
    heads = repairs.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), nothing.alias("role0"),
        F.lit(None).cast("binary").alias("digest0"), F.lit(0).cast("long").alias("copies"), F.col("audit").alias("edits"), F.lit(0).alias("side"),
    )
    met = texts_of(lines.unionByName(heads)).repartition("conv_id").sortWithinPartitions("conv_id", "side", *order_key())
    return met.select("conv_id", "side", "role", "text", "copies", "edits")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text) of each repaired row, after (conv_id, -1, None, None) for each conversation."""
    conv, edits, at, place, last = None, "", 0, 0, ""

    def rows(until: str) -> Iterator[tuple]:
        """Insertions, up to an edit of another kind."""
        nonlocal at, place, last
        while edits[at : at + 1] == until:
            last = "a" if last == "u" else "u"
            yield conv, place, "assistant" if last == "a" else "user", ""
            at, place = at + 1, place + 1

    for batch in batches:
        for now, side, role, text, copies, new in zip(*(c.to_pylist() for c in batch.columns)):
            if side == 0:
                yield from rows("I")
                conv, edits, at, place, last = now, new, 0, 0, ""
                yield conv, -1, None, None
            for _ in range(copies):
                yield from rows("I")
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "assistant" if last == "u" else "user"
                last = role[:1]
                yield conv, place, role, text
                place += 1
    yield from rows("I")


def edited_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of ordered_rows after the edits of repairs (conv_id, audit)."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import batched

        schema = pa.schema([("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for some in batched((r for r in _edit(batches) if r[1] >= 0), 1000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return _with_edits(rows, repairs).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def repaired_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of `role:text` of all repaired rows, joined by newlines; texts are not kept."""
    kind = rows.schema["conv_id"].dataType

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, conv = None, None
        for now, place, role, text in _edit(batches):
            if place < 0:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = now, hashlib.sha256()
            else:
                line = f"{role}:{text}" if place == 0 else f"\n{role}:{text}"
                digest.update(line.encode("utf-8", "surrogatepass"))
        if digest is not None:
            yield conv, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import batched

        for some in batched(digests(batches), 1000):
            convs, found = zip(*some)
            yield pa.record_batch([pa.array(convs, to_arrow_type(kind)), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])

    return _with_edits(rows, repairs).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the damage that the crc32 of `conv_id:turn` chooses, and `copies`.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 takes its [.!?] away, 3 repeats it in place and 4
    makes its role user. Nulls are one space, in the crc32 too; conv_id and turn stay null.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))), F.lit(20))
    role, text = known("role"), known("text")
    return rows.where(kind != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"), role.alias("role0"), F.unhex(F.md5(text)).alias("digest0"),
    )
