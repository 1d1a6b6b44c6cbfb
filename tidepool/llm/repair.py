"""Repair of conversation structure: the cheapest edits of the turns, by a min-plus scan of matrices.

Rows may be kept (0), given the role user or assistant (1) or deleted (2); turns of either role may be inserted (5);
rows that are blank or repeat an earlier row have to be deleted, and a truncated row that stays costs 5 more. What
remains has the role initials `(s?(ua)+)?`. Edits are written by their initials K, R, D, I in the order of the result; of equally cheap
edits those count whose text is least in ASCII order.

Four states read such initials: nothing yet, after s, after u, after a. A row is a 4x4 matrix whose entries say how cheaply, and by
which edits, the row leads from a state to another, inserted turns before it included (`CLOSURE`). Entries are (cost, edits);
the lesser pair counts, and a product adds costs and joins edits. Edits of one entry have an initial for every row of the
stretch, so that of two with equal costs neither begins the other; hence order survives joining, products are
associative, and a conversation can be cut anywhere.

Rows are sorted by range over the whole table and cut into chunks of CHUNK rows, each of which one task folds, conversation by
conversation. Only the first and the last conversation of a chunk can go on elsewhere; their matrices are multiplied in rounds, FAN
neighbouring chunks a task, until one is left. Counts of faults, gaps and illegal neighbours travel in the same parts. The first occurrence of a row is found by an
aggregate of digests, joined back for those that occur twice. Rows are written and hashed in a second reading that streams a conversation
after its edits; SHA-256 is sequential, so a conversation's texts pass one task, a batch at a time.

Nulls count as one space. Rows of a conversation go by turn, nulls first, then by the SHA-256 of conversation, role and text, which only
tells rows of one turn apart; equal rows are interchangeable. Null conversation ids are a conversation of their own. Empty and very long texts are texts
like all others. An empty table gives an empty result; other columns are left out. gaps beyond a long are cut to its end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialise, pick

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Roles that may be given or inserted, and the states they lead to: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STATES = 4
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")
#: Rows of a task of the scan; neighbouring parts of a task of the reduction.
CHUNK, FAN = 4096, 64
BLANKS = r"\x20\x09-\x0D"
MOST = 2**63 - 1

Entry = tuple[int, str]
Matrix = list[list[Entry | None]]


def least(entries) -> Entry | None:
    return min((e for e in entries if e is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: of all ways over a state between, the cheapest."""
    join = lambda x, y: None if x is None or y is None else (x[0] + y[0], x[1] + y[1])
    return [[least(join(a[i][k], b[k][j]) for k in range(STATES)) for j in range(STATES)] for i in range(STATES)]


def moves(*ways: tuple[str, int, str]) -> Matrix:
    """A matrix of (role initial, cost, edit)."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for initial, cost, edit in ways:
        for i, j in NEXT[initial].items():
            out[i][j] = least([out[i][j], (cost, edit)])
    return out


def either(a: Matrix, b: Matrix) -> Matrix:
    return [[least([x, y]) for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def unit(cost: int = 0, edit: str = "") -> Matrix:
    return [[(cost, edit) if i == j else None for j in range(STATES)] for i in range(STATES)]


def closure() -> Matrix:
    """Any number of inserted turns: from a state each other one is at most two away."""
    one = either(unit(), moves(("u", INSERT, "I"), ("a", INSERT, "I")))
    return times(times(one, one), one)


CLOSURE = closure()


def element(initial: str, fault: str) -> Matrix:
    """The matrix of a row: inserted turns, then the row kept, given a role or deleted."""
    row = unit(DELETE, "D")
    if fault not in ("blank", "duplicate"):
        more = CUT if fault == "truncated" else 0
        row = either(row, moves(("u", REROLE + more, "R"), ("a", REROLE + more, "R")))
        if initial in NEXT:
            row = either(row, moves((initial, KEEP + more, "K")))
    return times(CLOSURE, row)


_STEPS: dict[tuple[str, str], list[tuple[int, int, int, str]]] = {}


def _steps(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """What a row's matrix holds: (from, to, cost, edits)."""
    known = (initial if initial in NEXT else "", fault)
    if known not in _STEPS:
        m = element(*known)
        _STEPS[known] = [(i, j, *m[i][j]) for i in range(STATES) for j in range(STATES) if m[i][j] is not None]
    return _STEPS[known]


class Part:
    """A stretch of a conversation: its matrix and its counts. Parts that follow each other make one."""

    COUNTS = ("rows", *FAULTS, "illegal", "turns")
    SCHEMA = "conv_id long, chunk long, place int, open boolean, cost array<long>, edits array<string>, rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"

    def __init__(self) -> None:
        self.matrix = unit()
        self.count = dict.fromkeys(self.COUNTS, 0)
        self.turn: list[int | None] = [None, None]
        self.role: list[str | None] = [None, None]

    def add(self, initial: str, turn: int | None, fault: str) -> None:
        """One row more; this is the product with its sparse matrix."""
        steps = _steps(initial, fault)
        out = []
        for row in self.matrix:
            new: list[Entry | None] = [None] * STATES
            for i, j, cost, edits in steps:
                if (at := row[i]) is not None and (new[j] is None or at[0] + cost <= new[j][0]):
                    entry = (at[0] + cost, at[1] + edits)
                    if new[j] is None or entry < new[j]:
                        new[j] = entry
            out.append(new)
        self.matrix = out
        if fault:
            self.count[fault] += 1
        self._join(1, int(turn is not None), (turn, turn), (initial, initial))

    def extend(self, other: Part) -> None:
        """The part that follows."""
        self.matrix = times(self.matrix, other.matrix)
        for fault in FAULTS:
            self.count[fault] += other.count[fault]
        self.count["illegal"] += other.count["illegal"]
        self._join(other.count["rows"], other.count["turns"], other.turn, other.role)

    def _join(self, rows: int, turns: int, turn, role) -> None:
        """Rows that follow, with their number of different turns, and their first and last turn and role."""
        self.count["rows"] += rows
        self.count["turns"] += turns - (turns > 0 and self.turn[1] == turn[0])
        if self.role[1] is not None and role[0] is not None and self.role[1] + role[0] not in LEGAL:
            self.count["illegal"] += 1
        for mine, its in ((self.turn, turn), (self.role, role)):
            if its[0] is not None:
                mine[:] = [its[0] if mine[0] is None else mine[0], its[1]]

    def values(self) -> list:
        flat = [e for row in self.matrix for e in row]
        return [[-1 if e is None else e[0] for e in flat], ["" if e is None else e[1] for e in flat], *self.count.values(), *self.turn, *self.role]

    @classmethod
    def of(cls, row: dict) -> Part:
        out = cls()
        flat = [None if cost < 0 else (cost, edits) for cost, edits in zip(row["cost"], row["edits"], strict=True)]
        out.matrix = [flat[i : i + STATES] for i in range(0, STATES * STATES, STATES)]
        out.count = {name: row[name] for name in cls.COUNTS}
        out.turn, out.role = [row["first_turn"], row["last_turn"]], [row["first_role"], row["last_role"]]
        return out


_NAMES = [field.split()[0] for field in Part.SCHEMA.split(", ")]
_KINDS = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[field.split()[1]] for field in Part.SCHEMA.split(", ")]


def _parts(found: list[tuple[int | None, Part]], chunk: int) -> pa.Table:
    """Parts of a chunk as a table; the first and the last may go on in other chunks."""
    rows = [[conv, chunk, at, at in (0, len(found) - 1), *part.values()] for at, (conv, part) in enumerate(found)]
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _scan(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The rows of a chunk, folded by conversation."""
    rows = rows.sort_by("row")
    found: list[tuple[int | None, Part]] = []
    for conv, turn, initial, gone, blank, truncated, again in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "gone", "blank", "truncated", "again")), strict=True):
        if not found or found[-1][0] != conv:
            found.append((conv, Part()))
        if not gone:
            found[-1][1].add(initial, turn, "blank" if blank else "duplicate" if again else "truncated" if truncated else "")
    return _parts(found, key[0].as_py())


def _merge(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """Neighbouring chunks' parts, multiplied by conversation as a balanced tree."""
    runs: list[tuple[int | None, list[Part]]] = []
    for row in parts.sort_by([("chunk", "ascending"), ("place", "ascending")]).to_pylist():
        if not runs or runs[-1][0] != row["conv_id"]:
            runs.append((row["conv_id"], []))
        runs[-1][1].append(Part.of(row))
    found = []
    for conv, own in runs:
        while len(own) > 1:
            for left, right in zip(own[::2], own[1::2], strict=False):
                left.extend(right)
            own = own[::2]
        found.append((conv, own[0]))
    return _parts(found, key[0].as_py())


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by the CRC-32 of `conv_id:turn` modulo 20. Dropped rows stay as marks of their conversation."""
    rows = pick(conversations, conv_id=(conv_col, "long"), turn=(turn_col, "long"), role=(role_col, "string"), text=(text_col, "string"))
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(F.col("text")), "[.!?]", "")).otherwise(space(F.col("text")))
    role = F.when(kind == 4, "user").otherwise(space(F.col("role")))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _same() -> Column:
    """A row's digest: conversation, role and text, with lengths that keep them apart."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat_ws(":", conv, F.length("role").cast("string"), "role", "text"), 256))


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _finish(batches):
    """A whole conversation's part: what its edits cost and are, once inserted turns may end it."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            part = Part.of(row)
            end = times(part.matrix, CLOSURE)[0]
            cost, audit = least(end[j] for j in ENDS)
            gaps = 0 if part.turn[0] is None else min(part.turn[1] - part.turn[0] + 1 - part.count["turns"], MOST)
            out.append((row["conv_id"], gaps, *(part.count[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost, audit))
        kinds = [*[pa.int64()] * 7, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], [f.split()[0] for f in _RESULT.split(", ")])


class _Writer:
    """Writes a conversation's repaired rows into a digest as they stream by."""

    def __init__(self, head: tuple) -> None:
        self.head, self.edits, self.at, self.state, self.lines, self.sha = head, head[-1], 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str, initial: str) -> None:
        self.sha.update((f"\n{role}:" if self.lines else f"{role}:").encode())
        self.sha.update(text.encode())
        self.lines += 1
        self.state = NEXT[initial][self.state]

    def turned(self) -> str:
        """The initial of a given or inserted role, which the state decides."""
        return "a" if self.state == 2 else "u"

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            initial = self.turned()
            self.line(ROLE[initial], "", initial)

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text, role[0])
        elif edit == "R":
            initial = self.turned()
            self.line(ROLE[initial], text, initial)

    def done(self) -> tuple:
        self.inserted()
        return *self.head, self.sha.hexdigest()


def _write(batches):
    """Conversations, each its edits and then its rows: counts, edits and digest of each."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    now: _Writer | None = None

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [*[pa.int64()] * 7, pa.string(), pa.string()], strict=True)], [*names, "repaired_sha256"])

    for batch in batches:
        done, is_row = [], batch.column("is_row")
        heads = iter(batch.select(names).filter(pc.invert(is_row)).to_pylist())
        for row, role, text in zip(is_row.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if row:
                now.add(role, text)
            else:
                if now:
                    done.append(now.done())
                now = _Writer(tuple(next(heads).values()))
        if done:
            yield table(done)
    if now:
        yield table([now.done()])


def repair(conversations: DataFrame, chunk: int = CHUNK, fan: int = FAN, **columns: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after `damaged`."""
    rows = damaged(conversations, **columns).withColumn("same", _same())
    last = rf"[.!?][{BLANKS}]*\z"
    marks = rows.select("conv_id", "turn", "same", F.substring("role", 1, 1).alias("initial"), "gone", (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"), (~F.col("text").rlike(last)).alias("truncated"))
    order = ["conv_id", "turn", "gone", "same"]
    marks = materialise(marks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "repair-rows")
    within, part = F.col("row").bitwiseAND(2**33 - 1), F.shiftright("row", 33)
    size = marks.agg(F.max(within) + 1, F.max(part) + 1).first()
    if size[0] is None:
        return conversations.sparkSession.createDataFrame([], f"{_RESULT}, repaired_sha256 string")
    deep = -(-size[0] // chunk)  # chunks of the largest partition
    first = materialise(marks.where("not gone").groupBy("same").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repair-twice")
    again = marks.where("not gone").select("same", "row").join(first, "same").where(F.col("row") > F.col("first")).select("row", F.lit(True).alias("again"))
    known = marks.join(again, "row", "left").withColumns({"again": F.coalesce("again", F.lit(False)), "chunk": part * deep + F.floor(within / chunk)})
    parts = materialise(known.groupBy("chunk").applyInArrow(_scan, Part.SCHEMA), "repair-parts")
    whole, left = parts.where("not open"), size[1] * deep
    edge = parts.where("open")
    while left > 1:
        left = -(-left // fan)
        edge = materialise(edge.withColumn("group", F.floor(F.col("chunk") / fan)).groupBy("group").applyInArrow(_merge, Part.SCHEMA), "repair-edges")
        whole, edge = whole.union(edge.where("not open")), edge.where("open")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    heads = whole.union(edge).mapInArrow(_finish, _RESULT).select(*names, F.lit(False).alias("is_row"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("same", "binary"), ("role", "string"), ("text", "string"))])
    null = {n: F.lit(None).cast(k) for n, k in (f.split() for f in _RESULT.split(", ")) if n != "conv_id"}
    body = rows.where("not gone").select("conv_id", *[null[n].alias(n) for n in names[1:]], F.lit(True).alias("is_row"), "turn", "same", "role", "text")
    stream = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "same")
    return stream.mapInArrow(_write, f"{_RESULT}, repaired_sha256 string").select(*names, "repaired_sha256")
