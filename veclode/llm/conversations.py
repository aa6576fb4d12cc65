"""Repair of the structure of conversations by bidirectional Dijkstra over an edit lattice.

A conversation should be ``(s?(ua)+)?`` in the initials of its roles: maybe a system turn, then a user's and an assistant's by
turns, or nothing. A node of the lattice is (rows used up, state of that pattern); edges are Keep (0), Rerole to
user or assistant (2), Delete (3) and Insert of an empty user's or assistant's turn (2). A truncated row that stays costs 1
more, a blank or repeated one can only be deleted. From every state but the first one symbol alone can follow, so an
audit (the edits' initials) tells all roles.

Two heaps advance from the start and from the end, by cost and then by rows, so a node is settled with the ASCII-least
audit among its cheapest ones. They go on until no unsettled pair could still meet at the least cost; all edges at which
settled nodes of both sides meet at that cost are crossings, and the least concatenated audit of them is the answer.

Rows of a conversation reach one task as a sorted stream, as its audit and its digest are sequential. A conversation of more
than ``SEGMENT`` rows is solved a segment at a time, for all pairs of states at a segment's ends; audits of segments
concatenate. What a task holds is a segment's codes and an audit (a byte or so a row), never the texts: these follow in a
second stream that begins with the audit. Repeated rows are found by a window over (conversation, role, text).

Cases: a null role or text is one space, so such a text is blank; a null turn comes first and doesn't count in gaps; null
conv_ids are one conversation, as they can't be told apart; rows with equal turns are in the order of role and text; texts of
any length are one row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
SEGMENT = 8192
#: States: nothing yet, after the system's, after a user's, after an assistant's turn. What may follow, and the state then.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
#: White space of the operator's words; ends of a whole sentence.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"


# --- the lattice ---------------------------------------------------------------------------------------------------

def _edges(codes: str) -> tuple[list, list]:
    """Edges of a lattice over rows: for each node (row * 4 + state) those that leave and those that arrive, as (letter,
    cost, node). A row's code is its role's initial (s, u, a, or x for any other), upper case if truncated, or - if it must go."""
    n = len(codes)
    out, into = [[] for _ in range(4 * n + 4)], [[] for _ in range(4 * n + 4)]

    def put(letter: str, cost: int, a: int, b: int) -> None:
        out[a].append((letter, cost, b))
        into[b].append((letter, cost, a))

    for i in range(n + 1):
        for q, follow in NEXT.items():
            for role, r in follow.items():
                if role != "s":
                    put("I", INSERT, 4 * i + q, 4 * i + r)
            if i == n:
                continue
            put("D", DELETE, 4 * i + q, 4 * i + 4 + q)
            if codes[i] == "-":
                continue
            own, cut = codes[i].lower(), CUT if codes[i].isupper() else 0
            for role, r in follow.items():
                if role == own:
                    put("K", KEEP + cut, 4 * i + q, 4 * i + 4 + r)
                if role != "s":
                    put("R", REROLE + cut, 4 * i + q, 4 * i + 4 + r)
    return out, into


class _Path:
    """An audit as a chain that shares its tail: letters from a node to the chain's root, and how many they are."""

    __slots__ = ("letter", "rest", "n")

    def __init__(self, letter: str, rest: _Path | None) -> None:
        self.letter, self.rest, self.n = letter, rest, (rest.n + 1 if rest else 1)


def _letters(p: _Path | None) -> str:
    out = []
    while p:
        out.append(p.letter)
        p = p.rest
    return "".join(out)


def _less_forward(a: _Path | None, b: _Path | None) -> bool:
    """Whether the audit that a chain gives when read from its root is less: the first difference is just above the
    last link that both share."""
    la = lb = ""
    while a is not b:
        m, n = (a.n if a else 0), (b.n if b else 0)
        if m >= n:
            la, a_next = a.letter, a.rest
        if n >= m:
            lb, b = b.letter, b.rest
        if m >= n:
            a = a_next
        if m > n:
            lb = ""  # the longer one has letters beyond the shared link
        elif n > m:
            la = ""
    return la < lb


def _less_backward(a: _Path | None, b: _Path | None) -> bool:
    """The same for chains that are read from their heads."""
    while a is not b and a and b:
        if a.letter != b.letter:
            return a.letter < b.letter
        a, b = a.rest, b.rest
    return a is not b and a is None


class _Side:
    """One of the two searches: labels (cost, audit) of nodes, and which are settled."""

    def __init__(self, edges: list, starts: list[int], sign: int) -> None:
        self.edges, self.sign, self.less = edges, sign, _less_forward if sign > 0 else _less_backward
        self.label: dict[int, tuple[int, _Path | None]] = {s: (0, None) for s in starts}
        self.settled: set[int] = set()
        self.heap = [(0, sign * (s // 4), s) for s in starts]
        heapq.heapify(self.heap)

    def least(self) -> int | None:
        """Cost of the next node to settle."""
        while self.heap and (self.heap[0][2] in self.settled or self.heap[0][0] > self.label[self.heap[0][2]][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> int:
        cost, _, v = heapq.heappop(self.heap)
        self.settled.add(v)
        path = self.label[v][1]
        for letter, c, w in self.edges[v]:
            if w in self.settled:
                continue
            had = self.label.get(w)
            if had is None or cost + c < had[0]:
                self.label[w] = cost + c, _Path(letter, path)
                heapq.heappush(self.heap, (cost + c, self.sign * (w // 4), w))
            elif cost + c == had[0] and self.less(new := _Path(letter, path), had[1]):
                self.label[w] = cost + c, new
        return v


def cheapest(codes: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost of editing rows (see :func:`_edges`) from state start to a state of ends, and the ASCII-least audit of it."""
    n, (out, into) = len(codes), _edges(codes)
    fore, back = _Side(out, [start], 1), _Side(into, [4 * n + q for q in ends], -1)
    best = None
    if start in back.label:
        best = 0
    while True:
        a, b = fore.least(), back.least()
        if a is b is None or (best is not None and (a or 0) + (b or 0) > best):
            break
        side, other = (fore, back) if b is None or (a is not None and a <= b) else (back, fore)
        v = side.settle()
        for w, near in [(v, 0), *((w, c) for _, c, w in side.edges[v])]:
            if w in other.label:
                c = side.label[v][0] + near + other.label[w][0]
                best = c if best is None else min(best, c)
    if best is None:
        return None
    found, behind = [], {*back.settled, *(4 * n + q for q in ends)}
    for v in {*fore.settled, start}:
        cost, path = fore.label[v]
        for letter, c, w in [*out[v], ("", 0, v)]:
            if w in behind and cost + c + back.label[w][0] == best:
                found.append(_letters(path)[::-1] + letter + _letters(back.label[w][1]))
    return best, min(found)


@lru_cache(maxsize=1 << 14)
def _small(codes: str) -> tuple[int, str]:
    return cheapest(codes)


class Lattice:
    """The edits of a conversation whose rows' codes come one at a time; a full segment is solved and let go."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.at: dict[int, tuple[int, str]] | None = None  # state -> cost and audit of the segments so far

    def add(self, code: str) -> None:
        self.codes.append(code)
        if len(self.codes) == SEGMENT:
            self._fold(tuple(NEXT))

    def _fold(self, ends: tuple[int, ...]) -> None:
        codes, before = "".join(self.codes), self.at if self.at is not None else {0: (0, "")}
        self.codes, self.at = [], {}
        for q, (cost, audit) in before.items():
            for r in ends:
                if (part := cheapest(codes, q, (r,))) is not None:
                    new = cost + part[0], audit + part[1]
                    self.at[r] = min(self.at.get(r, new), new)

    def solved(self) -> tuple[int, str]:
        if self.at is None:
            codes = "".join(self.codes)
            return _small(codes) if len(codes) <= 32 else cheapest(codes)
        self._fold(ENDS)
        return min(self.at[q] for q in ENDS if q in self.at)


# --- streams -------------------------------------------------------------------------------------------------------

AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(batches):
    """Rows sorted by conversation: what is wrong with each and the edits that repair it."""
    import pyarrow as pa

    names = [x.split()[0] for x in AUDITS.split(", ")]
    now, started = None, False
    done: list[tuple] = []

    def flush():
        cols = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=names)

    for b in batches:
        for conv, turn, role, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
            if not started or conv != now:
                if started:
                    done.append((now, *row(), *lattice.solved()))
                now, started, lattice = conv, True, Lattice()
                first = last = before = None
                turns, n, illegal = 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0

                def row():
                    return (last - first + 1 - turns if turns else 0), n["blank"], n["duplicate"], n["truncated"], illegal

            if turn is not None and turn != last:  # sorted, so distinct turns follow each other
                first, last, turns = (turn if first is None else first), turn, turns + 1
            if fault:
                n[fault] += 1
            illegal += before is not None and before + role not in ("su", "ua", "au")
            before = role
            code = role if role in ("s", "u", "a") else "x"
            lattice.add("-" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        if len(done) >= 4096:
            yield flush()
    if started:
        done.append((now, *row(), *lattice.solved()))
    if done:
        yield flush()


def _repaired(batches):
    """Each conversation's audit, then its rows: the digest of the repaired rows, and how many they are."""
    import pyarrow as pa

    now, started = None, False
    done: list[tuple] = []

    def flush():
        convs, digests, sizes = zip(*done, strict=True)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests), pa.array(sizes, pa.int64())], names=["conv_id", "repaired_sha256", "n_repaired"])

    def end():
        inserted(len(audit))
        done.append((now, sha.hexdigest(), size))

    def put(role: str, text: str) -> None:
        nonlocal size
        sha.update((("\n" if size else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        size += 1

    def follower() -> str:
        """The role that comes next: by turns, after a system's turn at most."""
        return "assistant" if (size - system) % 2 else "user"

    def inserted(upto: int) -> None:
        nonlocal at
        while at < upto and audit[at] == "I":
            put(follower(), "")
            at += 1

    size = at = system = 0
    audit, sha = "", hashlib.sha256()
    for b in batches:
        for conv, own, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if own is not None:
                if started:
                    end()
                now, started, audit, sha = conv, True, own, hashlib.sha256()
                size = at = system = 0
                continue
            inserted(len(audit))
            letter, at = audit[at], at + 1
            if letter == "K":
                system = int(role[:1] == "s") if not size else system
                put(role, text)
            elif letter == "R":
                put(follower(), text)
        if len(done) >= 4096:
            yield flush()
    if started:
        end()
    if done:
        yield flush()


# --- on tables -----------------------------------------------------------------------------------------------------

def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as they are used; a null role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a hash of conversation and turn brings in: dropped, emptied, unended, repeated, a user's."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    out = rows.withColumn("_h", F.crc32(name.cast("binary")) % 20).where("_h <> 0")
    text = F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_h") == 3, 2).otherwise(1)
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")


def _fault(again: Column) -> Column:
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    end = F.substring(bare, -1, 1)
    return F.when(bare == "", "blank").when(again, "duplicate").when(~end.isin(*STOPS), "truncated")


def marked(rows: DataFrame) -> DataFrame:
    """rows with ``fault``: blank, duplicate, truncated or null, and the role's ``initial``; written."""
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    return written(rows.withColumn("again", again).select("conv_id", "turn", "role", "text", _fault(F.col("again")).alias("fault"), F.substring("role", 1, 1).alias("initial")), "turns")


def repaired(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For every conversation of ids (conv_id, distinct): what is wrong with its rows (conv_id, turn, role, text without
    nulls), the cheapest edits and the digest of the rows after them."""
    small_batches(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    turns = marked(rows)
    audits = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault").mapInArrow(_audits, AUDITS)
    audits = ids.select(F.col("conv_id").alias("_id")).join(audits, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_id", "conv_id")
    audits = written(audits.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit")), "audits")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = audits.select("conv_id", "audit", none("long", "turn"), none("string", "role"), none("string", "text"))
    both = heads.unionByName(turns.select("conv_id", none("string", "audit"), "turn", "role", "text"))
    both = both.repartition("conv_id").sortWithinPartitions(order[0], F.col("audit").isNull(), *order[1:])
    digests = both.select("conv_id", "audit", "role", "text").mapInArrow(_repaired, "conv_id long, repaired_sha256 string, n_repaired long")
    return audits.join(digests.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a hash: their faults, the cheapest edits that repair them, and the repaired digest.

    Cases: see the module. A conversation that lost all rows has zeros, an empty audit and the digest of the empty string.
    """
    rows = rows_of(table(spark, sf_dir, "conversations"))
    return repaired(damaged(rows), rows.select("conv_id").distinct())
