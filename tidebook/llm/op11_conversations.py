"""Operator 11, conversation structure repair by Hirschberg's divide and conquer.

A conversation's roles are to read ``(s?(ua)+)?``. Four states follow that pattern (nothing yet, after s, after u, after
a), so the cost of repairing the rows before or after a cut is a vector of four numbers. Forward and backward vectors
meet at the middle row; of the optimal crossings the one on the ASCII-least audit is taken, and both halves are solved
alike: space is linear, no table of rows by states is kept. Audits of equal cost over the same rows are never prefixes
of each other, so the least audit of a whole is made of the least audits of its halves.

The same vectors join pieces of one conversation: rows are sorted over all partitions by conversation and turn and cut
into chunks of at most ``CHUNK`` rows. A chunk gives its 4 x 4 costs, a scan over chunks the costs that follow each, a
second pass the least audit of each chunk from each state, a scan forward the state that each chunk starts in. Nothing
but a few numbers a chunk meets in one task. Only the digest of a repaired conversation must be made in one sequence:
its rows stream through a task in order, none is held. An audit is one string, as is asked.

Defined results: null roles and texts read as one space; a null conv_id is a conversation of its own; turns that are
null come first, and rows of one turn are ordered by the first 64 characters of role and text, then by digest, so that
repeated rows stand together; a role is judged by its first character, an empty one is none of s, u and a; very long
texts are whole; a gap beyond long is its largest value; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import row_key, stored

Costs = tuple[int, int, int, int]

NEVER = 1 << 50
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
#: The state that the next legal user or assistant leads to, and the role that it is, from each state.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
START, END = 0, (0, NEVER, NEVER, 0)
#: A row's code: its initial (0 other, 1 s, 2 u, 3 a), 4 if it must go, 8 if it is cut short.
MUST_GO, SHORT = 4, 8
CHUNK = 4096


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` after the damage that crc32 of ``conv_id:turn`` deals."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), deal.alias("_deal")).where("_deal <> 0")
    text = F.when(F.col("_deal") == 1, "").when(F.col("_deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("_deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_deal")
    return x.withColumn("_copy", F.explode(F.when(F.col("_deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_deal", "_copy")


# costs


def after_inserts(t: Costs) -> Costs:
    """Cost to go when rows may be inserted first."""
    u, a = min(t[2], INSERT + t[3]), min(t[3], INSERT + t[2])
    return min(t[0], INSERT + u), min(t[1], INSERT + u), u, a


def kept_in(code: int, s: int) -> int | None:
    """The state after keeping a row of this code in state s, if that is legal."""
    initial = code & 3
    legal = (s == 0, s != 2, s == 2)[initial - 1] if initial and not code & MUST_GO else False
    return initial if legal else None


@lru_cache(maxsize=100_000)
def _before(code: int, t: Costs) -> Costs:
    late = CUT_SHORT if code & SHORT else 0
    out = []
    for s in range(4):
        cost = DELETE + t[s]
        if not code & MUST_GO:
            cost = min(cost, REROLE + late + t[NEXT[s]])
            if (to := kept_in(code, s)) is not None:
                cost = min(cost, late + t[to])
        out.append(min(cost, NEVER))
    return after_inserts(tuple(out))


def backward(codes: bytes, t: Costs) -> Costs:
    """Least cost from each state before the rows to the end, where ``t`` is what follows."""
    t, base = after_inserts(t), 0
    for code in reversed(codes):
        t = _before(code, t)
        low = min(t)
        base += low
        t = tuple(x - low if x < NEVER else x for x in t)
    return tuple(min(x + base, NEVER) for x in t)


@lru_cache(maxsize=100_000)
def _after(code: int, f: Costs) -> Costs:
    late = CUT_SHORT if code & SHORT else 0
    out = [x + DELETE for x in f]
    if not code & MUST_GO:
        for s in range(4):
            out[NEXT[s]] = min(out[NEXT[s]], f[s] + REROLE + late)
            if (to := kept_in(code, s)) is not None:
                out[to] = min(out[to], f[s] + late)
    return _inserted(tuple(min(x, NEVER) for x in out))


def _inserted(f: Costs) -> Costs:
    u = min(f[2], INSERT + min(f[0], f[1], f[3]))
    return f[0], f[1], u, min(f[3], INSERT + u)


def forward(codes: bytes, s: int) -> Costs:
    """Least cost from state ``s`` to each state after the rows."""
    f, base = _inserted(tuple(0 if i == s else NEVER for i in range(4))), 0
    for code in codes:
        f = _after(code, f)
        low = min(f)
        base += low
        f = tuple(x - low if x < NEVER else x for x in f)
    return tuple(min(x + base, NEVER) for x in f)


def repair(codes: bytes, s: int, t: Costs) -> tuple[str, int]:
    """The ASCII-least of the cheapest audits of the rows from state ``s``, given what follows each state; and its last state."""
    if len(codes) < 2:
        return _least(codes, s, t)
    mid = len(codes) // 2
    f, b = forward(codes[:mid], s), backward(codes[mid:], t)
    best = min(x + y for x, y in zip(f, b, strict=True))
    left, crossing = repair(codes[:mid], s, tuple(y if x + y == best else NEVER for x, y in zip(f, b, strict=True)))
    right, last = repair(codes[mid:], crossing, t)
    return left + right, last


def _least(codes: bytes, s: int, t: Costs) -> tuple[str, int]:
    """One row or none: of the edits that keep to the least cost the ASCII-least at each step."""
    end = after_inserts(t)
    audit, row = "", codes[0] if codes else None
    begin = end if row is None else _before(row, end)
    left = begin[s]
    while row is not None or t[s] != left:
        to = None if row is None else kept_in(row, s)
        late = CUT_SHORT if row is not None and row & SHORT else 0
        if row is not None and DELETE + end[s] == left:
            edit, left, row = "D", left - DELETE, None
        elif INSERT + (end if row is None else begin)[NEXT[s]] == left:
            edit, left, s = "I", left - INSERT, NEXT[s]
        elif to is not None and late + end[to] == left:
            edit, left, s, row = "K", left - late, to, None
        else:
            edit, left, s, row = "R", left - REROLE - late, NEXT[s], None
        audit += edit
    return audit, s


# passes over sorted rows


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _sent(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and text."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, step: Callable[[Iterator[tuple]], Iterator[tuple]], **types: pa.DataType) -> DataFrame:
    """A function of a partition's rows, in order, to rows."""
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = pa.schema(list(types.items()))
    return df.mapInArrow(lambda batches: _sent(step(_rows(batches)), schema), from_arrow_schema(schema))


LONG, TEXT = pa.int64(), pa.string()
LONGS = pa.list_(LONG)


def _matrices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """k, chunk, costs between all states (by first state, then last)."""
    for (k, chunk), part in groupby(rows, key=lambda r: r[:2]):
        codes = bytes(r[3] for r in part)
        ends = [backward(codes, tuple(0 if i == e else NEVER for i in range(4))) for e in range(4)]
        yield k, chunk, [ends[e][s] for s in range(4) for e in range(4)]


def _following(rows: Iterator[tuple]) -> Iterator[tuple]:
    """k, chunk, what follows it from each state, whether it is the first; chunks come last to first."""
    for k, part in groupby(rows, key=lambda r: r[0]):
        t, last = END, None
        for _, chunk, m in part:
            if last is not None:
                yield *last, False
            last = (k, chunk, list(t))
            t = tuple(min(NEVER, *(m[4 * s + e] + t[e] for e in range(4))) for s in range(4))
        yield *last, True


def _audits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """k, chunk, audits, last states and costs by first state; counts of faults; illegal pairs inside; first and last initial."""
    for (k, chunk), part in groupby(rows, key=lambda r: r[:2]):
        part = list(part)  # CHUNK rows at most, a few numbers each
        codes, faults, t = bytes(r[3] for r in part), [r[4] for r in part], tuple(part[0][5])
        before = backward(codes, t)
        found = [repair(codes, s, t) for s in range(1 if part[0][6] else 4)]
        roles = [c & 3 for c in codes]
        illegal = sum(map(_illegal, roles, roles[1:]))
        yield k, chunk, [a for a, _ in found], [s for _, s in found], [before[s] - t[e] for s, (_, e) in enumerate(found)], *(faults.count(f) for f in (1, 2, 3)), illegal, roles[0], roles[-1]


def _illegal(one: int, two: int) -> bool:
    return (one, two) not in ((1, 2), (2, 3), (3, 2))


def _chosen(rows: Iterator[tuple]) -> Iterator[tuple]:
    """k, chunk, audit, cost, counts of faults, illegal pairs; chunks come in order."""
    for _, part in groupby(rows, key=lambda r: r[0]):
        s, last = START, None
        for k, chunk, audits, ends, costs, blank, duplicate, truncated, illegal, one, two in part:
            yield k, chunk, audits[s], costs[s], blank, duplicate, truncated, illegal + (last is not None and _illegal(last, one))
            s, last = ends[s], two


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """k, pos, role, text: a chunk's audit comes before its rows."""
    for k, part in groupby(rows, key=lambda r: r[0]):
        s = pos = 0
        audit, at, tail = "", 0, 0
        for _, _, is_row, _, role, text, more in part:
            if not is_row:
                audit, at, tail = more, 0, len(more.rstrip("I"))
                continue
            while True:
                edit = audit[at]
                at += 1
                if edit == "I":
                    yield k, pos, ROLE[s], ""
                    pos, s = pos + 1, NEXT[s]
                    continue
                if edit != "D":
                    yield k, pos, role if edit == "K" else ROLE[s], text
                    pos, s = pos + 1, 1 if edit == "K" and role[:1] == "s" else NEXT[s]
                break
            if at == tail:  # only insertions are left
                for _ in range(len(audit) - tail):
                    yield k, pos, ROLE[s], ""
                    pos, s = pos + 1, NEXT[s]


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    for k, part in groupby(rows, key=lambda r: r[0]):
        h = hashlib.sha256()
        for _, pos, role, text in part:
            h.update(f"{chr(10) if pos else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield k, h.hexdigest()


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows, sorted over all partitions and stored: k, at (ascending in that order), chunk, turn, role, text, who, fault (1 blank, 3 truncated, 0)."""
    seen = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    x = rows.select(_key().alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    x = x.withColumns({"who": row_key("role", "text"), "fault": F.when(seen == "", 1).when(seen.isin(".", "!", "?"), 0).otherwise(3), "tie": F.monotonically_increasing_id()})
    # short keys, as a range's bounds come from a sample of them; the last tells repeated rows apart, so that many of them can be divided
    by = [F.col("k"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("who"), F.col("tie")]
    x = x.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id())
    return stored(x.withColumn("chunk", F.expr(f"at div {CHUNK}")), "op11-rows")


def marked(rows: DataFrame) -> DataFrame:
    """k, chunk, at, code, fault (2 for rows whose role and text came earlier) of ordered rows; stored, a few numbers a row."""
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    x = rows.select("k", "chunk", "at", "who", "fault", initial.alias("initial"))
    often = x.groupBy(F.col("k").alias("k2"), F.col("who").alias("who2")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    x = x.join(often, (F.col("k") == F.col("k2")) & (F.col("who") == F.col("who2")), "left")
    x = x.withColumn("fault", F.when((F.col("fault") != 1) & (F.col("at") > F.col("first")), 2).otherwise(F.col("fault")))
    code = F.col("initial") + F.when(F.col("fault").isin(1, 2), MUST_GO).when(F.col("fault") == 3, SHORT).otherwise(0)
    return stored(x.select("k", "chunk", "at", code.cast("long").alias("code"), F.col("fault").cast("long").alias("fault")), "op11-marks")


def audits(rows: DataFrame) -> DataFrame:
    """k, chunk, audit, cost, blank, duplicate, truncated, illegal of every chunk of ordered rows; stored."""
    marks = marked(rows)
    dealt = marks.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "at")
    matrices = _mapped(dealt, _matrices, k=TEXT, chunk=LONG, m=LONGS)
    follow = _mapped(matrices.repartition("k").sortWithinPartitions("k", F.desc("chunk")), _following, k=TEXT, chunk=LONG, t=LONGS, first=pa.bool_())
    dealt = marks.join(follow, ["k", "chunk"]).repartition("k", "chunk").sortWithinPartitions("k", "chunk", "at").select("k", "chunk", "at", "code", "fault", "t", "first")
    faults = {f: LONG for f in ("blank", "duplicate", "truncated", "illegal")}
    by_start = _mapped(dealt, _audits, k=TEXT, chunk=LONG, audits=pa.list_(TEXT), ends=LONGS, costs=LONGS, **faults, one=LONG, two=LONG)
    return stored(_mapped(by_start.repartition("k").sortWithinPartitions("k", "chunk"), _chosen, k=TEXT, chunk=LONG, audit=TEXT, cost=LONG, **faults), "op11-audits")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """k, pos, role, text: the conversations as ``found`` repairs ordered ``rows``; each in order, in one partition, read row by row."""
    none = F.lit(None).cast("string")
    x = rows.select("k", "chunk", F.lit(1).alias("is_row"), "at", "role", "text", none.alias("audit"))
    x = x.unionByName(found.select("k", "chunk", F.lit(0).alias("is_row"), F.lit(0).cast("long").alias("at"), none.alias("role"), none.alias("text"), "audit"))
    return _mapped(x.repartition("k").sortWithinPartitions("k", "chunk", "is_row", "at"), _repaired, k=TEXT, pos=LONG, role=TEXT, text=TEXT)


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the faults, the audit and the digest of what ``rows`` of it become."""
    x = ordered(rows)
    found = audits(x)
    turns = x.groupBy(F.col("k").alias("k1")).agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    gap = F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1 - F.col("n")
    turns = turns.select("k1", F.coalesce(F.when(gap < 2**63 - 1, gap).when(gap.isNotNull(), 2**63 - 1), F.lit(0)).cast("long").alias("gaps"))
    faults = ("blank", "duplicate", "truncated", "illegal", "cost")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "")
    sums = found.groupBy(F.col("k").alias("k2")).agg(*[F.sum(c).alias(c) for c in faults], text.alias("audit"))
    sha = _mapped(repaired(x, found), _digests, k3=TEXT, sha=TEXT)
    out = conversations.groupBy("conv_id").agg(F.first(_key()).alias("k")).join(turns, F.col("k") == F.col("k1"), "left").join(sums, F.col("k") == F.col("k2"), "left").join(sha, F.col("k") == F.col("k3"), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *faults)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def score(conversations: DataFrame) -> DataFrame:
    """The query's columns: conversations damaged, then repaired."""
    return report(conversations, damaged(conversations))
