"""Operators 11 to 13 against brute force, on the given tables and on odd rows."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidebook.llm import op11_conversations, op12_spelling, op13_topk

NEXT, ROLES = (2, 2, 3, 2), ("user", "user", "assistant", "user")


def cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated): the least of all edit sequences, by exhaustive recursion."""
    n = len(rows)

    @lru_cache(None)
    def go(i, s, inserted):
        ways = [(0, "")] if i == n and s in (0, 3) else []
        if inserted < 3:
            c, a = go(i, NEXT[s], inserted + 1)
            ways.append((c + 2, "I" + a))
        if i < n:
            initial, must, short = rows[i]
            c, a = go(i + 1, s, 0)
            ways.append((c + 3, "D" + a))
            if not must:
                c, a = go(i + 1, NEXT[s], 0)
                ways.append((c + 2 + short, "R" + a))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, s))
                if to:
                    c, a = go(i + 1, to, 0)
                    ways.append((c + short, "K" + a))
        return min(ways, default=(10**9, ""))

    return go(0, 0, 0)


def repaired(rows):
    """The contract, read row by row."""
    convs, text = {c: [] for c, *_ in rows}, lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        r, x, deal = text(r), text(x), crc32(f"{text(c)}:{text(t)}".encode()) % 20
        x = "" if deal == 1 else re.sub("[.!?]", "", x) if deal == 2 else x
        convs[c] += [(t, "user" if deal == 4 else r, x)] * (0, 1, 1, 2, 1)[deal] if deal < 5 else [(t, r, x)]
    out = []
    for c, v in convs.items():
        v.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
        seen, codes, faults = set(), [], [0, 0, 0]
        for _, r, x in v:
            shown = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = 0 if not shown else 1 if (r, x) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                faults[fault] += 1
            codes.append((r[:1], fault in (0, 1), int(fault == 2)))
        cost, audit = cheapest(codes)
        lines, left, s = [], iter(v), 0
        for e in audit:
            if e == "I":
                lines.append(ROLES[s] + ":")
            else:
                _, r, x = next(left)
                if e == "D":
                    continue
                lines.append((r if e == "K" else ROLES[s]) + ":" + x)
            s = 1 if lines[-1][0] == "s" else NEXT[s]
        turns = [t for t, *_ in v if t is not None]
        illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(v, v[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return sorted(map(tuple, op11_conversations.score(df).select(*COLUMNS).collect()), key=str)


def test_divided_repair_is_that_of_all_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suat"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randrange(9))]
        codes = bytes("tsua".index(x) + (4 if must else 8 if short else 0) for x, must, short in rows)
        audit, _ = op11_conversations.repair(codes, 0, op11_conversations.END)
        assert (op11_conversations.backward(codes, op11_conversations.END)[0], audit) == cheapest([(x, m, 0 if m else s) for x, m, s in rows])


def test_long_conversations_are_repaired_in_little_space():
    codes = bytes(random.Random(2).choice((0, 1, 2, 3, 4, 10, 11)) for _ in range(20_000))
    audit, last = op11_conversations.repair(codes, 0, op11_conversations.END)
    price = {"D": 3, "I": 2, "R": 2, "K": 0}
    short = sum(1 for c, e in zip(codes, audit.replace("I", ""), strict=True) if c & 8 and e != "D")
    assert last in (0, 3) and sum(price[e] for e in audit) + short == op11_conversations.backward(codes, op11_conversations.END)[0]


def test_conversations_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(df) == repaired([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize("chunk", [4096, 3])
def test_odd_conversations_whole_or_in_chunks(spark, chunk, monkeypatch):
    """Nulls anywhere, ties and repeated rows, unknown and empty roles; a hot conversation cut into many chunks."""
    monkeypatch.setattr(op11_conversations, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [None, "", " \t", "a.", "b", "c! ", "d?\n", "e  ", "f. ", "long " * 3000 + "."]
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "ustad"]), rng.choice(texts)) for _ in range(250)]
    rows += [(9, 2**62, "user", "far."), (9, -(2**62), "user", "near."), (10, None, "user", "no turn.")]
    df = spark.createDataFrame(rows, TALK).repartition(3).withColumns({c: F.lit(1) for c in ("k", "at", "chunk", "fault", "who", "audit", "_deal", "n")})
    assert found(df) == repaired(rows)


def test_conversations_of_no_rows(spark):
    none = spark.createDataFrame([], TALK)
    assert found(none) == []
    dropped = next(t for t in range(1000) if crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark.createDataFrame([(7, dropped, "user", "hello.")], TALK)) == [(7, 0, 0, 0, 0, 0, 0, "", empty)]


def spelt(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            n[w] += len(w) >= 6
    n = {w: k for w, k in n.items() if k >= 5}
    letters, near, form, out = {c for w in n for c in w}, {}, {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + e :] for i in range(len(w) + 1) for c in letters for e in (0, 1)}
        near[w] = sorted(edits & n.keys() - {w})
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def variants(df, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op12_spelling.variants(df, **options).collect()}


def test_spelling_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = spelt([(r.doc_id, r.text) for r in df.collect()])
    assert variants(df) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("most", [32 << 20, 200])
def test_spelling_of_odd_rows_in_one_round_or_many(spark, most):
    """Chains of forms, ties, letters beyond ASCII, capitals, repeated rows, null ids and texts; slices of a length's filter."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéßÀ") for _ in range(rng.randrange(5, 9))) for _ in range(30)]
    words = []
    for w in base:
        words += [w] * 150 + [w + "x"] * 30 + [w + "xy"] * 6 + [w[1:] + "q"] * 5 + [w.upper() if w.isascii() else w] * 5
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "Àbcdefg-Àbcdefg ") for _ in range(6)] + [(1, None), (2, ""), (3, "日本語word\U0001f600words" * 5), (4, "z" * 4000 + " ")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("word", "n", "_id", "_text", "near", "size")})
    want = spelt(rows)
    assert variants(df, most=most) == want and any(v[0] and v[1] != v[0] for v in want.values())


def test_spelling_of_nothing(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")) == {}


def test_filters_hold_every_word_and_few_others(spark):
    words = [f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}zzz" for i in range(6000)]
    vocabulary = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    plan = op12_spelling.rounds_of({6: vocabulary.count()})[0]
    bloom = op12_spelling.filters(vocabulary, plan)

    def held(them):
        h = op12_spelling.prefixes(op12_spelling.codes(them, 6))[0][:, -1]
        return len(op12_spelling.held((h,), 6, {6: 1}, plan, bloom)[0])

    assert held(words) == len(words)
    assert held([w[:3] + "yyy" for w in words]) < 0.03 * len(words)


def top(rows, k=5):
    """Exact top k by sorting all scores."""
    v = [(i, [int(256 * x // 1) for x in e]) for i, e in rows if e is not None and all(x is not None and abs(x) < float("inf") for x in e)]
    out = []
    for a, (q, e) in enumerate(v):
        if q is not None and q % 50 == 0:
            s = sorted(((-sum(x * y for x, y in zip(e, f)), c is None, c or 0, c) for b, (c, f) in enumerate(v) if b != a and len(e) == len(f)), key=lambda x: x[:3])
            out += [(q, i + 1, x[3], -x[0]) for i, x in enumerate(s[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [8192, 7])
def test_top_k_of_odd_rows(spark, groups, monkeypatch):
    """Ties beyond k, repeated rows and ids, nulls, other lengths, large components; one group of candidates or many."""
    monkeypatch.setattr(op13_topk, "CANDIDATES", groups)
    monkeypatch.setattr(op13_topk, "QUERIES", groups)
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(300)]
    rows += [(400 + i, [0.5, 0.5, 0.5]) for i in range(60)] + [(0, [1.0, 0.0, 0.0])] * 2 + [(None, [1.0, 1.0, 1.0])]
    rows += [(1000, None), (1050, [None, 1.0, 1.0]), (1100, [float("nan"), 0.0, 0.0]), (1150, [float("inf"), 0.0, 0.0]), (1200, [1.0, 2.0]), (1201, [-1.0, 2.0]), (1250, []), (1300, [1.0])]
    rows += [(1350, [3e5, -2e5, 1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(1) for c in ("r", "v", "d", "g", "s", "lo", "rank", "score", "query_id")})
    assert sorted(map(tuple, op13_topk.score(df).select("query_id", "rank", "vec_id", "score").collect()), key=str) == top(rows)
    assert op13_topk.score(df.where("false")).count() == 0
