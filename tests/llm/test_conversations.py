"""Conversation repair against a plain search over all edits, whole query and odd rows."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import duckdb
import pytest

from lectern.llm import conversations as C
from lectern.llm.queries import op13_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    """(fault or None) of each (role, text)."""
    seen, out = set(), []
    for row in rows:
        bare = row[1].strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else None
        out.append(fault)
        seen.add(row)
    return out


def cheapest(rows):
    """(cost, audit, turns) by recursion from the end over the initials written so far."""
    faults = faults_of(rows)
    legal = lambda s: s in ("", "s") or GRAMMAR.fullmatch(s) or GRAMMAR.fullmatch(s + "a") or GRAMMAR.fullmatch(s + "ua")

    @functools.lru_cache(None)
    def best(i, last, inserts):
        """Least (cost, audit, turns) from row i on; `last` is the last initial, which with the grammar is all that counts."""
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        begin = {"": "", "s": "s", "u": "u", "a": "ua"}[last]
        if inserts < 3:
            for role in ("user", "assistant"):
                if legal(begin + role[0]):
                    cost, audit, turns = best(i, role[0], inserts + 1)
                    ways.append((cost + 5, "I" + audit, ((role, ""),) + turns))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, turns = best(i + 1, last, 0)
            ways.append((cost + 2, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                stay = 5 if faults[i] == "truncated" else 0
                for new, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if new and new[0] in "sua" and legal(begin + new[0]):
                        cost, audit, turns = best(i + 1, new[0], 0)
                        ways.append((cost + price + stay, letter + audit, ((new, text),) + turns))
        return min(ways, default=(10**6, "", ()))

    return best(0, "", 0)


def report(rows):
    """The whole query by loops: rows are (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        said, turns = [r[1:] for r in own], [r[0] for r in own if r[0] is not None]
        faults = faults_of(said)
        cost, audit, kept = cheapest(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_search_against_all_edits():
    """Up to three rows: every string of edits, with up to two inserts at each place."""
    places = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    words = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", "cut"), ("tool", "d."), ("user", ""), ("", "e.")]
    for rows in itertools.chain.from_iterable(itertools.product(words, repeat=n) for n in range(3)):
        faults, best = faults_of(rows), None
        for inserts in itertools.product(places, repeat=len(rows) + 1):
            for edits in itertools.product(("K", "D", "Ru", "Ra"), repeat=len(rows)):
                if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
                    continue
                initials = cost = 0
                initials, audit = "", ""
                for i in range(len(rows) + 1):
                    initials, audit, cost = initials + "".join(r[0] for r in inserts[i]), audit + "I" * len(inserts[i]), cost + 5 * len(inserts[i])
                    if i < len(rows):
                        e = edits[i]
                        initials += {"K": rows[i][0][:1] or "?", "D": "", "Ru": "u", "Ra": "a"}[e]
                        audit += e[0]
                        cost += {"K": 0, "D": 2, "Ru": 1, "Ra": 1}[e] + 5 * (faults[i] == "truncated" and e != "D")
                if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert cheapest(rows)[:2] == best, rows


def test_pass_in_parts():
    """Cut anywhere, the parts' ways join to what one pass gives; so for long rows of states that don't meet."""
    rng = random.Random(5)
    for size in (1, 7, 40, 700):
        rows = [(rng.choice("suaax"), rng.random() < 0.15, rng.random() < 0.2, rng.choice((1, 1, 1, 3))) for _ in range(size)]
        whole = C._Pass((0,))
        for r in rows:
            whole.row(*r)
        cut = rng.randrange(size + 1)
        first, second = C._Pass(range(4)), C._Pass(range(4))
        for i, r in enumerate(rows):
            (first if i < cut else second).row(*r)
        joined = {}
        for s, m, cost, audit in first.end():
            for m2, q, more, rest in second.end():
                if s == 0 and m == m2:
                    joined[q] = min(joined.get(q, (10**9, "")), (cost + more, audit + rest))
        assert joined == {q: (cost, audit) for _, q, cost, audit in whole.end()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{path}/conversations.parquet'").fetchall()
    assert results(op13_conversations(spark, path)) == report(rows)


def test_random_and_odd_rows(spark):
    rng = random.Random(3)
    texts = ["", " \t", "Hi.", "Hi", "Ho!\x0b", None, "é?", "日本語。", "a\nb."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, *range(-3, 12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(150)] for _ in range(rng.randrange(1, 9))]
    rows += rows[:40]  # repeated rows
    rows += [(900, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"Turn {t % 350}" + "." * (t % 9 > 0)) for t in range(500)]  # over several ranges
    rows += [(901, 1, "user", "Same.")] * 500 + [(902, None, "user", "x " * 50_000 + ".")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, n int")
    limit, name = sys.getrecursionlimit(), "spark.sql.adaptive.coalescePartitions.enabled"
    sys.setrecursionlimit(20_000)
    spark.conf.set(name, "false")
    try:
        assert C.in_ranges(C.damaged(frame)).where("conv_id = 900").select("part").distinct().count() > 1
        assert results(C.repair_report(frame)) == report(rows)
    finally:
        spark.conf.unset(name)
        sys.setrecursionlimit(limit)
    assert C.repair_report(frame.limit(0)).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "system", "C."), (2, 0, "system", "S."), (3, 0, "user", " ")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    figures, turns = C.repair_conversations(frame)
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.part, r.at)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "B."), ("assistant", "C.")]}
    assert {r.conv_id: (r.cost, r.audit) for r in figures.collect()} == {1: (3, "DKR"), 2: (2, "D"), 3: (2, "D")}
