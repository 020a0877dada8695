"""Translation in rounds against a plain recursion over the same scripted failures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import blocks as K
from lectern.functions import text as T
from lectern.functions.blocks import halves, packed
from lectern.operators import translate as N
from lectern.plans.catalog import QUERIES

WORDS = "the model reads a long page and writes about it again until nothing of it is left".split()


def ask(text, model, again=False, tokens=None):
    tokens = tokens or (2 * C.CALL_TOKENS if model == N.SECOND else C.CALL_TOKENS)
    return N.offline([{"text": text, "model": model, "tokens": tokens, "again": again}])[0]


def share(text):
    bare = re.sub(r"```.*?```", "", text, flags=re.S)
    solid = re.sub(r"\s", "", bare)
    return len(re.findall(r"[一-鿿]", solid)) / len(solid) if solid else 0.0


def split(text):
    both = halves(text) if len(text) > C.SPLIT_CHARS else None
    if both is None:
        return text, True
    parts, failed = [], False
    for half in both:
        got = ask(half, N.SECOND)
        more = False
        if got is None:
            got, more = split(half)
        parts.append(got)
        failed |= more
    return "\n\n".join(parts), failed


def chunk_of(text):
    """(translated, failed, retries)"""
    model, failed, got, retries = N.FIRST, False, ask(text, N.FIRST), 0
    if got is None:
        model, got = N.SECOND, ask(text, N.SECOND)
    if got is None:
        got, failed = split(text)
    while not failed and share(got) < C.RETRY_SHARE and retries < C.RETRIES:
        more = ask(text, model, again=True, tokens=C.CALL_TOKENS)
        if more is None:
            break
        got, retries = more, retries + 1
    return got, failed, retries


def article(body):
    """(body, notice, chunks, failed, retries)"""
    parts = packed(body or "")
    got = [chunk_of(p) if p.strip() else (p, False, 0) for p in parts]
    texts, failed = [g[0] for g in got], sum(g[1] for g in got)
    joined = "\n\n".join(texts)
    notice = [C.KEPT_CHUNKS.format(failed, len(parts))] if failed else []
    residue = re.search("|".join(C.RESIDUE), joined)
    if residue or share(joined) < C.COMPLETE_SHARE:
        if residue or not N.offline_review([(body, joined)])[0]:
            code = body and 1 - len(re.sub(r"```.*?```", "", body, flags=re.S)) / len(body) >= C.CODE_SHARE
            notice.append(C.CODE_NOTICE if code else C.PART_NOTICE)
            if len(parts) > 2:
                joined = "\n\n".join([texts[0], C.CODE_PLACEHOLDER if code else C.PART_PLACEHOLDER, texts[-1]])
    return joined, "；".join(notice) or None, len(parts), failed, sum(g[2] for g in got)


def made(rng):
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 60))) + "."
    table = lambda: "\n".join(f"| {rng.choice(WORDS)} | {rng.choice(WORDS)} |" for _ in range(rng.randrange(2, 60)))
    code = lambda: "```\n" + "\n".join(line() for _ in range(rng.randrange(1, 12))) + "\n```"
    return "\n\n".join(rng.choice([line, line, line, table, code])() for _ in range(rng.randrange(1, 40)))


@pytest.mark.parametrize("seed", range(2))
def test_articles_against_recursion(spark, seed):
    rng = random.Random(seed)
    bodies = {i: made(rng) for i in range(60)} | {100: "<td> in it " + made(rng), 101: "word " * 500, 102: "Short."}
    rows = spark.createDataFrame(list(bodies.items()), "doc_id long, body string")
    got = {r.doc_id: (r.body, r.notice, r.chunks, r.failed, r.retries) for r in N.translate_articles(rows).collect()}
    want = {i: article(b) for i, b in bodies.items()}
    assert {w[3] > 0 for w in want.values()} == {w[4] > 0 for w in want.values()} == {True, False}  # the script has every case
    assert got == want


def test_no_round_sees_what_is_done(spark):
    """Across all rounds a text is asked of a model once, and only after those before it failed."""
    calls = spark.sparkContext.accumulator(0)
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, made(rng)) for i in range(20)], "doc_id long, body string")

    def counted(questions):
        calls.add(len(questions))
        return N.offline(questions)

    N.translate_articles(rows, counted).collect()
    expected = 0
    plain = N.offline

    def count(questions):
        nonlocal expected
        expected += len(questions)
        return plain(questions)

    N.offline = count
    try:
        for r in rows.collect():
            article(r.body)
    finally:
        N.offline = plain
    assert calls.value == expected


def test_odd_articles(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 34\n-- 56 --"), (4, "正文" * 900)], "doc_id long, body string")
    got = {r.doc_id: r for r in N.translate_articles(rows, lambda qs: [None] * len(qs), lambda pairs: [False] * len(pairs)).collect()}
    assert got[3].body == "12 34\n-- 56 --" and got[3].failed == 0  # figures aren't asked
    assert got[4].failed == 1 and got[4].notice == C.KEPT_CHUNKS.format(1, 1) and got[4].body == "正文" * 900
    assert {1, 2} <= set(got)
    assert N.translate_articles(rows.limit(0)).count() == 0


def test_whole_chunks_meet_no_join(spark, monkeypatch):
    """Chunks that aren't split keep their text beside the answer, through the rounds of retries too."""
    made_joins = []
    rows = spark.createDataFrame([(i, 0, f"some words {i}") for i in range(40)] + [(99, 0, "12 34\n56")], "doc_id long, chunk int, text string")
    join = type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, *a, **k: made_joins.append(a) or join(self, *a, **k))

    def answers(questions):
        """Every third text is left to the second model, every other answer has no Chinese until it is asked again; one stays as it was."""
        n = [int(q["text"].split()[-1]) for q in questions]
        return [None if (i % 3 == 0 and q["model"] == N.FIRST) or (i == 7 and q["again"]) else "plain" if i % 2 and not q["again"] else f"译文{i}" for i, q in zip(n, questions)]

    got = {r.doc_id: (r.text, r.translated, r.skipped, r.failed, r.retries) for r in N.translated_chunks(rows, answers).collect()}
    want = {i: (f"some words {i}", "plain" if i == 7 else f"译文{i}", False, False, i % 2 if i != 7 else 0) for i in range(40)}
    # the model that answered is asked again, so that of the first model's texts none is divisible by 3
    assert got == want | {99: ("12 34\n56", "12 34\n56", True, False, 0)}
    assert not made_joins


def test_chunks_beside_python(spark):
    """Texts of one chunk aren't handed to Python, and come out as it gives them."""
    edge = [C.CHUNK_CHARS + d for d in range(-5, 4)]
    texts = ["", None, "\n\n", "a\n\nb"] + ["é" * n for n in edge] + ["x" * 700 + "\n\n" + "字" * (n - 702) for n in edge] + ["```\n" + "y" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in rows.select("i", K.chunked(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else packed(t) for i, t in enumerate(texts)}


def test_tail_before_references(spark):
    refs = "[12] A. Author et al.\n[13] arXiv"
    rows = [["a", "b", "c"], ["a", "b", refs], ["a", refs, refs], [refs, "b", "", refs], ["a"], [refs], []]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>")
    assert [r[1] for r in sorted(frame.select("i", T.fallback_tail(F.col("c"))).collect())] == ["c", "b", None, "", None, None, None]


def test_query(spark):
    got = QUERIES["translate_articles"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.where(F.col("failed") > 0).count() and got.where("notice IS NULL").count()
