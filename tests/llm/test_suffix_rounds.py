"""Rounds of refinement of op2: four pointers a round, chains of every length."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np

from veclode.llm import suffixes


def lines(r, period, size):
    """A line of ``period`` characters, again and again."""
    return ("".join(r.choice("abcdefgh ") for _ in range(period)) * (size // period + 1))[:size]


def test_op2_few_rounds_for_long_chains(spark, monkeypatch):
    """Repeated lines make anchors lie close, so windows are chains of up to some 370 phrases: five rounds settle them, and the
    places of a round are paired with later ones once."""
    r, texts = random.Random(11), []
    s = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for period in (1, 2, 3, 5, 7, 11, 16, 23, 31, 40, 57, 80, 110, 150):
        t = lines(r, period, 1500)
        texts += [s(60) + t, t[:900] + s(1) + t[900:] + s(40), t[200:590] + s(300) + t[300:702]]
    both, prose = "a" * 700 + "gh" * 350, s(4000)
    texts += [s(30) + both, both + s(30)]
    texts += [prose, s(50) + prose[500:3100] + s(20), prose[:1200] + "!" + prose[1201:], s(900), None, ""]

    tables, old = defaultdict(list), suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name, *a: tables[name].append(old(df, name, *a)) or tables[name][-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    marks = defaultdict(set)
    for x in suffixes.repeated(docs)[1].collect():
        marks[x["rid"]].update(range(x["lo"], x["hi"]))
    expected = brute.op2(texts)
    assert [len(marks[i]) for i in range(len(texts))] == [x[1] for x in expected]
    assert [sum(p - 1 not in marks[i] for p in marks[i]) for i in range(len(texts))] == [x[2] for x in expected]

    m = Counter(x["m"] for t in tables["chains"] for x in t.select("m").collect())
    assert {(k, v // k) for v in m for k in (1, 4, 16, 64, 256) if k <= v < 4 * k} >= {(k, j) for k in (1, 4, 16, 64) for j in (1, 2, 3)} | {(256, 1)}
    assert len(tables["places"]) <= 5 and len(tables["chains"]) <= 5


def test_op2_anchors_do_not_depend_on_steps():
    """Texts are named in short steps: no run of windows is lost, doubled or cut at their ends."""
    r = random.Random(12)
    parts = ["".join(r.choice("abcd ") for _ in range(n)).encode() for n in (90_000, 399, 400, 0, 32_768, 70_001)] + [b"ab" * 40_000]
    raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    whole = suffixes.anchors(raw, ends, step=1 << 30)
    for step in (1 << 15, 1 << 12, 777):
        assert all(np.array_equal(a, b) for a, b in zip(suffixes.anchors(raw, ends, step=step), whole, strict=True))
