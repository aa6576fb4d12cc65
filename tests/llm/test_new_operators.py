"""Centroids, languages and conversation repair, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import Q, awkward, messy, write  # noqa: F401  the fixture of awkward tables

from veclode.llm import centroids, conversations, languages

# --- centroids -----------------------------------------------------------------------------------------------------


def plain_centroids(rows, k=16, rounds=3):
    """rows: (vec_id, components or None)."""
    kept = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else w for j, w in enumerate(c)]
    at = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in at:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in at)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_op11(spark, messy):  # noqa: F811
    got = Counter(tuple(r) for r in Q["op11_centroids"](spark, messy[0]).select(*COLUMNS).collect())
    t = pq.read_table(messy[0] + "/embeddings.parquet").to_pylist()
    assert got == plain_centroids([(r["vec_id"], r["embedding"]) for r in t]) and sum(got.values()) == 45


def test_op11_few_vectors_and_far_components(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.uniform(-3e4, 3e4) if i else 1e9 / 64 / 8] * 64) for i in range(5)]
    (tmp_path / "t").mkdir()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(f"{tmp_path}/t/embeddings.parquet")
    assert Counter(tuple(x) for x in Q["op11_centroids"](spark, f"{tmp_path}/t").select(*COLUMNS).collect()) == plain_centroids(rows)
    with pytest.raises(Exception, match="exceeds"):
        centroids.integers(df.select("vec_id", F.transform("embedding", lambda x: x * 1e6).alias("embedding")))


def test_op11_tables_give_squared_distances():
    r = np.random.default_rng(3)
    x, c = r.integers(-40, 40, (500, 64)), r.integers(-40, 40, (16, 64))
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (centroids.tabulated(x, c) == d).all()
    cluster, dist = centroids.nearest(np.tile(x, (20, 1)), np.concatenate((c, c)))  # more than a block, and ties
    assert (cluster == np.tile(d.argmin(axis=1), 20)).all() and (dist == np.tile(d.min(axis=1), 20)).all()


# --- languages -----------------------------------------------------------------------------------------------------

WORDS = {"en": "the and of thing ing was that here with tion from".split(), "de": "der die und ung nicht schein ist für über keit".split(), "ru": "не что она быть этот который для".split()}


def text_of(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(("", "", r.choice(WORDS[lang]))) for _ in range(n))


def test_op12_held_out(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, text_of(r, lang := r.choice(list(WORDS)), r.randint(3, 60)), lang, "s") for i in range(600)]
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 34 \n!", "de", "s"), (1003, "THE AND OF THAT", None, "s"), (1004, "x" * 5, None, "s"), (None, rows[0][1], rows[0][2], "s"), (0, rows[0][1], rows[0][2], "s"), (1005, text_of(r, "de", 300_000), "de", "s")]
    (tmp_path / "t").mkdir()
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumns({"key": F.lit(1), "slot": F.lit("x"), "score": F.lit(None).cast("string"), "lang_pred": F.lit("fr")})
    df.coalesce(1).write.parquet(f"{tmp_path}/t/documents.parquet")
    out = Q["op12_languages"](spark, f"{tmp_path}/t").collect()
    assert len(out) == len(rows) + len(odd) and {x["lang_pred"] for x in out} <= {*WORDS, "und"}
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode() if x["doc_id"] is not None else b"") % 3 == 1) and 0 <= x["score"] <= 1 for x in out)
    by = {x["doc_id"]: x for x in out}
    held = [i for i, *_ in rows if by[i]["held_out"]]
    assert sum(by[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held) > 100
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1005)] == ["und", "und", "und", "en", "de"] and by[1002]["score"] == 0
    same = {(x["lang_pred"], x["score"]) for x in out if x["doc_id"] in (None, 0)}
    assert len(same) == 1
    # neither the language nor the source nor the id of a document that is held out matters
    other = df.withColumns({"lang": F.when(languages.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("t")})
    (tmp_path / "u").mkdir()
    other.repartition(5).write.parquet(f"{tmp_path}/u/documents.parquet")
    assert Counter(map(tuple, Q["op12_languages"](spark, f"{tmp_path}/u").collect())) == Counter(map(tuple, out))


def test_op12_features_of_parts_and_plain_counts(monkeypatch):
    text = "Été  THE-end! " * 9 + "Ω1a"
    x = re.sub(r"[\W\d_]+", "\0", text.lower())
    x = ("" if x.startswith("\0") else "\0") + x + ("" if x.endswith("\0") else "\0")
    grams = Counter(x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n] != "\0")
    whole = languages.slots(text, {})
    assert whole[1].sum() == sum(grams.values()) and sorted(whole[1]) == sorted(grams.values())
    for part in (1, 2, 5, 17):
        monkeypatch.setattr(languages, "PART", part)
        at, n = languages.slots(text, {})
        assert (at == whole[0]).all() and (n == whole[1]).all(), part
    assert languages.slots("12 !", {}) is None and languages.slots(None, {}) is None


def test_op12_ftrl_is_sparse_and_temperature_calibrates():
    r = np.random.default_rng(5)
    model = languages.Ftrl(2)
    for _ in range(600):  # slot 1 tells, slots 10 to 60 are noise
        y = int(r.random() < 0.5)
        at = np.unique(np.append(r.integers(10, 60, 3), 1 + y))
        model.learn(at, np.ones(len(at)) / np.sqrt(len(at)), y)
    w = model.weights(np.arange(languages.SLOTS + 1))
    assert w[1, 0] > 1 > -1 > w[1, 1] and (w[100:-1] == 0).all()
    # plain step by step, from the definition
    plain, (z, n) = languages.Ftrl(2), np.zeros((2, 2))
    for x, y in ((1.0, 0), (0.5, 1), (2.0, 1)):
        plain.learn(np.array([7]), np.array([x]), y)
    z, n, b, m = np.zeros(2), np.zeros(2), np.zeros(2), np.zeros(2)
    for x, y in ((1.0, 0), (0.5, 1), (2.0, 1)):
        w7 = np.where(abs(z) > languages.LASSO, -(z - np.sign(z) * languages.LASSO) / ((languages.DAMP + np.sqrt(n)) / languages.RATE + languages.RIDGE), 0)
        w0 = -b / ((languages.DAMP + np.sqrt(m)) / languages.RATE)
        p = np.exp(w7 * x + w0) / np.exp(w7 * x + w0).sum()
        p[y] -= 1
        for g, a, c, w in ((p * x, z, n, w7), (p, b, m, w0)):
            a += g - (np.sqrt(c + g * g) - np.sqrt(c)) / languages.RATE * w
            c += g * g
    assert np.allclose(plain.z[[7, languages.SLOTS]], [z, b]) and np.allclose(plain.n[[7, languages.SLOTS]], [n, m])
    s = r.normal(size=(4000, 3))
    y = np.array([r.choice(3, p=p) for p in languages.softmax(s)])
    assert abs(languages.temperature(4 * s, y) - 4) < 0.5 and languages.temperature(s[:0], y[:0]) == 1


# --- conversations -------------------------------------------------------------------------------------------------


def enumerated(codes):
    """The least (cost, audit) of all audits with up to four insertions, by trying each."""
    best = None

    def go(i, q, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and q in (0, 3):
            best = (cost, audit) if best is None else min(best, (cost, audit))
        for role, r in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q].items():
            if role != "s" and inserts < 4:
                go(i, r, cost + 2, audit + "I", inserts + 1)
            if i < len(codes) and codes[i] != "-":
                cut = codes[i].isupper()
                if role == codes[i].lower():
                    go(i + 1, r, cost + cut, audit + "K", inserts)
                if role != "s":
                    go(i + 1, r, cost + 2 + cut, audit + "R", inserts)
        if i < len(codes):
            go(i + 1, q, cost + 3, audit + "D", inserts)

    go(0, 0, 0, "", 0)
    return best


def relaxed(codes):
    """The same for long ones: row by row, the least (cost, audit) of each state."""
    at = {0: (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(4):
            for q, (cost, audit) in list(at.items()):
                r = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                at[r] = min(at.get(r, (cost + 2, audit + "I")), (cost + 2, audit + "I"))
        if i == len(codes):
            return min(at[q] for q in (0, 3))
        new = {}
        for q, (cost, audit) in at.items():
            steps = [(q, 3, "D")]
            for role, r in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q].items():
                if codes[i] != "-":
                    cut = codes[i].isupper()
                    steps += [(r, cut, "K")] * (role == codes[i].lower()) + [(r, 2 + cut, "R")] * (role != "s")
            for r, c, letter in steps:
                new[r] = min(new.get(r, (cost + c, audit + letter)), (cost + c, audit + letter))
        at = new


def test_op13_lattice_against_enumeration():
    r = random.Random(1)
    for _ in range(1500):
        codes = "".join(r.choice("suaSUAx-ua") for _ in range(r.randint(0, 6)))
        assert conversations.cheapest(codes) == enumerated(codes) == relaxed(codes), codes


@pytest.mark.parametrize("segment", [1, 3, 50, 8192])
def test_op13_long_ones_and_segments(monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    r = random.Random(segment)
    for n in (0, 2, 9, 50, 51, 150, 700):
        codes = "".join(r.choice("suaSUAx-uaua") for _ in range(n))
        lattice = conversations.Lattice()
        for c in codes:
            lattice.add(c)
        assert lattice.solved() == relaxed(codes)


def plain_repair(rows):
    """rows: (conv_id, turn, role, text); as the operator's query, by hand."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        role, text = (" " if role is None else role), (" " if text is None else text)
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, n, codes = set(), Counter(), ""
        for _, role, text in own:
            bare = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            code = role[0] if role and role[0] in "sua" else "x"
            codes += "-" if fault in ("blank", "duplicate") else code.upper() if fault else code
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = relaxed(codes)
        kept, left = [], iter(own)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter in "IR":
                odd = bool(kept) and kept[0].startswith("s")
                role = "assistant" if (len(kept) - odd) % 2 else "user"
            if letter != "D":
                kept.append(f"{role}:{text}")
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_op13_awkward_rows(spark, messy):  # noqa: F811
    t = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(messy[0] + "/conversations.parquet").to_pylist()]
    assert Counter(map(tuple, Q["op13_conversations"](spark, messy[0]).select(*REPAIRED).collect())) == plain_repair(t)


def test_op13_many(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    say = lambda: r.choice(("yes.", "no!", "what?", "cut", " ", "", "so. \t", "ends ", "é.\n", "\U0001f600", "two words.", None))
    role = lambda: r.choice(("user", "user", "assistant", "assistant", "system", "tool", "u", "", None))
    rows = [(c, r.choice((None, k, k, k + 2)), role(), say()) for c in [*range(150), None] for k in range(r.randint(1, 12))]
    rows += [(7000, k, "user" if k % 2 else "assistant", f"turn {k}" + "." * (k % 3)) for k in range(600)]
    rows += [(7001, 0, "user", "long " * 300_000 + "end."), (7001, 1, "assistant", "long " * 300_000)]
    rows += [(c, 0, "user", "only") for c in range(8000, 8060)]  # some of them lose their only row
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({"initial": F.lit("z"), "fault": F.lit("blank"), "audit": F.lit("K")}).write.parquet(f"{tmp_path}/t/conversations.parquet")
    out = Q["op13_conversations"](spark, f"{tmp_path}/t").select(*REPAIRED).collect()
    assert Counter(map(tuple, out)) == plain_repair(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert any(tuple(x)[1:] == (0, 0, 0, 0, 0, 0, "", empty) for x in out)
