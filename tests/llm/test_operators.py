"""The operators and the pipeline on awkward tables, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veclode.llm import chat, classifier, decontaminate, fingerprints, mixing, neardup, queries, rules, secrets, sharding, suffixes

Q = queries.queries()
FIND = {n.split("_")[0]: n for n in Q}


def prose(r, n):
    return " ".join("".join(r.choice(("an", "th", "ou", "é", "re", "st", "in")) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward():
    r = random.Random(5)
    a, b, item = prose(r, 300), prose(r, 200), prose(r, 30)
    words = a.split()
    near = [*words]
    near[40], near[200] = "changed", "words"
    token = "to" + "ken = abcdef123"
    key = "AK" + "IA" + "Q" * 16
    t = [
        None, "", " \n\t ", "one", "one two three four", "one two three four", a, a, " ".join(near), a.upper(), b + "\n" + a[:700], prose(r, 9000) + " " + b,
        ("line one here\n" * 30), "x y z " * 40, f"{prose(r, 40)} {token} {'0123456789abcdef' * 2} {key} {token[:9]}ab", prose(r, 60) + " " + item + " " + prose(r, 60),
        " ".join([*item.split()[:10], "other", *item.split()[11:]]) + " " + prose(r, 50), "LOUD!! WORDS!! " * 60, prose(r, 90) + " idiot scum " + prose(r, 60), "|".join(prose(r, 80).split()), "é K passſword=abcdef token=" + "a" * 7, b[:399], b[:399],
    ]
    rows = [{"doc_id": i, "text": x} for i, x in enumerate(t)] + [{"doc_id": 100 + i, "text": prose(r, 80)} for i in range(20)]
    rows += [{"doc_id": 6, "text": a}, {"doc_id": 3, "text": b}, {"doc_id": None, "text": a + " tail"}, {"doc_id": None, "text": None}, {"doc_id": 5, "text": "one two three four"}]
    for i, x in enumerate(rows):
        x |= {"lang": "en", "source": [None, "s1", "s2", "é", "S"][i % 5], "n_chars": 1, "rid": 7, "n": 1, "size": "x", "row": 2, "shard": "own", "bucket": i, "score": None}
    return rows, item


def write(path, documents, item, empty=False):
    path.mkdir()
    doc = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("size", pa.string()), ("row", pa.int64()), ("shard", pa.string()), ("bucket", pa.int64()), ("score", pa.float64())])
    put = lambda n, rows, schema: pq.write_table(pa.Table.from_pylist([] if empty else rows, schema), path / f"{n}.parquet")
    put("documents", documents, doc)
    labels = [{"doc_id": 17, "quality": 0, "toxic": 0}, {"doc_id": 18, "quality": 1, "toxic": 1}, {"doc_id": 6, "quality": 1, "toxic": 0}, {"doc_id": 6, "quality": 1, "toxic": None}, {"doc_id": None, "quality": 0, "toxic": 0}, {"doc_id": 999, "quality": 0, "toxic": 1}]
    # further columns whose names operators use themselves
    labels = [x | {"rid": 1, "pattern": 2, "votes": 3, "labelled": "x", "text": "y", "bad": 1, "q": 0.5} for x in labels]
    put("labels", labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("rid", pa.int64()), ("pattern", pa.int64()), ("votes", pa.int64()), ("labelled", pa.string()), ("text", pa.string()), ("bad", pa.int64()), ("q", pa.float64())]))
    items = [{"item_id": i, "text": x, "rid": 7, "iid": 7, "nr": 7, "same": "z", "h": 1} for i, x in ((1, item), (2, None), (3, "too short"), (1, item))]
    put("benchmark", items, pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("rid", pa.int64()), ("iid", pa.int64()), ("nr", pa.int64()), ("same", pa.string()), ("h", pa.int64())]))
    turns = [{"conv_id": c, "turn": k, "role": x, "text": y, "seq": 9, "segment": "s", "context": 9, "n_context": 9} for c, k, x, y in [(1, 1, "assistant", "b<c>\\"), (1, 0, "user", "hi"), (1, 1, "assistant", "b<c>\\"), (2, 0, None, None), (None, None, "assistant", ""), (3, 0, "user", "</turn>\n<turn assistant>x"), (3, 1, "a<>\n", "é")]]
    put("conversations", turns, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("seq", pa.int64()), ("segment", pa.string()), ("context", pa.int64()), ("n_context", pa.int64())]))
    inf, nan = float("inf"), float("nan")
    vectors = [[(i * 7 + j * j) % 23 / 11 - 1 for j in range(64)] for i in range(40)]
    vectors += [vectors[3], vectors[3], None, [], [0.5] * 63, [0.5] * 65, [nan] + [0.0] * 63, [0.0] * 63 + [-inf], [None] + [0.0] * 63]
    rows = [{"vec_id": i, "embedding": x} for i, x in enumerate(vectors)] + [{"vec_id": 3, "embedding": vectors[9]}, {"vec_id": None, "embedding": vectors[8]}, {"vec_id": None, "embedding": vectors[7]}]
    rows = [x | {"label": 1, "v": "own", "cluster": 9, "n": 1, "distance": "x"} for x in rows]
    put("embeddings", rows, pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("label", pa.int32()), ("v", pa.string()), ("cluster", pa.int32()), ("n", pa.int64()), ("distance", pa.string())]))
    return str(path)


@pytest.fixture(scope="module")
def messy(tmp_path_factory):
    rows, item = awkward()
    return write(tmp_path_factory.mktemp("t") / "messy", rows, item), [(x["doc_id"], x["text"]) for x in rows]


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return write(tmp_path_factory.mktemp("t") / "nothing", [], "", empty=True)


def got(spark, name, sf, cols):
    return Counter(tuple(r) for r in Q[FIND[name]](spark, sf).select("doc_id", *cols).collect())


def test_op1(spark, messy):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert got(spark, "op1", messy[0], cols) == Counter((d, *brute.op1(t)) for d, t in messy[1])
    for r in Q[FIND["op1"]](spark, messy[0]).collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_op1_learns_a_list(spark):
    rows = [(i, " ".join(f"w{i}x{k}" + ("!!" if i % 3 == 0 else "") for k in range(30))) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(120)], "doc_id long, quality int")
    out, learned = rules.apply_rules(docs, labels)
    assert learned and "bangs_a_word" in rules.as_sql(learned)
    assert {r["doc_id"] for r in out.where("not kept").collect()} == set(range(0, 120, 3))


def test_op1_learns_conjunctions(spark):
    """Bad are documents with marks and digits; either alone is good, so one threshold can't tell."""
    def text(i):
        return " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[k % 10]}{'xyz'[k % 3] * (k % 5)}" + ("!" if i % 2 else "q") + ("77" if i % 3 == 0 else "rr") for k in range(40))

    rows = [(i, text(i)) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(not (i % 2 and i % 3 == 0))) for i in range(600)], "doc_id long, quality int")
    stats = rules.counts(docs).withColumn("n_repeat_words", F.lit(0).cast("long"))
    learned = rules.learn(stats, labels)
    assert learned and len(learned[0]) == 2 and {t[0] for t in learned[0]} == {"bangs_a_word", "digits"}
    assert rules.learn(stats.repartition(7), labels) == learned
    bad = rules.with_features(stats).where(~rules.verdict(learned)).select("doc_id").collect()
    assert {r["doc_id"] for r in bad} == {i for i in range(600) if i % 2 and i % 3 == 0}


def test_op2(spark, messy):
    expected = brute.op2([t for _, t in messy[1]])
    assert got(spark, "op2", messy[0], ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == Counter((d, *x) for (d, _), x in zip(messy[1], expected, strict=True))


def test_op2_hypothetical_edges(spark):
    """Matches of exactly 400 bytes, at text ends, across many partners, and overlapping with themselves."""
    r = random.Random(3)
    s = lambda n: "".join(r.choice("abcde ") for _ in range(n))
    p, q = s(400), s(900)
    texts = [p + s(50), s(33) + p, q, q[:450] + s(10), s(5) + q[450:], q[200:601], "ab" * 300, "a" * 401, s(399), p[:399], q[:399] + "Z" + q[400:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    held, covered = suffixes.repeated(docs)
    marks = defaultdict(set)
    for x in covered.collect():
        marks[x["rid"]].update(range(x["lo"], x["hi"]))
    assert [len(marks[i]) for i in range(len(texts))] == [x[1] for x in brute.op2(texts)]


def test_op3(spark, messy):
    rows = Q[FIND["op3"]](spark, messy[0]).collect()
    assert len(rows) == len(messy[1]) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 17))


def test_op3_label_model_and_held_out(spark):
    r = random.Random(1)
    rows = [(i, prose(r, 80) + (" vile rotten " if i % 4 == 0 else " ") + prose(r, 40)) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 200)]
    docs = spark.createDataFrame(rows, "rid long, text string").withColumn("doc_id", F.col("rid"))
    out = {x["rid"]: x["kept"] for x in classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(out[i] == (i % 4 != 0) for i in range(200, 400)) >= 195
    # two labellers, one right nine times of ten, one blind: EM tells them apart
    counts = {2 + 3 * 2: 450, 2 + 3 * 1: 450, 1 + 3 * 2: 460, 1 + 3 * 1: 460, 2 + 3 * 2 + 9 * 2: 45, 2 + 3 + 9 * 2: 45, 1 + 6 + 9 * 2: 5, 1 + 3 + 9 * 2: 5, 1 + 3 + 9: 45, 1 + 6 + 9: 45, 2 + 3 + 9: 5, 2 + 6 + 9: 5}
    post, table, _ = classifier.label_model(counts, 3)
    assert post[2 + 3 * 1] > 0.7 > 0.3 > post[1 + 3 * 2]
    assert abs(table[1][1][2] - table[1][0][2]) < 0.1


def test_op4(spark, messy):
    found = {r["doc_id"] for r in Q[FIND["op4"]](spark, messy[0]).where("contaminated").collect()}
    assert found == {15, 16}


def test_op4_substitutions(spark):
    r = random.Random(9)
    item = [f"w{r.randrange(10**6)}" for _ in range(40)]
    docs = []
    for n in range(0, 24, 2):
        w = [*item]
        for k in r.sample(range(40), n):
            w[k] = f"other{k}"
        docs.append((n, prose(r, 30) + " " + " ".join(w).upper() + ", " + prose(r, 30)))
    out = {x["rid"] for x in decontaminate.overlaps(spark.createDataFrame(docs, "rid long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    expected = set()
    for n, t in docs:
        w = t.lower().replace(",", "").split()[30:70]
        if any(sum(a == b for a, b in zip(w[i : i + 16], item[i : i + 16], strict=True)) >= 12.8 for i in range(25)):
            expected.add(n)
    assert out == expected and 0 in out and 4 in out


def test_op5(spark, messy):
    expected = brute.op5(messy[1])
    assert got(spark, "op5", messy[0], ["n_words", "n_removed", "kept_sha256"]) == Counter((d, *x) for (d, _), x in zip(messy[1], expected, strict=True))


def test_op5_index_verifies_compacts_and_reopens(spark, tmp_path):
    r = random.Random(4)
    base = [prose(r, 60) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 5 else prose(r, 20) + " " + base[i % 7][:200]) for i in range(60)]
    docs = spark.createDataFrame(rows, "rid long, text string").withColumn("doc", F.col("rid"))
    root, places, expected = f"file://{tmp_path}/index", defaultdict(set), brute.op5(rows)
    for i, b in enumerate(fingerprints.batches_of(docs, 6)):
        # each batch comes in a session of its own, which knows the index by its manifest only, and is judged at once
        index = fingerprints.Index(spark.newSession() if i % 2 else spark, root, 3)
        assert index.parts == 3 and len(index.runs) == (0, 1, 2, 2, 3, 2)[i]
        for x in index.append(b).collect():
            places[x["rid"]] |= {k for p in [fingerprints._unpack(x["places"], "int32")] for w in p for k in range(w, w + 13)}
        done = {x["rid"] for x in b.select("rid").collect()}
        assert all(len(places[k]) == expected[k][1] for k in done)
    index = fingerprints.Index(spark, root)
    index.compact()
    assert [x.level for x in index.runs] == [2, 1] and [x.level for x in fingerprints.Index(spark, root).runs] == [2, 1]
    assert index.texts().count() == 60


def test_op5_appends_again_after_a_lost_driver(spark, tmp_path, monkeypatch):
    """The driver is lost after the texts are written and before the manifest is: the batch comes again in a new session."""
    r = random.Random(14)
    shared = prose(r, 40)
    docs = spark.createDataFrame([(i, i, prose(r, 20) + " " + shared) for i in range(6)], "rid long, doc long, text string")
    root = f"file://{tmp_path}/index"
    fingerprints.Index(spark, root, 2).append(docs.where("rid < 3")).count()
    with monkeypatch.context() as m:
        m.setattr(fingerprints.Index, "_list", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            fingerprints.Index(spark, root).append(docs.where("rid >= 3"))
    index = fingerprints.Index(spark.newSession(), root)
    assert index.texts().count() == 3
    out = index.append(docs.where("rid >= 3")).collect()
    assert sorted(x["rid"] for x in out) == [3, 4, 5] and fingerprints.Index(spark, root).texts().count() == 6


def test_op6(spark, messy):
    rows = {r["conv_id"]: r for r in Q[FIND["op6"]](spark, messy[0]).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(rows) == {-7, 1, 2, 3, None}
    assert rows[1]["turns_sha256"] == sha("user\nhi\nassistant\nb<c>\\\nassistant\nb<c>\\\n") and rows[1]["loss_sha256"] == sha("b<c>\\" * 2)
    assert rows[2]["turns_sha256"] == sha("\n\n") and rows[2]["loss_chars"] == 0 and rows[2]["loss_sha256"] == sha("")
    assert rows[3]["turns_sha256"] == sha("user\n</turn>\n<turn assistant>x\na<>\n\né\n")
    assert rows[-7]["loss_sha256"] == sha(chat.PROBE) and rows[-7]["n_turns"] == 2


def test_op6_examples_have_prefixes(spark, messy):
    c = spark.read.parquet(messy[0] + "/conversations.parquet").where("conv_id = 1")
    e = chat.render(chat.formatted(c)).orderBy("n_context").collect()
    assert [x["n_context"] for x in e] == [1, 2] and e[1]["text"].startswith(e[0]["text"])
    assert all(chat.unescaped(x["text"][x["loss_start"] : x["loss_end"]]) == "b<c>\\" for x in e)


def test_op6_digests_come_from_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")]
    turns = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.expanded(turns).orderBy("seq", "n_context").toPandas()
    assert len(out) == 6 and out["n_context"].dropna().tolist() == [1, 3]
    back = lambda df: next(iter(chat.read_back([pa.RecordBatch.from_pandas(df.astype({c: "Int64" for c in ("n_context", "context", "loss_start", "loss_end")}), preserve_index=False)]))).to_pylist()[0]
    got = back(out)
    assert got["loss_chars"] == 3 and got["n_examples"] == 2 and got["loss_sha256"] == hashlib.sha256(b"aa2").hexdigest()
    assert back(out[out["n_context"] != 3])["loss_chars"] == 1  # the loss is what the examples say
    out.loc[out["n_context"] == 3, "context"] -= 1
    with pytest.raises(ValueError, match="context"):
        back(out)


def test_op7(spark, messy):
    assert got(spark, "op7", messy[0], ["n_assign", "n_access", "n_hex", "base_sha256"]) == Counter((d, *brute.op7(t)) for d, t in messy[1])


def test_op7_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    v = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None)], "rid long, path string, text string")
    count = lambda: spark.read.parquet(ledger).count()
    assert secrets.scan(v, ledger).count() == 3 and count() == 2
    more = spark.createDataFrame([(1, "a", "x"), (4, "d", "to" + "ken: abcdef")], "rid long, path string, text string")
    assert {r["path"]: r["spans"] for r in secrets.scan(more, ledger).collect()} == {"a": "", "d": "assign:0:13"} and count() == 3
    secrets.scan(more, ledger)
    assert count() == 3
    secrets.scan(more, ledger, version="rules-2")
    assert count() == 5
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-twice")
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-twice")  # as two scans at the same time leave it
    assert secrets.scan(more, ledger + "-twice").count() == 2
    secrets.compacted(spark, ledger + "-twice", ledger + "-compact")
    assert spark.read.parquet(ledger + "-compact").count() == 5


def test_op8(spark, messy):
    expected = brute.op8(messy[1])
    found = Counter(tuple(r) for r in Q[FIND["op8"]](spark, messy[0]).select("doc_id", "n_shingles", "component_id", "kept").collect())
    # a component's id of a repeated doc_id is shared by its rows
    assert found == Counter((d, n, d if n == 0 else c, d == (d if n == 0 else c)) for (d, _), (n, c, _) in zip(messy[1], expected, strict=True))


def test_op8_chains_and_threshold(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):  # each differs a little from the one before: a chain that ends far from its start
        words[r.randrange(400)] = f"c{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "rid long, text string").withColumn("doc_id", F.col("rid"))
    assert {x["rid"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()} == {i: c for i, (_, c, _) in enumerate(brute.op8(rows))}


def test_op9(spark, messy):
    rows = Q[FIND["op9"]](spark, messy[0]).collect()
    assert len(rows) == len(messy[1])
    by, of = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and all(len(x) == 1 for x in of.values())


def test_op9_draws_sizes_and_crc_against_plain_python(spark, messy):
    import math
    import zlib

    def draw(level, child, key, weight):
        h = int(hashlib.md5(f"{sharding.SEED}:{level}{child}:{key}".encode()).hexdigest()[:12], 16)
        return -math.log((h + 1) / 2**48) / weight

    def down(key, shards):
        tree = sharding.topology(shards)
        best = lambda level, nodes: min((draw(level, c, key, w), c) for c, w in nodes)[1]
        region = best("r", [(x, sum(map(len, kk.values()))) for x, kk in tree.items()])
        rack = best("k", [(k, len(ss)) for k, ss in tree[region].items()])
        return best("s", [(s, 1) for s in tree[region][rack]])

    expected = Counter()
    for d, t in messy[1]:
        raw, key = (t or "").encode(), "" if d is None else str(d)
        expected[d, len(raw) + 16, zlib.crc32(raw), "key", down(key, 40), down(key, 41)] += 1
    rows = Q[FIND["op9"]](spark, messy[0]).select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard", "slot").collect()
    assert Counter(tuple(r)[:6] for r in rows) == expected
    again = Q[FIND["op9"]](spark.newSession(), messy[0]).select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard", "slot").collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_op9_weights_confine_movement(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"))
    tree = sharding.topology(40)
    a = d.select("doc_id", sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), tree, {7: 3.0}).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in a if r["a"] != r["b"]]
    assert moved and all(b // 10 == 0 for _, b in moved)  # only into the region of shard 7
    n = Counter(r["a"] for r in a)
    assert len(n) == 40 and max(n.values()) < 160 and min(n.values()) > 50


def test_op10(spark, messy):
    rows = Q[FIND["op10"]](spark, messy[0]).collect()
    assert len(rows) == len(messy[1]) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    again = Q[FIND["op10"]](spark, messy[0]).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    size = Counter()
    for r in rows:
        size[r["target"], r["source_size"]] += r["taken"]
    assert abs(sum(size.values()) - sum(r["size"] for r in rows)) <= 5
    assert all(abs(k - t) <= 2 for (t, _), k in size.items())


def test_op10_targets_and_seats(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 1, "d": 300}
    out = {r["source"]: r for r in mixing.quotas(mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")), seats=60, shards=4).collect()}
    w, left, t = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True)), dict(sizes), {}
    total = sum(sizes.values())
    while True:
        free = total - sum(t.values())
        over = {s for s in left if free * w[s] / sum(w[x] for x in left) > 3 * sizes[s]}
        if not over:
            t |= {s: free * w[s] / sum(w[x] for x in left) for s in left}
            break
        t |= {s: 3 * sizes[s] for s in over}
        left = {s: n for s, n in left.items() if s not in over}
    assert all(abs(out[s]["target"] - x) < 1e-6 for s, x in t.items())
    block = out["a"]["block"]
    seats, won = round(total / block), Counter()
    for _ in range(seats):
        best = max((s for s in t if won[s] < 3 * sizes[s] // block), key=lambda s: t[s] / (2 * won[s] + 1))
        won[best] += 1
    assert {s: out[s]["quota"] for s in t} == {s: won[s] for s in t}
    shards = Counter()
    for r in out.values():
        shards.update(r["by_shard"] or {})
    assert max(shards.values()) - min(shards.values()) <= 1


def test_texts_longer_than_what_is_read_at_a_time(spark, tmp_path_factory):
    r = random.Random(11)
    long = prose(r, 240_000) + " to" + "ken=abcdef1 " + prose(r, 20)
    assert len(long.encode()) > 1 << 20
    rows = [(1, long), (2, long + " and a tail"), (3, long[500_000:502_000]), (4, prose(r, 50)), (5, None)]
    sf = write(tmp_path_factory.mktemp("t") / "long", [{"doc_id": d, "text": t, "source": "s"} for d, t in rows], "an item of some words")
    assert got(spark, "op1", sf, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]) == Counter((d, *brute.op1(t)) for d, t in rows)
    assert got(spark, "op5", sf, ["n_words", "n_removed", "kept_sha256"]) == Counter((d, *x) for (d, _), x in zip(rows, brute.op5(rows), strict=True))
    assert got(spark, "op7", sf, ["n_assign", "n_access", "n_hex", "base_sha256"]) == Counter((d, *brute.op7(t)) for d, t in rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in Q[FIND["op8"]](spark, sf).collect()} == {d: (n, c if n else d) for (d, _), (n, c, _) in zip(rows, brute.op8(rows), strict=True)}
    removed = {x["doc_id"]: x["n_removed"] for x in Q[FIND["op2"]](spark, sf).collect()}
    assert removed == {1: len(long.encode()), 2: len(long.encode()), 3: len(rows[2][1].encode()), 4: 0, 5: 0}


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, nothing, name):
    assert Q[name](spark, nothing).count() == (1 if name.startswith("op6") else 0)


def test_pipeline_empty(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline(spark, messy):
    docs = spark.read.parquet(messy[0] + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, messy[0])
        assert out.columns == docs.columns, name
    one = corpus_pipeline.near_duplicates(spark, docs, messy[0])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert one.count() == len(set(brute.linked(rows)[1]))
    clean = {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, messy[0]).collect()}
    assert clean == {d for d, _ in rows} - {15, 16}
    out = corpus_pipeline.run(spark, messy[0])
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot", "grown_shard"] and out.count() > 0
