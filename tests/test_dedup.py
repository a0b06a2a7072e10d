import random

from pyspark.sql import functions as F

from weftline.operators import dedup, sections


def grams(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else {""}


def greedy(docs):
    kept, gone = [], set()
    for i, t in sorted(docs.items(), key=lambda x: (-len(x[1]), x[0])):
        g = grams(t)
        if any(len(g & k) / len(g | k) > 0.6 for k in kept):
            gone.add(i)
        else:
            kept.append(g)
    return gone


def corpus(seed):
    rng = random.Random(seed)
    words = [f"p{i}" for i in range(60)]
    docs = {}
    for i in range(40):
        if i and rng.random() < 0.5:
            w = docs[rng.randrange(i)].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        docs[i] = " ".join(w)
    return docs


def test_near_survivors_are_those_of_the_greedy_rule(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
        pairs = dedup.near_pairs(df)
        expected = {(a, b) for a in docs for b in docs if a < b and len(grams(docs[a]) & grams(docs[b])) / len(grams(docs[a]) | grams(docs[b])) > 0.6}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == expected
        assert {r["id"] for r in dedup.near_survivors(df, pairs).collect()} == greedy(docs)


def test_similarity_of_exactly_the_limit_stays(spark):
    # 4 shared of 5 + 3 - ... : sets of 4 and 4 with 3 shared are 0.6
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id int, text string")
    assert dedup.near_pairs(df).count() == 0


def test_exact_dedup_keeps_the_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "Hola  mundo"), (1, "hola mundo"), (2, "otra")], "doc_id int, text string")
    once = dedup.exact_dedup(df)
    assert sorted(r["doc_id"] for r in once.collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in dedup.exact_dedup(once).collect()) == [1, 2]


def test_report_adds_up(spark):
    docs = corpus(3)
    df = spark.createDataFrame([*docs.items(), (99, docs[0])], "doc_id int, text string")
    kept, report = dedup.deduplicate(df)
    r = report.first()
    assert r["total"] == 41 and r["exact_removed"] + r["near_removed"] + r["kept"] == 41 and kept.count() == r["kept"]


def test_sequential_ids(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aaaa"), (3, "aa"), (4, "")], "doc_id int, text string").repartition(3)
    assert {r["doc_id"]: r["seq_id"] for r in dedup.with_sequential_ids(df).collect()} == {2: "DOC-0001", 1: "DOC-0002", 3: "DOC-0003", 4: "DOC-0004"}


def test_sections(spark):
    para = "x" * 250
    body = "\n".join(["== Intro ==", para, "corto", "== Referencias ==", para, "=== Uso ===", *[para] * 7])
    got = sections.split_sections(spark.createDataFrame([(1, "T", body), (2, "U", para), (3, "V", None)], "id int, title string, body string")).orderBy("id", "part").collect()
    assert [(r["id"], r["part"], r["title"]) for r in got] == [(1, 1, "T — Intro"), *[(1, k, "T — Uso") for k in range(2, 7)], (2, 1, "U")]


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, category string")
    assert [r["id"] for r in sections.round_robin(df).orderBy("turn", "category").collect()] == [1, 3, 2]
    assert sections.round_robin(df).agg(F.max("turn")).first()[0] == 1


def test_rounds_drop_what_the_greedy_rule_drops(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    group = {100 + i: " ".join(w if rng.random() > 0.06 else f"x{rng.randrange(5)}" for w in base) for i in range(60)}
    for rounds, docs in ((0, corpus(3)), (1, corpus(4)), (6, corpus(5) | group), (2, group | {7: "", 8: "a", 9: "a b c"})):
        monkeypatch.setattr(dedup, "ROUNDS", rounds)
        df = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
        assert {r["id"] for r in dedup.near_dropped(df).collect()} == greedy(docs)
        kept, report = dedup.deduplicate(df)
        r = report.first()
        assert r["exact_removed"] + r["near_removed"] == len(greedy(docs)) and r["kept"] == kept.count() and kept.count() == len(docs) - len(greedy(docs))
    assert dedup.near_dropped(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_sets_of_rows_without_a_likely_pair_do_not_move(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 40])) for i in range(30)] + [(100, "uno dos tres cuatro cinco seis siete ocho"), (101, "uno dos tres cuatro cinco seis siete ocho nueve")]
    written, stored = {}, dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name, *a: written.setdefault(name, stored(df, name, *a)))
    df = spark.createDataFrame([(i, t if i >= 100 else " ".join(f"{w}x{i}" for w in t.split())) for i, t in rows], "doc_id int, text string")
    assert [(r["a"], r["b"]) for r in dedup.near_pairs(df).collect()] == [(100, 101)]
    assert {r["id"] for r in written["near-sets"].collect()} == {100, 101}
