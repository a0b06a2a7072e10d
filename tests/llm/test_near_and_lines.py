import random
import re

import numpy as np
import pytest

from weftline.llm import linededup, minhash, textgrams

LOW = {i: i + 32 for i in range(65, 91)}


def sets(docs):
    out = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append(frozenset(" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    return out


def groups(docs):
    s = sets(docs)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    return sorted(((i, len(s[k]), least[find(k)]) for k, (i, _) in enumerate(docs)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def near(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _h string")
    return sorted((r["_id"], r["n_shingles"], r["component"]) for r in minhash.near_duplicates(df).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if i > 3 and rng.random() < 0.6:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed) + [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE two"), (105, "one two three"), (106, "a b c d e"), (107, "A b\tc d\ne")]
    assert near(spark, docs) == groups(docs)


def test_long_copies_repeats_and_nothing(spark):
    long = " ".join(f"q{i}" for i in range(20_000))
    docs = [(5, long), (4, long + " end"), (7, "same text again and again"), (7, "same text again and again")]
    assert near(spark, docs) == groups(docs)
    assert near(spark, []) == []


def test_chain_is_one_component_and_blocks_find_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    w = [f"t{i}" for i in range(100)]
    docs = []
    for i in range(30):
        docs.append((i, " ".join(w)))
        w = w[4:] + [f"n{i}_{k}" for k in range(4)]
    assert near(spark, docs) == groups(docs)


@pytest.mark.parametrize("exact", [False, True])
def test_a_large_group_of_near_copies_and_the_exact_setting(spark, monkeypatch, exact):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TOGETHER", 16)
    rng = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(9)}" for w in base)) for i in range(150)]
    docs += [(200 + i, " ".join(f"z{rng.randrange(500)}" for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["_id"], r["n_shingles"], r["component"]) for r in minhash.near_duplicates(df, exact=exact).collect())
    assert got == groups(docs)


def test_copies_that_just_miss_are_not_paired_beyond_their_task(spark, monkeypatch):
    import random

    # copies of one text, each with two of 52 words changed: most pairs share about 0.7 of their shingles
    rng, base = random.Random(5), [f"w{k}" for k in range(52)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in (rng.randint(4, 24), rng.randint(28, 47)):
            words[k] = f"x{i}a{k}"
        docs.append((i, " ".join(words)))
    rows, cut = {}, minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df, name: rows.setdefault(name, cut(df, name)) if name.endswith("pairs") else cut(df, name))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r["_id"], r["n_shingles"], r["component"]) for r in minhash.near_duplicates(df).collect())
    assert got == groups(docs)
    assert rows["minhash-more-links-pairs"].count() <= 2 * len(docs)


def test_shingle_hashes_follow_the_texts():
    texts = ["a b c d e f", "A B  c d\te f", "x y", "", "é ü ñ a b c"]
    got = textgrams.shingle_sets([t.encode() for t in texts])
    assert [len(g) for g in got] == [2, 2, 1, 0, 2] and np.array_equal(got[0], got[1])
    alone = [textgrams.shingle_sets([t.encode()])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(got, alone, strict=True))


def lines_brute(docs, least=linededup.MIN_CHARS):
    seen, out = [], {}
    for k, (i, t) in enumerate(docs):
        kept = []
        for line in [] if t is None else t.split("\n"):
            f = line.lower().strip(linededup.WHITE)
            w = f.split(" ")
            if len(f) >= least:
                near = lambda g, v: linededup.within_one(w, v) if min(len(w), len(v)) >= 4 else max(len(w), len(v)) < 4 and min(len(f), len(g)) >= 20 and linededup.within_one(f, g)  # noqa: B023, E731
                dup = any(f == g or near(g, v) for g, v in seen)
                seen.append((f, w))
                if dup:
                    continue
            kept.append(line)
        out[k, i] = None if t is None else "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"palabra{i}" for i in range(12)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))
    pool = [line() for _ in range(25)]

    def some():
        w = rng.choice(pool).split(" ")
        k = rng.randrange(len(w))
        roll = rng.random()
        if roll < 0.2:
            w[k] = rng.choice(vocab)
        elif roll < 0.35:
            w.insert(k, rng.choice(vocab))
        elif roll < 0.5 and len(w) > 1:
            del w[k]
        return " ".join(w) if rng.random() < 0.8 else " ".join(w).upper() + " "

    def code():
        w = list(rng.choice(codes))
        k = rng.randrange(len(w))
        w[k] = rng.choice(["", w[k], "x", "éx", w[k] + "1"])
        return "".join(w)

    codes = ["https://ejemplo.es/ruta/12345", "参考资料：第一章的标题以及其他内容在这里列出来", "abcd", "uno dos palabras-largas-aquí", "1", "dos tres"]
    docs = [(i, "\n".join(rng.choice([some, some, code])() for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "corta\ncorta"), (63, "\n\n"), (64, " \t\n\r\n"), (65, "1\n2\n1")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, _gone string, pos int")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_gone", "pos", "n_lines", "n_removed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    want = lines_brute(docs)
    for k, (i, t) in enumerate(docs):
        assert rows[i]["text"] == want[k, i], (i, t)
        assert rows[i]["n_removed"] == (0 if t is None else len(t.split("\n")) - (len(want[k, i].split("\n")) if want[k, i] or rows[i]["n_lines"] > rows[i]["n_removed"] else 0))


def test_lines_of_empty_tables_repeats_and_long_lines(spark):
    schema = "doc_id long, text string"
    assert linededup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "una línea repetida aquí mismo"), (3, "una línea repetida aquí mismo"), (None, "UNA línea repetida aquí mismo")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, schema)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == [long] and by[2] == [""] and by[3] == ["", ""] and by[None] == ["UNA línea repetida aquí mismo"]


def test_lines_equal_the_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(11)
    vocab = ["sol", "mar", "luz", "río", "a"]
    line = lambda: rng.choice(["", " ", "\t"]) + rng.choice([" ", "-", "/"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(80)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(linededup.SQL).fetchall())


def test_many_lines_of_one_text_take_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "una misma línea\n" * n + "otra")], "doc_id long, text string")
        began = time.perf_counter()
        r = linededup.dedup_lines(df).first()
        assert r["n_removed"] == n - 1 and r["text"] == "una misma línea\notra"
        return time.perf_counter() - began

    seconds(10)
    assert seconds(200_000) < 12 * max(seconds(20_000), 1)


def test_within_one():
    one = linededup.within_one
    assert one("abc", "abc") and one("abc", "abx") and one("abc", "ab") and one("ab", "xab") and one("", "a") and one("", "")
    assert not one("abc", "acb") and not one("abc", "a") and not one("ab", "cd")


def test_null_ids_in_linked_sets_do_not_hide_the_least_id(spark):
    x = " ".join(f"w{i}" for i in range(60))
    near = x + " extra"
    docs = [(None, x), (5, x), (9, near), (None, "alone but for itself in this table"), (None, near), (12, "other words that nobody else has at all"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = groups(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for exact in (False, True):
        got = sorted(((r["_id"], r["n_shingles"], r["component"]) for r in minhash.near_duplicates(df, exact=exact).collect()), key=key)
        assert got == sorted(want, key=key)
        assert {(i, c) for i, _, c in got} >= {(5, 5), (9, 5), (None, 5), (12, 12), (None, None)}


def test_short_lines_by_code_points_and_columns_of_the_same_names(spark):
    docs = [(1, "Accept all cookies\nab\nthe quick brown fox jumps", 7, "a"), (2, "Accept all cookie\nac\nthe quick brown fax jumps\nthe quick red fox jumps high", 8, "b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_lines int, N_removed string")
    plain = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert plain[2]["text"] == "Accept all cookie\nac\nthe quick red fox jumps high" and (plain[2]["n_lines"], plain[2]["N_removed"], plain[2]["n_lines_"], plain[2]["n_removed_"]) == (8, "b", 4, 1)
    exact = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, least_words=1 << 30, least_chars=1).collect()}
    assert exact == {1: docs[0][1], 2: "the quick red fox jumps high"}
    three = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, least_words=3).collect()}
    assert three[2] == "ac\nthe quick red fox jumps high"
