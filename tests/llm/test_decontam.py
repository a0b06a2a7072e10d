import hashlib
import random
import re

from weftline.llm import decontam

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in wins:
                    hit.update(range(k, k + n))
                    its |= wins[g]
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return [a + b for a, b in zip(out, near(docs, items), strict=True)]


def near(docs, items, slop=3):
    """(document, items that match by proximity), by trying every start."""
    out = []
    for d, t in docs:
        w, its = words(t), set()
        for i, text in items:
            b = words(text)
            for k in range(max(len(b) - 9, 1) if b else 0):
                g = b[k : k + 10]
                for s in range(-slop, len(w) + slop):
                    at = lambda j: w[max(s + j - slop, 0) : max(s + j + slop + 1, 0)]  # noqa: B023, E731
                    stretch = w[max(s - slop, 0) : max(s + len(g) + slop, 0)]
                    if all(x in at(j) for j, x in enumerate(g)) and all(stretch.count(x) >= g.count(x) for x in g):
                        its.add(str(i))
                        break
        out.append((len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in decontam.contamination(d, b).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocab = "the of and to Alpha BETA gamma É école Ünter 7 42 zeta eta theta iota".split()
    say = lambda n: rng.choice([" ", "\n", ", ", " - "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 9, 10, 11, 25, 25, 40])] + [(8, None), (9, "..."), (10, say(0)), (11, "the the the the the the the the the the the")]
    items += [(12, items[5][1]), (13, "unseen " * 12)]
    docs = [(i, say(rng.randint(0, 40))) for i in range(40)]
    docs += [(100 + k, f"{say(3)} {items[k % 8][1].upper()} {say(2)}") for k in range(12)]
    docs += [(200, None), (201, ""), (202, " .. "), (203, "the " * 3000), (None, items[5][1]), (204, items[7][1] + " " + items[7][1]), (204, items[7][1] + " " + items[7][1])]
    assert order(run(spark, docs, items)) == order(brute(docs, items))


def test_case_folds_only_ascii(spark):
    item = "É uno dos tres cuatro cinco seis siete ocho nueve"
    docs = [(1, item), (2, item.replace("É", "é")), (3, item.upper()), (4, item.replace("uno", "UNO"))]
    assert order(run(spark, docs, [(1, item)])) == order(brute(docs, [(1, item)]))


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert [r[2] for r in run(spark, [(1, "a b c")], [])] == [0]
    assert [r[2] for r in run(spark, [(1, "a b c")], [(1, "!!"), (2, None)])] == [0]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontam, "small", lambda df, rows, limit=0: df)
    monkeypatch.setattr(decontam.common, "BROADCAST_ROWS", -1)
    docs, items = [(1, "x y z"), (1, "x y z"), (None, "y z"), (1, "x y z one two three four five six seven eight nine ten x")], [(1, "one two three four five six seven eight nine ten eleven"), (2, "y z")]
    assert order(run(spark, docs, items)) == order(brute(docs, items))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_proximity_allows_inserted_words_and_swaps_but_needs_every_word(spark):
    docs = [
        (1, ITEM), (2, ITEM.replace("beta", "beta so very")), (3, "alpha beta"), (4, "kappa only"), (5, "alpha " * 5), (6, "rose x rose"), (7, "rose"), (8, ITEM.replace("gamma delta", "delta gamma")),
        (9, ITEM.replace("delta", "other")), (10, ITEM.replace("epsilon", "epsilon " + "so " * 12)), (11, "kappa " + ITEM[:-6]), (12, "rose rose"), (13, " ".join(reversed(ITEM.split()))),
        *[(20 + k, "beta gamma delta epsilon zeta eta theta iota kappa") for k in range(9)],
    ]
    items = [(5, ITEM), (6, "rose rose"), (7, ITEM.replace("delta", "absent").replace("eta", "missing"))]
    got = run(spark, docs, items)
    assert order(got) == order(brute(docs, items))
    by = {r[0]: r for r in got}
    assert {d for d, r in by.items() if r[6]} == {1, 2, 6, 8, 12} and {d for d, r in by.items() if r[5]} == {1, 12}


def test_proximity_of_random_texts(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 4, 6, 12]))) for i in range(14)]
    docs = [(i, say(rng.randint(0, 30))) for i in range(60)]
    got = run(spark, docs, items)
    assert order(got) == order(brute(docs, items)) and any(r[6] > r[3] for r in got)


def test_both_results_equal_the_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, say(rng.choice([2, 5, 12]))) for i in range(12)] + [(20, None), (21, "a a b")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(50)] + [(60, items[2][1] + " x " + items[3][1]), (61, None)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert sorted(con.execute(decontam.SQL).fetchall()) == sorted(run(spark, docs, items))
