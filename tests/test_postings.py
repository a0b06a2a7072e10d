import random
from collections import defaultdict

import pytest

from weftline.operators import postings

SCHEMA = "doc_id long, keyword string, block string"


def pairs():
    rng = random.Random(5)
    rows = [(i - 40, "Hot", "x") for i in range(200)] + [(rng.randrange(-1000, 1 << 40), "wide", None) for _ in range(60)]
    rows += [(rng.randrange(200), f"t{rng.randrange(30)}", "x") for _ in range(500)]
    return [*rows, *rows[:50], (None, "hot", "x"), (3, None, "x"), (3, "hot", "y")]


def lists(rows):
    out = defaultdict(set)
    for i, t, _ in rows:
        if i is not None and t is not None:
            out[t.lower()].add(i)
    return out


@pytest.fixture(scope="module")
def index(spark):
    return postings.blocks(spark.createDataFrame(pairs(), SCHEMA), bits=3).cache()


def test_blocks_hold_every_posting_once(index):
    want, rows = lists(pairs()), index.collect()
    got = defaultdict(list)
    for r in rows:
        ids = [r["first"] + x for x in r["offsets"]]
        assert ids == sorted(set(ids)) and (ids[0], ids[-1], len(ids)) == (r["first"], r["last"], r["n"]) and len(ids) <= 8
        assert r["block"] == (0 if len(want[r["term"]]) <= 8 else ids[0] >> 3) and len({i >> 3 for i in ids}) == 1 or len(want[r["term"]]) <= 8
        got[r["term"]] += ids
    assert {t: sorted(v) for t, v in got.items()} == {t: sorted(v) for t, v in want.items()}
    assert {(r["term"], r["id"]) for r in postings.ids(index).collect()} == {(t, i) for t, v in want.items() for i in v}


def test_intersections_equal_sets(spark, index, tmp_path):
    want, rng = lists(pairs()), random.Random(6)
    names = sorted(want)
    queries = {f"q{k}": rng.sample(names, rng.randrange(1, 4)) for k in range(60)} | {"none": ["hot", "absent"], "one": ["absent"], "twice": ["HOT", "hot"], "frequent": ["hot", "wide"]}
    q = spark.createDataFrame([(k, t) for k, v in queries.items() for t in v], "query string, term string")
    expected = {(k, i) for k, v in queries.items() for i in set.intersection(*(want.get(t.lower(), set()) for t in v))}
    postings.save(index, f"file://{tmp_path}/ix")
    for ix in (index, postings.load(spark, f"file://{tmp_path}/ix")):
        got = [(r["query"], r["id"]) for r in postings.intersect(ix, q, bits=3).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_empty_and_unfit_ids(spark):
    empty = postings.blocks(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and postings.intersect(empty, spark.createDataFrame([("q", "a")], "query string, term string")).count() == 0
    with pytest.raises(ValueError, match="integers"):
        postings.blocks(spark.createDataFrame([("a", "b")], "doc_id string, keyword string"))
