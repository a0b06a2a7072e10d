import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_decontam import brute
from test_models_and_media import plain_passages, plain_score
from test_near_and_lines import groups, lines_brute
from weftline.llm import pieces, quality, queries

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    good = {i: text() for i in range(80)}
    bad = {i: " | ".join(word() for _ in range(60)) for i in range(80, 130)}
    leak, line = text(30), text(15)
    good[0] = f"{text()}\n{line}"
    good[1] = f"{text()}\n{line}"
    good[2] = f"{text(5)} {leak} {text(5)}"
    copy = text(100)
    good[3], good[4] = f"{copy} uno dos", f"{copy} tres"
    rows = [(i, t, "en", "src", len(t)) for i, t in (good | bad).items()] + [(5, good[5], "en", "src", len(good[5])), (200, None, None, None, None), (201, "", "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(130)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{len(at)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        at[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    a, b, c, d, e = at.values()
    assert len([i for i in a if i is not None and i < 80]) >= 76 and len([i for i in a if 80 <= i < 130]) <= 3
    assert b[0]["text"].endswith(line) and not b[1]["text"].endswith(line) and b[1]["n_chars"] == len(b[1]["text"])
    assert 3 in c and 4 not in c and set(c) >= {0, 1, 2, 5}
    assert 2 in c and 2 not in d and set(c) - set(d) == {2}
    assert set(e) == set(d) and all(r["lossless"] for r in e.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    lines = [text(rng.randint(1, 9)) for _ in range(12)]
    items = [(1, text(14)), (2, text(3)), (3, None)]
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.25:
            t = " | ".join(rng.choice(vocab) for _ in range(rng.randint(5, 80)))
        elif kind < 0.5 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = "\n".join([text(rng.randint(20, 60)), *rng.sample(lines, rng.randint(0, 3)), text(25)])
            if rng.random() < 0.15:
                t += " " + items[0][1].upper()
        rows.append((i, t))
    rows += [rows[3], rows[3], (None, rows[7][1]), (300, None), (301, ""), (302, " \n ")]
    table = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("|" not in (t or "|")), 0) for i, t in rows[:140]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")

    score = {t: plain_score(model, plain_passages((t or "").encode())) for _, t in rows}
    assert all(abs(s - quality.THRESHOLD) > 1e-4 for s in score.values())
    kept = [r for r in rows if score[r[1]] >= quality.THRESHOLD]
    once = sorted(set(kept), key=order)
    without = lines_brute(once)
    kept = [(i, without[once.index((i, t)), i]) for i, t in kept]
    least = {i: c for i, _, c in groups_of(kept)}
    kept = [r for r in sorted(set(kept), key=order) if least[r[0]] == r[0]]
    hit = {r[0] for r in brute(kept, items) if r[5]}
    kept = [r for r in kept if r[0] not in hit]
    want = pieces.encode_documents(spark.createDataFrame([(i, t, "en") for i, t in kept], "doc_id long, text string, lang string")).collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(kept) < len(rows) and sorted(map(str, got)) == sorted(map(str, want))


def groups_of(docs):
    """groups() where ids may be null."""
    least = min((i for i, _ in docs if i is not None), default=0) - 1
    return [(None if i == least else i, n, None if c == least else c) for i, n, c in groups([(least if i is None else i, t) for i, t in docs])]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    r = c.sql(queries.oracle_sql()[name])
    assert sorted(r.columns) == cols
    assert sorted(tuple(x[k] for k in cols) for x in df.collect()) == sorted(tuple(x[r.columns.index(k)] for k in cols) for x in r.fetchall())


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
