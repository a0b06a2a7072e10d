import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import htmltree, media, packing, pieces, quality, webp


def test_quality_on_held_out_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        w = [word() for _ in range(rng.randint(1, 300))]
        rows.append((i, " ".join(w) + "." if good else rng.choice([" | ".join(w), " ".join([w[0]] * len(w)) + " " + w[0] + " " + w[0], "!! ".join(w).upper() + "!!"])))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 50_000), (1003, "uno"), (1003, "uno")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (2, labels[2][1])], "doc_id long, quality int")
    got = quality.score_documents(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93


def test_quality_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "uno dos"), (2, None)], "doc_id long, text string")
    for labels, score in (([], 0.5), ([(3, 1)], None), ([(1, 1)], None)):
        got = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len({r["score"] for r in got}) == 1 and (score is None or got[0]["score"] == score)
    assert quality.score_documents(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def plain_passages(text):
    """Features of each passage, word by word and byte by byte."""
    kinds = []
    for c in range(256):
        ch = chr(c)
        kinds.append(
            8 if ch == "!" else 7 if c > 127 else 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 4 if ch == "\n" else 3 if ch in " \t\x0b\x0c\r" else 5 if ch in ".,;:'\"-?()" else 6
        )
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text)]
    n = max(-(-len(found) // quality.PASSAGE), 1)
    out = np.zeros((n, quality.N_FEATURES))
    padded = text + b" "
    for k in range(n):
        w = found[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        if not w:
            continue
        pairs = np.zeros((quality.C, quality.C))
        end = found[(k + 1) * quality.PASSAGE][0] if len(found) > (k + 1) * quality.PASSAGE else len(padded)
        for i in range(w[0][0], min(end, len(padded) - 1)):
            pairs[kinds[padded[i]], kinds[padded[i + 1]]] += 1
        out[k, : quality.C**2] = (pairs / max(pairs.sum(), 1)).ravel()
        said, last = set(), None
        for a, z in w:
            x = text[a:z]
            first, final, second = kinds[x[0]], kinds[x[-1]], kinds[x[min(1, len(x) - 1)]]
            row = (len(x) / 10, len(x) <= 3, x == last, x in said, final in (6, 8), first == 6 and final == 6, first == 1 and second == 1, final == 5)
            out[k, quality.C**2 :] += np.array(row, float) / len(w)
            said.add(x)
            last = x
    return out


def plain_score(p, bag):
    """The score of one bag, passage by passage."""
    hidden, logits = [], []
    for x in bag:
        h = np.tanh((x - p["mean"]) / p["std"] @ p["W"] + p["b"])
        gate = 1 / (1 + np.exp(-(h @ p["U"])))
        hidden.append(h)
        logits.append((np.tanh(h @ p["V"]) * gate) @ p["w"])
    weights = np.exp(logits) / np.exp(logits).sum()
    z = sum(a * h for a, h in zip(weights, hidden, strict=True))
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))


def bag_model(rng):
    size = lambda *s: rng.normal(size=s) / 2
    h = quality.HIDDEN
    return {
        "W": size(quality.N_FEATURES, h), "b": size(h), "V": size(h, h), "U": size(h, h), "w": size(h), "c": size(h), "d": np.array(0.3),
        "mean": size(quality.N_FEATURES), "std": np.abs(size(quality.N_FEATURES)) + 0.5,
    }


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    x, at, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    p = bag_model(rng)

    def loss(p):
        s = quality.forward(p, x, at)["y"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = quality.gradient(p, x, at, y)
    for name, g in grad.items():
        for _ in range(6):
            i = tuple(int(rng.integers(0, n)) for n in p[name].shape)
            up, down = ({**p, name: p[name].copy()} for _ in range(2))
            up[name][i] += 1e-6
            down[name][i] -= 1e-6
            assert np.isclose((loss(up) - loss(down)) / 2e-6, g[i], rtol=1e-4, atol=1e-8), name


def test_scores_equal_a_plain_evaluation():
    rng, word = np.random.default_rng(2), random.Random(2)
    p = bag_model(rng)
    texts = [b"", b" ", b"uno", "¡Hola! (ñandú) A1 b2 -- fin.".encode(), b"\n".join(b"x y z" for _ in range(90))]
    texts += [" ".join(word.choice(["la", "Casa", "!", "%%", "12", "fin.", "OK!", "é"]) for _ in range(word.randint(1, 300))).encode() for _ in range(12)]
    x, at = quality.passages(texts)
    got = quality.forward(p, x.astype(float), at)
    assert np.allclose(np.add.reduceat(got["a"], at[:-1]), 1)
    for k, t in enumerate(texts):
        plain = plain_passages(t)
        assert np.allclose(x[at[k] : at[k + 1]], plain, atol=1e-6), t
        assert np.isclose(got["y"][k], plain_score(p, plain), atol=1e-6)


def test_training_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 5)
    bag = quality.training_bag(b"uno dos tres. " * 2000, 5)
    assert len(bag) == 5 and len(quality.training_bag(b"")) == 1 and len(quality.training_bag(b"uno dos tres. " * 9000, None)) == 422
    rows = [(1, "uno dos tres")] * 50 + [(2, "%% !! %%")] * 50 + [(2, "otra fila")]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert "W" in model or "constant" in model


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.DEFAULT_MODEL)


TEXTS = [b"", b"a", "El modelo  dice\nhola ▁ café \U0001f600".encode(), b"   ", b"\x00\x01 x", b"the " * 400, ("word" * 300).encode(), "日本語のテキスト".encode()]


def test_pieces_are_lossless_and_depend_on_the_key_alone(vocabulary):
    keys = np.arange(len(TEXTS)).astype(np.uint64)
    ids, at = vocabulary.sample(TEXTS, keys, 3)
    for k, t in enumerate(TEXTS):
        own = ids[at[k] : at[k + 1]]
        assert vocabulary.decode(own) == t
        alone, _ = vocabulary.sample([t], keys[k : k + 1], 3)
        assert np.array_equal(own, alone)
    other, _ = vocabulary.sample(TEXTS, keys, 4)
    assert not np.array_equal(ids[: len(other)], other[: len(ids)])


def test_draws_follow_the_lattice(vocabulary):
    text = b"than"

    def paths(at):
        if at == len(text):
            return [((), 1.0)]
        out = []
        for end in range(at + 1, len(text) + 1):
            i = vocabulary.text.index(text[at:end], 259) if text[at:end] in vocabulary.text[259:] else (int(vocabulary.byte_id[text[at]]) if end == at + 1 else None)
            if i is not None:
                out += [((i, *p), w * float(np.exp(vocabulary.score[i]))) for p, w in paths(end)]
        return out

    all_paths = dict(paths(0))
    total = sum(all_paths.values())
    n = 20_000
    ids, at = vocabulary.sample([text] * n, np.arange(n).astype(np.uint64), 1)
    seen = {}
    for k in range(n):
        p = tuple(int(x) for x in ids[at[k] : at[k + 1]])
        seen[p] = seen.get(p, 0) + 1
    assert set(seen) <= set(all_paths)
    for p, w in all_paths.items():
        q = w / total
        assert abs(seen.get(p, 0) / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3


def test_encoding_and_decoding_tables(spark):
    rows = [(1, "Hola mundo", 7), (2, None, 7), (3, "", 7), (1, "Hola mundo", 7), (None, "x y", 7), (4, "largo " * 30_000, 7)]
    got = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int"))
    back = pieces.decode_documents(got).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in back)
    assert len({tuple(r["ids"]) for r in back if r["doc_id"] == 1}) == 1
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_webp_round_trips_with_every_transform(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 30, 2)
    few = rng.random() < 0.5
    img = rng.choice(rng.integers(0, 2**32, int(rng.integers(1, 40)), dtype=np.uint32), (h, w)) if few else rng.integers(0, 2**32, (h, w), dtype=np.uint32)
    tile = int(rng.integers(2, 5))
    th, tw = -(-h >> tile), -(-w >> tile)
    steps = []
    if rng.random() < 0.6:
        steps.append((webp.PREDICTOR, tile, rng.integers(0, 14, (th, tw))))
    if rng.random() < 0.6:
        steps.append((webp.CROSS, tile, rng.integers(0, 2**24, (th, tw), dtype=np.uint32) | np.uint32(0xFF000000)))
    if rng.random() < 0.6:
        steps.append((webp.GREEN,))
    if few and rng.random() < 0.5:
        steps = [(webp.PALETTE,)]
    data = webp.encode_argb(img, tuple(steps), int(rng.integers(0, 8)), bool(rng.random() < 0.6))
    assert np.array_equal(webp.decode(data), img)


def test_every_predictor_mode():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 2**32, (9, 11), dtype=np.uint32)
    for mode in range(14):
        data = webp.encode_argb(img, ((webp.PREDICTOR, 2, np.full((3, 3), mode)),))
        assert np.array_equal(webp.decode(data), img)


def test_a_hand_made_stream():
    # 1 x 1, no transforms, no cache, no meta codes; five simple codes of one symbol: ARGB ff 02 01 03
    w = webp._head(1, 1)
    w.put(0, 3)
    for s in (1, 2, 3, 255, 0):
        w.put(1, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(s, 8)
    data = webp._file(w.bytes())
    assert webp.decode(data).tolist() == [[0xFF020103]]


def test_broken_streams_are_refused():
    data = webp.encode_argb(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"", b"RIFF", data[:30], data[:20] + b"\x00" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


@pytest.mark.parametrize("text", [b"", b"a", b"ab" * 40, bytes(range(17)) * 20, bytes(range(256)) * 3, bytes(range(250)) * 9, b"x" * 1_200_000, "ñandú ".encode() * 99])
def test_payloads_survive_storage(text):
    p = media.payload(text)
    assert len(p) % 64 == 0 and len(p) > 0 and p.rstrip(b"\0") == text.rstrip(b"\0")
    assert webp.load(webp.store(p)).tobytes() == p


def test_media_columns(spark):
    rows = [(1, "hola"), (2, None), (3, ""), (1, "hola"), (None, "é" * 5000)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string"), with_media=True).collect()
    assert len(got) == 5
    for r in got:
        t = (dict(rows)[r["doc_id"]] or "").encode()
        back = webp.load(bytes(r["media"])).tobytes()
        assert back == media.payload(t) and r["n_bytes"] == len(t) and r["payload_bytes"] == len(back) and r["media_bytes"] == len(r["media"]) and r["tail_crc32"] == zlib.crc32(back[-64:])
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.randint(1, 60)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        rooms = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [(r, j) for j, r in enumerate(rooms) if r >= sizes[k]]
            if fits:
                rooms[min(fits)[1]] -= sizes[k]
            else:
                rooms.append(length - sizes[k])
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(length - sum(sizes[k] for k in r) for r in rows) == sorted(rooms) and sorted(k for r in rows for k in r) == list(range(len(sizes)))


def test_packing_is_lossless(spark, tmp_path):
    rows = [(i, "palabra " * (i * 37 % 500)) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 3000), (62, "x" * 3000)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), length=64).collect()
    enc, parts = packing.encoding(packing.DEFAULT_RANKS), {}
    for r in packed:
        assert len(r["ids"]) == 64 and r["cu_seqlens"][-1] == r["n_ids"] and r["resets"] == r["cu_seqlens"][:-1] and set(r["ids"][r["n_ids"] :]) <= {packing.END}
        for k, (doc, off) in enumerate(zip(r["doc_ids"], r["offsets"], strict=True)):
            parts.setdefault((doc, off), []).append(r["ids"][r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]])
    for doc, t in dict(rows).items():
        copies = sum(i == doc for i, _ in rows)
        got = [x for (d, _), v in sorted(parts.items()) if d == doc for x in v[0]]
        assert got == [*enc.encode_ordinary(t or ""), packing.END] and all(len(v) == copies for (d, _), v in parts.items() if d == doc)
    files = packing.write_packed(packing.pack_documents(spark.createDataFrame(rows[:9], "doc_id long, text string"), length=64), str(tmp_path / "p")).collect()
    for r in files:
        cu, pos = np.frombuffer(r["cu_bin"], np.int32), np.frombuffer(r["position_bin"], np.int32)
        assert len(np.frombuffer(r["ids_bin"], np.uint16)) == 64 and all(pos[c] == 0 for c in cu[:-1]) and all(pos[b - 1] == b - a - 1 for a, b in zip(cu, cu[1:], strict=False))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_long_white_space_keeps_its_ids(seed):
    rng, enc = random.Random(seed), packing.encoding(packing.DEFAULT_RANKS)
    runs = [" ", "\n", "\t", "\u2003", "\u3000", "\x1c", "\x85"]
    text = "".join(rng.choice(runs) * rng.randint(1, 2500) if rng.random() < 0.5 else rng.choice(["a", "palabra", "1", "...", "'s", "é"]) for _ in range(30))
    assert packing.encode_text(enc, text) == enc.encode_ordinary(text)


def test_packing_survives_very_long_runs(spark):
    rows = [(1, "\n" * 1_500_000), (2, "a" + " " * 1_500_000 + "b"), (3, "x" * 300_000), (4, "1.") ]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_ids", "offsets", "cu_seqlens", "ids").collect()
    enc, parts = packing.encoding(packing.DEFAULT_RANKS), {}
    for r in packed:
        for k, at in enumerate(zip(r["doc_ids"], r["offsets"], strict=True)):
            parts[at] = r["ids"][r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    for doc, text in rows:
        ids = [x for (d, _), v in sorted(parts.items()) if d == doc for x in v]
        assert ids[-1] == packing.END and enc.decode(ids[:-1]) == text


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 150), "palabra " * rng.randint(0, 300)) for _ in range(200)] + [(None, "nada")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(str, packing.pack_documents(df.repartition(n), length=128, window_bytes=60_000).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_shipped_model_files(spark, tmp_path):
    import shutil

    shutil.copy(packing.DEFAULT_RANKS, tmp_path / "own.tiktoken")
    spark.sparkContext.addFile(str(tmp_path / "own.tiktoken"))
    df = spark.createDataFrame([(1, "uno dos")], "doc_id long, text string")
    got = packing.pack_documents(df, ranks="/nowhere/own.tiktoken").first()
    assert got["ids"] == packing.pack_documents(df).first()["ids"]


def marginals_by_sums(unary, pair, parent):
    n = len(unary)
    total, on = 0.0, np.zeros(n)
    for s in range(2**n):
        y = [(s >> i) & 1 for i in range(n)]
        e = sum(unary[i] * y[i] for i in range(n)) + sum(pair[i, y[i]] for i in range(1, n) if y[i] == y[parent[i]])
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    return on / total, np.log(total)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        unary, pair = rng.normal(size=n), rng.normal(size=(n, 2))
        q, joint, log = htmltree.marginals(unary, pair, parent)
        want, z = marginals_by_sums(unary, pair, parent)
        assert np.allclose(q, want) and np.isclose(log, z) and all(np.isclose(sum(j), 1) for j in joint[1:])


def test_extraction_on_held_out_layouts():
    w = htmltree.weights()
    hits = total = said = 0
    for source, blocks in htmltree.labelled_pages(80, seed=123):
        got = [x for x in htmltree.extract(source, w).split("\n\n") if x]
        want = [html.unescape(b) for b in blocks]
        hits += len(set(got) & set(want))
        total, said = total + len(set(want)), said + len(set(got))
    assert hits / total > 0.95 and hits / said > 0.95


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
        ("<nav><a href=/>x</a></nav><article><h1>T &amp; u</h1><p>Uno<br>dos\n tres<p>Cuatro &copy; &#233; &am</article><footer>f</footer>", "T & u\n\nUno dos tres\n\nCuatro © é &am"),
        ("<body><header>menu</header><main><p>Hola <b>mundo</b>.</p><script>var a='<p>no</p>'</script><aside>x</aside></main>", "Hola mundo."),
        ("<article><p>Hola.</p><div class='ad'>Compra ya.</div><p>Adiós.</p></article><section class=comments><p>Opino que no.</p></section>", "Hola.\n\nAdiós."),
        ("<article><p>a < b y c > d</p></article>", "a < b y c > d"),
        ("<article><!-- <p>oculto</p> --><p title='a>b'>visto</p><style>p{}</style>", "visto"),
    ],
)
def test_pages(page, text):
    assert htmltree.extract(page, htmltree.weights()) == text


def test_deep_and_wide_pages():
    w = htmltree.weights()
    assert htmltree.extract("<div>" * 3000 + "<article><p>fondo</p></article>", w) in ("fondo", "")
    assert htmltree.extract("<article>" + "<p>uno dos.</p>" * 3000 + "</article>", w).count("uno") == 3000


def test_generated_pages_give_their_articles():
    import pyarrow.parquet as pq

    w, total, right = htmltree.weights(), 0, 0
    for source in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        m = re.search(r"<article[^>]*>(.*?)</article>", source or "", re.S)
        if m is None:
            continue
        inside = re.sub(r"(?s)<(aside|nav|footer|form|script|style|figure)\b.*?</\1>", "\n", m[1])
        words = set(re.findall(r"\w+", html.unescape(re.sub(r"<[^>]+>", " ", inside))))
        got = set(re.findall(r"\w+", htmltree.extract(source, w)))
        total, right = total + 1, right + (got <= words and len(got) >= 0.9 * len(words))
    assert total > 50 and right / total > 0.95


def test_deep_pages_take_time_in_proportion():
    import time

    w = htmltree.weights()

    def seconds(n):
        page = "<ul>" + "<div>" * n + "<article>" + "<li>uno dos.</section>" * n + "</article>"
        began = time.perf_counter()
        htmltree.extract(page, w)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 25 * max(seconds(2_000), 0.02)


def test_page_table(spark):
    rows = [(1, "u", "<article><p>Hola.</p></article>", "z"), (2, None, None, "z"), (2, None, None, "z"), (None, "u", "", "z")]
    got = htmltree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, x string")).collect()
    assert sorted(r["text"] for r in got) == ["", "", "", "Hola."]
    assert re.fullmatch(r"\S+", got[0].asDict()["x"])
    assert htmltree.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def block_f1(pairs):
    """F1 of blocks over (expected, found) lists."""
    hit = sum(sum((Counter(a) & Counter(b)).values()) for a, b in pairs)
    return 2 * hit / max(sum(len(a) + len(b) for a, b in pairs), 1)


@pytest.mark.parametrize(("opening", "closing"), [("<section>", "</section>"), ("<div>", "</div>"), ("<main>", "</main>"), ("<table><tr><td>", "</td></tr></table>"), ("<blockquote>", "</blockquote>"), ("<section id=zq7>", "</section>")])
def test_supplied_articles_in_other_containers(opening, closing):
    import pyarrow.parquet as pq

    w = htmltree.weights()
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    split = lambda t: t.split("\n\n") if t else []
    pairs = [(split(htmltree.extract(h, w)), split(htmltree.extract(h.replace("<article>", opening).replace("</article>", closing), w))) for h in pages]
    kept = sum(sum((Counter(a) & Counter(b)).values()) for a, b in pairs) / sum(len(a) for a, _ in pairs)
    assert kept >= 0.99 and block_f1(pairs) >= 0.99


def test_layouts_with_names_that_the_fit_did_not_see():
    w = htmltree.weights()
    rng = random.Random(3)
    known = re.compile(r"\b(" + "|".join(htmltree.WORD_GROUPS) + r")\b")
    unseen = "lede hentry blurb copyblock zone panel box grid wrapper shell mod unit tile strip".split()

    def renamed(page):
        return re.sub(r"((?:class|id)=)([\"'])([^\"']*)\2", lambda m: m[1] + m[2] + known.sub(lambda _: rng.choice(unseen), m[3]) + m[2], page)

    pages = htmltree.labelled_pages(150, seed=77)
    f1 = lambda change: block_f1([(blocks, [t for t in htmltree.extract(change(page), w).split("\n\n") if t]) for page, blocks in pages])
    # measured: 0.950, where nearly half of the named containers mislead, and 0.935 without any known name:
    # adverts of one sentence within an article then look like its paragraphs
    assert f1(lambda p: p) >= 0.94
    assert f1(renamed) >= 0.92
