"""URL rules, importance resampling and collocations against plain versions in Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from weftline.llm import collocations, resampling, urlfilter

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        h, p = h.lower(), slash + p
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, verdict))  # "block" after "allow" in order of letters
    return host, path, best and best[2], best[3] if best else default


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules), **more)
    return {r["_id"]: tuple(r)[1:] for r in out.collect()}


def test_urls_of_the_contract(spark):
    urls = [
        "http://a.example.net/en/1", "http://example.net/en", "HTTP://EXAMPLE.NET/en/?q=/de/", "https://net/", "https://net", "https://x.net?y", "https://xnet/",
        "http://example.com/de/x", "http://notexample.com/de/", "http://example.com/DE/", "http://www.example.org/fr/", "http://example.org/frx", "mailto:a@b.net",
        "", None, "://", "http:///en/", "http://a..net/", "http://.net/", "http://ünet.net/ü?://x.org/fr/", "http://user@example.net:80/en/", "see http://one.net/a://two.org/fr/",
    ]
    got = judged(spark, urls, RULES)
    assert got == {i: plain_verdict(u, RULES) for i, u in enumerate(urls)}
    assert got[0][2:] == ("example.net/en/", "allow") and got[4][2:] == (None, "allow") and got[3][2:] == ("net/", "block")


@pytest.mark.parametrize("max_bits", [1 << 30, 4000])
def test_many_rules_are_exact_over_the_corpus(spark, max_bits):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    host = lambda: ".".join(word() for _ in range(rng.randint(1, 4)))
    rules = [(rng.choice(["block", "allow"]), f"{host()}/{''.join(word() + '/' for _ in range(rng.randint(0, 2)))}") for _ in range(700)]
    rules += [("allow", r) for v, r in rules[:20] if v == "block"]
    urls = [f"https://{host()}/{'/'.join(word() for _ in range(rng.randint(0, 4)))}" for _ in range(3000)]
    got = judged(spark, urls, rules, default="block", max_bits=max_bits)
    assert got == {i: plain_verdict(u, rules, "block") for i, u in enumerate(urls)}
    assert sum(r[2] is not None for r in got.values()) > 300


def test_cascade_has_several_levels_and_no_wrong_key(spark):
    rows = [(f"h{i}.example", "/") for i in range(4000)]
    every = urlfilter._keyed(spark.createDataFrame(rows, "host string, path string"))
    listed = every.filter("CAST(substr(host, 2, length(host) - 9) AS INT) < 300").persist()
    c = urlfilter.build(listed, every, 300, 4000)
    assert len(c.levels) > 2 and c.bits < 300 * 30
    holds = urlfilter.holder(spark, c)[0]
    assert {r[0] for r in every.filter(holds("a", "b")).select("host").collect()} == {f"h{i}.example" for i in range(300)}


def test_url_tables_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urlfilter.judge_urls(none, urlfilter.rule_table(spark, RULES)).count() == 0
    odd = spark.createDataFrame([(1, "http://a.net/", "x", "y")] * 2, "page_id bigint, url string, host string, verdict string")
    assert [tuple(r) for r in urlfilter.judge_urls(odd, urlfilter.rule_table(spark, RULES)).collect()] == [(1, "a.net", "/", "net/", "block")] * 2
    void = spark.createDataFrame([(None, "/", True), ("", "/", True), ("net", None, True)], "host string, path string, block boolean")
    assert judged_rows(urlfilter.judge_urls(odd, void)) == [(1, "a.net", "/", None, "allow")] * 2
    long = "http://" + "a." * 20_000 + "net/" + "b" * 50_000
    assert judged(spark, [long], RULES)[0][2:] == ("net/", "block")


def judged_rows(df):
    return sorted(tuple(r) for r in df.collect())


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_resample(docs, target, percent, orders, buckets, least):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    own, aim = Counter(b for _, t in docs for b in features(t)[1]), Counter(b for t in target for b in features(t)[1])
    s, t = sum(own.values()), sum(aim.values())
    rows = []
    for i, text in docs:
        n, f = features(text)
        gain = [math.floor(1000 * math.log(((aim[b] + 1) * (s + buckets)) / ((own[b] + 1) * (t + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(drawn[: len(drawn) * percent // 100], 1)}
    return [(*r, ranks.get(id(r))) for r in rows]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resampling_against_a_plain_version(spark, orders):
    rng = random.Random(orders)
    words = ["Alpha", "beta", "é", "9", "ß-ẞ", "ÀB", "x_y", "日本", "end."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 30])))) for i in range(200)]
    docs += [(None, "beta beta beta beta"), (7, None), (8, ""), (9, " .,! "), (-5, "one " * 5000)]
    target = ["beta 9 beta 9", "ÀB Alpha", None, ""]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, buckets=50, least_words=3)
    want = plain_resample(docs, target, 25, orders, 50, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:5])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_resampling_of_repeats_and_empty_tables(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u"
    docs = spark.createDataFrame([(1, text, 0)] * 8 + [(None, text, 0)] * 2, "doc_id bigint, text string, rank int")
    none = spark.createDataFrame([], "text string")
    rows = [tuple(r) for r in resampling.resample(docs, none, percent=50).collect()]
    assert len(rows) == 10 and len({r[1:4] for r in rows}) == 1 and sorted(r[5] for r in rows if r[5]) == [1, 2, 3, 4, 5]
    assert resampling.resample(docs.limit(0), none).count() == 0
    named = spark.createDataFrame([("x", text)], "b1 string, _t string")
    assert resampling.resample(named, none, "b1", "_t").first()["n_words"] == 21


def plain_phrases(docs, longest, least, inside, top):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), b in cand.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, rows = Counter(), []
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return rows


@pytest.mark.parametrize(("longest", "top"), [(2, 2000), (3, 2000), (3, 5), (4, 2000)])
def test_phrases_against_a_plain_version(spark, longest, top):
    rng = random.Random(longest)
    words = ["New", "york", "city", "of", "the", "é\u00a0x", "a"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", " ,"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    docs += [("new york city " * 40, "en"), (None, "en"), ("", None), ("...", "fr"), ("x y", "fr"), ("ha ha ha ha", None)] * 3
    df = spark.createDataFrame([(t, lang, 1) for t, lang in docs], "text string, lang string, rank int")
    got = sorted(tuple(r) for r in collocations.best_phrases(df, top, longest=longest, least=4).collect())
    assert got == sorted(plain_phrases(docs, longest, 4, 50, top))
    assert collocations.best_phrases(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 5_000_000_087, 7_000_000_001
    below = spark.createDataFrame([(1, "en", "x", left, [], []), (2, "en", "y", right, [], [])], "id bigint, lang string, phrase string, f bigint, pre array<bigint>, suf array<bigint>")
    named = collocations._named(spark.createDataFrame([(9, 1, 2, a)], "id bigint, c0 bigint, c1 bigint, f bigint"), below)
    assert named.select(collocations.cut_scores().alias("x")).first()["x"].score == 1_000_000 * a * a // (left * right)
