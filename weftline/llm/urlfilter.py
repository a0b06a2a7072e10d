"""URL rules by a Bloom filter cascade.

A URL's candidate keys are every (host suffix, path prefix) that has the shape of some rule: so many labels, so many
characters. The first filter holds the keys of all rules; the second holds the candidates of the corpus that pass the
first without being rules; the third holds the rules that pass the second, and so on until nothing passes wrongly.
Each level ends a wrong answer of the one before, so that membership is exact for every key of the corpus and needs
no join: a key is a rule if the number of levels that it passes is odd. A second cascade, over the rules alone, knows
which of them block. What is sent to tasks grows with the rules, by some 10 to 30 bits each, and not with the URLs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_cut, small
from .textgrams import U, mix

#: Bits of one cascade that tasks hold at once; larger lists are split by hash and take a pass for each part.
MAX_BITS = 1 << 30
#: A level more than this means two different keys of equal 128-bit hash.
MAX_LEVELS = 64


class Cascade:
    """Levels of (words of 64 bits, bits, hash functions); keys are pairs of 64-bit hashes."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def passes(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which keys the level's filter holds, or seems to."""
        words, bits, k = self.levels[level]
        ok = np.ones(len(a), bool)
        for p in places(a, b, level, bits, k):
            ok &= (words[p >> U(6)] >> (p & U(63))) & U(1) == 1
        return ok

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact membership for keys of the universe that the cascade was built over."""
        deep, at = np.zeros(len(a), np.int64), np.arange(len(a))
        for i in range(len(self.levels)):
            at = at[self.passes(i, a[at], b[at])]
            deep[at] += 1
        return deep % 2 == 1

    @property
    def bits(self) -> int:
        return sum(bits for _, bits, _ in self.levels)


def places(a: np.ndarray, b: np.ndarray, level: int, bits: int, k: int) -> list[np.ndarray]:
    """The k bits of each key at a level; each level hashes anew."""
    return [mix(a ^ mix(b + U((0x9E3779B97F4A7C15 * (64 * level + i + 1)) & (2**64 - 1)))) % U(bits) for i in range(k)]


def _sizes(members: int, wrong: float) -> tuple[int, int]:
    """(bits, hash functions) of a filter for so many members at this share of wrong answers."""
    k = max(1, round(math.log2(1 / wrong)))
    return max(64, -(-int(members * k / math.log(2)) // 64) * 64), k


def _filled(members: DataFrame, level: int, bits: int, k: int) -> np.ndarray:
    """The filter's words: bits are set by an aggregate over the members, and only the words reach the driver."""

    @F.arrow_udf("array<bigint>")
    def at(a: pa.Array, b: pa.Array) -> pa.Array:
        p = np.stack(places(a.to_numpy(zero_copy_only=False).view(U), b.to_numpy(zero_copy_only=False).view(U), level, bits, k), 1) if len(a) else np.zeros((0, k), U)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * k), pa.array(p.astype(np.int64).ravel()))

    p = members.select(F.explode(at("a", "b")).alias("p"))
    found = p.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("x")).toArrow()
    words = np.zeros(bits // 64, U)
    words[found.column("w").to_numpy()] = found.column("x").to_numpy().view(U)
    return words


def holder(spark: SparkSession, cascade: Cascade, level: int | None = None):  # noqa: ANN201
    """A column function of key hashes (a, b): exact membership, or whether a level is passed. Takes arrays or single values."""
    sent = spark.sparkContext.broadcast(cascade)
    ask = (lambda a, b: sent.value.holds(a, b)) if level is None else (lambda a, b: sent.value.passes(level, a, b))

    @F.arrow_udf("boolean")
    def one(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(ask(a.to_numpy(zero_copy_only=False).view(U), b.to_numpy(zero_copy_only=False).view(U)))

    @F.arrow_udf("array<boolean>")
    def many(a: pa.Array, b: pa.Array) -> pa.Array:
        ok = ask(a.flatten().to_numpy(zero_copy_only=False).view(U), b.flatten().to_numpy(zero_copy_only=False).view(U))
        ends = np.concatenate(([0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ok))

    return one, many


def build(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade:
    """A cascade over rows (a, b, host, path): listed keys, distinct, against all others of the universe, repeats allowed.

    Only the first level meets the whole universe; what passes it wrongly is about as large as the list.
    """
    spark, out = listed.sparkSession, Cascade()
    if not n_listed:
        return out
    bits, k = _sizes(n_listed, min(0.5, max(0.7 * n_listed / max(n_universe - n_listed, 1), 2.0**-40)))
    out.levels.append((_filled(listed, 0, bits, k), bits, k))
    passed = universe.filter(holder(spark, out, 0)[0]("a", "b")).select("a", "b", "host", "path").distinct()
    inside, outside = listed, cut(passed.join(small(listed.select("host", "path"), n_listed), ["host", "path"], "left_anti"), "urls-wrong")
    while n := outside.count():
        level = len(out.levels)
        if level == MAX_LEVELS:
            raise RuntimeError("keys that no hash tells apart")
        bits, k = _sizes(n, 0.5)
        out.levels.append((_filled(outside, level, bits, k), bits, k))
        wrong = cut(inside.filter(holder(spark, out, level)[0]("a", "b")), "urls-wrong")
        if inside is not listed:
            drop_cut(inside)
        inside, outside = outside, wrong
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # or the end, A-Z lowered, and from there up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"a": F.xxhash64("host", "path"), "b": F.xxhash64(F.lit(1), "path", "host")})


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, block) of (verdict, rule) pairs such as ("block", "example.com/de/")."""
    rows = [(r[: r.index("/")] if "/" in r else r, r[r.index("/") :] if "/" in r else "", v == "block") for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, block boolean")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of pages: _id, host, path, rule (the longest that fits, else null), verdict.

    rules has (host, path, block), of any number of rows. A rule fits its host and all subdomains of it if the URL's
    path starts with the rule's, character by character: a path of '/' does not fit a URL without a path. Of rules of one
    key one that blocks wins; of rules of one length that of the longer host. Hosts of rules are lowered (A-Z);
    rules of a null or empty host or a null path fit nothing. A URL under no rule is not listed and has the default
    verdict. Null URLs and those without :// have an empty host and path, and no rule. Repeated rows give equal
    results, an empty table none, and columns other than the two named are not read.
    """
    spark = pages.sparkSession
    listed = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "block").filter("host <> '' AND path IS NOT NULL")
    listed = listed.groupBy("host", "path").agg(F.max(F.coalesce("block", F.lit(False))).alias("block"))
    listed = cut(_keyed(listed), "urls-rules")
    n_listed = listed.count()
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    if not n_listed:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # at most as many shapes as there are label counts times path lengths among the rules
    shapes = listed.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("n"), F.length("path").alias("l")).distinct().collect()
    shapes = F.array(*[F.struct(F.lit(s["n"]).alias("n"), F.lit(s["l"]).alias("l")) for s in sorted(shapes)])
    keys = F.expr(
        """transform(filter(s, x -> x.n <= labels AND x.l <= length(path)),
             x -> named_struct('host', substring_index(host, '.', -x.n), 'path', substring(path, 1, x.l)))"""
    )
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    cands = rows.withColumns({"s": shapes, "labels": labels}).withColumn("k", keys).drop("s", "labels")
    cands = cands.withColumn("k", F.transform("k", lambda x: F.struct(x["host"].alias("host"), x["path"].alias("path"), F.xxhash64(x["host"], x["path"]).alias("a"), F.xxhash64(F.lit(1), x["path"], x["host"]).alias("b"))))
    universe = cands.select(F.inline("k"))
    n_universe = universe.agg(F.approx_count_distinct("a", 0.02)).first()[0]
    expected = n_listed * (1.5 * max(1.0, math.log2(max(n_universe, 2) / n_listed)) + 6)
    parts = max(1, math.ceil(expected / max_bits))
    out = cands.withColumn("best", F.lit(None).cast("struct<n:int,h:int,rule:string,block:boolean>"))
    for p in range(parts):
        mine = lambda df: df if parts == 1 else df.filter(F.pmod("b", F.lit(parts)) == p)  # noqa: B023, E731
        part = cut(mine(listed), "urls-part") if parts > 1 else listed
        n = part.count() if parts > 1 else n_listed
        member = build(part, mine(universe), n, max(n_universe // parts, 1))
        blocks = part.filter("block")
        blocking = build(blocks, part, blocks.count(), n)
        known, barred = holder(spark, member)[1], holder(spark, blocking)[1]
        k = F.col("k") if parts == 1 else F.filter("k", lambda x: F.pmod(x["b"], F.lit(parts)) == p)  # noqa: B023
        asked = out.withColumn("q", k).withColumns({"in": known("q.a", "q.b"), "bar": barred("q.a", "q.b")})
        hit = F.expr("array_max(transform(filter(arrays_zip(q, in, bar), x -> x.in), x -> named_struct('n', length(x.q.host) + length(x.q.path), 'h', length(x.q.host), 'rule', concat(x.q.host, x.q.path), 'block', x.bar)))")
        out = asked.withColumn("best", F.greatest("best", hit)).drop("q", "in", "bar")
        if parts > 1:  # one part's filters at a time
            out = cut(out, "urls-judged")
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    return out.select("_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


#: DuckDB: each page against each of a few rules.
SQL = r"""
WITH rules(verdict, host, path) AS (VALUES {rules}),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, r.rule, coalesce(r.verdict, 'allow') AS verdict FROM h LEFT JOIN LATERAL (
  SELECT x.host || x.path AS rule, x.verdict FROM rules x WHERE (h.host = x.host OR suffix(h.host, '.' || x.host)) AND starts_with(h.path, x.path)
  ORDER BY length(x.host || x.path) DESC LIMIT 1) r ON true
"""


def sql(rules: list[tuple[str, str]]) -> str:
    return SQL.replace("{rules}", ", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in rules))
