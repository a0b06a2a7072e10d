"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for three base kinds and for opaque tokens that mix cases and digits. The hashes
of all candidate values are aggregated by distinct repositories and owners over the whole corpus: a value
that several owners carry is a widely copied example, a value that stays with one owner looks live. Opaque
tokens that look live are added as spans of kind `owned`; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, same

# The base kinds in the order that breaks ties of start, each pattern with the group that must
# have at least so many code points. Matches run leftmost without overlap; those that are too short are dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
OWNED = "owned"

#: Candidates of the added kind: 20 or more token characters with a digit, an upper-case and a lower-case letter.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words of examples, or one letter or digit six times over.
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|" + "|".join(c + "{6}" for c in "abcdefghijklmnopqrstuvwxyz0123456789")

SPANS = "array<struct<s:int,e:int,k:int,v:bigint>>"
#: Matches that are folded at a time: a fold copies what it has at each step, so it runs over blocks, then over their totals.
FOLD = 128


def _walked(pairs: Column, kind: int, least: int) -> Column:
    """Spans from matches and the gaps before them, in time proportional to their number for all but huge texts."""
    none = F.from_json(F.lit("[]"), SPANS)

    def block(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["m"]).alias("at"),
                F.when(
                    _good(kind, x, least),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["m"]).alias("e"), F.lit(kind).alias("k"), x["v"].alias("v")))),
                ).otherwise(acc["out"]).alias("out"),
            ),
        )

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["k"].alias("k"), x["v"].alias("v")))

    # an array of one binds what a lambda uses many times, so that it is computed once
    once = lambda value, use: F.transform(F.array(value), use)[0]
    blocks = once(
        pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / FOLD).cast("int")), lambda i: block(F.slice(p, i * FOLD + 1, FOLD)))
    )
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(x["out"], acc["at"]))).alias("out")),
    )
    return F.flatten(joined["out"])


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of all matches: the text between matches and the matches themselves give the positions."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))),
        value,
        lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(v).alias("n"), F.xxhash64(v).alias("v"), v.alias("t")),
    )
    return F.when(text.rlike(pattern), _walked(pairs, kind, least)).otherwise(F.from_json(F.lit("[]"), SPANS))


def _good(kind: int, x: Column, least: int) -> Column:
    if kind < len(BASE):
        return x["n"] >= least
    t = x["t"]
    return t.rlike("[0-9]") & t.rlike("[A-Z]") & t.rlike("[a-z]") & ~t.rlike(PLACEHOLDER)


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(OWNED))
    ordered = F.array_sort(spans)  # structs sort by start first; equal starts by end, so kinds are put before
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))))


def _by_kind(spans: Column) -> Column:
    """start, kind, end, value: the order in which spans are joined."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", max_owners: int = 1) -> DataFrame:
    """One row for each row of df: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_shared.

    A repository is the value of repo_col (null: a repository of its own name ''); its owner is the part before
    the first '/'. n_live counts candidates whose value no more than max_owners owners carry, n_shared the others.
    Null texts count as empty: no spans, and the digest of the empty string. Rows that repeat id and text get
    equal results and count once for each repository. Opaque tokens that touch a base span are not added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.flatten(F.array(*[_spans(text, i, p, g, n) for i, (_, p, g, n) in enumerate(BASE)]))
    found = cut(
        df.select(
            F.col(id_col).alias("_id"),
            F.xxhash64(text).alias("_h"),
            F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"),
            base.alias("_base"),
            _spans(text, len(BASE), OPAQUE, 0, 20).alias("_more"),
        ).withColumns({"_base": _by_kind(F.col("_base")), "_more": _by_kind(F.col("_more"))}),
        "secret-spans",
    )
    some = found.filter((F.size("_base") > 0) | (F.size("_more") > 0))
    # spans follow from id and text alone, however many rows or repositories have both
    every = some.select("_id", "_h", F.explode(F.concat("_base", "_more")).alias("x")).distinct()
    is_base = F.col("x.k") < len(BASE)
    # frames that grow from an end are one pass each; what follows a span is what precedes it from the other side
    by_start = lambda order: Window.partitionBy("_id", "_h").orderBy(order)
    ends = F.max(F.when(is_base, F.col("x.e"))).over(by_start(F.asc("x.s")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(is_base, F.col("x.s"))).over(by_start(F.desc("x.s")).rangeBetween(Window.unboundedPreceding, -1))
    apart = (F.coalesce(ends, F.lit(0)) <= F.col("x.s")) & (F.coalesce(after, F.col("x.e")) >= F.col("x.e"))
    spans = cut(every.withColumn("_apart", apart).filter(is_base | F.col("_apart")).drop("_apart"), "secret-candidates")
    # distinct values by repository first, so that a value copied everywhere is one row for each repository
    repos = some.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "_repo").distinct()
    held = (
        spans.join(repos, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")))
        .select(F.col("x.v").alias("v"), "_repo").distinct().withColumn("_owner", F.substring_index("_repo", "/", 1))
    )
    owners = cut(held.groupBy("v").agg(F.count("*").alias("n_repos"), F.count_distinct("_owner").alias("n_owners")), "secret-owners")
    judged = cut(
        spans.select("_id", "_h", "x", F.col("x.v").alias("v")).join(owners, "v")
        .select("_id", "_h", "x", (F.col("n_owners") <= max_owners).alias("live")),
        "secret-judged",
    )
    added = judged.groupBy("_id", "_h").agg(
        F.collect_list(F.when(F.col("live") & (F.col("x.k") == len(BASE)), F.col("x"))).alias("_own"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_shared"),
    )
    joined = found.drop("_repo", "_more").join(added.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    own = F.coalesce(F.col("_own"), F.filter("_base", lambda x: F.lit(False)))
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return joined.select(
        F.col("_id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_digest(F.col("_base")), 256).alias("base_sha256"),
        _digest(F.concat("_base", own)).alias("spans"),
        F.size(own).cast("long").alias("n_owned"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
    )


def _sql_kind(k: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {k} AS k, m[i] AS m, v[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT doc_id, source, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g FROM d),
      LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) WHERE {keep}"""


_OWN = f"regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]') AND NOT regexp_matches(v[i], '{PLACEHOLDER}')"
#: DuckDB: matches and the pieces between them give positions; values are counted by distinct owners.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
base AS ({" UNION ALL ".join(_sql_kind(k, p, g, f"length(v[i]) >= {n}") for k, (_, p, g, n) in enumerate(BASE))}),
more AS (SELECT * FROM ({_sql_kind(len(BASE), OPAQUE, 0, _OWN)}) o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.s + length(o.m) AND o.s < b.s + length(b.m))),
c AS (SELECT * FROM base UNION ALL SELECT * FROM more),
o AS (SELECT v, count(DISTINCT string_split(source, '/')[1]) AS n FROM c GROUP BY 1),
j AS (SELECT c.*, o.n <= 1 AS live, list_extract([{", ".join(f"'{k}'" for k, *_ in BASE)}, '{OWNED}'], c.k + 1) || ':' || s || ':' || (s + length(m)) AS span FROM c JOIN o USING (v)),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base,
  string_agg(span, ',' ORDER BY s, k) FILTER (k < 3 OR live) AS spans, count(*) FILTER (k = 3 AND live) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN a USING (doc_id)
"""
