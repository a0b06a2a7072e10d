"""Line dedup by a deletion-neighbourhood join.

Lines are compared after case folding and trimming; equal ones go at any length. An edit inserts, deletes or replaces
one unit: a word in lines of four words or more; in shorter ones of twenty code points or more, which one word would
change altogether, a code point. Lines below both have no edits. Equal lines are grouped by hash first. Two different
lines are within one edit exactly if one is the other without a unit, or both agree after the unit at the same place is
deleted from each. So a line is posted under the hash of each variant with its length and place (replacements), under
its own hash, and under the hash of each variant alone (insertions): equal keys join, and the earliest line of a key is
all that a group has to carry. A line with an earlier partner is compared with it by edit distance and goes; the
earliest line of all stays.

Variants are many, so lines are screened without loss: an edit spares the first or the last units of a line.
Lines that share neither of these parts with another line have no partner and emit nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop_cut, free, small
from .textgrams import BASE, U, give_back, mix, powers, span_hashes

#: Lines that are empty after folding stay; an edit is a word in lines of so many words, else a code point in lines of so many.
MIN_CHARS, LEAST_WORDS, LEAST_CHARS = 1, 4, 20
#: What folding trims.
WHITE = " \t\r\x0b\x0c"
INV = U(pow(int(BASE), -1, 2**64))


def fold(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(WHITE))


def _parts(f: Column, w: Column, least_words: int, least_chars: int) -> Column:
    """Hashes of the outer units that a line f of words w shares with a partner of as many units, one fewer or one more.

    Of two partners the longer has n units, or both have; their first or their last (n - 1) div 2 units agree. Each
    line is the longer one at its own length and the shorter one at the next.
    """
    words, chars = F.size(w), F.length(f)
    half = lambda size: F.floor((size - 1) / 2).cast("int")

    def by_words(size: Column) -> Column:
        m = half(size)
        return F.array(F.xxhash64(F.lit("<"), size, F.slice(w, F.lit(1), m)), F.xxhash64(F.lit(">"), size, F.slice(w, -m, m)))

    def by_chars(size: Column) -> Column:
        m = half(size)
        return F.array(F.xxhash64(F.lit("[<"), size, F.substring(f, F.lit(1), m)), F.xxhash64(F.lit("[>"), size, F.substring(f, chars - m + 1, m)))

    return F.when(words >= least_words, F.concat(by_words(words), by_words(words + 1))).when(chars >= least_chars, F.concat(by_chars(chars), by_chars(chars + 1)))


def units(line: str, least_words: int = LEAST_WORDS) -> list[str]:
    words = line.split(" ")
    return words if len(words) >= least_words else list(line)


def unit_hashes(line: str, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Hashes of a line's words; of its code points, apart from those of words, if it has few."""
    if line.count(" ") + 1 < least_words:
        return mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(U) + U(0xC0DE << 32)) + U(1)
    buf = np.frombuffer(line.encode() + b" ", np.uint8)
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return span_hashes(buf, starts, ends) + U(1)


def variants(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line from its units' hashes, and their sorts: 0 variants by place, 1 variants alone, 2 the line itself."""
    n = len(h)
    up, _ = powers(n + 1)
    head = np.concatenate((np.zeros(1, U), np.cumsum(h * up[:n], dtype=U)))
    # without unit i, those behind it move down by one place
    cuts = mix(head[:-1] + (head[-1] - head[1:]) * INV)
    place = mix(cuts + np.arange(1, n + 1, dtype=U) * U(0xD6E8FEB86659FD93) + U(n << 32))
    alone = np.unique(cuts)
    keys = np.concatenate((place, alone, mix(head[-1:])))
    return keys.astype(np.int64), np.concatenate((np.zeros(n, np.int8), np.ones(len(alone), np.int8), np.full(1, 2, np.int8)))


def _emit(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, size = [], 0
        for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, kind = variants(unit_hashes(line, least_words))
            parts.append((np.full(len(keys), h, np.int64), keys, kind))
            size += len(keys)
            if size > 200_000:
                yield _batch(parts)
                parts, size = [], 0
        if parts:
            yield _batch(parts)
        give_back()


def _batch(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["h", "key", "kind"])


def within_one(a: list, b: list) -> bool:
    """Whether the edit distance of two lists is one at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [within_one(units(a, least_words), units(b, least_words)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["h"])


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(_id, _h, pos) of every line that goes, from docs (_id, _h, _t). A line is known by 128 bits of hash."""
    bound_batches(docs.sparkSession)
    place = ["_id", "_h", "pos"]
    order = F.struct(*place)
    folded = docs.select("_id", "_h", F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line")).select(*place, fold(F.col("line")).alias("f"))
    lines = folded.filter(F.length("f") >= min_chars).withColumn("w", F.split("f", " "))
    lines = lines.select(*place, F.xxhash64("f").alias("a"), F.xxhash64(F.lit(1), "f").alias("b"), _parts(F.col("f"), F.col("w"), least_words, least_chars).alias("k"))
    keyed = cut(lines.drop("k"), "line-hashes")
    # the earliest place of each different line, by a partial minimum in each task
    first = cut(lines.groupBy("a", "b").agg(F.min(order).alias("at"), F.count("*").alias("n"), F.first("k").alias("k")), "line-first")
    # different lines that share an outer part with another one
    parts = first.select("a", "b", F.explode("k").alias("key"))
    shared = cut(parts.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("key"), "line-parts")
    likely = cut(parts.join(small(shared, shared.count()), "key").select("a", "b").distinct().join(first, ["a", "b"]).select("a", "b", "at"), "line-met")
    drop_cut(shared)
    # their numbers follow the order of places, so the least number of a key is its earliest line
    likely = cut(likely.select("a", "b", "at.*").repartitionByRange(*place).sortWithinPartitions(*place).withColumn("h", F.monotonically_increasing_id()), "line-likely")
    homes = likely.select(F.col("_id").alias("_i2"), F.col("_h").alias("_h2")).distinct()
    at_home = docs.join(small(homes, likely.count()), F.col("_id").eqNullSafe(F.col("_i2")) & (F.col("_h") == F.col("_h2")), "left_semi")
    lines = at_home.select("_id", "_h", F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line")).select(*place, fold(F.col("line")).alias("f"))
    texts = lines.join(likely.select(*(F.col(c).alias(f"{c}2") for c in place), "h"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")) & (F.col("pos") == F.col("pos2")))
    texts = cut(texts.select("h", "f"), "line-texts")
    # cheap to make again, and larger than what follows
    every = texts.mapInArrow(lambda it: _emit(it, least_words), "h bigint, key bigint, kind tinyint")
    whole = F.col("kind") != 1
    groups = every.groupBy("key").agg(F.min(F.when(whole, F.col("h"))).alias("a"), F.min(F.when(~whole, F.col("h"))).alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    # keys of a single line join nothing
    groups = cut(groups.filter("lo <> hi").select("key", "a", "b"), "line-groups")
    # lines that meet by place, or are the variant itself, are partners; a variant alone only meets the line it is
    partner = F.when(F.col("kind") == 2, F.least("a", "b")).otherwise(F.col("a"))
    pairs = every.join(small(groups, groups.count()), "key").select("h", partner.alias("ph")).filter("ph < h").groupBy("h").agg(F.min("ph").alias("ph"))
    pairs = cut(pairs, "line-pairs")
    drop_cut(groups)
    near = pairs.join(texts, "h").join(texts.select(F.col("h").alias("ph"), F.col("f").alias("pf")), "ph").select("h", "f", "pf").mapInArrow(lambda it: _verify(it, least_words), "h bigint").distinct()  # rows that repeat a document repeat its lines
    near = near.join(likely, "h").select("a", "b", F.lit(True).alias("near"))
    # lines of which something goes
    late = cut(first.drop("k").join(near, ["a", "b"], "left").filter("near OR n > 1").select("a", "b", "at", "near"), "line-late")
    return keyed.join(small(late, late.count()), ["a", "b"]).filter(F.col("near").isNotNull() | (order != F.col("at"))).select(*place)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """df with text_col without its repeated lines, and the long columns n_lines, n_removed (with underscores behind them
    where df has such columns).

    An edit inserts, deletes or replaces a word in lines of least_words words or more, a code point in other lines of
    least_chars code points or more; lines shorter still go only if they equal an earlier one. least_words beyond every
    line and least_chars of 1 compare all lines by code points.

    Lines are ordered by id (nulls first), then by hash of the text, then by place. A line goes if any earlier line
    is within one edit of it after folding; lines of fewer than min_chars folded characters, by default the blank ones,
    stay. Null texts stay null with no lines; an empty text is one empty line. Rows that repeat id and text lose the same
    lines, and keep the earliest ones in each copy. Other columns stay, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"))
    gone = cut(duplicate_lines(base, min_chars, least_words, least_chars).groupBy(F.col("_id").alias("_i2"), F.col("_h").alias("_h2")).agg(F.collect_set("pos").alias("_gone")), "line-gone")
    # rows of 30 bytes and 4 for each place: what a broadcast would hold, in rows of 30
    held = gone.agg(F.count("*") + F.coalesce(F.sum(F.size("_gone")), F.lit(0)) / 7).first()[0]
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_i"), F.xxhash64(text).alias("_hh"))
    j = whole.join(small(gone, held), F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_hh") == F.col("_h2")), "left")
    old = F.col("_row")[text_col]
    lines = F.split(old, "\n", -1)
    # places that stay, by a set difference; lines are bound once by an array of one
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.transform(F.array(lines), lambda a: F.array_join(F.transform(left, lambda i: F.get(a, i)), "\n"))[0]
    kept = F.when(F.col("_gone").isNull(), old).otherwise(kept)
    return j.select(
        *[kept.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns],
        F.when(old.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(free(df, "n_lines")),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias(free(df, "n_removed")),
    )


#: DuckDB: each different line against the earlier ones that share its first or its last unit.
SQL = f"""
WITH l AS (SELECT doc_id, i - 1 AS pos, a[i] AS line, trim(lower(a[i]), concat(' ', chr(9), chr(13), chr(11), chr(12))) AS f
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
u AS (SELECT f, min((doc_id, pos)) AS at, string_split(f, ' ') AS w FROM l WHERE length(f) >= {MIN_CHARS} GROUP BY f),
k AS (SELECT f, u.at, w, len(w) AS n, 0 AS kind FROM u WHERE len(w) >= {LEAST_WORDS}
  UNION ALL SELECT f, u.at, list_transform(range(1, length(f) + 1), lambda i: f[i]), length(f), 1 FROM u WHERE len(w) < {LEAST_WORDS} AND length(f) >= {LEAST_CHARS}),
p AS (SELECT x.w AS xw, y.w AS yw, x.n AS xn, y.n AS yn, y.f FROM k x JOIN k y ON x.w[1] = y.w[1] AND x.kind = y.kind WHERE abs(x.n - y.n) <= 1 AND x.at < y.at
  UNION ALL SELECT x.w, y.w, x.n, y.n, y.f FROM k x JOIN k y ON x.w[-1] = y.w[-1] AND x.w[1] <> y.w[1] AND x.kind = y.kind WHERE abs(x.n - y.n) <= 1 AND x.at < y.at),
q AS (SELECT f, xw, yw, xn, yn, coalesce(list_position(list_transform(range(1, least(xn, yn) + 1), lambda i: xw[i] <> yw[i]), true), least(xn, yn) + 1) AS c FROM p),
near AS (SELECT DISTINCT f FROM q WHERE CASE WHEN xn = yn THEN xw[c + 1:] = yw[c + 1:] WHEN xn > yn THEN xw[c + 1:] = yw[c:] ELSE xw[c:] = yw[c + 1:] END),
t AS (SELECT l.*, u.f IS NOT NULL AND (u.at <> (l.doc_id, l.pos) OR near.f IS NOT NULL) AS gone FROM l LEFT JOIN u ON u.f = l.f LEFT JOIN near ON near.f = l.f)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM t GROUP BY doc_id
"""
