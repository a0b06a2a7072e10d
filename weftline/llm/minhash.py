"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents with equal shingle sets form one class first. A class is posted under each (coordinate, value) pair
of its signature. Coordinates that no other class has are skipped; of the others, ordered by how many classes
hold them, only a prefix is merged: two signatures that agree on T of K coordinates share one of the K-T+1
rarest. First, each class is compared with the hub it meets most often (a list's hub is the class whose coordinates
most others hold, the middle of a group of copies); what that links becomes components. Then only lists that still
hold several components are merged, in blocks that compare signatures, then finer ones, and return pairs of enough
matches, each in the first list that both are posted in. All pairs are confirmed on the full shingle sets. No list is cut short,
and no task sees more than two blocks of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop_cut, small
from .textgrams import U, chunks, give_back, mix, shingle_sets

#: K coordinates; pairs of similarity 0.75 agree on 96 of them on average, with a deviation of 4.9, so that
#: fewer than T agree in about 2 of a million such pairs. SCREEN of them are merged first; LEAST must be shared
#: (missed by 3 of ten million pairs at 0.75).
K, T, SCREEN, LEAST, BLOCK = 128, 73, 16, 3, 256
#: Partners of one document that are confirmed together.
TOGETHER = 64
#: Sets of at most WHOLE shingles go with their postings, by 64 bits of hash up to SURE shingles and by 16 beyond, so that
#: pairs of them are compared where they are found; those of at most ALONE meet no larger set and need no finer coordinates.
SURE, ALONE, WHOLE = 64, 288, 384
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 2**64, K, dtype=U) | U(1)
_B = _RNG.integers(0, 2**64, K, dtype=U)
#: Candidates are told apart more finely by FINE further coordinates of 4 bits: at 0.75, 784 agree on average with a
#: deviation of 13.6, and fewer than FINE_T in one of two million pairs.
FINE, FINE_T = 1024, 717
_FA = _RNG.integers(1, 2**64, FINE, dtype=U) | U(1)
_FB = _RNG.integers(0, 2**64, FINE, dtype=U)


def _least(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each of some random linear maps of the hashes."""
    low = np.full(len(a), 2**64 - 1, U)
    for i in range(0, len(grams), 2048):
        np.minimum(low, (grams[None, i : i + 2048] * a[:, None] + b[:, None]).min(axis=1), out=low)
    return low


def fine(grams: np.ndarray) -> np.ndarray:
    """FINE values of 4 bits, two in a byte."""
    v = mix(_least(grams, _FA, _FB)).astype(np.uint8) & 15
    return v[::2] | v[1::2] << 4


def signature(grams: np.ndarray) -> np.ndarray:
    """K 32-bit values."""
    low = _least(grams, _A, _B)
    return ((low ^ (low >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(32)).astype(np.uint32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()).to_pylist()
        at = 0
        for run in chunks(t or b"" for t in texts):
            n, c1, c2, sig = [], [], [], []
            for s in shingle_sets(run):
                n.append(len(s))
                for c, salt in ((c1, U(0)), (c2, U(0x5851F42D4C957F2D))):
                    c.append(int(mix(s ^ salt).sum(dtype=U).astype(np.int64)) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids[at : at + len(run)], hashes[at : at + len(run)], pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sig, pa.binary())],
                names=["_id", "_h", "n", "c1", "c2", "sig"],
            )
            at += len(run)
        give_back()


def _unpack(batches: Iterator[pa.RecordBatch], upto: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            cids = batch.column(0)[i : i + 2048].to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(1)[i : i + 2048].to_pylist()), np.uint32).reshape(-1, K)[:, :upto]
            keys = sigs.astype(np.int64) + (np.arange(upto, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cids, upto)), pa.array(keys.ravel())], names=["cid", "key"])


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, whole = [], []
        for run in chunks(t.encode() for t in batch.column(1).to_pylist()):
            for s in shingle_sets(run):
                out.append(fine(s).tobytes() if len(s) > ALONE else b"")
                whole.append(s.tobytes() if len(s) <= SURE else s.astype(np.uint16).tobytes() if len(s) <= WHOLE else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(whole, pa.binary())], names=["cid", "fine", "whole"])
        give_back()


def coordinates(df: DataFrame, upto: int) -> DataFrame:
    return df.select("cid", "sig").mapInArrow(lambda it: _unpack(it, upto), "cid bigint, key bigint")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) similar enough on full sets, from rows (a, block, role, b, text) in that order: role 0 brings a's text, 1 b's."""
    now, hub = None, None
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))
        kept, at = [], 0
        for run in chunks(t.encode() for t in batch.column(4).to_pylist()):
            for (a, block, role, b), s in zip(keys[at : at + len(run)], shingle_sets(run), strict=True):
                if role == 0:
                    now, hub = (a, block), s
                    continue
                if now != (a, block):
                    raise RuntimeError("a block without its first text")
                both = len(np.intersect1d(hub, s, assume_unique=True))
                if 100 * both >= 75 * (len(hub) + len(s) - both):
                    kept.append((a, b))
            at += len(run)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])
        give_back()


def _open_pairs(batches: Iterator[pa.RecordBatch], t: int, fine_t: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sure) of different components in one group (key, i, j) that agree on t coordinates at least and are in no earlier list together.

    Pairs whose sets are at hand are compared by them and dropped if they miss. Where the hashes are whole, the others are
    sure, and components that such a pair links count as one from then on. Rows come sorted by group. A group has no more than the members of two blocks; its pairs are made and compared
    in bounded runs, first by size and the lower bytes of signatures.
    """
    held: list[np.ndarray] | None = None
    linked: dict[int, int] = {}
    none = bytes(FINE // 2)

    def root(x: int) -> int:
        while (up := linked.get(x, x)) != x:
            linked[x] = x = linked.get(up, up)
        return x

    for last, batch in _with_last(batches):
        cols = [batch.column(k).to_numpy() for k in range(9)]
        cols.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint32).reshape(-1, K))
        cols.append(np.frombuffer(b"".join(x or none for x in batch.column(10).to_pylist()), np.uint8).reshape(-1, FINE // 2))
        cols.append(np.array([*batch.column(11).to_pylist(), None], object)[:-1])
        if held is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
        key, i, j = cols[:3]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        end = len(key) if last else new[-1]
        held = None if last else [x[end:] for x in cols]
        starts = np.append(new[new < end], end)
        b, cid, comp, n, m0, m1, sig, finer, whole = (x[:end] for x in cols[3:])
        low = sig.astype(np.uint8)
        posted = np.unpackbits(np.stack((m0, m1), 1).view(np.uint8), axis=1, bitorder="little").astype(bool)
        coord = key[:end] >> 32
        # each row meets the rows that follow it in its group
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        after = starts[1:][group] - np.arange(end) - 1
        at = 0
        while at < end:
            upto = max(int(np.searchsorted(np.cumsum(after[at:]), 400_000, side="right")), 1) + at
            rows = np.repeat(np.arange(at, upto), after[at:upto])
            first = np.repeat(np.cumsum(after[at:upto]) - after[at:upto], after[at:upto])
            other = rows + 1 + np.arange(len(rows)) - first
            ok = (comp[rows] != comp[other]) & ((i[:end][rows] == j[:end][rows]) | (b[rows] != b[other])) & (4 * np.minimum(n[rows], n[other]) >= 3 * np.maximum(n[rows], n[other]))
            rows, other = rows[ok], other[ok]
            for c in range(0, len(rows), 16384):
                r, o = rows[c : c + 16384], other[c : c + 16384]
                hit = (low[r] == low[o]).sum(axis=1) >= t
                r, o = r[hit], o[hit]
                agree = sig[r] == sig[o]
                hit = (agree.sum(axis=1) >= t) & ((agree & posted[r] & posted[o]).argmax(axis=1) == coord[r])
                r, o = r[hit], o[hit]
                if len(r):
                    x = finer[r] ^ finer[o]
                    hit = (np.maximum(n[r], n[o]) <= WHOLE) | (((x & 15 == 0).sum(axis=1) + (x & 240 == 0).sum(axis=1)) >= fine_t)
                    r, o = r[hit], o[hit]
                kept, sure = [], []
                for k, (x, y) in enumerate(zip(r.tolist(), o.tolist(), strict=True)):
                    one, two = root(int(comp[x])), root(int(comp[y]))
                    if one == two:
                        continue
                    most = max(n[x], n[y])
                    if most <= WHOLE:
                        # 16 bits may count shingles too many, never too few
                        p, q = (np.frombuffer(whole[z], U if n[z] <= SURE else np.uint16) for z in (x, y))
                        if most > SURE:
                            p, q = p.astype(np.uint16), np.sort(q.astype(np.uint16))
                        both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                        if 100 * both < 75 * int(n[x] + n[y] - both):
                            continue
                    if most <= SURE:
                        linked[max(one, two)] = min(one, two)
                    kept.append(k)
                    sure.append(bool(most <= SURE))
                if kept:
                    r, o = r[kept], o[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[r], cid[o])), pa.array(np.maximum(cid[r], cid[o])), pa.array(sure)], names=["a", "b", "sure"])
            at = upto
        give_back()


def _with_last(it: Iterator) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Items that are not empty, each with whether it is the last."""
    prev = None
    for x in it:
        if x.num_rows:
            if prev is not None:
                yield False, prev
            prev = x
    if prev is not None:
        yield True, prev


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each end of an edge (a, b) reaches; labels spread and jump until none changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        new = cut(step.join(jump, "to").select("node", F.least("to", "far").alias("comp"), "was"), "cc-labels")
        moved = new.filter("comp <> was").limit(1).count()
        drop_cut(labels)
        labels = new.select("node", "comp")
        labels._weftline_path = new._weftline_path
        if not moved:
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row for each row of df: _id, _h (xxhash64 of the text), n_shingles, component (least id of the group, itself included).

    Null texts and texts without words have no shingles and stay alone; so does a row with a null id, unless its
    set equals or links with others': then it has their least id. Rows with equal sets (by size and 128 bits of hash) are one group. An empty table
    gives no rows. exact: no screen and no threshold of matches, so that every pair that shares one of the K coordinates
    is confirmed; a pair at 0.75 shares none once in 10**77, but lists are merged whole, which suits small tables.
    """
    screen, least, t, fine_t = (K, 1, 1, 0) if exact else (SCREEN, LEAST, T, FINE_T)
    bound_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"))
    id_type = docs.schema["_id"].dataType.simpleString()
    signed = cut(docs.mapInArrow(_sign, f"_id {id_type}, _h bigint, n bigint, c1 bigint, c2 bigint, sig binary"), "minhash-signatures")
    # one row and one number for each distinct set; its least row, nulls first, stands for it
    classes = signed.filter("c1 IS NOT NULL").groupBy("n", "c1", "c2").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.min("_id").alias("least"))
    classes = cut(classes.select("n", "c1", "c2", F.monotonically_increasing_id().alias("cid"), "rep.*", "least"), "minhash-classes")
    c = classes.drop("least").withColumnsRenamed({"n": "n2", "c1": "d1", "c2": "d2", "_id": "_id2", "_h": "_h2"})
    reps = signed.join(c, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("n") == F.col("n2")) & F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")))
    reps = cut(reps.select("cid", "_id", "_h", "n", "sig").dropDuplicates(["cid"]), "minhash-reps")

    def shared(source: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
        keys = coordinates(source, upto)
        freq = cut(keys.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-df")
        return keys, freq

    keys, freq = shared(reps, screen)
    met = keys.join(freq, "key").groupBy("cid").agg(F.count("*").alias("m")).filter(F.col("m") >= least).select("cid")
    left = cut(reps.join(met, "cid"), "minhash-screened")
    keys, freq = shared(left, K)
    bits = lambda base: F.expr(f"aggregate(p, 0L, (m, x) -> m | if(shiftright(x.key, 32) div 64 = {base}, shiftleft(1L, CAST(shiftright(x.key, 32) % 64 AS INT)), 0L))")
    prefix = (
        keys.join(freq, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("k"))
        .filter(F.size("k") >= t)
        .select("cid", F.expr("aggregate(k, 0L, (s, x) -> s + x.df)").alias("held"), F.slice("k", F.lit(1), F.size("k") - t + 1).alias("p"))
        .select("cid", "held", bits(0).alias("m0"), bits(1).alias("m1"), F.explode("p.key").alias("key"))
    )
    postings = cut(prefix, "minhash-postings")
    rank = F.struct("held", F.negative("cid").alias("o"), "cid")
    lists = cut(postings.groupBy("key").agg(F.max(rank).alias("hub"), F.count("*").alias("len")).filter("len > 1").select("key", F.col("hub.cid").alias("hub"), "hub.held"), "minhash-lists")
    star = (
        postings.select("cid", "key").join(lists, "key").filter("cid <> hub").groupBy("cid", "hub", "held").agg(F.count("*").alias("m"))
        .groupBy("cid").agg(F.max(F.struct("m", "held", "hub")).alias("x"))
        .select(F.col("x.hub").alias("a"), F.col("cid").alias("b"))
    )
    pool_ids = postings.select("cid").distinct().join(left, "cid").select("cid", "_id", "_h")
    pool_ids = cut(pool_ids, "minhash-pool")
    pool = cut(
        docs.join(small(pool_ids.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}), pool_ids.count()), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")))
        .select("cid", "_t").dropDuplicates(["cid"]),
        "minhash-texts",
    )

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs, a's partners in blocks: its text goes once to each block, that of b once to each of its pairs."""
        pairs = cut(pairs, f"{name}-pairs")
        # only those of many partners, at most one in TOGETHER of the pairs, need several blocks
        many = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("nb")).filter("nb > 1"), f"{name}-blocks")
        dealt = pairs.join(small(many, many.count()), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("nb", F.lit(1))).alias("block"), "b")
        hubs = dealt.select("a", "block").distinct().join(pool.withColumnRenamed("cid", "a"), "a").select("a", "block", F.lit(0).alias("role"), F.col("a").alias("b"), "_t")
        others = dealt.join(pool.withColumnRenamed("cid", "b"), "b").select("a", "block", F.lit(1).alias("role"), "b", "_t")
        rows = hubs.unionByName(others).repartition("a", "block").sortWithinPartitions("a", "block", "role")
        return cut(rows.mapInArrow(_confirm, "a bigint, b bigint"), name)

    # every class has one hub that ranks above it, so these links are trees: pointers are halved until roots
    links = confirmed(star, "minhash-links")
    nodes = postings.select("cid").distinct().join(links.select(F.col("b").alias("cid"), F.col("a").alias("up")), "cid", "left").select("cid", F.coalesce("up", "cid").alias("comp"))
    nodes = cut(nodes, "minhash-trees")
    while True:
        up = nodes.select(F.col("cid").alias("comp"), F.col("comp").alias("top"))
        new = cut(nodes.join(up, "comp").select("cid", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), "minhash-trees")
        moved = new.filter("moved").limit(1).count()
        drop_cut(nodes)
        nodes = new.select("cid", "comp")
        nodes._weftline_path = new._weftline_path
        if not moved:
            break
    # lists that still hold several components are merged in blocks
    tagged = postings.join(nodes, "cid")
    open_lists = cut(tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("len")).filter("lo <> hi").select("key", F.ceil(F.col("len") / BLOCK).alias("nb")), "minhash-open")
    open_ids = tagged.join(open_lists, "key").select("cid").distinct()
    finer = cut(pool.join(open_ids, "cid", "left_semi").select("cid", "_t").mapInArrow(_refine, "cid bigint, fine binary, whole binary"), "minhash-fine")
    dealt = (
        tagged.join(open_lists, "key").join(left.select("cid", "n", "sig"), "cid").join(finer, "cid")
        .withColumn("b", F.pmod(F.xxhash64("cid"), "nb"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "cid", "comp", "n", "m0", "m1", "sig", "fine", "whole")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )
    found = cut(dealt.mapInArrow(lambda it: _open_pairs(it, t, fine_t), "a bigint, b bigint, sure boolean"), "minhash-found")
    more = confirmed(found.filter("NOT sure").select("a", "b"), "minhash-more-links").unionByName(found.filter("sure").select("a", "b"))
    root = nodes
    if more.limit(1).count():
        ends = more.join(nodes.withColumnsRenamed({"cid": "a", "comp": "ca"}), "a").join(nodes.withColumnsRenamed({"cid": "b", "comp": "cb"}), "b")
        merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        root = nodes.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("cid", F.coalesce("top", "comp").alias("comp"))
    # the least id of a group is that of its rows which have one, whichever rows stand for its sets
    ids = classes.select("cid", "n", "c1", "c2", "least").join(root, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    ids = cut(ids, "minhash-components")
    lowest = cut(ids.groupBy("comp").agg(F.min("least").alias("component")), "minhash-least")
    answer = cut(ids.join(lowest, "comp").select("n", "c1", "c2", "component"), "minhash-answer")
    out = signed.select("_id", "_h", "n", "c1", "c2").join(answer, ["n", "c1", "c2"], "left")
    return out.select("_id", "_h", F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component"))


#: DuckDB: all pairs that share a shingle, then what each document reaches.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id AND 100 * least(nx.n, ny.n) >= 75 * greatest(nx.n, ny.n) GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
