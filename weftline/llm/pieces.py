"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text runs over its UTF-8 bytes: an edge for each vocabulary piece found there (the piece's
space mark stands for a space) and one for each byte. Forward sums are filtered left to right; pieces are drawn
right to left in proportion to forward sum times weight, with numbers that depend on seed, row key, position
and step alone. No piece continues past a space after another character, or across a byte that only byte
pieces hold; lattices therefore factor there, equal factors of a run of texts share one forward pass, and draws
are made for all of them at once.

The model file holds merge ranks, not probabilities; a piece of rank r has weight (r + 2)**-alpha, a byte piece
that of the last rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free, model_file
from .textgrams import U, chunks, give_back, mix, span_hashes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 18


class Pieces:
    """Vocabulary as a byte trie, with weights."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file(path))
        size = sp.get_piece_size()
        self.text: list[bytes] = [b""] * size
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        found = {}
        for i in range(size):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[b], self.text[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                found[self.text[i]] = i
        if (self.byte_id == sp.unk_id()).any():
            raise ValueError("the model lacks byte pieces, so decoding could not be lossless")
        self.sizes = np.array([len(t) for t in self.text])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        rank = np.maximum(np.arange(size) - 259, 0)
        self.score = (-alpha * np.log(rank + 2.0)).astype(np.float32)
        self.score[self.byte_id] = -alpha * np.log(size + 2.0)
        inside = set().union(*found)
        self.alone = np.array([b not in inside for b in range(256)])
        # a piece with a space after another character would cross the cuts at words
        self.cut_at_space = not any(b" " in t.lstrip(b" ") for t in found)
        nodes, ends, edges = [{}], [-1], 0
        for t, i in found.items():
            at = 0
            for b in t:
                nxt = nodes[at].get(b)
                if nxt is None:
                    nxt = nodes[at][b] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = i
        self.trie = np.zeros((len(nodes), 256), np.int32)
        for at, n in enumerate(nodes):
            if n:
                self.trie[at, list(n)] = list(n.values())
        self.ends = np.array(ends, np.int32)

    def split(self, buf: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Starts of the factors of a run of texts, whose first bytes are at doc_starts."""
        start = np.zeros(len(buf) + 1, bool)
        start[doc_starts] = True
        lone = self.alone[buf]
        start[:-1] |= lone
        start[1:] |= lone
        if self.cut_at_space:
            space = buf == 32
            start[1:-1] |= space[1:] & ~space[:-1]
        return np.flatnonzero(start[:-1])

    def sample(self, texts: list[bytes], keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after another, and where each text's begin. keys: 64-bit row keys."""
        buf = np.frombuffer(b"".join(texts), np.uint8)
        doc_at = np.cumsum([0] + [len(t) for t in texts])
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.split(buf, doc_at[:-1][np.diff(doc_at) > 0])
        ends = np.concatenate((starts[1:], [len(buf)]))
        _, one, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[one]
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, size, first = rank[which], size[order], starts[one][order]
        # column-major: column t holds byte t of the factors longer than t, which come first
        n_at = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        col = np.concatenate(([0], np.cumsum(n_at)))
        t_of = np.repeat(np.arange(size[0]), n_at)
        r_of = np.arange(col[-1]) - col[t_of]
        data = buf[first[r_of] + t_of]
        # edges by length: rows are nodes after each byte, nodes are numbered like the byte before them
        live, node, at = np.arange(col[-1]), np.zeros(col[-1], np.int32), data
        by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(1, int(size[0]) + 1):
            node = self.trie[node, at]
            ok = node > 0
            live, node = live[ok], node[ok]
            if not len(live):
                break
            ids = self.ends[node]
            hit = ids >= 0
            if hit.any():
                by_len[length] = (live[hit], ids[hit])
            more = t_of[live] + length < size[r_of[live]]
            live, node = live[more], node[more]
            at = data[col[t_of[live] + length] + r_of[live]]
        ids = {k: np.full(col[-1], -1, np.int32) for k in {1, *by_len}}
        ids[1][:] = self.byte_id[data]
        lengths = sorted(ids)
        bounds = {}
        for k, (pos, i) in by_len.items():
            end = col[t_of[pos] + k - 1] + r_of[pos]
            if k == 1:
                # a piece of one byte stands for its byte piece; both would decode alike
                ids[1][pos] = i
            else:
                ids[k][end] = i
                bounds[k] = (pos, end, self.score[i], np.searchsorted(pos, col))
        total = np.zeros(col[-1], np.float64)
        unit = self.score[ids[1]].astype(np.float64)
        for t in range(int(size[0])):
            a, b = col[t], col[t + 1]
            total[a:b] = unit[a:b] + (total[col[t - 1] : col[t - 1] + b - a] if t else 0.0)
            for k in lengths[1:]:
                if k > t + 1:
                    break
                pos, end, s, lim = bounds[k]
                x, y = lim[t + 1 - k], lim[t + 2 - k]
                if x < y:
                    e = end[x:y]
                    before = total[col[t - k] + r_of[pos[x:y]]] if t + 1 > k else 0.0
                    total[e] = np.logaddexp(total[e], before + s[x:y])
        share = {}
        prev = np.zeros(col[-1])
        tail = t_of > 0
        prev[tail] = total[col[t_of[tail] - 1] + r_of[tail]]
        share[1] = np.exp(prev + unit - total).astype(np.float32)
        for k in lengths[1:]:
            pos, end, s, _ = bounds[k]
            before = np.zeros(len(pos))
            inner = t_of[pos] > 0
            before[inner] = total[col[t_of[pos[inner]] - 1] + r_of[pos[inner]]]
            share[k] = np.zeros(col[-1], np.float32)
            share[k][end] = np.exp(before + s - total[end])
        # draws, from each factor's last byte to its first
        doc = np.searchsorted(doc_at, starts, side="right") - 1
        base = mix(keys[doc] ^ mix(np.full(1, seed, np.int64).astype(U))) + (starts - doc_at[doc]).astype(U) * U(0x9E3779B97F4A7C15)
        occ, left = np.arange(len(starts)), size[which]
        out_occ, out_id, out_step = [], [], []
        step = 0
        while len(occ):
            e = col[left - 1] + which[occ]
            u = (mix(base[occ] + U(step * 0xD1B54A32D192ED03 % 2**64)) >> U(40)).astype(np.float32) * np.float32(2**-24)
            chosen, ident = np.ones(len(occ), np.int64), ids[1][e]
            wait = np.flatnonzero(u >= share[1][e])
            u = u[wait] - share[1][e[wait]]
            for k in lengths[1:]:
                if not len(wait):
                    break
                p = share[k][e[wait]]
                take = u < p
                done = wait[take]
                chosen[done], ident[done] = k, ids[k][e[done]]
                wait, u = wait[~take], (u - p)[~take]
            out_occ.append(occ)
            out_id.append(ident)
            out_step.append(np.full(len(occ), step, np.int32))
            left = left - chosen
            go = left > 0
            occ, left = occ[go], left[go]
            step += 1
        o, i, s = np.concatenate(out_occ), np.concatenate(out_id), np.concatenate(out_step)
        count = np.bincount(o, minlength=len(starts))
        at = np.concatenate(([0], np.cumsum(count)))
        result = np.empty(len(i), np.int32)
        result[at[o] + count[o] - 1 - s] = i
        per_doc = np.bincount(doc, count, minlength=len(texts)).astype(np.int64)
        return result, np.concatenate(([0], np.cumsum(per_doc)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the pieces spell; control and unknown ids spell nothing."""
        n = self.sizes[ids]
        at = np.cumsum(n) - n
        return self.flat[np.arange(n.sum()) - np.repeat(at - self.begin[ids], n)].tobytes()


_loaded: dict[tuple, Pieces] = {}


def load(path: str, alpha: float) -> Pieces:
    """One copy for each Python worker."""
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Pieces(path, alpha)
    return _loaded[path, alpha]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, alpha: float = 1.0, seed: int = 5) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_pieces, ids, lossless. An id column of one of these names becomes _id.

    The row key is the xxhash64 of id, so rows with equal ids and texts get equal pieces. Null and empty texts
    have no pieces. lossless says that decoding gave back the text's bytes. The model lies at its path on every node or
    was shipped with SparkContext.addFile().
    """

    bound_batches(df.sparkSession)
    own = "_id" if id_col in ("n_bytes", "n_pieces", "ids", "lossless") else id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, alpha)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            keys = batch.column(1).to_numpy().astype(U)
            at = 0
            for part in chunks((t or b"" for t in texts), CHUNK):
                ids, to = pieces.sample(part, keys[at : at + len(part)], seed)
                whole = pieces.decode(ids) == b"".join(part)
                ok = [True] * len(part) if whole else [pieces.decode(ids[a:b]) == t for a, b, t in zip(to[:-1], to[1:], part, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(part)], pa.array([len(t) for t in part], pa.int64()), pa.array(np.diff(to)),
                        pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids)), pa.array(ok),
                    ],
                    names=[own, "n_bytes", "n_pieces", "ids", "lossless"],
                )
                at += len(part)
            give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.xxhash64(F.col(id_col)).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInArrow(
        run, f"`{own}` {kind}, n_bytes bigint, n_pieces bigint, ids array<int>, lossless boolean"
    )


def decode_documents(df: DataFrame, ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with a column text that its ids spell, with underscores behind its name where df has one; null ids give null."""
    spell = F.arrow_udf(lambda ids: pa.array([None if x is None else load(model, 1.0).decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string()), "string")
    return df.withColumn(free(df, "text"), spell(F.col(ids_col)))
