"""Token ids packed into fixed-length rows.

Texts are encoded, each closed by the end token, and cut into segments of at most `length` ids, so an overlong
document becomes several segments and nothing is lost. Segments are dealt by hash into windows, as many as the
table's bytes call for, and each window is packed by best-fit decreasing: longest first, each into the open row with
the least room that still holds it, which a segment tree over rooms finds in logarithmic time. The rows of a window
follow from its segments in a fixed order, so the packing is a function of the table, however its files are split,
and a lost task packs its windows again alike.

A packed row holds an id matrix row (padded), cumulative segment lengths, the places where positions restart, and
for each segment its document and its offset there; write_packed() writes these as binary files.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, model_file
from .textgrams import give_back

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, END = 2048, 50256
#: Text bytes that a window holds on average, and ids after which one is packed at the latest (many equal rows share one).
WINDOW_BYTES, WINDOW_IDS = 8 << 20, 1 << 23
#: Runs of the pattern's white space that the tokenizer's matcher would descend into too deeply.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

_encodings: dict = {}


def encoding(path: str):  # noqa: ANN201
    if path not in _encodings:
        import tiktoken

        with open(model_file(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class Rooms:
    """A segment tree over rows: the greatest number of rows with each room; finds the least room of at least n."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        i, tree = room + self.size, self.tree
        while i:
            tree[i] += n
            i >>= 1

    def best(self, n: int) -> tuple[int, int] | None:
        """(room, row) of the least room that is n at least, taken out; None if there is none."""
        i, tree = n + self.size, self.tree
        if not tree[i]:
            # up to the first ancestor with something to its right, then down to its least leaf
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not tree[i]:
                    i += 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the segments of each row; equal sizes keep their order."""
    rooms, out = Rooms(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = rooms.best(sizes[k])
        if found is None:
            found = length, len(out)
            out.append([])
        out[found[1]].append(k)
        left = found[0] - sizes[k]
        if left:
            rooms.put(left, found[1])
    return out


def encode_text(enc, text: str) -> list[int]:  # noqa: ANN001
    """Ids of a text. A long run of white space is one piece, but for its last character if more text follows, as the pattern has it."""
    out, at = [], 0
    for m in LONG_SPACE.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + enc.encode_ordinary(text[at:]) if out else enc.encode_ordinary(text)


def segments(ids: np.ndarray, length: int) -> list[np.ndarray]:
    return [ids[i : i + length] for i in range(0, len(ids), length)]


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else in four; the first byte says which."""
    size = 2 if ids.max() < 1 << 16 else 4
    return bytes([size]) + ids.astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks: str = DEFAULT_RANKS, end: int = END, window_bytes: int = WINDOW_BYTES
) -> DataFrame:
    """Packed rows: n_ids, ids (length of them, padded with end), cu_seqlens (0 first), resets, doc_ids, offsets.

    cu_seqlens[k] is where segment k begins; resets are those places as well, without the total at the end; each
    doc_ids[k] and offsets[k] say which ids of which document segment k is. Null and empty texts are one end token.
    Rows that repeat an id are packed as often as they occur; equal rows share a window, which is packed in parts of
    2**23 ids, so that no task holds more. An empty table gives no rows. The file at ranks lies
    at that path on every node or was shipped with SparkContext.addFile().
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    total = texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n_windows = max(1, math.ceil(total / window_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                row, off, seg = [], [], []
                for k, text in enumerate(batch.column(2)[i : i + 512].to_pylist()):
                    for j, part in enumerate(segments(np.array([*encode_text(enc, text), end], np.int32), length)):
                        row.append(i + k)
                        off.append(j * length)
                        seg.append(_narrow(part))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(off, pa.int64()), pa.array(seg, pa.binary())], names=["_id", "_h", "off", "seg"])
            give_back()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (document, offset, ids)
        now, n, id_type = None, 0, pa.int64()
        for batch in batches:
            id_type = batch.column(1).type
            for window, doc, off, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (window != now or n >= WINDOW_IDS):
                    yield from _packed_rows(held, length, end, id_type)
                    held, n = [], 0
                now = window
                ids = _wide(seg)
                held.append((doc, off, ids))
                n += len(ids)
            give_back()
        if held:
            yield from _packed_rows(held, length, end, id_type)

    dealt = (
        texts.select("_id", F.xxhash64("_t").alias("_h"), "_t").mapInArrow(encode, f"_id {kind}, _h bigint, off bigint, seg binary")
        .withColumn("_w", F.pmod(F.xxhash64("_id", "_h", "off"), F.lit(n_windows)).cast("int"))
        .repartition(n_windows, "_w").sortWithinPartitions("_w", "_h", "_id", "off").select("_w", "_id", "off", "seg")
    )
    return dealt.mapInArrow(pack, f"n_ids int, ids array<int>, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, offsets array<bigint>")


def _packed_rows(held: list[tuple], length: int, end: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing([len(s) for _, _, s in held], length)
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        matrix = np.full((len(part), length), end, np.int32)
        cu = []
        for r, row in enumerate(part):
            at = [0]
            for k in row:
                ids = held[k][2]
                matrix[r, at[-1] : at[-1] + len(ids)] = ids
                at.append(at[-1] + len(ids))
            cu.append(at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c[-1] for c in cu], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * length), pa.array(matrix.ravel())),
                pa.array(cu, pa.list_(pa.int32())), pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
                pa.array([[held[k][0] for k in row] for row in part], pa.list_(id_type)), pa.array([[held[k][1] for k in row] for row in part], pa.list_(pa.int64())),
            ],
            names=["n_ids", "ids", "cu_seqlens", "resets", "doc_ids", "offsets"],
        )


def write_packed(packed: DataFrame, path: str, kind: str = "uint16") -> DataFrame:
    """Adds to packed rows their binary forms and writes them as Parquet: ids_bin (little-endian, of the kind), cu_bin
    (int32) and position_bin (int32: places within segments, restarting at 0; padding counts on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_bin, cu_bin, pos_bin = [], [], []
            for ids, cu in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids_bin.append(np.array(ids, kind).tobytes())
                cu_bin.append(np.array(cu, np.int32).tobytes())
                start = np.zeros(len(ids), np.int32)
                start[cu[:-1]] = cu[:-1]
                pos_bin.append((np.arange(len(ids), dtype=np.int32) - np.maximum.accumulate(start)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (ids_bin, cu_bin, pos_bin)] + [batch.column(2), batch.column(3)], names=["ids_bin", "cu_bin", "position_bin", "doc_ids", "offsets"])

    doc_kind = packed.schema["doc_ids"].dataType.simpleString()
    packed.select("ids", "cu_seqlens", "doc_ids", "offsets").mapInArrow(run, f"ids_bin binary, cu_bin binary, position_bin binary, doc_ids {doc_kind}, offsets array<bigint>").write.parquet(path)
    return packed.sparkSession.read.parquet(path)
