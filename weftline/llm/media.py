"""Media columns: texts stored as lossless WebP images, read back, and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import bound_batches


def payload(text: bytes) -> bytes:
    """The bytes, then zeros up to a positive multiple of a row."""
    return text + b"\0" * (-len(text) % webp.ROW if text else webp.ROW)


def features(images: list[np.ndarray]) -> list[str]:
    """For each image 16 hex digits: which of 8 x 8 cells are brighter than their mean; then mean and deviation."""
    if not images:
        return []
    h = np.array([len(x) for x in images])
    # rows of all images lie behind one another, so the last band of an image ends where the next image begins
    rows = np.arange(8) * h[:, None] // 8
    tall = np.maximum(np.diff(rows, axis=1, append=h[:, None]), 1)
    bands = np.add.reduceat(np.concatenate(images), (rows + (np.cumsum(h) - h)[:, None]).ravel(), axis=0, dtype=np.int64) / tall.reshape(-1, 1)
    cells = bands.reshape(len(images), 64, -1).mean(axis=2)
    bits = np.packbits(cells > cells.mean(axis=1, keepdims=True), axis=1).tobytes().hex()
    counts = np.stack([np.bincount(x.ravel(), minlength=256) for x in images])
    size = h * images[0].shape[1]
    mean = counts @ _VALUES / size
    spread = np.sqrt(np.maximum(counts @ _SQUARES / size - mean * mean, 0))
    return [f"{bits[16 * k : 16 * k + 16]}:{m:.3f}:{d:.3f}" for k, (m, d) in enumerate(zip(mean.tolist(), spread.tolist(), strict=True))]


def feature(samples: np.ndarray) -> str:
    """features() of one image."""
    return features([samples])[0]


_VALUES = np.arange(256)
_SQUARES = _VALUES**2
FIELDS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _describe(texts: list[bytes], media: list[bytes], with_media: bool) -> list[tuple]:
    """The columns of FIELDS, and the files."""
    out, at = [], 0
    while at < len(media):
        # so many images are held at once as their files, or one text, allow
        images, held = [], 0
        while at + len(images) < len(media) and held < webp.TOGETHER:
            images.append(webp.load(media[at + len(images)]))
            held += images[-1].nbytes
        for samples, told in zip(images, features(images), strict=True):
            text, file, back = texts[at], media[at], samples.tobytes()
            out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-webp.ROW :]), len(file), hashlib.sha256(file).hexdigest(), told, *([file] if with_media else [])))
            at += 1
    return list(zip(*out, strict=True))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row for each row of df: id (_id if it is named like one of the others) and FIELDS, computed from the pixels read back; with_media adds the files.

    Null and empty texts are one row of zeros. A text is one image; only beyond 8 MiB do files follow one another.
    """

    bound_batches(df.sparkSession)
    own = "_id" if id_col in (*(f.split()[0] for f in FIELDS.split(", ")), "media") else id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0)[i : i + 512], batch.column(1)[i : i + 512].cast(pa.binary()).to_pylist()
                texts = [t or b"" for t in texts]
                rows = _describe(texts, webp.store_many([payload(t) for t in texts]), with_media)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = [own, *(f.split()[0] for f in FIELDS.split(", ")), "media"][: 1 + len(rows)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rows, kinds, strict=False))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInArrow(run, f"`{own}` {kind}, {FIELDS}" + ", media binary" * with_media)
