"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE consecutive words, all of them. Each passage is encoded from its byte
classes, their transitions and its word shapes; gated attention, learned from document labels alone, weighs the
encodings, and a logistic unit scores the weighted sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .textgrams import SPACE, chunks, give_back, span_hashes, word_bounds

#: Words of a passage; labelled documents that a model is fitted on at most, and passages of each; decision threshold.
PASSAGE, TRAIN_DOCS, TRAIN_PASSAGES, THRESHOLD = 64, 2000, 256, 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 16, 30, 128, 0.01, 1e-4

_CLASS = np.full(256, 6, np.int64)  # other ASCII symbols
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[128:] = 7
_CLASS[33] = 8
C = 9
N_FEATURES = C * C + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and where each text's passages begin. An empty text is one passage of zeros."""
    buf, starts, ends, first = word_bounds(texts, SPACE)
    n_words = np.diff(first)
    n_pass = np.maximum(-(-n_words // PASSAGE), 1)
    at = np.concatenate(([0], np.cumsum(n_pass)))
    out = np.zeros((at[-1], N_FEATURES), np.float32)
    if not len(starts):
        return out, at
    doc = np.repeat(np.arange(len(texts)), n_words)
    word_pass = at[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    # bytes from one word's start to the next one's belong to the passage of the word
    kind = _CLASS[buf]
    span = np.diff(np.concatenate((starts, [len(buf)])))
    byte_pass, word_doc = np.repeat(word_pass, span)[:-1], np.repeat(doc, span)[:-1]
    body = kind[starts[0] :]
    # pairs within the text of the word; a text's last byte is paired with the space behind it
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])[starts[0] :]
    own = np.flatnonzero((text_of[:-1] == word_doc) & (text_of[1:] == word_doc))
    pairs = np.bincount(byte_pass[own] * (C * C) + body[own] * C + body[own + 1], minlength=at[-1] * C * C).reshape(-1, C * C)
    out[:, : C * C] = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    h = span_hashes(buf, starts, ends)
    size = ends - starts
    per = lambda x: np.bincount(word_pass, x, minlength=at[-1])
    n = np.maximum(per(np.ones(len(starts))), 1)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (word_pass[1:] == word_pass[:-1])))
    order = np.lexsort((h, word_pass))
    seen = np.zeros(len(h), bool)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (word_pass[order[1:]] == word_pass[order[:-1]])
    last, head = kind[ends - 1], kind[starts]
    second = kind[np.minimum(starts + 1, ends - 1)]
    rest = (size / 10, size <= 3, again, seen, (last == 6) | (last == 8), (head == 6) & (last == 6), (head == 1) & (second == 1), (last == 5))
    for i, x in enumerate(rest):
        out[:, C * C + i] = per(np.asarray(x, float)) / n
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, at: np.ndarray) -> dict:
    """Scores of bags; at holds where each bag's passages begin."""
    x = (x - p["mean"]) / p["std"]
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
    e = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
    a = e / np.add.reduceat(e, at[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, at[:-1])
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}


def gradient(p: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    """Derivatives of the mean log loss of bags by each weight."""
    f = forward(p, x, at)
    dy = (f["y"] - y) / len(y)
    dz = dy[:, None] * p["c"]
    da = (dz[f["bag"]] * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, at[:-1])[f["bag"]])
    dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = 6) -> dict:
    """Weights by Adam on the mean log loss of bags."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"W": init(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, HIDDEN), "U": init(HIDDEN, HIDDEN), "w": init(HIDDEN), "c": init(HIDDEN), "d": np.zeros(())}
    fixed = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-2}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            docs = order[i : i + BATCH]
            rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in docs])
            sub = np.concatenate(([0], np.cumsum(at[docs + 1] - at[docs])))
            grad = gradient(p | fixed, x[rows], sub, y[docs])
            step += 1
            for k in p:
                g = grad[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def training_bag(text: bytes, most: int | None = TRAIN_PASSAGES) -> np.ndarray:
    """A text's passages, or so many of them at equal distances; scoring takes them all."""
    x = passages([text])[0]
    return x if most is None or len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)]


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_passages: int | None = TRAIN_PASSAGES) -> dict:
    """Model fitted on at most train_docs labelled documents, those of the least hashes of their ids, each with at most
    train_passages passages (None: with all); of several rows of an id, one (the text of the least hash) counts.

    Rows whose crc32(id) mod 5 is 0 and null labels are left out; an id with several labels takes the largest.
    With labels of one class, or none, the model is their smoothed share (one half without labels).
    """
    bound_batches(docs.sparkSession)
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    )
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    bags = F.arrow_udf(lambda t: pa.array([training_bag(s or b"", train_passages).tobytes() for s in t.cast(pa.binary()).to_pylist()], pa.binary()), "binary")
    joined = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(sample), F.col("_i") == F.col("_id"))
    one = joined.groupBy("_i", "_y").agg(F.min(F.struct(F.xxhash64("_t"), "_t"))["_t"].alias("_t"))
    rows = one.select("_i", "_y", bags("_t").alias("bag")).collect()  # bounded by train_docs times train_passages
    rows.sort(key=lambda r: (str(r["_i"]), bytes(r["bag"])))
    y = np.array([float(r["_y"]) for r in rows])
    if len(set(y)) < 2:
        return {"constant": (y.sum() + 1) / (len(y) + 2)}
    x = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(np.concatenate(x).astype(float), np.concatenate(([0], np.cumsum([len(b) for b in x]))), y)


def scorer(model: dict):
    """An Arrow function of a text column that returns scores from 0 to 1, to 5 places.

    The last digits of a product of matrices depend on how many texts are scored together; rounding keeps equal texts equal
    but for scores within 1e-7 of half a place.
    """
    model = {k: np.asarray(v, np.float32) for k, v in model.items()}

    def score(texts: pa.Array) -> pa.Array:
        out = []
        for run in chunks((t or b"" for t in texts.cast(pa.binary()).to_pylist()), 1 << 18):
            if "constant" in model:
                out += [float(model["constant"])] * len(run)
            else:
                out += np.round(forward(model, *passages(run))["y"].astype(float), 5).tolist()
        give_back()
        return pa.array(out, pa.float64())

    return F.arrow_udf(score, "double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted. Null and empty texts are a bag of one empty passage."""
    bound_batches(docs.sparkSession)
    score = scorer(train(docs, labels, id_col, text_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
