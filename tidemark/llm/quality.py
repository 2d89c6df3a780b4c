"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Every passage is encoded (counts of kinds of bytes, word lengths,
repetition), a small network turns the encoding into a representation, and a gated attention, learned from labels
of whole documents, says how much each passage counts; the weighted representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import held_out

WORDS = 64
#: Kinds of bytes whose shares describe a passage; what is in none has kind 0.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".", ",", "!?", "|", "#$%&*@^~", "\n", ":;=<>/\\_+", "\"'()[]{}-"]
KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate(KINDS, 1):
    KIND[list(_chars.encode())] = _k
KIND[0x80:] = len(KINDS) + 1
FEATURES = len(KINDS) + 2 + 9


def passages(buffer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(encodings, first passage of each row and the end) of a block; a text without words has one passage of zeros."""
    start, end = hashing.words(buffer)
    row_word = hashing.by_row(at, start)
    n_words = np.diff(row_word)
    n = np.maximum(1, -(-n_words // WORDS))
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    lo = row_word[row] + (np.arange(first[-1]) - first[row]) * WORDS
    hi = np.minimum(lo + WORDS, row_word[row + 1])
    full = hi > lo
    out = np.zeros((first[-1], FEATURES))
    if not full.any():
        return out, first
    a, b = start[lo[full]], end[hi[full] - 1]
    size, words = (b - a).astype(float), (hi - lo)[full].astype(float)
    kind = KIND[buffer]
    for k in range(len(KINDS) + 2):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        out[full, k] = (sums[b] - sums[a]) / size * (1 if k in (0, 1, 2, len(KINDS) + 1) else 4)
    h = hashing.word_hashes(buffer, start, end)
    length = (end - start).astype(float)
    total = lambda x: np.add.reduceat(np.append(x, 0.0), np.stack([lo[full], hi[full]], 1).ravel())[::2]
    mean = total(length) / words
    same = np.append(h[1:] == h[:-1], False).astype(float)
    owner = np.repeat(np.arange(len(n_words)), n_words).astype(np.uint64)
    f = len(KINDS) + 2

    def repeated(x: np.ndarray) -> np.ndarray:
        """Whether a hash is there again in its text."""
        _, back, count = np.unique(x ^ hashing.mix(owner[: len(x)]), return_inverse=True, return_counts=True)
        return np.append(count[back] > 1, np.zeros(len(h) - len(x), bool)).astype(float)

    capital = ((buffer[start] >= 0x41) & (buffer[start] <= 0x5A)).astype(float)
    out[full, f] = mean / 8
    out[full, f + 1] = np.sqrt(np.maximum(0, total(length**2) / words - mean**2)) / 8
    out[full, f + 2] = total(same) / words
    out[full, f + 3] = total(repeated(h)) / words
    out[full, f + 4] = total(repeated(hashing.rolling(h, 3))) / words
    out[full, f + 5] = total(repeated(hashing.rolling(h, 8))) / words
    out[full, f + 6] = total(capital) / words
    out[full, f + 7] = np.log1p(n_words[row[full]]) / 8
    out[full, f + 8] = words / WORDS
    return out, first


class Attention:
    """The network, its training on whole bags and its scores."""

    def __init__(self, width: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "W": r.normal(0, FEATURES**-0.5, (FEATURES, width)), "b": np.zeros(width),
            "V": r.normal(0, width**-0.5, (width, width)), "U": r.normal(0, width**-0.5, (width, width)), "w": np.zeros(width),
            "c": np.zeros(width), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, n = self.p, np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[row])
        a = e / np.add.reduceat(e, first[:-1])[row]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"row": row, "h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.p, self.forward(x, first)
        row, h, t, g, a, z = (f[k] for k in ("row", "h", "t", "g", "a", "z"))
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[row] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[row])
        dt, dg = de[:, None] * g * p["w"] * (1 - t**2), de[:, None] * t * p["w"] * g * (1 - g)
        dh = (a[:, None] * dz[row] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {
            "W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg,
            "w": ((t * g) * de[:, None]).sum(0), "c": z.T @ d, "d": np.array([d.sum()]),
        }

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Attention:
        """Adam over all bags at once, from a fixed start."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in "mv")
        for step in range(1, steps + 1):
            for k, g in self.gradients(x, first, y).items():
                g = g + decay * self.p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g**2 - v[k])
                self.p[k] -= rate * (1 - step / steps * 0.9) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, buffer, at in hashing.blocks(column):
            out[lo:hi] = self.forward(*passages(buffer, at))["score"]
        return out


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [passages(buffer, at) for _, _, buffer, at in hashing.blocks(pa.array(texts, pa.string()))]
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def learn(docs: DataFrame, labels: DataFrame, most: int = 4000, longest: int = 50_000) -> Attention:
    """Fits the network to at most ``most`` labelled documents, those of smallest hashed id, of up to ``longest`` characters.

    labels: doc_id, label (0 or 1); of several labels of an id the largest holds, of several texts
    the first in their order. Without labels every score is 0.5.
    """
    labels = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = labels.count()
    picked = labels.where(rank < int((1 << 30) * min(1, 1.5 * most / max(1, n)))).orderBy(rank, "doc_id").limit(most)
    texts = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= longest).select("doc_id", "text")
    # picked has at most ``most`` rows of two numbers
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    model = Attention()
    if rows:
        rows.sort(key=lambda r: r.doc_id)
        model.fit(*bags([r.text or "" for r in rows]), np.array([float(r.label) for r in rows]))
    return model


def score(docs: DataFrame, model: Attention, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on). A null text counts as empty and is scored as a passage of zeros.

    Rows are scored each on its own; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(1))
            predicted = pa.array((found >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), predicted], ["doc_id", "score", "predicted"])

    columns = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted. docs: doc_id, text; labels: doc_id, quality.

    Learns from labels of rows whose crc32 of the id is no multiple of 5.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    known = labels.where(~out).select("doc_id", F.col("quality").cast("int").alias("label"))
    return score(docs, learn(docs, known, most)).select("doc_id", out.alias("held_out"), "score", "predicted")
