"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE_WORDS`` words).  Every passage is encoded by a
small network over surface measurements: byte-class shares, word lengths, repeated words, a
byte-class pair table.  Gated attention, tanh(V h) * sigmoid(U h), gives each passage a weight
inside its document; the score is a logistic function of the weighted passage encoding.
Only documents have labels; passages get theirs through the attention weights.

Fitting: on a bounded sample of labelled documents (``SAMPLE``, the smallest hashes of their
ids, ``PASSAGES`` passages together at most), all passages of them, measured by the executors.  The driver
holds the measurements as half-precision numbers.  Scoring: every document, all passages of it, in tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsim.llm.common import cut_lineage, labelled_texts, ship, spans_hash, without, word_edges

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6000
#: Passages that it is fitted on, at most (384 bytes each): documents are taken in the order of their hashes while they fit.
PASSAGES = 200_000
PASSAGE_WORDS = 64
#: Bytes measured at a time.
SLICE = 1 << 20
#: Passages encoded at a time.
STEP = 4096

ship(__name__)


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 . and , 6 ! and ?
    7 quotes and brackets, 8 | and similar, 9 other ASCII signs, 10 UTF-8 lead, 11 UTF-8 tail, 12 control."""
    c = np.full(256, 12, np.uint8)
    for k, chars in enumerate((b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:", b"!?",
                               b"\"'()[]{}<>", b"|/\\_~=", b"#$%&*+-@^`")):
        c[list(chars)] = k
    c[0xC0:], c[0x80:0xC0] = 10, 11
    return c


CLASSES = 13
_CLASS = _byte_classes()
FEATURES = CLASSES + CLASSES * CLASSES + 10


def _measure_slice(data: bytes, starts: np.ndarray, ends: np.ndarray, stop: int, words: int) -> np.ndarray:
    """Measurements of the passages of a slice up to ``stop`` whose words are given."""
    n = -(-len(starts) // words)
    at = np.arange(len(starts)) // words
    first = np.arange(n) * words
    cut = np.concatenate((starts[first], [stop]))
    raw = np.frombuffer(data, np.uint8, int(cut[-1] - cut[0]), int(cut[0]))
    kind = _CLASS[raw].astype(np.int64)
    passage = np.repeat(np.arange(n), np.diff(cut))
    size = np.maximum(1, np.diff(cut)).astype(float)
    both = passage[1:] == passage[:-1]
    pairs = np.bincount((passage[1:] * CLASSES ** 2 + kind[:-1] * CLASSES + kind[1:])[both], minlength=n * CLASSES ** 2)
    pairs = pairs.reshape(n, CLASSES ** 2) / size[:, None]
    single = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    length = (ends - starts).astype(float)
    count = np.bincount(at, minlength=n).astype(float)
    mean = np.bincount(at, length, n) / count
    spread = np.sqrt(np.maximum(0, np.bincount(at, length * length, n) / count - mean * mean))
    h = spans_hash(raw.astype(np.uint64) + np.uint64(1), starts - cut[0], ends - cut[0], 0x9E3779B97F4A7C15)
    distinct = np.bincount((np.unique(np.stack((at.astype(np.uint64), h)), axis=1)[0]).astype(np.int64), minlength=n) / count
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(at[1:], ((h[1:] == h[:-1]) & (at[1:] == at[:-1])).astype(float), n) / count
    first_kind, last_kind = _CLASS[raw[starts - cut[0]]], _CLASS[raw[ends - 1 - cut[0]]]
    share = lambda hit: np.bincount(at, hit.astype(float), n) / count
    more = np.stack((np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, distinct, same, share(length == 1),
                     share(first_kind == 3), share(last_kind >= 8), share(last_kind == 6), share(length > 20),
                     np.minimum(count, words) / words), axis=1)
    return np.concatenate((np.sqrt(single), np.sqrt(pairs), more), axis=1).astype(np.float32)


def measure(data: bytes, words: int = PASSAGE_WORDS) -> np.ndarray:
    """Measurements of every passage of a text; one row of zeros if it has no word.  Long texts
    are measured through slices, so the memory beside the result stays bounded."""
    starts, ends = word_edges(data)
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    out, i = [], 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SLICE, "right"))
        j = min(len(starts), i + max(words, (j - i) // words * words))
        stop = starts[j] if j < len(starts) else ends[-1]
        out.append(_measure_slice(data, starts[i:j], ends[i:j], int(stop), words))
        i = j
    return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray      # features x hidden
    shift: np.ndarray       # hidden
    v: np.ndarray           # hidden x gate
    u: np.ndarray           # hidden x gate
    attend: np.ndarray      # gate
    out: np.ndarray         # hidden
    bias: float

    def _passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh((x - self.mean) / self.scale @ self.encode + self.shift)
        return h, (np.tanh(h @ self.v) * _sigmoid(h @ self.u)) @ self.attend

    def score(self, x: np.ndarray) -> float:
        """Score of a bag, from 0 to 1; runs over the passages with a softmax kept in one pass."""
        top, total, rep = -np.inf, 0.0, np.zeros(len(self.out))
        for i in range(0, len(x), STEP):
            h, a = self._passages(x[i:i + STEP])
            new = max(top, float(a.max()))
            e = np.exp(a - new)
            old = np.exp(top - new)
            total, rep, top = total * old + float(e.sum()), rep * old + e @ h, new
        return float(_sigmoid(rep / total @ self.out + self.bias))


class Bags(Sequence):
    """Bags of measurements, kept as bytes of half-precision numbers; a bag is widened when asked for."""

    def __init__(self, bags: list[bytes]):
        self.bags = bags

    def __len__(self) -> int:
        return len(self.bags)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(self.bags[i], np.float16).reshape(-1, FEATURES).astype(np.float32)


def fit(bags: Sequence[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30,
        rate: float = 0.005, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> AttentionModel:
    """Fits encoder, attention and output together by Adam on the documents' cross entropy, both
    classes weighted alike.  Without both classes the score is the share of label 1."""
    labels = np.asarray(labels, float)
    rows = max(1, sum(len(b) for b in bags))
    mean = sum((b.sum(axis=0, dtype=float) for b in bags), np.zeros(FEATURES)) / rows
    scale = np.sqrt(sum((np.square(b - mean).sum(axis=0) for b in bags), np.zeros(FEATURES)) / rows) + 0.02
    rng = np.random.default_rng(seed)
    p = {"encode": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), "shift": np.zeros(hidden),
         "v": rng.normal(0, hidden ** -0.5, (hidden, gate)), "u": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "attend": rng.normal(0, gate ** -0.5, gate), "out": rng.normal(0, hidden ** -0.5, hidden), "bias": np.zeros(1)}
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(bags) or not 0 < share < 1:
        odds = np.log((share + 1e-3) / (1 - share + 1e-3))
        return AttentionModel(mean, scale, p["encode"], p["shift"], p["v"], p["u"], p["attend"], 0 * p["out"], float(odds))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    moment = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in p.items()}
    t = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            x = [bags[i] for i in part]
            sizes = np.array([len(b) for b in x])
            x = (np.concatenate(x) - mean.astype(np.float32)) / scale.astype(np.float32)
            doc = np.repeat(np.arange(len(part)), sizes)
            begin = np.cumsum(sizes) - sizes
            h = np.tanh(x @ p["encode"] + p["shift"])
            tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
            a = (tv * su) @ p["attend"]
            e = np.exp(a - np.maximum.reduceat(a, begin)[doc])
            w = e / np.add.reduceat(e, begin)[doc]
            z = np.add.reduceat(w[:, None] * h, begin)
            s = _sigmoid(z @ p["out"] + p["bias"][0])
            d = (s - labels[part]) * weight[part] / len(part)
            g = {"out": z.T @ d, "bias": np.array([d.sum()])}
            dz = d[:, None] * p["out"]
            along = (h * dz[doc]).sum(axis=1)
            da = w * (along - np.add.reduceat(w * along, begin)[doc])
            g["attend"] = (tv * su).T @ da
            gate_v, gate_u = da[:, None] * p["attend"] * su * (1 - tv * tv), da[:, None] * p["attend"] * tv * su * (1 - su)
            g["v"], g["u"] = h.T @ gate_v, h.T @ gate_u
            dh = (w[:, None] * dz[doc] + gate_v @ p["v"].T + gate_u @ p["u"].T) * (1 - h * h)
            g["encode"], g["shift"] = x.T @ dh, dh.sum(axis=0)
            t += 1
            for k in p:
                m, q = moment[k]
                m += 0.1 * (g[k] - m)
                q += 0.001 * (g[k] * g[k] - q)
                p[k] -= rate * (m / (1 - 0.9 ** t) / (np.sqrt(q / (1 - 0.999 ** t)) + 1e-8) + decay * p[k])
    return AttentionModel(mean, scale, p["encode"], p["shift"], p["v"], p["u"], p["attend"], p["out"], float(p["bias"][0]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> AttentionModel:
    """Model of ``labels`` (doc_id, ``label``) on at most ``sample`` of the labelled ``docs``: those with
    the smallest hashes of their ids, so the choice does not depend on the order of rows.  Of these a document longer than
    an eighth of ``passages`` is not used, nor those after the first ``passages`` passages.  Rows
    with a null id or label are not used; of rows that repeat an id the smallest text is."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
             .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample))

    @F.pandas_udf("binary")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: measure((t or "").encode()).astype(np.float16).tobytes())

    got = cut_lineage(labelled_texts(docs, known).select("doc_id", "y", measured("text").alias("x")), "quality-bags")
    size = (F.length("x") / (2 * FEATURES)).cast("long")
    place = Window.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")       # over at most ``sample`` ids
    taken = (got.select("doc_id", size.alias("n")).where(F.col("n") <= passages // 8).withColumn("total", F.sum("n").over(place))
             .where(F.col("total") <= passages).select("doc_id"))
    seen = {r.doc_id: (bytes(r.x), r.y) for r in got.join(taken, "doc_id").toLocalIterator()}
    order = [seen[i] for i in sorted(seen)]
    return fit(Bags([x for x, _ in order]), np.array([y for _, y in order]))


def with_quality(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus ``out`` (double, 0 to 1, higher: label 1 likelier).  A null text counts as empty;
    an empty text has one passage of zeros and so a score too.  All rows and columns stay
    (a column named ``out`` is replaced); an empty table stays empty."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(measure((t or "").encode())))

    return without(docs, out).withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))
