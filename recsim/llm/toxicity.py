"""Toxicity classifier with counterfactual regularisation.

Features are the presence of words and of letter runs in words, chosen by the z-score of their log
odds between the classes.  The model is logistic.  Beside the cross entropy, the fit has a
penalty on the squared change of the logit when the identity terms of a document are
swapped for others of their group: a mere mention of a group must not move the score.

Fitting uses a bounded sample of labelled documents (``SAMPLE``, the smallest hashes of their
ids).  Feature counts are summed inside every batch before the shuffle.  Every document
is scored whole, in tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import cut_lineage, fresh, labelled_texts, ship, without

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 16_000
#: Features of the model, at most (a parameter of the model, not of the data).
FEATURES = 4096
#: Least z-score of a feature's log odds, and least count of documents that have it.
LEAST_Z, LEAST_DOCS = 3.0, 4
#: Lengths of the letter runs inside words that are features.
GRAMS = (4, 5)
#: Words whose features a task keeps at hand.
CACHE = 1 << 16

#: Terms that name groups, by kind; a term may stand for any other of its row.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "refugee", "native"), ("immigrants", "refugees", "natives"),
    ("old", "young"), ("blind", "deaf", "disabled"),
)

_WORD = re.compile(r"[^\W\d_]+")

ship(__name__)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> tuple[str, ...]:
    """The word between marks, and the letter runs inside it."""
    return (f"^{word}$", *{word[i:i + n] for n in GRAMS for i in range(len(word) - n + 1)})


def swapped(words: set[str], identity=IDENTITY, turn: int = 1) -> set[str]:
    """``words`` with every identity term replaced by the one ``turn`` further in its row."""
    place = {w: row[(k + turn) % len(row)] for row in identity for k, w in enumerate(row)}
    return {place.get(w, w) for w in words}


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def logit(self, words: set[str]) -> float:
        cache, weights = self.cache, self.weights
        if len(cache) > CACHE:
            cache.clear()
        found: set[str] = set()
        for w in words:
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = tuple(f for f in features_of(w) if f in weights)
            if hit:
                found.update(hit)
        return self.bias + sum(weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -30, 30))))


def _rows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return doc, np.array([f for d in docs for f in d], np.int64)


def fit_logistic(docs: list[list[int]], labels: np.ndarray, n_features: int, pairs: list[tuple[int, list[int]]],
                 fairness: float = 5.0, ridge: float = 0.5, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise summed cross entropy (the rarer class weighted by the square root of
    the classes' ratio) + ``ridge`` * |w|^2, and ``fairness`` * the mean squared change of the logit
    over ``pairs`` (document, features after the swap), by Adam."""
    y = np.asarray(labels, float)
    doc, feat = _rows(docs)
    other, swap = np.array([i for i, _ in pairs], np.int64), _rows([f for _, f in pairs])
    w, share = np.zeros(n_features + 1), min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    if not len(docs):
        return w[:-1], float(w[-1])
    cost = np.where(y == 1, max(1, (1 - share) / share) ** 0.5, max(1, share / (1 - share)) ** 0.5) / len(docs)
    m, q = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[feat], len(docs)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        g = np.append(np.bincount(feat, d[doc], n_features), d.sum())
        if pairs:
            change = (z[other] - w[-1]) - np.bincount(swap[0], w[swap[1]], len(pairs))
            push = 2 * fairness * change / len(pairs)
            along = np.bincount(other, push, len(docs))
            g[:-1] += np.bincount(feat, along[doc], n_features) - np.bincount(swap[1], push[swap[0]], n_features)
        g[:-1] += 2 * ridge * w[:-1] / len(docs)
        m += 0.1 * (g - m)
        q += 0.001 * (g * g - q)
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE,
                 features: int = FEATURES, fairness: float = 5.0, identity=IDENTITY) -> ToxicModel:
    """Model of ``labels`` (doc_id, ``label``) on at most ``sample`` of the labelled ``docs``: those with
    the smallest hashes of their ids.  Rows with a null id or label are not used; of rows
    that repeat an id the smallest text is.  Without labels the score is 0.5."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
             .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample))

    def bags(batches):
        for batch in batches:
            found = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.string()))],
                                             names=["doc_id", "y", "words"])

    train = cut_lineage(labelled_texts(docs, known)
                        .mapInArrow(bags, "doc_id long, y int, words array<string>"), "toxic-words")
    total = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    n1, n0 = int(total.ones), int(total.n - total.ones)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return ToxicModel({}, float(np.log(share / (1 - share))))

    def count(batches):
        for batch in batches:
            ones, zeros = Counter(), Counter()
            for y, words in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist()):
                (ones if y else zeros).update({f for w in words for f in features_of(w)})
            names = list(ones.keys() | zeros.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ones[f] for f in names], pa.int64()),
                                              pa.array([zeros[f] for f in names], pa.int64())], names=["f", "a", "b"])

    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    counts = train.select("y", "words").mapInArrow(count, "f string, a long, b long").groupBy("f").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    chosen = (counts.withColumn("z", F.abs(odds / F.sqrt(1 / a + 1 / b))).where(F.col("z") >= LEAST_Z)
              .orderBy(F.desc("z"), "f").limit(features).select("f").collect())
    index = {r.f: k for k, r in enumerate(sorted(chosen, key=lambda r: r.f))}
    terms = {w for row in identity for w in row}

    def inside(batches):
        for batch in batches:
            have, swap = [], []
            for words in batch.column("words").to_pylist():
                words = set(words)
                pick = lambda ws: sorted({index[f] for w in ws for f in features_of(w) if f in index})
                have.append(pick(words))
                swap.append([pick(swapped(words, identity, k)) for k in (1, 2)] if words & terms else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(have, pa.list_(pa.int32())),
                 pa.array(swap, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "y", "have", "swap"])

    rows = train.mapInArrow(inside, "doc_id long, y int, have array<int>, swap array<array<int>>").toPandas()
    rows["key"] = rows["have"].map(lambda x: tuple(x))
    rows = rows.sort_values(["doc_id", "y", "key"], ignore_index=True)
    have = [list(x) for x in rows["have"]]
    pairs = [(i, list(s)) for i, sw in enumerate(rows["swap"]) if sw is not None for s in sw if list(s) != have[i]]
    w, bias = fit_logistic(have, rows["y"].to_numpy(), len(index), pairs, fairness)
    return ToxicModel({f: float(w[k]) for f, k in index.items() if w[k]}, bias)


def with_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus ``out`` (double, 0 to 1, higher: label 1 likelier).  A null text counts as empty and
    gets the score of a text without features.  All rows and columns stay (a column named
    ``out`` is replaced); an empty table stays empty."""
    model = ToxicModel(model.weights, model.bias)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(model.score)

    return without(docs, out).withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` less the rows that score ``threshold`` or more; columns as given."""
    out, = fresh(docs, "score")
    return with_toxicity(docs, model, text, out).where(F.col(out) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
