import re
import zlib

import numpy as np

from recsim.llm import toxicity
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def held_out(doc_id, of, rest):
    return zlib.crc32(str(doc_id).encode()) % of == rest


def test_penalty_lowers_scores_of_neutral_mentions(spark):
    rng = np.random.default_rng(0)
    plain = [" ".join(rng.choice(["house", "river", "walk", "green", "music", "table"], 6)) for _ in range(300)]
    rows = [(i, t + (" muslim idiot" if i % 3 == 0 else " christian" if i % 3 == 1 else ""), int(i % 3 == 0)) for i, t in enumerate(plain)]
    rows += [(300 + i, t + " idiot", 1) for i, t in enumerate(plain[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fair, plain_model = (toxicity.fit_toxicity(df, df, fairness=f) for f in (50.0, 0.0))
    neutral = "a walk by the river with a muslim friend"
    gap = lambda m: abs(m.logit(toxicity.words_of(neutral)) - m.logit(toxicity.words_of(neutral.replace("muslim", "christian"))))
    assert gap(fair) < 0.3 * gap(plain_model)
    assert fair.score(neutral) < 0.5 < fair.score("what an idiot")


def test_swap_stays_in_the_row():
    assert toxicity.swapped({"muslim", "house"}) == {"jewish", "house"}
    assert toxicity.swapped({"women"}) == {"men"}


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "bad idiot" if i % 2 else "good day", i % 2) for i in range(40)]
                                  + [(None, "x", 1), (41, None, None), (42, None, 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(train, train)
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "idiot " * 200_000, "c"), (3, "Good DAY!", "d")],
                                "doc_id long, text string, score string")
    got = toxicity.with_toxicity(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(str(r.score) for r in kept.collect()) == ["a", "a", "b", "d"]


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(none, none)
    assert model.score("anything") == 0.5
    assert toxicity.with_toxicity(none, model).count() == 0


def test_a_repeated_id_is_fitted_once(spark, monkeypatch):
    rows = [(i, "bad idiot" if i % 2 else "good day", i % 2) for i in range(40)]
    labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = spark.createDataFrame(rows + [(3, "bad idiot", 1)] * 500 + [(2, None, 0)], labels.schema).repartition(4)
    seen = []
    monkeypatch.setattr(toxicity, "fit_logistic", lambda docs, y, n, *_: seen.append((len(docs), sum(y))) or (np.zeros(n), 0.0))
    toxicity.fit_toxicity(train, labels)
    assert seen == [(40, 20)]


def test_scores_equal_plain_loops(spark):
    """Every score against a loop over the text's letter runs and the model's weights."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.weights
    for r in toxicity.with_toxicity(docs, model).collect():
        words, word = set(), ""
        for c in (r.text or "").lower() + " ":
            if re.fullmatch(r"[^\W\d_]", c):
                word += c
            elif word:
                words.add(word)
                word = ""
        have = {f"^{w}$" for w in words} | {w[i:i + n] for w in words for n in (4, 5) for i in range(len(w)) if i + n <= len(w)}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in have)
        assert abs(r.score - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9


def test_held_out_accuracy_and_purity(spark):
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held_out(i, 5, 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [i for i in labels if held_out(i, 5, 0)]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.9
