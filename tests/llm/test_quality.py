import math
import re
import zlib

import numpy as np

from recsim.llm import quality
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_measure_is_the_same_through_slices(monkeypatch):
    data = ("Wörter und! | so 12 weiter the The\n" * 500).encode()
    whole = quality.measure(data)
    monkeypatch.setattr(quality, "SLICE", 2000)
    assert np.allclose(whole, quality.measure(data), atol=1e-6)
    assert whole.shape == (-(-len(data.split()) // quality.PASSAGE_WORDS), quality.FEATURES)


def test_measure_of_odd_texts():
    for text in ["", " \n", "a", "x" * 3_000_000, "\x00\x01", "漢" * 10]:
        x = quality.measure(text.encode())
        assert np.isfinite(x).all() and x.shape[1] == quality.FEATURES


def test_score_in_one_pass_equals_softmax(monkeypatch):
    rng = np.random.default_rng(0)
    bags = [rng.random((rng.integers(1, 9), quality.FEATURES)).astype(np.float32) for _ in range(60)]
    y = np.array([b[:, 0].max() > 0.8 for b in bags])
    model = quality.fit(bags, y, epochs=3)
    h, a = model._passages(bags[0])
    w = np.exp(a - a.max())
    want = 1 / (1 + np.exp(-((w / w.sum()) @ h @ model.out + model.bias)))
    monkeypatch.setattr(quality, "STEP", 2)
    assert abs(model.score(bags[0]) - want) < 1e-9


def test_gradients_lower_the_loss_through_attention():
    """One bad passage among good ones marks the document: the mean alone cannot tell it as well."""
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(400):
        b = rng.normal(0, 0.1, (20, quality.FEATURES)).astype(np.float32)
        if i % 2:
            b[rng.integers(20), :5] += 2
        bags.append(b)
        y.append(1 - i % 2)
    model = quality.fit(bags[:300], np.array(y[:300]), epochs=40)
    assert np.mean([(model.score(b) >= 0.5) == t for b, t in zip(bags[300:], y[300:])]) > 0.95
    h, a = model._passages(bags[301])
    assert np.argmax(np.abs(a - np.median(a))) == np.argmax(bags[301][:, 0])


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "good words of text " * 9 if i % 2 else "$$$ &&& !! " * 9, i % 2) for i in range(60)]
                                  + [(None, "x", 1), (70, None, None)], "doc_id long, text string, quality int")
    model = quality.fit_quality(train, train)
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (2, "word " * 100_000, 3)], "doc_id long, text string, score int")
    got = quality.with_quality(odd, model)
    assert got.count() == 4 and all(0 <= r.score <= 1 for r in got.collect())
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    empty = quality.fit_quality(none, none)
    assert 0 <= empty.score(quality.measure(b"text")) <= 1
    assert quality.with_quality(none, empty).count() == 0


def test_fit_takes_every_passage(spark, monkeypatch):
    texts = {i: " ".join(f"w{k % 7}{'!' * (k // 64 % 5)}" for k in range(64 * n)) for i, n in enumerate([1, 48, 49, 100, 313])}
    rows = [(i, t, i % 2) for i, t in texts.items()]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append(([bags[i] for i in range(len(bags))], list(labels))))
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    quality.fit_quality(train, train)
    (bags, labels), = seen
    assert labels == [i % 2 for i in range(5)]
    for i, b in enumerate(bags):
        assert np.array_equal(b, quality.measure(texts[i].encode()).astype(np.float16).astype(np.float32))


def test_a_repeated_id_is_measured_once(spark, monkeypatch):
    rows = [(i, f"word {i} " * 70, i % 2) for i in range(6)]
    labels = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    train = spark.createDataFrame(rows + [(3, "word 3 " * 70, 1)] * 500 + [(2, None, 0)], labels.schema).repartition(4)
    kept, cut = [], quality.cut_lineage
    monkeypatch.setattr(quality, "cut_lineage", lambda df, name: kept.append(cut(df, name)) or kept[-1])
    bags = []
    monkeypatch.setattr(quality, "fit", lambda b, y: bags.extend(len(x) for x in b))
    quality.fit_quality(train, labels)
    assert sorted(r.doc_id for r in kept[0].collect()) == list(range(6))
    assert bags == [3, 3, 1, 3, 3, 3]


def test_the_sample_is_bounded_in_passages(spark, monkeypatch):
    texts = {i: "word " * (64 * n) for i, n in enumerate([3, 11, 2, 9, 4, 5, 1, 10, 6])}
    train = spark.createDataFrame([(i, t, i % 2) for i, t in texts.items()], "doc_id long, text string, quality int").repartition(3)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append(sorted(len(b) for b in bags)))
    quality.fit_quality(train, train, passages=80)
    quality.fit_quality(train, train, passages=20)
    assert seen[0] == [1, 2, 3, 4, 5, 6, 9, 10] and sum(seen[1]) <= 20 and set(seen[1]) <= {1, 2}


def plain_measure(text, words=quality.PASSAGE_WORDS):
    """The measurements of each passage, letter by letter."""
    raw = text.encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if not spans:
        return [[0.0] * quality.FEATURES]
    kind, out = quality._CLASS, []
    for i in range(0, len(spans), words):
        mine = spans[i:i + words]
        end = spans[i + words][0] if i + words < len(spans) else spans[-1][1]
        part = [int(kind[b]) for b in raw[mine[0][0]:end]]
        single, pairs = [0] * quality.CLASSES, [0] * quality.CLASSES ** 2
        for k, c in enumerate(part):
            single[c] += 1
            if k:
                pairs[part[k - 1] * quality.CLASSES + c] += 1
        w = [raw[a:b] for a, b in mine]
        n, lengths = len(w), [len(x) for x in w]
        mean = sum(lengths) / n
        spread = max(0.0, sum(x * x for x in lengths) / n - mean * mean) ** 0.5
        share = lambda hit: sum(map(hit, w)) / n
        out.append([(x / len(part)) ** 0.5 for x in single + pairs] + [
            min(mean, 40) / 10, min(spread, 40) / 10, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, share(lambda x: len(x) == 1),
            share(lambda x: kind[x[0]] == 3), share(lambda x: kind[x[-1]] >= 8), share(lambda x: kind[x[-1]] == 6), share(lambda x: len(x) > 20),
            min(n, words) / words])
    return out


def plain_score(m, text):
    """Gated attention over the passages of a text by plain loops over the model's weights."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda x, col: sum(a * b for a, b in zip(x, col))
    hs, logits = [], []
    for x in plain_measure(text):
        x = [(a - b) / c for a, b, c in zip(x, m.mean, m.scale)]
        h = [math.tanh(dot(x, m.encode[:, k]) + m.shift[k]) for k in range(len(m.out))]
        gate = [math.tanh(dot(h, m.v[:, k])) * sig(dot(h, m.u[:, k])) for k in range(len(m.attend))]
        hs.append(h)
        logits.append(dot(gate, m.attend))
    weights = [math.exp(a - max(logits)) for a in logits]
    rep = [sum(w * h[k] for w, h in zip(weights, hs)) / sum(weights) for k in range(len(m.out))]
    return sig(dot(rep, m.out) + m.bias)


def test_scores_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit_quality(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    some = sorted(texts, key=lambda i: len(texts[i]))[:120]
    odd = {-1: "", -2: " \n", -3: "a a a B! 12 " * 90, -4: "漢字 " * 70}
    frame = spark.createDataFrame([(i, texts[i]) for i in some] + list(odd.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.with_quality(frame, model).collect()}
    for i, t in [(i, texts[i]) for i in some] + list(odd.items()):
        assert abs(got[i] - plain_score(model, t)) < 1e-5, i


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
