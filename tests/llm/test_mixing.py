import re

import pytest
from pyspark.sql import functions as F

from recsim.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """By filling in small steps of the excess: capped sources leave, the others share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: w[s] * unit for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def corpus(n=400):
    return [(i, "s%d" % (i % 7 if i % 3 else 0), " ".join(f"w{i}" for _ in range((i * 37) % 90))) for i in range(n)] + \
        [(1000, "tiny", "one two three"), (1001, "empty", ""), (1002, "empty", None), (1003, None, "a\x0bb c d " * 40), (1004, "s1", "x " * 30000)]


def mix(spark, rows, parts=4, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("size", F.lit("x")).withColumn("no", F.lit(0)).withColumn("slot", F.lit(0))
    return mixing.mix_documents(df, **kw)


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 40, None: 7, "d": 0, "B": 300}, {"x": 5}, {"a": 1, "b": 1, "c": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_golden_points(spark):
    rows = mixing.golden_points(spark, 5000).collect()
    assert all(r.point == (r.slot + 1) * mixing.GOLDEN % 2 ** 40 for r in rows)


def test_the_mix_meets_its_targets_all_along(spark):
    rows = corpus()
    spans = mix(spark, rows, block_words=32).collect()
    size = {i: len(re.findall(mixing.WORD, t or "")) for i, _, t in rows}
    sizes = {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = targets(sizes)
    taken, by_source, cover = {}, {}, {}
    for r in spans:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        if r.slot is not None:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
            by_source[r.source] = by_source.get(r.source, 0) + r.words
            cover.setdefault((r.doc_id, r["pass"]), []).append((r.start, r.words))
    assert {r.doc_id for r in spans} == set(size)
    assert all(n <= 2 * size[i] for i, n in taken.items())
    for s in sizes:
        assert abs(by_source.get(s, 0) - want[s]) <= max(4 * 32, 0.1 * want[s])
    for (_, _), parts in cover.items():                # within a pass no word comes twice
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:]))
    # every stretch holds the sources in their shares
    slots = sorted({(r.slot, r.source) for r in spans if r.slot is not None}, key=lambda x: x[0])
    half = len(slots) // 2
    for s in sizes:
        first, whole = sum(x[1] == s for x in slots[:half]), sum(x[1] == s for x in slots)
        assert abs(first - whole / 2) <= 4
    assert len(slots) == len({x[0] for x in slots})


def test_reruns_agree_in_any_layout(spark):
    rows = corpus(150) + [(5, "s5", "again and again")] * 40
    a, b = (sorted(map(str, mixing.taken_words(mix(spark, rows, n)).collect())) for n in (1, 9))
    assert a == b and len(a) == len(rows)


def test_small_ranges_give_the_same(spark, monkeypatch):
    want = sorted(map(str, mix(spark, corpus(120), block_words=8).collect()))
    monkeypatch.setattr(mixing, "RANGE", 4)
    assert sorted(map(str, mix(spark, corpus(120), block_words=8).collect())) == want


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(empty).collect() == []
    rows = [(None, None, None), (None, "a", "x y"), (None, "a", "x y"), (2, "a", ""), (2, "b", "z " * 500), (2, "b", "y " * 500)]
    got = sorted((str(r.doc_id), r.size, r.source_size, r.taken) for r in mixing.taken_words(mix(spark, rows)).collect())
    assert [g[:3] for g in got] == [("2", 0, 4), ("2", 500, 1000), ("2", 500, 1000), ("None", 0, 0), ("None", 2, 4), ("None", 2, 4)]
    assert all(g[3] <= 2 * g[1] for g in got) and sum(g[3] for g in got if g[2] == 1000) > 1300
    with pytest.raises(ValueError):
        mix(spark, rows, most=1.5)
