import numpy as np
import pytest
from pyspark.sql import functions as F

from recsim.llm import negatives

SCHEMA = "vec_id long, label string, embedding array<double>"


def brute(rows, every=10, scale=256, positives=5, negatives=5, low=80, high=100):
    good = []
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, y, [int(np.floor(scale * x)) for x in v]))
    out = []
    for a, (i, y, v) in enumerate(good):
        if i % every:
            continue
        told = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, z, w) in enumerate(good) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(t for t in told if t[2] == y)[:positives]:
            fits = sorted((t, n) for t, n, z in told if z != y and low * -s <= 100 * -t <= high * -s)
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("planes", F.lit("x")).withColumn("row", F.lit(1))
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect())


def cloud(seed, n, dim, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), str(rng.integers(labels)), (centres[rng.integers(6)] + rng.normal(0, 0.4, dim)).tolist()) for i in rng.permutation(n)]


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for bits, dim, kind in ((2, 3, np.int32), (10, 64, np.int32), (25, 17, np.int64)):
        most = 2 ** (bits - 1)
        a, r = rng.integers(-most, most, (7, dim)), rng.integers(-most, most, (50, dim))
        tables = negatives.subset_sums(negatives.from_planes(negatives.bit_planes(a, bits)), kind)
        assert (negatives.scores(tables, negatives.bit_planes(r, bits)) == r @ a.T).all()


@pytest.mark.parametrize("seed,n,dim,labels", [(0, 300, 9, 4), (1, 200, 16, 2), (2, 120, 3, 1)])
def test_equals_brute_force(spark, seed, n, dim, labels):
    rows = cloud(seed, n, dim, labels)
    assert mined(spark, rows) == brute(rows)


def test_many_cells_hot_label_and_copies(spark, monkeypatch):
    for name, size in (("CELL_ANCHORS", 4), ("CELL_ROWS", 30), ("TABLE_ANCHORS", 3), ("STEP", 16)):
        monkeypatch.setattr(negatives, name, size)
    rows = [(i, "hot" if i % 3 else y, v) for i, y, v in cloud(3, 250, 5, 5)]
    rows += [(300 + i, str(i % 2), rows[0][2]) for i in range(80)]             # a group of equal vectors: ties by id
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, "a", [1.0, 0.0]), (10, "a", [1.0, 0.5]), (1, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.0]), (2, "b", [0.9, 0.0]),
            (3, "b", [0.85, 1.0]), (4, None, [1.0, 0.0]), (5, "b", None), (6, "b", [None, 1.0]), (7, "b", [nan, 1.0]), (8, "b", [inf, 1.0]),
            (None, "b", [1.0, 0.0]), (20, "b", [-1.0, 0.0]), (30, "c", []), (31, "c", []), (32, "d", []), (40, "e", [1.0, 0.0, 0.0]), (41, "f", [0.9, 0.0, 0.0])]
    assert mined(spark, rows) == brute(rows)
    some = dict(positives=1, negatives=2, low=50, high=90)
    assert mined(spark, rows, **some) == brute(rows, **some)
    assert mined(spark, [r for r in rows if r[0] != 10 and r[0] not in (20, 30, 40)]) == []
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(10, "a", [1e300]), (1, "a", [1.0])])
    assert mined(spark, [(10, "a", [5e4]), (1, "a", [5e4]), (2, "b", [4.5e4])]) == brute([(10, "a", [5e4]), (1, "a", [5e4]), (2, "b", [4.5e4])])
