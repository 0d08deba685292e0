import pytest
from pyspark.sql import functions as F

from recsim.operators import evaluate as H
from recsim.operators import predict as G
from recsim.operators import similarity as E
from recsim.params import Params
from recsim.plans import train_eval as P
from tests.conftest import ITEM_SCHEMA
from tests.helpers import random_ratings

NB_SCHEMA = "movie_i long, movie_j long, cosine_similarity double"


def test_weighted_mean_and_fallback(mk, spark):
    train = mk([(1, 10, 4.0), (1, 11, 2.0), (2, 10, 5.0)])
    test = mk([(1, 12, 3.0), (1, 13, 5.0), (9, 12, 1.0)])       # user 9 is cold; item 13 has no neighbour
    nb = spark.createDataFrame([(12, 10, 0.5), (12, 11, 0.25), (12, 99, 0.9)], NB_SCHEMA)
    warm = G.warm_test(test, train)
    assert {(r.userId, r.movieId) for r in warm.collect()} == {(1, 12), (1, 13)}
    pr = {(r.userId, r.movieId): r for r in G.final_predictions(warm, nb, train, 3.0).collect()}
    assert pr[(1, 12)].predicted_rating == pytest.approx((0.5 * 4 + 0.25 * 2) / 0.75)
    assert not pr[(1, 12)].is_fallback and pr[(1, 12)].num_neighbors == 2
    assert pr[(1, 13)].predicted_rating == 3.0 and pr[(1, 13)].is_fallback


def test_fused_prediction_equals_stepwise(mk):
    rows = random_ratings(30, 25, 0.35, seed=8)
    r = mk(rows)
    from recsim.operators import splits as C
    train, test = C.hash_split(r, 0.2)
    nb = E.topk_neighbors(E.symmetric_pairs(E.exact_cosine_pairs(train, min_cosine=0.2)), 5)
    warm = G.warm_test(test, train)
    fused = {(x.userId, x.movieId): x.predicted_rating
             for x in G.final_predictions(warm, nb, train, 3.0).where(~F.col("is_fallback")).collect()}
    step = G.neighbor_predictions(G.neighbor_ratings(G.neighbor_expansion(warm, nb), train))
    stepd = {(x.userId, x.target_movie): x.predicted_rating for x in step.collect()}
    assert fused == pytest.approx(stepd, abs=1e-12)


def test_prediction_within_neighbour_rating_range(mk):
    rows = random_ratings(30, 25, 0.35, seed=9)
    run = P.train_and_evaluate(mk(rows), Params(threshold=1.3, top_k=5, min_ratings=2), checkpoint=False)
    for x in run.predictions.collect():
        assert 1.0 - 1e-9 <= x.predicted_rating <= 5.0 + 1e-9


def test_exact3_coverage_compat_vs_flag(mk, spark):
    # one neighbour-based prediction equal to exactly 3.0 and one fallback
    train = mk([(1, 10, 3.0), (1, 11, 3.0)])
    test = mk([(1, 12, 4.0), (1, 13, 2.0)])
    nb = spark.createDataFrame([(12, 10, 0.5), (12, 11, 0.5)], NB_SCHEMA)
    pr = G.final_predictions(G.warm_test(test, train), nb, train, 3.0)
    c = H.prediction_coverage(pr, 3.0).first()
    assert c.coverage == 50.0
    assert c.coverage_compat == 0.0


def test_metrics_by_hand(spark):
    preds = spark.createDataFrame([(1, 1, 4.0, 3.0, False), (1, 2, 2.0, 4.0, False)],
                                  "userId long, movieId long, true_rating double, predicted_rating double, "
                                  "is_fallback boolean")
    m = H.prediction_metrics(preds).first()
    assert m.rmse == pytest.approx(((1 + 4) / 2) ** 0.5)
    assert m.mae == pytest.approx(1.5)
    s = H.error_stats(preds).first()
    assert s.mean_error == pytest.approx(0.5)
    assert s.std_error == pytest.approx(((1.5 ** 2 + 1.5 ** 2) / 1) ** 0.5)


def test_user_recommendations_unseen_and_min_neighbors(mk, spark):
    train = mk([(1, 10, 5.0), (1, 11, 1.0), (2, 12, 4.0)])
    nb = spark.createDataFrame([(12, 10, 0.8), (12, 11, 0.2), (13, 10, 0.5), (10, 12, 0.9)], NB_SCHEMA)
    items = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c"), (13, "d")], ITEM_SCHEMA)
    recs = G.user_recommendations(train, nb, items, top_n=5, min_neighbors=1).collect()
    u1 = {r.movieId: r.score for r in recs if r.userId == 1}
    assert set(u1) == {12, 13}                                # 10, 11 are seen
    assert u1[12] == pytest.approx((0.8 * 5 + 0.2 * 1) / 1.0)
    recs2 = G.user_recommendations(train, nb, items, top_n=5, min_neighbors=2).collect()
    assert {r.movieId for r in recs2 if r.userId == 1} == {12}


def test_sweep_row_equals_single_run(mk):
    rows = random_ratings(40, 30, 0.3, seed=12)
    r = mk(rows)
    base = Params(min_ratings=2, bits_per_band=1)
    sweep = P.parameter_sweep(r, tables=(1, 3), thresholds=(1.0, 1.3), top_ks=(3, 10), base=base).collect()
    assert len(sweep) == 5 * 2 * 2 * 2 and {x.bucketLength for x in sweep} == {1.0, 2.0, 3.0, 4.0, 5.0}
    for t, thr, k in [(1, 1.3, 3), (3, 1.0, 10), (3, 1.3, 10)]:
        row = [x for x in sweep if x.numHashTables == t and x.threshold == thr and x.top_k == k][0]
        single = P.train_and_evaluate(r, base.with_(num_hash_tables=t, threshold=thr, top_k=k),
                                      method="lsh", checkpoint=False).metrics.first()
        assert row.rmse == pytest.approx(single.rmse, abs=1e-9)
        assert row.mae == pytest.approx(single.mae, abs=1e-9)
        assert row.coverage == pytest.approx(single.coverage, abs=1e-9)


def test_cross_validate_folds(mk):
    rows = random_ratings(30, 20, 0.4, seed=13)
    per_fold, mean = P.cross_validate(mk(rows), 3, Params(min_ratings=2, threshold=1.3, top_k=5))
    folds = per_fold.collect()
    assert sorted(f.cv for f in folds) == [1, 2, 3]
    assert mean.first().folds == 3


def test_methods_agree_on_exact_neighbours(mk):
    rows = random_ratings(40, 25, 0.35, seed=14)
    r = mk(rows)
    p = Params(min_ratings=2, threshold=1.0, top_k=5, num_hash_tables=24)
    exact = P.train_and_evaluate(r, p, "exact", checkpoint=False).metrics.first()
    lsh = P.train_and_evaluate(r, p, "lsh", checkpoint=False).metrics.first()
    assert lsh.rmse == pytest.approx(exact.rmse, abs=1e-9)
