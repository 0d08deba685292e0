"""Blocked recommendation scores and the one Gram product of all folds."""

import numpy as np
import pytest

from recsim.operators import blocked_scores as S
from recsim.operators import fold_gram as Q
from recsim.operators import gram as K
from recsim.operators import predict as G
from recsim.operators import similarity as E
from recsim.params import Params
from recsim.plans import train_eval as P
from tests.helpers import brute_cosines, random_ratings

ITEMS = "movieId long, title string"


def brute_recs(rows, edges, titles, n, least):
    rated = {}
    for u, i, r in rows:
        rated.setdefault(u, {})[i] = r
    out = set()
    for u, mine in rated.items():
        scored = []
        for c in {c for c, _, _ in edges} - set(mine):
            hits = [(w, mine[j]) for a, j, w in edges if a == c and j in mine]
            if len(hits) >= least and c in titles:
                scored.append((-round(sum(w * r for w, r in hits) / sum(w for w, _ in hits), 9), c, len(hits)))
        out |= {(u, c, k + 1, h) for k, (_, c, h) in enumerate(sorted(scored)[:n])}
    return out


def recs(train, edges, items, **kw):
    return {(r.userId, r.movieId, r["rank"], r.num_neighbors) for r in G.user_recommendations(train, edges, items, **kw).collect()}


@pytest.mark.parametrize("user_rows,candidates,least", [(500_000, 4096, 1), (40, 7, 2), (8, 5, 1), (1, 3, 1)])
def test_blocks_equal_brute_force(mk, spark, user_rows, candidates, least):
    """Also with users too heavy for a block (all of them at ``user_rows`` = 1) and a hub item that neighbours everything."""
    rows = random_ratings(25, 30, 0.25, 2, hot_user=3, hot_share=0.3)
    near = E.exact_topk_neighbors(mk(rows), 6).select("movie_i", "movie_j", "cosine_similarity").collect()
    edges = {(r.movie_i, r.movie_j): r.cosine_similarity for r in near} | {(c, 0): 0.5 for c in range(1, 30)} | {(0, c): 0.25 for c in range(1, 30)}
    edges = [(a, b, w) for (a, b), w in edges.items()]
    titles = {i: f"t{i % 4}" for i in range(30) if i % 5}
    frame = spark.createDataFrame(edges, "movie_i long, movie_j long, cosine_similarity double")
    items = spark.createDataFrame(list(titles.items()), ITEMS)
    got = recs(mk(rows), frame, items, top_n=4, min_neighbors=least, user_rows=user_rows, candidates=candidates)
    assert got == brute_recs(rows, edges, titles, 4, least)


def test_rows_that_leave_the_cells_are_bounded(mk, spark):
    rows = random_ratings(40, 60, 0.3, 4)
    edges = spark.createDataFrame([(c, j, 1.0 / (1 + abs(c - j))) for c in range(60) for j in range(60) if c != j],
                                  "movie_i long, movie_j long, cosine_similarity double")
    scores, rest = S.blocked_scores(mk(rows), edges, top_n=3, candidates=20)
    assert rest is None and scores.count() <= 40 * 3 * 3


def test_equal_scores_break_by_id():
    score = np.array([[1.0, 2.0, 2.0, 2.0, np.nan], [3.0, 3.0 + 1e-12, 1.0, 3.0, 3.0]])
    count = np.array([[1, 1, 1, 0, 1], [1, 1, 1, 1, 1]])
    rows, cols = S.best_per_user(score, count, np.array([10, 30, 20, 5, 1]), 2, 1)
    assert list(zip(rows.tolist(), cols.tolist())) == [(0, 2), (0, 1), (1, 4), (1, 3)]


def test_empty_inputs(mk, spark):
    edges = spark.createDataFrame([], "movie_i long, movie_j long, cosine_similarity double")
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert recs(mk([(1, 1, 2.0)]), edges, items, top_n=3) == set()
    assert recs(mk([]), edges, items, top_n=3) == set()


def _folded(rows, k, seed=0):
    rng = np.random.default_rng(seed)
    return [(u, i, r, int(rng.integers(k)) + 1) for u, i, r in rows]


@pytest.mark.parametrize("item_block,side_rows,dense", [(8192, 10 ** 6, True), (5, 40, True), (6, 10 ** 6, False), (4, 25, False)])
def test_one_product_equals_a_product_per_fold(mk, spark, monkeypatch, item_block, side_rows, dense):
    if not dense:
        monkeypatch.setattr(K, "_DENSE_MAX", 0)
        monkeypatch.setattr(K, "_CHUNK", 50)
        monkeypatch.setattr(K, "_DENSE_ACC", 60)
    rows = _folded(random_ratings(40, 25, 0.35, 6, hot_user=2, hot_share=0.3), 4)
    df = spark.createDataFrame(rows, "userId long, movieId long, rating double, fold int").repartition(4)
    got = {(r.cv, r.movie_i, r.movie_j): r.cosine_similarity
           for r in Q.fold_topk_neighbors(df, 4, 6, min_ratings=4, min_cosine=0.2, item_block=item_block, side_rows=side_rows).collect()}
    want = {}
    for c in range(1, 5):
        train = [(u, i, r) for u, i, r, f in rows if f != c]
        held = {i for i in {x[1] for x in train} if sum(x[1] == i for x in train) >= 4}
        cos = {k: x for k, x in brute_cosines([x for x in train if x[1] in held]).items() if x > 0.2}
        both = cos | {(j, i): x for (i, j), x in cos.items()}
        for i in held:
            for _, j in sorted((-round(x, 9), j) for (a, j), x in both.items() if a == i)[:6]:
                want[c, i, j] = both[i, j]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cross_validation_equals_runs_of_their_own(mk):
    rows = random_ratings(30, 20, 0.4, 3)
    df, p = mk(rows + [(99, 3, 5.0)]), Params(threshold=1.3, top_k=5, min_ratings=3)      # user 99 is cold in its only fold
    per_fold, mean = P.cross_validate(df, 4, p)
    from recsim.operators import evaluate as H
    from recsim.operators import splits as C
    from recsim.functions.exprs import hash_order_key
    folded = C.kfold_assign(df.withColumn("_h", hash_order_key("userId", "movieId", seed=p.seed)), 4, ["_h", "userId", "movieId"]).drop("_h")
    for r in per_fold.collect():
        train, test = folded.where(f"fold <> {r.cv}").drop("fold"), folded.where(f"fold = {r.cv}").drop("fold")
        near = P.neighbor_table(P.supported_train(train, p), p)
        own = H.summary(G.final_predictions(G.warm_test(test, train), near, train, p.default_rating), p.default_rating).first()
        assert r.rmse == pytest.approx(own.rmse, abs=1e-9) and r.num_predictions == own.num_predictions and r.coverage == own.coverage
    assert mean.first().folds == 4


@pytest.mark.parametrize("user_rows, candidates", [(10_000, 4096), (40, 3), (9, 4096)])
def test_fold_predictions_equal_the_joins(spark, user_rows, candidates):
    from pyspark.sql import functions as F
    rows = [(*r, i % 3 + 1) for i, r in enumerate(random_ratings(25, 15, 0.5, 4))] + [(1, None, 2.0, 1), (2, 90, None, 2), (99, 3, 5.0, 1)]
    folded = spark.createDataFrame(rows, "userId long, movieId long, rating double, fold int")
    rng = np.random.default_rng(5)
    edges = [(c, i, j, float(rng.choice([0.0, 0.3, 0.9]))) for c in (1, 2, 3) for i in range(16) for j in rng.choice(16, 4, replace=False).tolist() if i != j]
    near = spark.createDataFrame(edges, "cv int, movie_i long, movie_j long, cosine_similarity double")
    rated = folded.withColumn("_test", F.col("userId") != 99)
    found, rest = S.blocked_fold_predictions(rated, near, 3.0, user_rows=user_rows, candidates=candidates)
    test = rated.where("_test").select("userId", "movieId", "rating", F.col("fold").alias("cv"))
    left = G.final_predictions(rest.select(*test.columns[:3], F.col("fold").alias("cv")), near, folded, 3.0, ["cv"], fold="fold")
    key = lambda df: sorted(((r.cv, r.userId, r.movieId, r.true_rating, round(r.predicted_rating, 9), r.is_fallback, r.num_neighbors) for r in df.collect()), key=str)
    want = key(G.final_predictions(test, near, folded, 3.0, ["cv"], fold="fold"))
    assert key(found.unionByName(left)) == want and any(not w[5] for w in want)
    none = S.blocked_fold_predictions(rated, near.limit(0), 3.0, user_rows=10_000)[0]
    assert none.where("is_fallback").count() == rated.where("_test and movieId is not null and rating is not null").count()


def test_cross_validation_joins_no_rating_with_its_neighbours(mk):
    per_fold, _ = P.cross_validate(mk(random_ratings(20, 12, 0.5, 6)), 3, Params(threshold=1.3, top_k=5, min_ratings=2))
    plan = per_fold._jdf.queryExecution().optimizedPlan().toString()
    assert "_prediction_cell" in plan or plan.count("FlatMapCoGroupsInPandas") == 1


def test_the_shuffle_of_ratings_does_not_depend_on_k(mk, spark):
    rows = random_ratings(30, 20, 0.4, 3)
    sizes = []
    for k in (2, 8):
        df = spark.createDataFrame(_folded(rows, k), "userId long, movieId long, rating double, fold int")
        plan = Q.fold_topk_neighbors(df, k, 5, min_ratings=1)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Generate explode"))
        assert "cv" not in plan[plan.index("FlatMapCoGroupsInPandas") + 400:].replace("(cv", "")
    assert sizes[0] == sizes[1]
