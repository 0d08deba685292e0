import pytest
from pyspark.sql import functions as F

from recsim.operators import interactions as D
from recsim.operators import profile as B
from recsim.operators import splits as C
from recsim.operators.indexing import dense_index
from tests.helpers import random_ratings


def test_dedupe_keeps_highest_rating(mk):
    r = mk([(1, 1, 2.0), (1, 1, 4.0), (1, 2, 3.0)])
    got = {(x.userId, x.movieId): x.rating for x in D.dedupe_ratings(r).collect()}
    assert got == {(1, 1): 4.0, (1, 2): 3.0}


def test_hash_split_is_a_partition_and_stable(mk):
    rows = random_ratings(50, 40, 0.3, seed=1)
    r = mk(rows)
    tr, te = C.hash_split(r, 0.1)
    a = {(x.userId, x.movieId) for x in tr.collect()}
    b = {(x.userId, x.movieId) for x in te.collect()}
    assert not a & b and len(a) + len(b) == len(rows)
    assert 0.05 < len(b) / len(rows) < 0.15
    b2 = {(x.userId, x.movieId) for x in C.hash_split(r.repartition(5), 0.1)[1].collect()}
    assert b == b2


def test_dense_index_matches_global_row_number(mk):
    rows = random_ratings(60, 30, 0.3, seed=2)
    r = mk(rows)
    got = {(x.userId, x.movieId): x.pos for x in dense_index(r, ["userId", "movieId"], "pos", 5).collect()}
    want = {k: n for n, k in enumerate(sorted((u, i) for u, i, _ in rows))}
    assert got == want


def test_dense_index_has_no_single_partition_exchange(mk):
    r = mk(random_ratings(10, 10, 0.5))
    df = dense_index(r, ["userId", "movieId"], "pos", 4)
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_user_index_dense_zero_based(mk):
    r = mk([(30, 1, 1.0), (10, 1, 2.0), (20, 2, 3.0), (10, 3, 1.0)])
    got = {x.userId: x.user_idx for x in D.user_index(r).collect()}
    assert got == {10: 0, 20: 1, 30: 2}


def test_kfold_disjoint_complete_and_positional(mk):
    rows = random_ratings(40, 30, 0.3, seed=3)
    got = C.kfold_assign(mk(rows), 5).collect()
    assert len(got) == len(rows)
    order = sorted((u, i) for u, i, _ in rows)
    n = len(order)
    want = {k: p * 5 // n + 1 for p, k in enumerate(order)}
    assert {(x.userId, x.movieId): x.fold for x in got} == want


def test_leave_n_out_per_user(mk):
    rows = random_ratings(20, 30, 0.5, seed=4)
    got = C.leave_n_out(mk(rows), 2, 4, ["movieId"]).collect()
    by_user = {}
    for u, i, _ in rows:
        by_user.setdefault(u, []).append(i)
    want = {(u, i) for u, its in by_user.items() for k, i in enumerate(sorted(its), 1) if 2 <= k <= 4}
    assert {(x.userId, x.movieId) for x in got if x.split == "test"} == want
    assert len(got) == len(rows)


def test_leave_n_out_uses_group_limit_before_shuffle(mk):
    df = C.leave_n_out(mk(random_ratings(10, 10, 0.5)), 1, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_leave_n_out_capped(mk):
    rows = random_ratings(20, 30, 0.5, seed=5)
    got = C.leave_n_out_capped(mk(rows), 1, 3, 10, ["movieId"]).collect()
    test = sorted((x.userId, x.movieId) for x in got if x.split == "test")
    uncapped = sorted((x.userId, x.movieId) for x in C.leave_n_out(mk(rows), 1, 3).collect() if x.split == "test")
    assert test == uncapped[:10]


def test_fold_roles_one_test_fold_each(mk):
    r = C.kfold_assign(mk(random_ratings(20, 20, 0.3, seed=6)), 4)
    roles = C.fold_roles(r, 4)
    per = roles.groupBy("userId", "movieId").agg(F.count_if(F.col("role") == "test").alias("t"),
                                                 F.count("*").alias("n")).collect()
    assert all(x.t == 1 and x.n == 4 for x in per)


def test_profile_aggregates(mk):
    r = mk([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (3, 3, 1.0)])
    s = B.dataset_stats(r).first()
    assert (s.num_ratings, s.num_users, s.num_items) == (4, 3, 3)
    assert s.avg_rating == pytest.approx(13 / 4)
    assert [tuple(x) for x in B.rating_distribution(r).collect()] == [(1.0, 1), (3.0, 1), (4.0, 1), (5.0, 1)]
    assert B.most_rated_item(r).first().movieId == 1
    assert B.supported_item_count(r, 2).first().num_items == 1
    assert B.sample_rows(r, 2, 1).count() == 2


def test_histogram_last_bin_closed(mk, spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 10]], "v double")
    h = {x.bin: x.num_values for x in B.value_histogram(df, "v", 5).collect()}
    assert sum(h.values()) == 7
    assert h[4] == 1 and h[0] == 2
    const = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(x.bin, x.num_values) for x in B.value_histogram(const, "v", 20).collect()] == [(0, 2)] + [(b, 0) for b in range(1, 20)]
    gap = B.value_histogram(df, "v", 20).collect()
    assert [x.bin for x in gap] == list(range(20)) and sum(x.num_values == 0 for x in gap) == 13
    assert B.value_histogram(df.where("v > 99"), "v", 20).count() == 0
