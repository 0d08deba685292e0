import pytest

from recsim.operators import serving as I
from tests.conftest import ITEM_SCHEMA

CACHE_SCHEMA = "movie_i long, title_i string, movie_j long, title_j string, cosine_similarity double"
# Two items share the title "Twin" (titles are the key of the seed query).
CACHE = [
    (1, "Twin", 3, "Gamma", 0.9), (1, "Twin", 4, "Delta", 0.2),
    (2, "Twin", 3, "Gamma", 0.1), (2, "Twin", 5, "Epsilon", 0.7), (2, "Twin", 1, "Twin", 0.6),
    (3, "Gamma", 1, "Twin", 0.9), (4, "Delta", 5, "Epsilon", 0.4),
    (6, "50% off_Deal", 4, "Delta", 0.3),
]


@pytest.fixture
def cache(spark):
    return spark.createDataFrame(CACHE, CACHE_SCHEMA)


def test_seed_recommendations_title_semantics(cache):
    got = [(r.movie_j, r.score, r.relative_score, r.rank) for r in I.seed_recommendations(cache, ["Twin"], 5).collect()]
    got.sort(key=lambda x: x[3])
    # Gamma = 0.9 + 0.1, Epsilon = 0.7, Delta = 0.2; the seed title itself is excluded
    assert [g[0] for g in got] == [3, 5, 4]
    assert got[0][1] == pytest.approx(1.0)
    assert [g[2] for g in got] == [100, 70, 20]


def test_seed_recommendations_empty_and_top_n(cache):
    assert I.seed_recommendations(cache, [], 5).count() == 0
    assert I.seed_recommendations(cache, ["Twin", "Delta"], 1).count() == 1


def test_seed_bulk_equals_single(cache, spark):
    baskets = spark.createDataFrame([(1, "Twin"), (2, "Delta"), (2, "Gamma")], "basket_id long, title string")
    bulk = I.seed_recommendations_bulk(cache, baskets, 5).collect()
    for bid, seeds in [(1, ["Twin"]), (2, ["Delta", "Gamma"])]:
        single = {(r.movie_j, round(r.score, 9)) for r in I.seed_recommendations(cache, seeds, 5).collect()}
        assert {(r.movie_j, round(r.score, 9)) for r in bulk if r.basket_id == bid} == single


@pytest.mark.parametrize("small", [200_000, 0])
def test_baskets_are_dealt_before_their_sums(cache, spark, monkeypatch, small):
    monkeypatch.setattr(I, "SMALL_CACHE", small)
    monkeypatch.setattr(I, "BASKET_ROWS", 1)
    baskets = spark.createDataFrame([(1, "Twin"), (1, "Twin"), (2, "Delta"), (2, "Gamma"), (None, "Twin"), (3, None), (4, "unknown")], "basket_id long, title string")
    bulk = I.seed_recommendations_bulk(cache, baskets, 5)
    plan = bulk._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [basket_id" in plan and "LeftAnti" not in plan
    rows = bulk.collect()
    assert {r.basket_id for r in rows} <= {1, 2, None}
    for bid, seeds in [(1, ["Twin"]), (2, ["Delta", "Gamma"]), (None, ["Twin"])]:
        hits, own = {}, set(seeds)
        for r in cache.collect():
            if r.title_i in own and r.title_j not in own:
                hits[r.movie_j] = hits.get(r.movie_j, 0.0) + r.cosine_similarity
        assert {r.movie_j: round(r.score, 9) for r in rows if r.basket_id == bid} == {j: round(x, 9) for j, x in hits.items()}


def test_search_substring_not_pattern(cache):
    cat = I.item_catalog(cache)
    assert [r.title for r in I.search_items(cat, "%", 20).collect()] == ["50% off_Deal"]
    assert [r.title for r in I.search_items(cat, "_d", 20).collect()] == ["50% off_Deal"]
    assert [r.movieId for r in I.search_items(cat, "tWiN", 20).collect()] == [1, 2]
    assert I.search_items(cat, "", 20).count() == 0
    assert I.search_items(cat, "a", 1).count() == 1


def test_user_history_and_stats(mk, spark):
    ratings = mk([(1, 1, 5.0), (1, 2, 3.0), (1, 9, 1.0), (2, 1, 4.0)])
    items = spark.createDataFrame([(1, "a"), (2, "b")], ITEM_SCHEMA)       # item 9 is untitled
    hist = I.user_history(ratings, items, 1).collect()
    assert [(r.title, r.rating) for r in hist] == [("a", 5.0), ("b", 3.0)]
    s = I.user_profile_stats(ratings, items, 1).first()
    assert (s.avg_rating, s.total_ratings) == (4.0, 2)
    s0 = I.user_profile_stats(ratings, items, 77).first()
    assert (s0.avg_rating, s0.total_ratings) == (0.0, 0)
    assert [r.userId for r in I.user_ids(ratings).collect()] == [1, 2]


def test_recommendations_for_user_confidence(spark):
    recs = spark.createDataFrame([(1, f"t{i}", float(10 - i)) for i in range(8)], "userId long, title string, score double")
    got = I.recommendations_for_user(recs, 1, 6).collect()
    assert [r.confidence for r in sorted(got, key=lambda r: r.rank)] == [95, 90, 85, 80, 75, 75]


# -- one item against all, and the title index ---------------------------------------------

def test_seed_neighbors_equal_the_neighbour_table(mk, spark):
    from recsim.operators import similarity as E
    from tests.helpers import random_ratings
    df = mk(random_ratings(40, 30, 0.3, 4, hot_user=1, hot_share=0.3) + [(1, 77, 0.0), (2, 78, 4.0)])
    seeds = spark.createDataFrame([(3,), (8,), (3,), (78,), (500,)], "movieId long")
    rows = lambda d: {(r.movie_i, r.movie_j): round(r.cosine_similarity, 9) for r in d.collect()}
    for cut in (None, 0.3):
        want = {k: c for k, c in rows(E.exact_topk_neighbors(df, 5, min_cosine=cut)).items() if k[0] in (3, 8, 78)}
        assert rows(E.seed_neighbors(df, seeds, 5, min_cosine=cut)) == want and want


def test_similar_items_builds_no_neighbour_table(spark):
    import os
    import pytest
    from recsim.plans.workloads import Workload
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver tables not present")
    plan = Workload(spark, "/root/testdata/sf0.001").similar_items()._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_title_index_equals_contains(spark):
    from recsim.operators import serving as I
    titles = ["The Heat (1995)", "heat", "Sheath", "100% Wolf_", "", None, "Ça va ça", "aaaa", "aa", "Heat Heat", "x"]
    catalog = spark.createDataFrame(list(enumerate(titles)), "movieId long, title string")
    asked = ["heat", "HEAT", "he", "h", "eath", "100%", "f_", "%", "ça", "ÇA", "aaa", "aaaaa", "zzz", "", None, "heat heat", "at h", "he", "t ("]
    queries = spark.createDataFrame([(x,) for x in asked], "query string")
    for rarest in (1, 2, 5):
        got = {(r.query, r.movieId) for r in I.search_titles(I.title_index(catalog), catalog, queries, rarest).collect()}
        assert got == {(x, i) for x in asked if x for i, t in enumerate(titles) if t and x.lower() in t.lower()}
    assert I.search_titles(I.title_index(catalog.limit(0)), catalog.limit(0), queries).collect() == []


def test_the_title_index_gathers_no_entries_of_many_titles(spark):
    """Entries are distinct as they are cut, also where an id has two titles; nothing is aggregated behind the explode."""
    from recsim.operators import serving as I
    cat = spark.createDataFrame([(1, "aba"), (1, "ABA"), (1, "bab"), (2, "b"), (None, "b"), (3, None)], "movieId long, title string")
    index = I.title_index(cat)
    got = [tuple(r) for r in index.collect()]
    assert sorted(got) == [("a", 1), ("ab", 1), ("aba", 1), ("b", 1), ("b", 2), ("ba", 1), ("bab", 1)]
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
