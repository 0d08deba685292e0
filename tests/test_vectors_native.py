"""Item vectors are built and taken apart without Python code in the plan."""

from recsim.operators import interactions as D


def test_item_vectors_are_mllib_vectors_and_native(mk):
    from pyspark.ml.linalg import SparseVector
    ratings = mk([(10, 1, 5.0), (20, 1, 3.0), (20, 2, 1.0), (30, 3, 0.5)])
    index = D.user_index(ratings)
    vectors = D.item_vectors(D.item_profiles(D.indexed_ratings(ratings, index)), index)
    got = {r.movieId: r.features for r in vectors.collect()}
    assert got[1] == SparseVector(3, {0: 5.0, 1: 3.0}) and got[3] == SparseVector(3, {2: 0.5})
    entries = D.vector_entries(vectors)
    assert sorted(map(tuple, entries.collect())) == [(1, 0, 5.0), (1, 1, 3.0), (2, 1, 1.0), (3, 2, 0.5)]
    for df in (vectors, entries):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_dense_vectors_give_entries_too(mk):
    ratings = mk([(10, 1, 5.0), (20, 1, 3.0)])
    index = D.user_index(ratings)
    vectors = D.item_vectors(D.item_profiles(D.indexed_ratings(ratings, index)), index)
    normed = D.normalize_vectors(vectors)
    total = sum(r.value ** 2 for r in D.vector_entries(normed, "norm_features").collect())
    assert abs(total - 1) < 1e-12
