import pytest

from recsim.operators import interactions as D
from recsim.operators import lsh as L
from recsim.operators import similarity as E
from tests.helpers import brute_cosines, random_ratings


def _pairs(df):
    return {(r.movie_i, r.movie_j): r.cosine_similarity for r in df.collect()}


def test_mllib_lsh_many_tables_equals_exact(mk):
    rows = random_ratings(40, 30, 0.3, seed=1)
    r = mk(rows)
    index = D.user_index(r)
    normalized = D.normalize_vectors(D.item_vectors(D.item_profiles(D.indexed_ratings(r, index)), index))
    model = L.fit_mllib_lsh(normalized, 2.0, 20, 126784)
    got = _pairs(L.mllib_similar_pairs(model, normalized, 1.0))
    want = {k: v for k, v in brute_cosines(rows).items() if v > 0.5}
    assert set(got) == set(want)
    assert got == pytest.approx(want, abs=1e-9)


def test_mllib_buckets_are_a_sign_hash_on_unit_vectors(mk):
    rows = random_ratings(30, 20, 0.4, seed=2)
    r = mk(rows)
    index = D.user_index(r)
    normalized = D.normalize_vectors(D.item_vectors(D.item_profiles(D.indexed_ratings(r, index)), index))
    model = L.fit_mllib_lsh(normalized, 2.0, 5, 7)
    buckets = {row.bucket for row in L.mllib_buckets(model, normalized).collect()}
    assert buckets <= {-1, 0}


def test_projection_lsh_all_bands_equals_exact(mk):
    rows = random_ratings(40, 30, 0.3, seed=3)
    r = mk(rows)
    sig = L.projection_signatures(r, 24, 1, 99)
    got = _pairs(L.projection_pairs(r, sig, min_cosine=0.5))
    want = {k: v for k, v in brute_cosines(rows).items() if v > 0.5}
    assert got == pytest.approx(want, abs=1e-12)


def test_projection_pairs_are_a_subset_with_exact_cosine(mk):
    rows = random_ratings(40, 30, 0.3, seed=4)
    r = mk(rows)
    sig = L.projection_signatures(r, 2, 3, 5)
    got = _pairs(L.projection_pairs(r, sig, item_block=3, side_rows=5))
    want = brute_cosines(rows)
    assert set(got) <= set(want)
    assert got == pytest.approx({k: want[k] for k in got}, abs=1e-12)


def test_signature_buckets_in_range(mk):
    rows = random_ratings(20, 15, 0.4, seed=5)
    sig = L.projection_signatures(mk(rows), 3, 2, 1).collect()
    assert all(0 <= s.bucket < 4 for s in sig)
    assert {s.band for s in sig} == {0, 1, 2}


def test_recall_monotone_in_tables(mk):
    rows = random_ratings(40, 30, 0.3, seed=6)
    r = mk(rows)
    exact = E.exact_cosine_pairs(r, min_cosine=0.3)
    sig = L.projection_signatures(r, 6, 1, 3)
    lsh = L.projection_pairs(r, sig, min_cosine=0.3)
    rec = sorted(L.lsh_recall(exact, lsh, 6).collect(), key=lambda x: x.num_tables)
    vals = [x.recall for x in rec]
    assert vals == sorted(vals)
    assert all(0.0 <= v <= 1.0 for v in vals)


@pytest.mark.parametrize("item_block,side_rows", [(2048, 10 ** 6), (3, 10 ** 6), (3, 7)])
def test_projection_topk_equals_window_over_lsh_pairs(mk, item_block, side_rows):
    rows = random_ratings(35, 30, 0.3, seed=19)
    r = mk(rows)
    sig = L.projection_signatures(r, 3, 2, 11)
    pairs = L.projection_pairs(r, sig, min_cosine=0.2).drop("first_table")
    want = E.topk_neighbors(E.symmetric_pairs(pairs), 4, keep_rank=True).collect()
    got = E.topk_neighbors(L.projection_topk_neighbors(r, sig, 4, min_cosine=0.2, item_block=item_block,
                                                       side_rows=side_rows), 4, keep_rank=True).collect()
    key = lambda x: (x.movie_i, x.rank)
    assert [(x.movie_i, x.movie_j) for x in sorted(got, key=key)] == \
        [(x.movie_i, x.movie_j) for x in sorted(want, key=key)]
