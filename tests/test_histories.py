"""Products from users' histories: the same results as the cells of two blocks, and what is sent."""

import time

import numpy as np
import pytest

from recsim.operators import gram
from recsim.operators import histories as H
from recsim.operators import similarity as E
from tests.helpers import brute_cosines, random_ratings


@pytest.fixture
def sparse(monkeypatch):
    monkeypatch.setattr(H, "LEAST_ROWS", 0)
    monkeypatch.setattr(H, "SENT", 10 ** 6)


def _rows(df):
    return sorted((*r[:2], *(round(x, 9) if isinstance(x, float) else x for x in r[2:])) for r in df.collect())


def test_pairs_and_neighbours_equal_those_of_the_cells(mk, sparse, monkeypatch):
    rng = np.random.default_rng(5)
    rows = random_ratings(60, 40, 0.15, 5) + [(None, i, float(rng.normal())) for i in range(0, 12)] + [(7000, 5, 0.0)]
    df = mk(rows).repartition(5)
    got = _rows(E.exact_cosine_pairs(df, item_block=4, side_rows=50)), _rows(E.exact_topk_neighbors(df, 3, item_block=4, side_rows=50, keep_rank=True))
    cut = _rows(E.exact_cosine_pairs(df, min_cosine=0.3, item_block=4))
    assert "MapInArrow" in E.exact_cosine_pairs(df, item_block=4, side_rows=50)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(H, "LEAST_ROWS", 1 << 60)
    assert got == (_rows(E.exact_cosine_pairs(df)), _rows(E.exact_topk_neighbors(df, 3, keep_rank=True)))
    assert cut == _rows(E.exact_cosine_pairs(df, min_cosine=0.3))


def test_a_rating_goes_only_to_blocks_of_its_user(mk, sparse):
    """200 blocks, users of four ratings: at most four copies of a rating, however many blocks there are."""
    rows = [(u, u * 4 + k, 1.0) for u in range(200) for k in range(4)]
    sent = H.history_cells(mk(rows), ["rating"], 200, False).collect()
    assert 0 < sum(len(H._unpacked(r.body)[2]) for r in sent) <= 4 * len(rows)


@pytest.mark.parametrize("flush,step", [(1, 7), (40, 1 << 21)])
def test_stripes_and_batches_do_not_show(monkeypatch, flush, step):
    monkeypatch.setattr(H, "STEP", step)
    rows = random_ratings(20, 15, 0.4, 9)
    user, item, value = (np.array(x) for x in zip(*rows))
    cells = {}
    for u0 in range(0, 20, 5):
        some = (user >= u0) & (user < u0 + 5)
        for cell, body in H._bodies(user[some] - user[some][0], item[some], [value[some]], 4, True):
            cells.setdefault(cell, []).append(body)
    dots = {}
    for cell, bodies in cells.items():
        sums = H.Sums()
        for held in H.stripes(bodies, flush):
            for a, b, (items, v) in H.products(held, cell, 4, True):
                sums.add(H.summed(items[a], items[b], [v[a] * v[b]]))
        i, j, (dot,), _ = sums.settle()
        for pair in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), dot.tolist()):
            assert pair[:2] not in dots
            dots[pair[:2]] = pair[2]
    norm = {i: sum(r * r for _, k, r in rows if k == i) for _, i, _ in rows}
    want = {p: c * np.sqrt(norm[p[0]] * norm[p[1]]) for p, c in brute_cosines(rows).items()}
    assert dots.keys() == want.keys() and all(abs(dots[p] - want[p]) < 1e-9 for p in want)


def test_narrow_columns_keep_their_values():
    for x in (np.array([1, 255]), np.array([2 ** 60 + 1, 5]), np.array([-3, 7]), np.array([0.1, 2.0]), np.array([0.5, 3.0]), np.array([np.nan, 1.0])):
        got, = H._unpacked(H._packed([H._narrow(x)]))
        assert np.array_equal(got.astype(x.dtype), x, equal_nan=x.dtype.kind == "f")


def test_a_user_beyond_a_stripe_stays_with_the_cells(mk, sparse):
    df = mk([(u, i, 1.0 + (u + i) % 3) for u in range(3) for i in range(60)])
    plan = gram.gram_products(df, side_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("seed,density,t", [(0, 0.3, 0.3), (1, 0.1, 0.2), (4, 0.3, 1.0), (6, 0.2, 0.6)])
def test_prefix_join_in_cells_equals_the_joins(mk, monkeypatch, seed, density, t):
    from recsim.operators import prefix_join as X
    monkeypatch.setattr(X, "LIKE", 10 ** 6)
    df = mk(random_ratings(40, 25, density, seed)).repartition(4)
    found = {}
    for least in (1 << 60, 0):
        monkeypatch.setattr(H, "LEAST_ROWS", least)
        monkeypatch.setattr(H, "SENT", 10 ** 6)
        monkeypatch.setattr(H, "CELL_PRODUCTS", 300)
        got = X.prefix_cosine_join(df, t)
        assert ("prefix-pairs" in "".join(got.pairs.inputFiles())) == (least == 0)
        found[least] = _rows(got.pairs), got.work.first()
    assert found[0] == found[1 << 60]


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}


def test_the_shuffle_files_of_a_write_go_with_it(spark, mk):
    from recsim.session import cut_lineage
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffle_files(spark), spark.conf.get(flag, None)
    df = mk(random_ratings(30, 20, 0.5, 1)).repartition(7).groupBy("movieId").sum("rating")
    kept = cut_lineage(df, "sums")
    end = time.monotonic() + 20
    while (left := _shuffle_files(spark) - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(flag, None) == was
    assert kept.count() == 20 and df.count() == 20


@pytest.fixture
def many_turns(sparse, monkeypatch):
    monkeypatch.setattr(H, "LEAST_TURN", 1)
    monkeypatch.setattr(H, "TURN", 6)
    monkeypatch.setattr(H, "STORED", 20)


def test_turns_bound_what_is_sent(mk, many_turns):
    """Users of 40 ratings, 300 blocks: the turns send every block's histories once, and none sends more than a share of them."""
    rows = [(u, (u * 13 + k * 7) % 300, 1.0 + (u + k) % 4) for u in range(60) for k in range(40)]
    blocks, half = 300, False
    df = mk(rows)
    layout = H.blocks_for(df, 300, 60, blocks, 1000, 1 << 30)
    turns = layout.turns(1, half)
    assert (layout.blocks, layout.ratings, layout.sent) == (blocks, len(rows), 40 * len(rows)) and turns == 20

    def ratings(sent):
        got = {}
        for r in sent.collect():
            size, items, (value,) = H._flat([H._unpacked(r.body)])
            at = np.r_[0, np.cumsum(size)]
            got.setdefault(r.cell, []).extend(tuple(zip(items[a:b].tolist(), value[a:b].tolist())) for a, b in zip(at[:-1], at[1:]))
        return {cell: sorted(h) for cell, h in got.items()}

    whole, stored, merged = ratings(H.history_cells(df, ["rating"], blocks, half)), H.stored_histories(df, ["rating"]), {}
    assert stored.count() > 20
    for turn in range(turns):
        part = ratings(H.turn_cells(stored, blocks, half, turn, turns))
        assert sum(len(x) for h in part.values() for x in h) <= 2 * layout.sent / turns and not part.keys() & merged.keys()
        merged |= part
    assert merged == whole


def test_turns_do_not_show(spark, mk, many_turns, monkeypatch):
    from recsim.operators import prefix_join as X
    monkeypatch.setattr(X, "LIKE", 10 ** 6)
    rng = np.random.default_rng(5)
    rows = random_ratings(60, 40, 0.15, 5) + [(None, i, float(rng.normal())) for i in range(0, 12)] + [(7000, 5, 0.0)] + [(u, (1 << 60) + u % 5, 2.5) for u in range(60)]
    df = mk(rows).repartition(5)
    at = dict(item_block=4, side_rows=100)
    got = {}
    for least in (1, 1 << 60):
        monkeypatch.setattr(H, "LEAST_TURN", least)
        found = [E.exact_cosine_pairs(df, **at), E.exact_cosine_pairs(df, min_cosine=0.3, **at), E.exact_topk_neighbors(df, 3, keep_rank=True, **at)]
        assert all(("history-pairs" in "".join(x.inputFiles())) == (least == 1) for x in found)
        join = X.prefix_cosine_join(df, 0.3)
        got[least] = [*map(_rows, found), _rows(join.pairs), join.work.first()]
    assert got[1] == got[1 << 60] and all(len(x) for x in got[1])
