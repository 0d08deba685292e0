"""Products of the item pairs that share a bucket, from the users' histories: many small buckets over sparse ratings.

As groups of the Gram product the ratings of an item are sent to each of its buckets, though two items of a small bucket have hardly
ever a user in common.  Here a rating is sent once, to its user, with the buckets of its item.  Two ratings of a user whose items share a
bucket make one product, however many buckets they share; items that share one do so with every user, so the sum over the
users is the dot product of the pair.

* The products of whole users are formed together, about ``STEP`` at once, and added up per pair before they leave a task.
* What a task holds is bounded by ``CODES``, ``STEP`` and the buckets of the widest user's history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.operators import histories as H
from recsim.operators.histories import _column, _starts, numbered, summed    # by name: tasks run without this package
from recsim.session import cut_lineage, ship_by_value

ship_by_value(__name__)

CODES = 1 << 19      # buckets of the ratings that are looked at together
STEP = 1 << 19       # products formed at once
PRODUCTS = 2         # products that weigh as much as a rating sent to one of its buckets
_ZERO = 1e-12        # as in ``gram``


def shared_pairs(user: np.ndarray, size: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): the places a < b of the ratings of one user whose items share a bucket, each pair once, all pairs of an a together.

    ``codes`` holds the buckets of the ratings, ``size`` of each."""
    if not len(codes):
        return
    n, owner = len(user), np.repeat(np.arange(len(user)), size)
    code, span = codes - codes.min(), int(codes.max()) - int(codes.min()) + 1
    if span * (int(user.max()) + 1) >= 1 << 62:
        kinds, code = np.unique(codes, return_inverse=True)
        span = len(kinds)
    key = user[owner] * span + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
    length = np.diff(np.r_[begin, len(key)])
    later = np.repeat(begin + length, length) - np.arange(1, len(key) + 1)      # ratings behind it in its bucket
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    entry = np.flatnonzero(later[place])
    row, place, later = owner[entry], place[entry], later[place[entry]]
    total = np.cumsum(later)
    i = 0
    while i < len(entry):
        base = total[i - 1] if i else 0
        e = max(int(np.searchsorted(total, base + STEP, "right")), i + 1)
        e = int(np.searchsorted(row, row[e - 1], "right"))
        pair = np.unique(np.repeat(row[i:e], later[i:e]) * n + owner[order[_starts(place[i:e] + 1, later[i:e])]])
        yield pair // n, pair % n
        i = e


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of each pair, added up over the users of a flush; rows come by user."""
    held: list[list[np.ndarray]] = []
    waiting, last, number = 0, None, 0

    def flush(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting
        user, items, rating, norm2, size, codes = [np.concatenate(x) for x in zip(*held)]
        cut = len(user) if whole else int(np.searchsorted(user, user[-1]))
        ends = int(size[:cut].sum())
        held, waiting = [[x[cut:].copy() for x in (user, items, rating, norm2, size)] + [codes[ends:].copy()]], len(codes) - ends
        for a, b in shared_pairs(user[:cut] - user[0], size[:cut], codes[:ends]):
            i, j = np.minimum(items[a], items[b]), np.maximum(items[a], items[b])
            two = i != j
            a, b, i, j = a[two], b[two], i[two], j[two]
            i, j, dots, norms = summed(i, j, [rating[a] * rating[b]], [norm2[a] * norm2[b]])
            for lo in range(0, len(i), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + (1 << 16)]) for x in (i, j, *dots, *norms)],
                                                 names=["movie_i", "movie_j", "_dot", "_norms"])

    for batch in batches:
        if not batch.num_rows:
            continue
        user, last = numbered(batch.column(0), number, last)
        number = int(user[-1])
        buckets = batch.column(4)
        held.append([user, *(_column(batch.column(c)) for c in (1, 2, 3)), np.diff(buckets.offsets.to_numpy()), buckets.flatten().to_numpy()])
        waiting += len(held[-1][-1])
        if waiting >= CODES:
            yield from flush(False)
    if held:
        yield from flush(True)


def bucket_products(ratings: DataFrame, signatures: DataFrame, rows: int, *, side_rows: int, min_cosine: float | None = None) -> DataFrame | None:
    """(movie_i, movie_j, cosine_similarity) for the pairs i < j of items that share a (band, bucket) of ``signatures`` (movieId, band, bucket), or
    None where the Gram product of the buckets is the better way: the ``rows`` ratings with their buckets are few, a user's history
    is too long for a task, or the buckets hold so large a share of what users have rated that products outnumber them.

    ``signatures`` is read several times.  Pairs with a zero dot product are not returned.
    """
    sizes = signatures.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    held, met = sizes.agg(F.sum("_n"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first()
    if not held:
        return None
    items, most = signatures.groupBy("movieId").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)), F.max("_n")).first()
    if rows * held < H.LEAST_ROWS * items:
        return None
    rated = ratings.where(F.col("rating") != 0).select("userId", "movieId", F.col("rating").cast("double").alias("rating"))
    widest, work = rated.groupBy("userId").agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d"), F.sum(F.col("_d").cast("double") * F.col("_d"))).first()
    if not widest or widest * most > side_rows or work * met / items / items > PRODUCTS * rows * held / items:
        return None
    code = F.col("band").cast("bigint") * F.lit(1 << 32) + F.col("bucket")
    norms = rated.groupBy("movieId").agg(F.sum(F.col("rating") * F.col("rating")).alias("_norm2"))
    buckets = cut_lineage(signatures.groupBy("movieId").agg(F.collect_set(code).alias("_codes")).join(norms, "movieId"), "item-buckets")
    sent = rated.join(buckets, "movieId").select("userId", "movieId", "rating", "_norm2", "_codes")
    shares = sent.repartition("userId").sortWithinPartitions("userId").mapInArrow(_shares, "movie_i long, movie_j long, _dot double, _norms double")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot") / F.sqrt("_norms")))
    pairs = (shares.groupBy("movie_i", "movie_j").agg(F.sum("_dot").alias("_dot"), F.max("_norms").alias("_norms"))
             .select("movie_i", "movie_j", cosine.alias("cosine_similarity")).where(F.abs("cosine_similarity") > _ZERO))
    return pairs if min_cosine is None else pairs.where(F.col("cosine_similarity") > F.lit(float(min_cosine)))
