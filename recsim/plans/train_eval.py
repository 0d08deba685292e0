"""End-to-end runs: train-and-evaluate, one-job parameter sweep, one-job
cross-validation.

A run is split -> supported items -> similarity -> symmetric top-K ->
prediction -> metrics.  The neighbour table is the one result reused by
several downstream jobs, so it is cut out of the lineage into the shared
checkpoint folder (it survives executor loss; no local checkpoint).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.operators import evaluate as H
from recsim.operators import interactions as D
from recsim.operators import lsh as L
from recsim.operators import predict as G
from recsim.operators import similarity as E
from recsim.operators import splits as C
from recsim.operators.blocked_scores import blocked_fold_predictions
from recsim.operators.fold_gram import fold_topk_neighbors
from recsim.params import Params
from recsim.session import cut_lineage

SIGNS = -1.0    # stands for every bucketLength of at least 1 in the sweep
METHODS = ("exact", "lsh", "multiprobe", "mllib")


def similarity_pairs(train_supported: DataFrame, params: Params, method: str = "exact",
                     by: Sequence[str] = ()) -> DataFrame:
    """Half edge list (movie_i < movie_j, cosine_similarity) above ``params.min_cosine``."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "mllib":
        if by:
            raise ValueError("the MLlib path has no grouping support; use 'exact' or 'lsh'")
        index = D.user_index(train_supported)
        profiles = D.item_profiles(D.indexed_ratings(train_supported, index))
        normalized = D.normalize_vectors(D.item_vectors(profiles, index))
        model = L.fit_mllib_lsh(normalized, params.bucket_length, params.num_hash_tables, params.seed)
        return L.mllib_similar_pairs(model, normalized, params.threshold).select(
            "movie_i", "movie_j", "cosine_similarity")
    if method == "multiprobe":
        raise ValueError("the multi-probe path gives top-K neighbours, not pairs; see neighbor_table")
    if method == "exact":
        return E.exact_cosine_pairs(train_supported, min_cosine=params.min_cosine, by=by,
                                    item_block=params.item_block, side_rows=params.side_rows)
    sig = L.projection_signatures(train_supported, params.num_hash_tables, params.bits_per_band, params.seed, by)
    return L.projection_pairs(train_supported, sig, item_block=params.item_block, side_rows=params.side_rows,
                              min_cosine=params.min_cosine, by=by).drop("first_table")


def neighbor_table(train_supported: DataFrame, params: Params, method: str = "exact",
                   by: Sequence[str] = ()) -> DataFrame:
    if method == "exact":
        return E.exact_topk_neighbors(train_supported, params.top_k, min_cosine=params.min_cosine, by=by,
                                      item_block=params.item_block, side_rows=params.side_rows)
    if method == "lsh":
        sig = L.projection_signatures(train_supported, params.num_hash_tables, params.bits_per_band,
                                      params.seed, by)
        return L.projection_topk_neighbors(train_supported, sig, params.top_k, min_cosine=params.min_cosine,
                                           item_block=params.item_block, side_rows=params.side_rows, by=by)
    if method == "multiprobe":
        if by:
            raise ValueError("the multi-probe path has no grouping support; use 'exact' or 'lsh'")
        return L.multiprobe_topk_neighbors(train_supported, params.top_k, bands=params.num_hash_tables, bucket_items=params.bucket_items,
                                           probes=params.probes, seed=params.seed, min_cosine=params.min_cosine,
                                           item_block=params.item_block, side_rows=params.side_rows)
    pairs = similarity_pairs(train_supported, params, method, by)
    return E.topk_neighbors(E.symmetric_pairs(pairs, by), params.top_k, by)


def staged_split(ratings: DataFrame, params: Params, checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Deduplicated ratings tagged train/test, written once to the shared
    checkpoint folder: every later stage reads the files instead of
    re-running the scan, the dedupe shuffle and the split."""
    tagged = C.tag_hash_split(D.dedupe_ratings(ratings), params.test_fraction)
    if checkpoint:
        tagged = cut_lineage(tagged, "ratings")
    train = tagged.where(F.col("split") == "train").drop("split")
    test = tagged.where(F.col("split") == "test").drop("split")
    return train, test


def supported_train(train: DataFrame, params: Params, by: Sequence[str] = (), checkpoint: bool = True) -> DataFrame:
    """Training ratings of the supported items.  The item list (one row per item)
    is written once, so the two passes of the Gram product do not each redo the
    support aggregation over the training ratings."""
    keep = D.supported_items(train, params.min_ratings, by).select(*by, "movieId")
    if checkpoint:
        keep = cut_lineage(keep, "supported-items")
    return train.join(keep, [*by, "movieId"], "left_semi")


@dataclass
class Run:
    train: DataFrame
    test: DataFrame
    neighbors: DataFrame
    predictions: DataFrame
    metrics: DataFrame      # one row: rmse, mae, num_predictions, coverage, coverage_compat, ...


def train_and_evaluate(ratings: DataFrame, params: Params = Params(), method: str = "exact",
                       checkpoint: bool = True) -> Run:
    train, test = staged_split(ratings, params, checkpoint)
    sup = supported_train(train, params, checkpoint=checkpoint)
    neighbors = neighbor_table(sup, params, method)
    if checkpoint:
        neighbors = cut_lineage(neighbors, "neighbors")
    warm = G.warm_test(test, train)
    preds = G.final_predictions(warm, neighbors, train, params.default_rating)
    metrics = H.summary(preds, params.default_rating)
    return Run(train, test, neighbors, preds, metrics)


# -- one-job parameter sweep ---------------------------------------------------------

def parameter_sweep(ratings: DataFrame, tables: Sequence[int] = (1, 3, 5, 7),
                    thresholds: Sequence[float] = (0.8, 1.0, 1.2), top_ks: Sequence[int] = (10, 20, 30),
                    base: Params = Params(), bucket_lengths: Sequence[float] = (1.0, 2.0, 3.0, 4.0, 5.0)) -> DataFrame:
    """Metrics of every (bucketLength, tables, threshold, top_k) setting of the relational LSH.

    * the LSH is hashed once with max(tables) bands; with T tables a pair is a
      candidate iff its ``first_table < T`` (the first T bands of a larger model
      are the T-band model);
    * the ranking by cosine is the same for every threshold (a threshold only
      cuts the tail), so it is computed once per table count;
    * predictions for all (threshold, top_k) pairs are conditional sums of one
      aggregate per (table count, test row) - no replication per setting.
    * on unit vectors every bucketLength of at least 1 gives the same sign buckets, so these
      metrics are computed once and emitted per value; smaller lengths have the buckets of
      ``gaussian_buckets``, whose projections are computed once for all of them.
    """
    tables = sorted(set(int(t) for t in tables))
    settings = [(float(t), int(k)) for t in thresholds for k in top_ks]
    cuts = {t: 1.0 - t * t / 2.0 for t, _ in settings}
    fine, coarse = [[float(b) for b in bucket_lengths if (b < 1) == small] for small in (True, False)]
    keys = ["_length", "num_tables"]                   # _length: a fine bucketLength, or SIGNS for all coarse ones
    train, test = staged_split(ratings, base)
    sup = supported_train(train, base)
    lowest = dict(item_block=base.item_block, side_rows=base.side_rows, min_cosine=min(cuts.values()))
    columns = ["_length", "movie_i", "movie_j", "first_table", "cosine_similarity"]
    found = []
    if coarse:
        sig = L.projection_signatures(sup, max(tables), base.bits_per_band, base.seed)
        found.append(L.projection_pairs(sup, sig, **lowest).withColumn("_length", F.lit(SIGNS)).select(*columns))
    if fine:
        buckets = L.gaussian_buckets(sup, max(tables), fine, base.seed)
        found.append(L.gaussian_pairs(sup, buckets, **lowest).withColumnRenamed("bucketLength", "_length").select(*columns))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    sym = E.symmetric_pairs(pairs, ["_length"], extra=["first_table"])
    tarr = F.array(*[F.lit(t) for t in tables])
    larr = F.array(*[F.lit(x) for x in fine + ([SIGNS] if coarse else [])])
    per_t = sym.withColumn("num_tables", F.explode(F.filter(tarr, lambda t: t > F.col("first_table"))))
    ranked = E.topk_neighbors(per_t, max(top_ks), by=keys, keep_rank=True)
    warm = G.warm_test(test, train).withColumn("num_tables", F.explode(tarr)).withColumn("_length", F.explode(larr))
    nb = ranked.select(*keys, F.col("movie_i").alias("movieId"), "movie_j", "cosine_similarity", "rank")
    tr = train.select("userId", F.col("movieId").alias("movie_j"), F.col("rating").alias("_r"))
    rated = warm.join(nb, [*keys, "movieId"], "left").join(tr, ["userId", "movie_j"], "left")
    aggs = []
    for i, (t, k) in enumerate(settings):
        cond = F.col("_r").isNotNull() & (F.col("rank") <= k) & (F.col("cosine_similarity") > F.lit(cuts[t]))
        aggs += [F.sum(F.when(cond, F.col("cosine_similarity") * F.col("_r"))).alias(f"_n{i}"),
                 F.sum(F.when(cond, F.col("cosine_similarity"))).alias(f"_d{i}")]
    per_row = rated.groupBy(*keys, "userId", "movieId", "rating").agg(*aggs)
    metric_aggs = []
    for i, _ in enumerate(settings):
        p = F.try_divide(F.col(f"_n{i}"), F.col(f"_d{i}"))
        e = F.coalesce(p, F.lit(float(base.default_rating))) - F.col("rating")
        metric_aggs += [F.sqrt(F.avg(e * e)).alias(f"_rmse{i}"), F.avg(F.abs(e)).alias(f"_mae{i}"),
                        F.count_if(p.isNotNull()).alias(f"_cov{i}")]
    m = per_row.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_predictions"), *metric_aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("top_k"),
                              F.col(f"_rmse{i}").alias("rmse"), F.col(f"_mae{i}").alias("mae"),
                              F.col(f"_cov{i}").alias("num_from_neighbors"))
                     for i, (t, k) in enumerate(settings)])
    lengths = F.when(F.col("_length") == SIGNS, F.array(*[F.lit(b) for b in coarse]).cast("array<double>")).otherwise(F.array("_length"))
    return (m.select(*keys, "num_predictions", F.explode(rows).alias("_s"))
            .withColumn("bucketLength", F.explode(lengths))
            .select("bucketLength", F.col("num_tables").cast("int").alias("numHashTables"), "_s.threshold", "_s.top_k",
                    "_s.rmse", "_s.mae",
                    (F.lit(100.0) * F.col("_s.num_from_neighbors") / F.col("num_predictions")).alias("coverage"),
                    "num_predictions"))


# -- one-job k-fold cross-validation ---------------------------------------------------

def cross_validate(ratings: DataFrame, k: int = 5, params: Params = Params(), method: str = "exact",
                   order_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """k-fold cross-validation as one job: every operator is keyed by the run ``cv``.

    The exact method takes every rating once: one Gram product serves all runs (``fold_gram``), and predictions join
    the training table once, leaving out the run's own fold.  The LSH method replicates the ratings to the runs.

    Folds are positional (fold i = i-th block of N/k rows) over a seeded hash
    order of the keys (a reproducible shuffle, like a randomly ordered rating
    file), unless ``order_cols`` gives another unique order.
    Returns (per-fold metrics, mean over folds).
    """
    r = D.dedupe_ratings(ratings)
    if order_cols is None:
        from recsim.functions.exprs import hash_order_key
        r = r.withColumn("_h", hash_order_key("userId", "movieId", seed=params.seed))
        order_cols = ["_h", "userId", "movieId"]
    folded = C.kfold_assign(r, k, order_cols).drop("_h")
    by = ["cv"]
    if method == "exact":       # every rating enters once, with its fold
        folded = cut_lineage(folded, "folded")
        neighbors = cut_lineage(fold_topk_neighbors(folded, k, params.top_k, min_ratings=params.min_ratings, min_cosine=params.min_cosine,
                                                    item_block=params.item_block, side_rows=params.side_rows), "fold-neighbors")
        users = folded.groupBy("userId").agg((F.min("fold") != F.max("fold")).alias("_test"))      # warm: rated in another fold too
        rated = folded.join(users, "userId")
        preds, rest = blocked_fold_predictions(rated, neighbors, params.default_rating)
        rest = rest.select("userId", "movieId", "rating", F.col("fold").alias("cv"))
        preds = preds.unionByName(G.final_predictions(rest, neighbors, folded, params.default_rating, by, fold="fold"))
    else:
        roles = C.fold_roles(folded, k)
        train = roles.where(F.col("role") == "train").drop("role")
        test = roles.where(F.col("role") == "test").drop("role")
        sup = supported_train(train, params, by)
        neighbors = neighbor_table(sup, params, method, by)
        warm = G.warm_test(test, train, by)
        preds = G.final_predictions(warm, neighbors, train, params.default_rating, by)
    per_fold = H.summary(preds, params.default_rating, by)
    mean = per_fold.agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"),
                        F.avg("coverage").alias("coverage"), F.count(F.lit(1)).alias("folds"))
    return per_fold, mean
