"""Registered workloads over the driver tables (FIXTURES.md §2).

``Workload`` wires the fixture tables (event ratings, hash split, part
titles) into the operators; each public method is one registered query and
returns a DataFrame over the whole tables.  Float outputs are rounded last
(6 digits) so the DuckDB oracle can compare values exactly; every ordering
decision is taken on the unrounded values.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.functions.exprs import distance_to_cosine
from recsim.operators import evaluate as H
from recsim.operators import interactions as D
from recsim.operators import lsh as L
from recsim.operators import predict as G
from recsim.operators import prefix_join as X
from recsim.operators import profile as B
from recsim.operators import serving as I
from recsim.operators import similarity as E
from recsim.operators import splits as C
from recsim.params import Params
from recsim.plans import train_eval as P
from recsim.schemas import GENRE_NAMES
from recsim.sources import files as A
from recsim.session import cut_lineage
from recsim.sources import testdata as src

# Parameters of the registered workloads.  FIXTURES.md: threshold 1.2 keeps
# every scale non-empty; the LSH-vs-exact key uses threshold 1.0 and 20 tables.
DRIVER_PARAMS = Params(threshold=1.2, top_k=20)
SUPPORT_FLOOR = 70          # supported_items key: a floor that bites at sf0.01
LSH_TABLES = 20             # MLlib LSH key compared with the exact oracle
LSH_THRESHOLD = 1.0
PROJ_BANDS, PROJ_BITS = 3, 2   # relational LSH keys: 3 bands of 2 sign bits
RECALL_BANDS = 7
PROBE_BANDS, PROBES = 3, 2     # multi-probe LSH keys: bands, and buckets probed beside an item's own
PREFIX_COSINE = 0.2            # threshold of the prefix-filtering keys over the part ratings
FINE_LENGTHS = (0.1, 0.5)      # bucketLength below 1: more buckets than the sign
FINE_SWEEP = dict(tables=(1, 3), thresholds=(1.0, 1.2), top_ks=(10, 20), bucket_lengths=(0.1, 0.5, 2.0))
RECALL_SAMPLE, PART_SAMPLE = 40, 200    # items of the sampled recall: event ratings, part ratings
CACHE_BUCKETS = 8              # buckets of the co-located caches
PART_BUCKET, EVENT_BUCKET = 64, 16   # items of an average bucket: part ratings, event ratings (100 items)
LEAVE_START, LEAVE_STOP, LEAVE_CAP = 1, 10, 500
KFOLDS = 5
SEARCH_QUERY = "Red"
SEED_PAGE_N = 8             # the seed page asks for 8 items
SEED_BASKET_ITEMS = 3       # basket = titles of the 3 most rated items
STRIPED = {"item_block": 256, "side_rows": 2000}   # many user stripes, so the stripe sum is exercised
HIST_BINS = 20
RUN_STAMP = "20250101_000000"   # stamp written by the metrics round trip


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (applied last, after all ordering decisions)."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _edges(hist: DataFrame) -> DataFrame:
    """Bin edges of 6-digit values over 20 bins have at most 8 decimals: round there,
    so a decimal half (e.g. x.xxxxxx5) never meets a rounding step."""
    return hist.select("bin", F.round("bin_start", 8).alias("bin_start"),
                       F.round("bin_end", 8).alias("bin_end"), "num_values")


class Workload:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DRIVER_PARAMS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.p = params

    # -- fixture tables ---------------------------------------------------------
    @cached_property
    def tagged(self) -> DataFrame:
        """Event ratings tagged train/test, written once to the shared checkpoint
        folder so the many branches of a query read files, not the events scan."""
        return cut_lineage(C.tag_hash_split(src.event_ratings(self.spark, self.sf_dir), self.p.test_fraction),
                           "event-ratings")

    @property
    def ratings(self) -> DataFrame:
        return self.tagged.drop("split")

    @property
    def ratings_once(self) -> DataFrame:
        """The rating table for queries that read it once: straight from the scan."""
        return src.event_ratings(self.spark, self.sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return src.part_items(self.spark, self.sf_dir)

    @property
    def train(self) -> DataFrame:
        return self.tagged.where(F.col("split") == "train").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.tagged.where(F.col("split") == "test").drop("split")

    @cached_property
    def train_supported(self) -> DataFrame:
        return D.supported_ratings(self.train, self.p.min_ratings)

    @cached_property
    def train_supported_once(self) -> DataFrame:
        """``train_supported`` over a written list of the supported items."""
        return P.supported_train(self.train, self.p)

    @cached_property
    def pairs(self) -> DataFrame:
        """Exact half edge list above the workload threshold."""
        return E.exact_cosine_pairs(self.train_supported, min_cosine=self.p.min_cosine,
                                    item_block=self.p.item_block, side_rows=self.p.side_rows)

    @cached_property
    def neighbors_ranked(self) -> DataFrame:
        return E.exact_topk_neighbors(self.train_supported, self.p.top_k, min_cosine=self.p.min_cosine,
                                      item_block=self.p.item_block, side_rows=self.p.side_rows, keep_rank=True)

    @property
    def neighbors(self) -> DataFrame:
        return self.neighbors_ranked.drop("rank")

    @property
    def top_item(self) -> DataFrame:
        return B.most_rated_item(self.train).select("movieId")

    @property
    def top_user(self) -> DataFrame:
        """Most active user of the rating table (ties: lowest id)."""
        return (self.ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("_n"))
                .orderBy(F.col("_n").desc(), F.col("userId").asc()).limit(1).select("userId"))

    @cached_property
    def predictions(self) -> DataFrame:
        warm = G.warm_test(self.test, self.train)
        return G.final_predictions(warm, self.neighbors, self.train, self.p.default_rating)

    @cached_property
    def sim_cache(self) -> DataFrame:
        return I.similarity_cache(self.neighbors, self.items)

    @cached_property
    def recs(self) -> DataFrame:
        return G.user_recommendations(self.train, self.neighbors, self.items, self.p.user_top_n,
                                      self.p.min_neighbors)

    def _mllib(self, num_tables: int):
        index = D.user_index(self.train_supported)
        profiles = D.item_profiles(D.indexed_ratings(self.train_supported, index))
        normalized = D.normalize_vectors(D.item_vectors(profiles, index))
        model = L.fit_mllib_lsh(normalized, self.p.bucket_length, num_tables, self.p.seed)
        return model, normalized

    # -- A: sources and sinks -------------------------------------------------------
    def load_ratings(self) -> DataFrame:
        path = A.scratch_path(self.spark, "ratings-csv")
        self.ratings.write.options(**A.CSV).csv(path)
        return rounded(A.read_ratings_csv(self.spark, path))

    def load_items(self) -> DataFrame:
        path = A.scratch_path(self.spark, "items-csv")
        self.items.select("movieId", "title", F.lit(None).cast("string").alias("genres")) \
            .write.options(**A.CSV).csv(path)
        return A.read_items_csv(self.spark, path)

    def write_predictions(self) -> DataFrame:
        path = A.scratch_path(self.spark, "predictions-csv")
        A.write_predictions(rounded(self.predictions), path)
        return A.read_predictions(self.spark, path)

    def cache_roundtrip(self) -> DataFrame:
        path = A.scratch_path(self.spark, "similarity-cache")
        A.write_cache(self.sim_cache, path, "movie_i")
        return rounded(A.read_cache(self.spark, path))

    def recs_cache_roundtrip(self) -> DataFrame:
        path = A.scratch_path(self.spark, "recommendation-cache")
        A.write_cache(I.recommendation_cache(self.recs), path, "userId")
        return rounded(A.read_cache(self.spark, path))

    def load_rating_folds(self) -> DataFrame:
        """All events with an item, as a tab separated fold with Unix seconds."""
        path = A.scratch_path(self.spark, "fold-tsv")
        ev = src.table(self.spark, self.sf_dir, "events")
        (ev.select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                   F.least(F.lit(5), 1 + F.floor(F.col("value") / 20)).cast("int").alias("rating"),
                   F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
         .where("user_id is not null and item_id is not null").write.option("sep", "\t").csv(path))
        return A.read_rating_folds(self.spark, path).select("userId", "movieId", "rating", "timestamp",
                                                            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))

    def load_user_table(self) -> DataFrame:
        """Customers as a pipe separated user table; the zip column holds letters."""
        path = A.scratch_path(self.spark, "users-pipe")
        (src.table(self.spark, self.sf_dir, "customer")
         .select("c_custkey", "c_nationkey", F.substring("c_mktsegment", 1, 1), "c_mktsegment", "c_name")
         .write.option("sep", "|").csv(path))
        return A.read_users(self.spark, path)

    def load_item_flags(self) -> DataFrame:
        """Parts as an item file in Latin-1; a part's genres are those whose number its size is a multiple of."""
        path = A.scratch_path(self.spark, "item-flags")
        part = src.table(self.spark, self.sf_dir, "part")
        flags = [(F.col("p_size") % (i + 1) == 0).cast("int").alias(f"g{i}") for i in range(len(GENRE_NAMES))]
        (part.select("p_partkey", F.concat("p_name", F.lit(" é")).alias("title"), "p_brand", F.lit(None).cast("string").alias("v"), "p_type", *flags)
         .write.option("sep", "|").option("quote", "\u0000").option("encoding", "ISO-8859-1").option("emptyValue", "").csv(path))
        return A.read_item_file(self.spark, path).select("movieId", "title", "release_date", "url",
                                                         F.array_join("genres", ",").alias("genres"))

    def load_genres(self) -> DataFrame:
        """Nations as a pipe separated genre list with blank lines."""
        path = A.scratch_path(self.spark, "genres-pipe")
        lines = src.table(self.spark, self.sf_dir, "nation").select(F.concat_ws("|", "n_name", "n_nationkey").alias("value"))
        lines.withColumn("value", F.explode(F.array("value", F.lit(""), F.lit("  ")))).write.text(path)
        return A.read_genres(self.spark, path)

    def load_occupations(self) -> DataFrame:
        """Market segments as an occupation list, one per line, with blank lines and spaces around."""
        path = A.scratch_path(self.spark, "occupations")
        names = src.table(self.spark, self.sf_dir, "customer").select("c_mktsegment").distinct()
        names.select(F.explode(F.array(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")), F.lit(""))).alias("value")).write.text(path)
        return A.read_occupations(self.spark, path)

    # -- B: profiling -------------------------------------------------------------------
    def dataset_stats(self) -> DataFrame:
        return rounded(B.dataset_stats(self.ratings_once))

    def rating_distribution(self) -> DataFrame:
        return B.rating_distribution(self.ratings_once)

    def split_stats(self) -> DataFrame:
        return rounded(B.split_stats(self.tagged))

    def most_rated_items(self) -> DataFrame:
        return B.most_rated_items(self.train, 10)

    def most_rated_item(self) -> DataFrame:
        return B.most_rated_item(self.train)

    def item_title(self) -> DataFrame:
        return B.item_title(self.items, self.top_item)

    def sample_rows(self) -> DataFrame:
        return B.sample_rows(self.train, 5, self.p.seed)

    def supported_item_count(self) -> DataFrame:
        return B.supported_item_count(self.train, self.p.min_ratings)

    def prediction_histogram(self) -> DataFrame:
        v = self.predictions.select(F.round("predicted_rating", 6).alias("predicted_rating"))
        return _edges(B.value_histogram(v, "predicted_rating", HIST_BINS))

    def true_rating_histogram(self) -> DataFrame:
        v = self.predictions.select(F.round("true_rating", 6).alias("true_rating"))
        return _edges(B.value_histogram(v, "true_rating", HIST_BINS))

    def error_histogram(self) -> DataFrame:
        e = self.predictions.select(F.round(F.col("predicted_rating") - F.col("true_rating"), 6).alias("error"))
        return _edges(B.value_histogram(e, "error", HIST_BINS))

    # -- C: splits ------------------------------------------------------------------------
    def random_split(self) -> DataFrame:
        tr, te = C.random_split(self.ratings, self.p.test_fraction, self.p.seed)
        return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))

    def random_split_invariants(self) -> DataFrame:
        """What holds for any random split: every rating lies in exactly one side."""
        both = self.random_split().groupBy("userId", "movieId").agg(F.count(F.lit(1)).alias("times"))
        return both.agg(F.count(F.lit(1)).alias("num_ratings"), F.sum("times").alias("num_rows"),
                        F.count_if(F.col("times") > 1).alias("overlap"))

    def hash_split(self) -> DataFrame:
        return C.tag_hash_split(src.event_ratings(self.spark, self.sf_dir), self.p.test_fraction)

    def kfold_assign(self) -> DataFrame:
        return C.kfold_assign(self.ratings, KFOLDS, ["userId", "movieId"])

    def leave_n_out(self) -> DataFrame:
        return C.leave_n_out(self.ratings, LEAVE_START, LEAVE_STOP, ["movieId"])

    def leave_n_out_capped(self) -> DataFrame:
        return C.leave_n_out_capped(self.ratings, LEAVE_START, LEAVE_STOP, LEAVE_CAP, ["movieId"])

    def cross_validate(self) -> DataFrame:
        per_fold, _ = P.cross_validate(self.ratings, KFOLDS, self.p)
        return rounded(per_fold.select("cv", "rmse", "mae", "num_predictions", "coverage"))

    # -- D: interaction matrix ---------------------------------------------------------------
    def user_index(self) -> DataFrame:
        return D.user_index(self.train)

    def indexed_ratings(self) -> DataFrame:
        return D.indexed_ratings(self.train, D.user_index(self.train))

    def item_profiles(self) -> DataFrame:
        prof = D.item_profiles(D.indexed_ratings(self.train, D.user_index(self.train)))
        return prof.select("movieId",
                           F.transform("user_ratings", lambda x: x["user_idx"]).alias("user_idx_list"),
                           F.transform("user_ratings", lambda x: x["rating"]).alias("rating_list"),
                           "num_ratings")

    def supported_items(self) -> DataFrame:
        return D.supported_items(self.train, SUPPORT_FLOOR)

    def item_vectors(self) -> DataFrame:
        index = D.user_index(self.train_supported)
        vec = D.item_vectors(D.item_profiles(D.indexed_ratings(self.train_supported, index)), index)
        return D.vector_entries(vec)

    def normalized_profiles(self) -> DataFrame:
        return rounded(D.normalized_profiles(self.train_supported))

    # -- E: similarity ---------------------------------------------------------------------------
    def lsh_buckets(self) -> DataFrame:
        model, normalized = self._mllib(self.p.num_hash_tables)
        return L.mllib_buckets(model, normalized)

    def lsh_bucket_invariants(self) -> DataFrame:
        """Every item has one bucket per table, and on unit vectors a bucket is the sign: -1 or 0."""
        return self.lsh_buckets().groupBy("hash_table").agg(
            F.count(F.lit(1)).alias("num_rows"), F.count_distinct("movieId").alias("num_items"),
            F.bool_and(F.col("bucket").isin(-1, 0)).alias("in_range"))

    def lsh_similar_pairs(self) -> DataFrame:
        model, normalized = self._mllib(LSH_TABLES)
        pairs = L.mllib_similar_pairs(model, normalized, LSH_THRESHOLD)
        return rounded(pairs.select("movie_i", "movie_j", "cosine_similarity"))

    def join_distance_to_cosine(self) -> DataFrame:
        """The distances that MLlib's join returns, and the cosines they stand for."""
        model, normalized = self._mllib(LSH_TABLES)
        pairs = L.mllib_similar_pairs(model, normalized, LSH_THRESHOLD)
        return rounded(pairs.select("movie_i", "movie_j", "distance", distance_to_cosine("distance").alias("cosine_similarity")))

    def distance_to_cosine(self) -> DataFrame:
        d = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * F.col("cosine_similarity")))
        return rounded(self.pairs.select("movie_i", "movie_j", d.alias("distance"))
                       .withColumn("cosine_similarity", distance_to_cosine("distance")))

    def exact_cosine_pairs(self) -> DataFrame:
        return rounded(E.exact_cosine_pairs(self.train_supported, item_block=self.p.item_block,
                                            side_rows=self.p.side_rows))

    def projection_buckets(self) -> DataFrame:
        return L.projection_signatures(self.train_supported, PROJ_BANDS, PROJ_BITS, self.p.seed)

    def projection_similar_pairs(self) -> DataFrame:
        sig = L.projection_signatures(self.train_supported, PROJ_BANDS, PROJ_BITS, self.p.seed)
        pairs = L.projection_pairs(self.train_supported, sig, item_block=self.p.item_block,
                                   side_rows=self.p.side_rows, min_cosine=self.p.min_cosine)
        return rounded(pairs)

    def lsh_topk_neighbors(self) -> DataFrame:
        """Top-K neighbours of the part ratings by multi-probe LSH: buckets of one size at any number of items."""
        return rounded(L.multiprobe_topk_neighbors(self.part_ratings, self.p.top_k, bands=PROBE_BANDS, bucket_items=PART_BUCKET, probes=PROBES,
                                                   seed=self.p.seed, item_block=self.p.item_block, side_rows=self.p.side_rows))

    def lsh_metrics(self) -> DataFrame:
        """Train-and-evaluate with multi-probe neighbours, the share of the exact neighbours that they hold, and
        the pairs that the buckets multiplied."""
        p = self.p.with_(num_hash_tables=PROBE_BANDS, bucket_items=EVENT_BUCKET, probes=PROBES)
        train, sup = self.train, cut_lineage(self.train_supported, "supported")
        found = cut_lineage(P.neighbor_table(sup, p, "multiprobe"), "neighbors")
        preds = G.final_predictions(G.warm_test(self.test, train), found, train, p.default_rating)
        exact = self.neighbors.select("movie_i", "movie_j").join(found.select("movie_i", "movie_j", F.lit(1).alias("_hit")), ["movie_i", "movie_j"], "left")
        recall = exact.agg(F.try_divide(F.count("_hit").cast("double"), F.count(F.lit(1)).cast("double"))).scalar()
        bits = L.bits_for(sup.agg(F.count_distinct("movieId")).first()[0], EVENT_BUCKET)
        work = L.bucket_work(L.probed_signatures(sup, PROBE_BANDS, bits, PROBES, p.seed))
        return rounded(H.summary(preds, p.default_rating).select("rmse", "mae", "num_predictions", "coverage", recall.alias("recall"),
                                                                 work.select("pairs").scalar().alias("pairs")))

    def gaussian_buckets(self) -> DataFrame:
        return L.gaussian_buckets(self.train_supported, self.p.num_hash_tables, FINE_LENGTHS, self.p.seed)

    def lsh_recall_sampled(self) -> DataFrame:
        """``lsh_recall`` estimated from a sample of the items, with bounds."""
        sup = cut_lineage(self.train_supported, "supported")
        sig = cut_lineage(L.projection_signatures(sup, RECALL_BANDS, 1, self.p.seed), "signatures")
        return rounded(L.sampled_recall(sup, sig, RECALL_BANDS, min_cosine=self.p.min_cosine, sample=RECALL_SAMPLE, seed=self.p.seed))

    def part_recall_sampled(self) -> DataFrame:
        """Recall of multi-probe LSH on the part ratings, estimated from a sample of the items."""
        lp = self.part_ratings
        bits = L.bits_for(lp.agg(F.count_distinct("movieId")).first()[0], PART_BUCKET)
        sig = cut_lineage(L.probed_signatures(lp, RECALL_BANDS, bits, PROBES, self.p.seed), "signatures")
        return rounded(L.sampled_recall(lp, sig, RECALL_BANDS, min_cosine=PREFIX_COSINE, sample=PART_SAMPLE, seed=self.p.seed))

    def lsh_recall(self) -> DataFrame:
        sig = L.projection_signatures(self.train_supported, RECALL_BANDS, 1, self.p.seed)
        lsh = L.projection_pairs(self.train_supported, sig, item_block=self.p.item_block,
                                 side_rows=self.p.side_rows, min_cosine=self.p.min_cosine)
        return rounded(L.lsh_recall(self.pairs, lsh, RECALL_BANDS))

    def symmetric_pairs(self) -> DataFrame:
        return rounded(E.symmetric_pairs(self.pairs))

    def topk_neighbors(self) -> DataFrame:
        return rounded(self.neighbors_ranked)

    def supplier_cosine_pairs(self) -> DataFrame:
        """Exact pairs above the threshold on the lineitem/supplier ratings (R_ls)."""
        ls = cut_lineage(src.lineitem_ratings(self.spark, self.sf_dir, "supp"), "supplier-ratings")
        return rounded(E.exact_cosine_pairs(ls, min_cosine=self.p.min_cosine,
                                            item_block=self.p.item_block, side_rows=self.p.side_rows))

    @cached_property
    def part_ratings(self) -> DataFrame:
        return cut_lineage(src.lineitem_ratings(self.spark, self.sf_dir, "part"), "part-ratings")

    def part_threshold_pairs(self) -> DataFrame:
        """Pairs of the part ratings (R_lp) above a threshold by prefix filtering."""
        return rounded(X.prefix_cosine_join(self.part_ratings, PREFIX_COSINE).pairs)

    def supplier_threshold_pairs(self) -> DataFrame:
        """``supplier_cosine_pairs`` by prefix filtering."""
        ls = cut_lineage(src.lineitem_ratings(self.spark, self.sf_dir, "supp"), "supplier-ratings")
        return rounded(X.prefix_cosine_join(ls, self.p.min_cosine).pairs)

    def prefix_join_work(self) -> DataFrame:
        """Index entries, candidates, products done and products pruned of ``part_threshold_pairs``."""
        return X.prefix_cosine_join(self.part_ratings, PREFIX_COSINE).work

    def part_topk_neighbors(self) -> DataFrame:
        """Top-K neighbours without a threshold on the sparse lineitem/part ratings (R_lp)."""
        return rounded(E.exact_topk_neighbors(self.part_ratings, self.p.top_k, item_block=self.p.item_block,
                                              side_rows=self.p.side_rows, keep_rank=True))

    def topk_neighbors_striped(self) -> DataFrame:
        """``part_topk_neighbors`` under a layout of many stripes; the result is the same."""
        return rounded(E.exact_topk_neighbors(self.part_ratings, self.p.top_k, keep_rank=True, **STRIPED))

    def embedding_cosine_pairs(self) -> DataFrame:
        ent = src.embedding_entries(self.spark, self.sf_dir)
        return rounded(E.exact_cosine_pairs(ent, min_cosine=self.p.min_cosine,
                                            item_block=self.p.item_block, side_rows=self.p.side_rows))

    # -- F: similar items --------------------------------------------------------------------------
    def similar_items(self) -> DataFrame:
        top = cut_lineage(self.top_item, "top-item")
        near = E.seed_neighbors(self.train_supported_once, top, self.p.top_k, min_cosine=self.p.min_cosine)
        return rounded(E.similar_items(near, self.items, top, self.p.similar_k))

    def similar_items_bulk(self) -> DataFrame:
        ids = self.train.select("movieId").distinct()
        return rounded(E.similar_items_bulk(self.neighbors, self.items, ids, self.p.similar_k))

    # -- G: prediction --------------------------------------------------------------------------------
    def warm_test_ratings(self) -> DataFrame:
        return G.warm_test(self.test, self.train)

    def neighbor_expansion(self) -> DataFrame:
        return rounded(G.neighbor_expansion(G.warm_test(self.test, self.train), self.neighbors))

    def neighbor_ratings(self) -> DataFrame:
        exp = G.neighbor_expansion(G.warm_test(self.test, self.train), self.neighbors)
        return rounded(G.neighbor_ratings(exp, self.train))

    def bucketed_neighbor_ratings(self) -> DataFrame:
        """``neighbor_ratings`` over caches that are bucketed on the join keys: neither join moves them."""
        bucketed = lambda df, keys, name: A.write_bucketed(df, keys, CACHE_BUCKETS, name)
        test = bucketed(G.warm_test(self.test, self.train), ["movieId"], "test_by_item")
        neighbors = bucketed(self.neighbors, ["movie_i"], "neighbors_by_item")
        train = bucketed(self.train, ["userId", "movieId"], "train_by_user_item")
        return rounded(G.neighbor_ratings(G.neighbor_expansion(test, neighbors), train))

    def neighbor_predictions(self) -> DataFrame:
        exp = G.neighbor_expansion(G.warm_test(self.test, self.train), self.neighbors)
        return rounded(G.neighbor_predictions(G.neighbor_ratings(exp, self.train)))

    def final_predictions(self) -> DataFrame:
        return rounded(self.predictions)

    def user_recommendations(self) -> DataFrame:
        return rounded(self.recs)

    # -- H: evaluation ------------------------------------------------------------------------------------
    def prediction_metrics(self) -> DataFrame:
        return rounded(H.prediction_metrics(self.predictions))

    def prediction_coverage(self) -> DataFrame:
        return rounded(H.prediction_coverage(self.predictions, self.p.default_rating))

    def error_stats(self) -> DataFrame:
        return rounded(H.error_stats(self.predictions))

    def true_vs_predicted(self) -> DataFrame:
        pr = self.predictions.withColumn("predicted_rating", F.round("predicted_rating", 6))
        return rounded(H.true_vs_predicted(pr))

    def append_metrics(self) -> DataFrame:
        path = A.scratch_path(self.spark, "metrics")
        rec = H.metrics_record(rounded(H.prediction_metrics(self.predictions)), self.p, "events", stamp=RUN_STAMP)
        for run in ("first", "first", "second"):       # the first run is retried: its record is replaced
            A.append_metrics(rec, path, run)
        return A.read_metrics(self.spark, path)

    def parameter_sweep(self) -> DataFrame:
        return rounded(P.parameter_sweep(self.ratings, base=self.p))

    def parameter_sweep_fine(self) -> DataFrame:
        return rounded(P.parameter_sweep(self.ratings, base=self.p, **FINE_SWEEP))

    # -- I: serving -------------------------------------------------------------------------------------------
    def user_ids(self) -> DataFrame:
        return I.user_ids(self.ratings_once)

    def user_history(self) -> DataFrame:
        return I.user_history(self.ratings, self.items, self.top_user)

    def user_profile_stats(self) -> DataFrame:
        return rounded(I.user_profile_stats(self.ratings, self.items, self.top_user))

    def recommendations_for_user(self) -> DataFrame:
        """One user's history against the neighbour table: other users are not scored."""
        user = cut_lineage(self.top_user, "top-user")
        recs = G.user_recommendations(self.train.join(user, "userId", "left_semi"), self.neighbors, self.items, self.p.user_top_n,
                                      self.p.min_neighbors)
        return rounded(I.recommendations_for_user(I.recommendation_cache(recs), user, self.p.user_top_n))

    def item_catalog(self) -> DataFrame:
        return I.item_catalog(self.sim_cache)

    def seed_recommendations(self) -> DataFrame:
        ids = B.most_rated_items(self.train, SEED_BASKET_ITEMS).select("movieId")
        seeds = ids.join(self.items, "movieId").select("title")
        return rounded(I.seed_recommendations(self.sim_cache, seeds, SEED_PAGE_N))

    def search_items(self) -> DataFrame:
        return I.search_items(I.item_catalog(self.sim_cache), SEARCH_QUERY, self.p.search_limit)

    def filter_titles(self) -> DataFrame:
        return I.filter_titles(I.item_catalog(self.sim_cache), SEARCH_QUERY)

    def search_titles_bulk(self) -> DataFrame:
        """Every distinct word of the titles as a query, by the index."""
        words = self.items.select(F.explode(F.split(F.col("title"), " ")).alias("query"))
        return I.search_titles(cut_lineage(I.title_index(self.items), "title-index"), self.items, words)

    def seed_recommendations_bulk(self) -> DataFrame:
        """Every user's whole history is a basket."""
        baskets = self.train.join(self.items, "movieId").select(F.col("userId").alias("basket_id"), "title")
        return rounded(I.seed_recommendations_bulk(self.sim_cache, baskets, SEED_PAGE_N))


REGISTERED = [
    # A
    "load_ratings", "load_items", "write_predictions", "cache_roundtrip", "append_metrics",
    "recs_cache_roundtrip", "load_rating_folds", "load_user_table", "load_item_flags", "load_genres", "load_occupations",
    # B
    "dataset_stats", "rating_distribution", "split_stats", "most_rated_items", "most_rated_item",
    "item_title", "sample_rows", "supported_item_count", "prediction_histogram", "true_rating_histogram",
    "error_histogram",
    # C
    "random_split", "random_split_invariants", "hash_split", "kfold_assign", "leave_n_out", "leave_n_out_capped", "cross_validate",
    # D
    "user_index", "indexed_ratings", "item_profiles", "supported_items", "item_vectors", "normalized_profiles",
    # E
    "lsh_buckets", "lsh_bucket_invariants", "lsh_similar_pairs", "distance_to_cosine", "join_distance_to_cosine", "exact_cosine_pairs", "projection_buckets",
    "projection_similar_pairs", "lsh_topk_neighbors", "lsh_metrics", "gaussian_buckets", "lsh_recall_sampled", "part_recall_sampled", "lsh_recall", "symmetric_pairs", "topk_neighbors", "embedding_cosine_pairs",
    "supplier_cosine_pairs", "supplier_threshold_pairs", "part_threshold_pairs", "prefix_join_work", "part_topk_neighbors", "topk_neighbors_striped",
    # F
    "similar_items", "similar_items_bulk",
    # G
    "warm_test_ratings", "neighbor_expansion", "neighbor_ratings", "bucketed_neighbor_ratings", "neighbor_predictions",
    "final_predictions", "user_recommendations",
    # H
    "prediction_metrics", "prediction_coverage", "error_stats", "true_vs_predicted", "parameter_sweep", "parameter_sweep_fine",
    # I
    "user_ids", "user_history", "user_profile_stats", "recommendations_for_user", "item_catalog",
    "seed_recommendations", "search_items", "filter_titles", "search_titles_bulk", "seed_recommendations_bulk",
]
