"""Locality-sensitive hashing for the similarity join.

Two paths:

* **MLlib path** (the original tool's operators): sparse item vectors,
  ``Normalizer``, ``BucketedRandomProjectionLSH``, ``approxSimilarityJoin``.
  On unit vectors with bucketLength >= 1 the bucket id takes only the values
  -1 and 0, i.e. it is a sign hash: every table splits the items in two.
* **Relational projection LSH**: the projection of item i on a random +/-1
  vector is sum_u r(u, i) * xi(u, t), an ordinary grouped sum (no vectors, no
  UDF); its sign is one bit (signed random projections, Charikar 2002).
  ``bits_per_band`` bits form a band's bucket (AND), bands are OR-ed.
  Candidate verification reuses the blocked Gram product restricted to items
  of the same (band, bucket), so no candidate pair list is materialised and a
  heavy user or a degenerate bucket never lands in one task.
* **Multi-probe LSH**: the same signs with as many bits as keep a bucket at a set
  size whatever the number of items, so the candidates grow with the items, not with their
  square.  An item also enters the buckets that differ in one of its least sure bits (those
  whose projection is nearest to zero), so few bands do the work of many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.functions.exprs import digest_sign, distance_to_cosine, user_digest
from recsim.operators.bucket_histories import bucket_products
from recsim.operators.gram import DEFAULT_ITEM_BLOCK, DEFAULT_SIDE_ROWS, gram_products
from recsim.session import cut_lineage

# -- MLlib path ------------------------------------------------------------------


def fit_mllib_lsh(normalized: DataFrame, bucket_length: float, num_tables: int, seed: int,
                  input_col: str = "norm_features"):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    lsh = BucketedRandomProjectionLSH(inputCol=input_col, outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed)
    return lsh.fit(normalized.select("movieId", input_col))


def mllib_buckets(model, normalized: DataFrame, input_col: str = "norm_features") -> DataFrame:
    """(movieId, hash_table, bucket) from ``model.transform``."""
    from pyspark.ml.functions import vector_to_array
    hashed = model.transform(normalized.select("movieId", input_col))
    return hashed.select("movieId", F.posexplode("hashes").alias("hash_table", "_h")).select(
        "movieId", F.col("hash_table").cast("int").alias("hash_table"),
        vector_to_array("_h")[0].cast("bigint").alias("bucket"))


def mllib_similar_pairs(model, normalized: DataFrame, threshold: float,
                        input_col: str = "norm_features") -> DataFrame:
    """Pairs closer than ``threshold`` (strict) in at least one shared bucket.

    Only (id, vector) is handed to the join: the join packs whole rows into
    structs and deduplicates on them, so extra columns would ride along.
    """
    proj = normalized.select("movieId", input_col)
    joined = model.approxSimilarityJoin(proj, proj, threshold, distCol="distance")
    return (joined.where(F.col("datasetA.movieId") < F.col("datasetB.movieId"))
            .select(F.col("datasetA.movieId").alias("movie_i"), F.col("datasetB.movieId").alias("movie_j"),
                    "distance", distance_to_cosine("distance").alias("cosine_similarity")))


# -- relational projection LSH -------------------------------------------------------


def projection_signatures(ratings: DataFrame, bands: int, bits_per_band: int = 1, seed: int = 126784,
                          by: Sequence[str] = ()) -> DataFrame:
    """(movieId, band, bucket) for every item: bucket = the band's sign bits as an int.

    One grouped aggregate with ``bands * bits_per_band`` conditional sums (no
    row replication); the md5 digest is computed once per rating for each 32
    projections.  Partial aggregation runs before the shuffle.
    """
    by = list(by)
    n = bands * bits_per_band
    digests = [user_digest("userId", c, seed).alias(f"_d{c}") for c in range((n + 31) // 32)]
    pre = ratings.select(*by, "movieId", "userId", "rating", *digests)
    sums = [F.sum(F.col("rating") * digest_sign(f"_d{t // 32}", t)).alias(f"_p{t}") for t in range(n)]
    proj = pre.groupBy(*by, "movieId").agg(*sums)
    band_ids = []
    for b in range(bands):
        bits = [F.when(F.col(f"_p{b * bits_per_band + k}") > 0, F.lit(1 << k)).otherwise(F.lit(0))
                for k in range(bits_per_band)]
        acc = bits[0]
        for x in bits[1:]:
            acc = acc + x
        band_ids.append(acc)
    return proj.select(*by, "movieId", F.posexplode(F.array(*band_ids)).alias("band", "bucket")).select(
        *by, "movieId", F.col("band").cast("int").alias("band"), F.col("bucket").cast("int").alias("bucket"))


MAX_BITS = 30    # a band's bits come from one md5 digest of 32 digits
FEW = 256        # ratings per item up to which partial sums save nothing


def bits_for(items: int, bucket_items: int) -> int:
    """Bits per band with which a bucket holds about ``bucket_items`` of ``items`` items."""
    bits = 1
    while bits < MAX_BITS and bucket_items << bits < items:
        bits += 1
    return bits


def probed_signatures(ratings: DataFrame, bands: int, bits: int, probes: int, seed: int = 126784,
                      by: Sequence[str] = ()) -> DataFrame:
    """(movieId, band, bucket, probe): every item in its own bucket of each band (probe 0) and in those
    that differ in the bit of its ``probes`` smallest projections (probe 1, 2, ...; ties by bit).

    Bit k of band b is the sign of sum r * xi, with xi from hex digit k of md5(seed, user, b): one
    grouped aggregate with ``bands * bits`` conditional sums.  The smallest projection is the
    bit that a similar item most likely has otherwise, so its other bucket is probed first.

    Where items have ``FEW`` ratings on average, a task has hardly two of an item, and partial sums would be shuffled that are
    many times as wide as the ratings: there the ratings themselves are dealt by item first (one job counts them).
    """
    by = list(by)
    if not 1 <= bits <= MAX_BITS:
        raise ValueError(f"bits must lie in 1..{MAX_BITS}")
    digests = [user_digest("userId", b, seed).alias(f"_d{b}") for b in range(bands)]
    groups, rows, hottest = ratings.groupBy(*by, "movieId").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if rows <= FEW * groups and hottest <= DEFAULT_SIDE_ROWS:
        ratings = ratings.select(*by, "movieId", "userId", "rating").repartition(*by, "movieId")
    pre = ratings.select(*by, "movieId", "userId", "rating", *digests)
    proj = pre.groupBy(*by, "movieId").agg(*[
        F.sum(F.col("rating") * digest_sign(f"_d{b}", k)).alias(f"_p{b}_{k}") for b in range(bands) for k in range(bits)])
    buckets = []
    for b in range(bands):
        cols = [F.col(f"_p{b}_{k}") for k in range(bits)]
        own = sum((F.when(c > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(cols)), F.lit(0))
        unsure = F.sort_array(F.array(*[F.struct(F.abs(c).alias("size"), F.lit(1 << k).alias("mask")) for k, c in enumerate(cols)]))
        near = F.transform(F.slice(unsure, 1, probes), lambda x: own.bitwiseXOR(x["mask"])) if probes else F.array().cast("array<int>")
        buckets.append(F.concat(F.array(own), near))
    return (proj.select(*by, "movieId", F.posexplode(F.array(*buckets)).alias("band", "_probes"))
            .select(*by, "movieId", F.col("band").cast("int").alias("band"), F.posexplode("_probes").alias("probe", "bucket"))
            .select(*by, "movieId", "band", "bucket", F.col("probe").cast("int").alias("probe")))


def multiprobe_topk_neighbors(ratings: DataFrame, k: int, *, bands: int, bucket_items: int, probes: int, seed: int = 126784,
                              min_cosine: float | None = None, item_block: int = DEFAULT_ITEM_BLOCK,
                              side_rows: int = DEFAULT_SIDE_ROWS, bits: int | None = None) -> DataFrame:
    """Top-k neighbours per item among the items that share a bucket, own or probed, in some band.

    The bits per band follow from the number of items (one number that reaches the driver) unless
    given.  Buckets hold about ``(probes + 1) * bucket_items`` items, so the pairs that are multiplied grow in
    proportion to the items.  Sparse ratings are sent to their users once, with their items' buckets (``bucket_histories``);
    otherwise every bucket is a group of the blocked Gram product, which keeps its own top-k.
    """
    from recsim.operators.similarity import symmetric_pairs, topk_neighbors
    rows, items = ratings.agg(F.count("movieId"), F.count_distinct("movieId")).first()
    if bits is None:
        bits = bits_for(items, bucket_items)
    sig = cut_lineage(probed_signatures(ratings, bands, bits, probes, seed).where("movieId is not null").drop("probe"), "signatures")
    pairs = bucket_products(ratings, sig, rows, side_rows=side_rows, min_cosine=min_cosine)
    if pairs is not None:
        return topk_neighbors(symmetric_pairs(pairs), k)
    return projection_topk_neighbors(ratings, sig, k, min_cosine=min_cosine, item_block=item_block, side_rows=side_rows)


def bucket_work(signatures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): items, buckets, largest_bucket and pairs, the pairs of items that the buckets multiply."""
    sizes = signatures.groupBy(*by, "band", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    items = signatures.groupBy(*by).agg(F.count_distinct("movieId").alias("items"))
    work = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("buckets"), F.max("_n").alias("largest_bucket"),
                                  F.sum(F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint").alias("pairs"))
    return items.join(work, list(by)) if by else items.withColumn("_k", F.lit(0)).join(work.withColumn("_k", F.lit(0)), "_k").drop("_k")


# -- bucketed Gaussian projections ---------------------------------------------------


def gaussian(user, table: int, seed: int):
    """A standard normal number for (seed, user, table): Box-Muller on two 32-bit numbers of an md5."""
    h = F.md5(F.concat(F.lit(f"{seed}:g:"), F.col(user).cast("string"), F.lit(f":{table}")))
    part = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.sqrt(F.lit(-2.0) * F.log(part(1))) * F.cos(F.lit(2.0) * F.pi() * part(9))


def gaussian_buckets(ratings: DataFrame, tables: int, bucket_lengths: Sequence[float], seed: int = 126784) -> DataFrame:
    """(bucketLength, movieId, hash_table, bucket): floor(projection / bucketLength) of each item's unit vector on unit Gaussian vectors.

    The bucketed random projection with real buckets: below a length of 1 they are more than the
    sign.  The projections are one grouped sum over the ratings and serve every length; the lengths of the random vectors are one
    aggregate over the distinct users.
    """
    if min(bucket_lengths) <= 0:
        raise ValueError("bucketLength must be positive")
    cols = [f"_g{t}" for t in range(tables)]
    drawn = lambda df: df.select("*", *[gaussian("userId", t, seed).alias(c) for t, c in enumerate(cols)])
    length = drawn(ratings.select("userId").distinct()).agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in cols])
    proj = drawn(ratings.select("movieId", "userId", "rating")).groupBy("movieId").agg(
        F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("_norm"), *[F.sum(F.col("rating") * F.col(c)).alias(c) for c in cols])
    units = F.array(*[F.col(c) / (F.col("_norm") * length.select(c).scalar()) for c in cols])
    return (proj.where("_norm > 0").select("movieId", F.posexplode(units).alias("hash_table", "_p"))
            .withColumn("bucketLength", F.explode(F.array(*[F.lit(float(b)) for b in bucket_lengths])))
            .select("bucketLength", "movieId", F.col("hash_table").cast("int").alias("hash_table"),
                    F.floor(F.col("_p") / F.col("bucketLength")).cast("bigint").alias("bucket")))


def gaussian_pairs(ratings: DataFrame, buckets: DataFrame, *, item_block: int = DEFAULT_ITEM_BLOCK, side_rows: int = DEFAULT_SIDE_ROWS,
                   min_cosine: float | None = None) -> DataFrame:
    """(bucketLength, movie_i, movie_j, first_table, cosine_similarity) of the pairs that share a bucket of some table."""
    groups = ["bucketLength", "hash_table", "bucket"]
    dots = gram_products(ratings.join(buckets, "movieId"), groups, item_block=item_block, side_rows=side_rows, min_cosine=min_cosine)
    pairs = dots.groupBy("bucketLength", "movie_i", "movie_j").agg(
        F.min("hash_table").alias("first_table"), F.min_by("cosine_similarity", "hash_table").alias("cosine_similarity"))
    return pairs


def projection_pairs(ratings: DataFrame, signatures: DataFrame, *, item_block: int = DEFAULT_ITEM_BLOCK,
                     side_rows: int = DEFAULT_SIDE_ROWS, min_cosine: float | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Verified LSH pairs: (movie_i, movie_j, first_table, cosine_similarity).

    A pair is a candidate when it shares a bucket in at least one band;
    ``first_table`` is the lowest such band, so the result for the first T
    bands is ``first_table < T`` (used by the one-job sweep).  Every (band,
    bucket) is a group of the blocked Gram product, so a degenerate bucket
    holding half of the items is split into sub-blocks like any large group.
    """
    by = list(by)
    r = ratings.join(signatures, [*by, "movieId"])
    dots = gram_products(r, [*by, "band", "bucket"], item_block=item_block, side_rows=side_rows, min_cosine=min_cosine)
    pairs = dots.groupBy(*by, "movie_i", "movie_j").agg(
        F.min("band").alias("first_table"), F.min_by("cosine_similarity", "band").alias("cosine_similarity"))
    return pairs.select(*by, "movie_i", "movie_j", "first_table", "cosine_similarity")


def projection_topk_neighbors(ratings: DataFrame, signatures: DataFrame, k: int, *,
                              min_cosine: float | None = None, item_block: int = DEFAULT_ITEM_BLOCK,
                              side_rows: int = DEFAULT_SIDE_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Top-k LSH neighbours per item (cosine desc, id asc) among bucket-sharing items.

    Each (band, bucket) group keeps only its own top-k per item inside the Gram
    cells; an edge of the global top-k is in the top-k of every group holding
    it, so the union of the group winners (deduplicated across bands) followed
    by the per-item window is exact.
    """
    from recsim.operators.similarity import topk_neighbors
    by = list(by)
    r = ratings.join(signatures, [*by, "movieId"])
    edges = gram_products(r, [*by, "band", "bucket"], item_block=item_block, side_rows=side_rows,
                          top_k=k, min_cosine=min_cosine)
    unique = edges.groupBy(*by, "movie_i", "movie_j").agg(F.max("cosine_similarity").alias("cosine_similarity"))
    return topk_neighbors(unique, k, by)


def lsh_recall(exact_pairs: DataFrame, lsh_pairs: DataFrame, bands: int) -> DataFrame:
    """Recall of the first T bands against the exact pairs, T = 1..bands, in one pass.

    One aggregate with a conditional count per T, unpivoted by ``posexplode``.
    """
    j = exact_pairs.select("movie_i", "movie_j").join(
        lsh_pairs.select("movie_i", "movie_j", "first_table"), ["movie_i", "movie_j"], "left")
    found = [F.count_if(F.col("first_table") < F.lit(t)).alias(f"_f{t}") for t in range(1, bands + 1)]
    agg = j.agg(F.count(F.lit(1)).alias("exact_pairs"), *found)
    return (agg.select("exact_pairs", F.posexplode(F.array(*[F.col(f"_f{t}") for t in range(1, bands + 1)]))
                       .alias("_t", "found_pairs"))
            .select((F.col("_t") + 1).cast("int").alias("num_tables"), "found_pairs", "exact_pairs",
                    F.try_divide(F.col("found_pairs").cast("double"), F.col("exact_pairs").cast("double"))
                    .alias("recall")))


Z99 = 2.5758293035489004    # two-sided 99 % point of the normal distribution


def sampled_recall(ratings: DataFrame, signatures: DataFrame, bands: int, *, min_cosine: float, sample: int, seed: int = 126784) -> DataFrame:
    """Recall of the first T bands, T = 1..bands, estimated from ``sample`` items, with a 99 % interval.

    The sampled items (those of the smallest md5) are multiplied with all others through their raters; the pairs above
    ``min_cosine`` are the truth, and one is found if its items share a bucket of ``signatures`` (movieId, band, bucket; an item may have
    several per band).  No table of all pairs is built.  Recall is a ratio estimate with the items as clusters.  How much items
    differ is taken from all of them, each seen through its pairs with the sampled ones, so rare items that miss most of their pairs widen
    the interval though none of them is sampled.  (num_tables, sampled_items, true_pairs, found_pairs, recall, low, high); without
    a true pair recall and bounds are null.
    """
    from recsim.functions.exprs import hash_order_key
    from recsim.operators.similarity import seed_products
    items = cut_lineage(ratings.groupBy("movieId").agg(F.lit(1).alias("_one")).drop("_one"), "items")
    seeds = cut_lineage(items.orderBy(hash_order_key("movieId", seed=seed), "movieId").limit(sample), "sampled-items")
    truth = seed_products(ratings, seeds).where(F.col("cosine_similarity") > F.lit(float(min_cosine)))
    held = signatures.groupBy("movieId").agg(F.collect_set(F.struct("band", "bucket")).alias("_b"))   # bands x probes entries
    side = lambda s: held.select(F.col("movieId").alias(f"movie_{s}"), F.col("_b").alias(f"_b{s}"))
    joined = truth.join(side("i").join(seeds.select(F.col("movieId").alias("movie_i")), "movie_i", "left_semi"), "movie_i", "left").join(side("j"), "movie_j", "left")
    first = joined.withColumn("_t", F.array_min(F.array_intersect("_bi", "_bj"))["band"])
    counts = first.groupBy("movie_j").agg(F.count(F.lit(1)).alias("t"), *[F.count_if(F.col("_t") < T).alias(f"f{T}") for T in range(1, bands + 1)])
    per_item = F.array(*[F.struct(F.lit(T).alias("num_tables"), F.col(f"f{T}").alias("f")) for T in range(1, bands + 1)])
    each = counts.select("t", F.explode(per_item).alias("s")).select("t", "s.num_tables", F.col("s.f").alias("f"))
    total = each.groupBy("num_tables").agg(*[F.sum(x).cast("double").alias(n) for n, x in (
        ("f", F.col("f")), ("t", F.col("t")), ("ff", F.col("f") * F.col("f")), ("ft", F.col("f") * F.col("t")), ("tt", F.col("t") * F.col("t")))])
    m, n = seeds.agg(F.count(F.lit(1))).scalar().cast("double"), items.agg(F.count(F.lit(1))).scalar().cast("double")
    every = ratings.sparkSession.range(1, bands + 1).select(F.col("id").cast("int").alias("num_tables"), m.alias("m"), n.alias("n"))
    r = F.try_divide("f", "t")
    spread = F.greatest(F.lit(0.0), F.col("ff") - 2 * r * F.col("ft") + r * r * F.col("tt"))
    error = F.lit(Z99) * F.col("n") * F.sqrt((F.lit(1.0) - F.col("m") / F.col("n")) * spread / (F.col("m") * F.greatest(F.col("n") - 1, F.lit(1.0)))) / F.col("t")
    return (every.join(total, "num_tables", "left")
            .select("num_tables", F.col("m").cast("bigint").alias("sampled_items"), F.coalesce("t", F.lit(0)).cast("bigint").alias("true_pairs"),
                    F.coalesce("f", F.lit(0)).cast("bigint").alias("found_pairs"), r.alias("recall"),
                    F.when(r.isNotNull(), F.greatest(F.lit(0.0), r - error)).alias("low"), F.when(r.isNotNull(), F.least(F.lit(1.0), r + error)).alias("high")))
