"""DuckDB SQL equivalents of the registered workloads (the correctness oracle).

The driver registers every table as a view; the CTEs below rebuild the
fixtures of FIXTURES.md §2 and compute each operator the textbook way
(self joins, windows over whole tables).  Literals come from the same
``Params`` and constants the Spark side uses.  Unreferenced CTEs are not
executed by DuckDB.
"""

from __future__ import annotations

from recsim.schemas import GENRE_NAMES
from recsim.functions.exprs import hex_cut
from recsim.params import Params
from recsim.plans import workloads as W


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def sig_ctes(name: str, bands: int, bits: int, seed: int) -> str:
    """Relational LSH signatures over ``tr`` and the candidate pairs they imply."""
    n = bands * bits
    return f"""
{name}_proj AS (
  SELECT x.movieId, g.t,
         sum(x.rating * CASE WHEN substr(md5(concat('{seed}:', CAST(x.userId AS VARCHAR), ':',
                                  CAST(g.t // 32 AS VARCHAR))), CAST(g.t % 32 AS INTEGER) + 1, 1) < '8'
                             THEN 1 ELSE -1 END) AS p
  FROM tr x CROSS JOIN (SELECT range AS t FROM range({n})) g
  GROUP BY 1, 2),
{name}_sig AS (
  SELECT movieId, CAST(t // {bits} AS INTEGER) AS band,
         CAST(sum(CASE WHEN p > 0 THEN pow(2, t % {bits}) ELSE 0 END) AS INTEGER) AS bucket
  FROM {name}_proj GROUP BY 1, 2),
{name}_cands AS (
  SELECT a.movieId AS movie_i, b.movieId AS movie_j, min(a.band) AS first_table
  FROM {name}_sig a JOIN {name}_sig b ON a.band = b.band AND a.bucket = b.bucket AND a.movieId < b.movieId
  GROUP BY 1, 2)"""


def probe_ctes(name: str, source: str, bands: int, bucket_items: int, probes: int, seed: int) -> str:
    """Multi-probe signatures over ``source`` and the candidate pairs they imply."""
    return f"""
{name}_bits AS (
  SELECT min(b) AS bits FROM range(1, 31) t(b), (SELECT count(DISTINCT movieId) AS n FROM {source}) WHERE b = 30 OR ({bucket_items} << b) >= n),
{name}_proj AS (
  SELECT x.movieId, CAST(g.band AS INTEGER) AS band, CAST(k.k AS INTEGER) AS k,
         sum(x.rating * CASE WHEN substr(md5(concat('{seed}:', CAST(x.userId AS VARCHAR), ':', CAST(g.band AS VARCHAR))),
                                         CAST(k.k AS INTEGER) + 1, 1) < '8' THEN 1 ELSE -1 END) AS p
  FROM {source} x CROSS JOIN range({bands}) g(band) CROSS JOIN (SELECT unnest(range(bits)) AS k FROM {name}_bits) k
  GROUP BY 1, 2, 3),
{name}_own AS (SELECT movieId, band, CAST(sum(CASE WHEN p > 0 THEN 1 << k ELSE 0 END) AS INTEGER) AS bucket FROM {name}_proj GROUP BY 1, 2),
{name}_sig AS (
  SELECT movieId, band, bucket FROM {name}_own
  UNION ALL
  SELECT o.movieId, o.band, CAST(xor(o.bucket, 1 << u.k) AS INTEGER)
  FROM {name}_own o JOIN (SELECT *, row_number() OVER (PARTITION BY movieId, band ORDER BY abs(p), k) AS n FROM {name}_proj) u
    ON u.movieId = o.movieId AND u.band = o.band AND u.n <= {probes}),
{name}_cands AS (
  SELECT DISTINCT a.movieId AS movie_i, b.movieId AS movie_j
  FROM {name}_sig a JOIN {name}_sig b ON a.band = b.band AND a.bucket = b.bucket AND a.movieId < b.movieId)"""


def gaussian_ctes(name: str, source: str, tables: int, lengths, seed: int) -> str:
    """Buckets of the Gaussian projections of ``source`` for each bucketLength."""
    number = lambda at: f"(CAST('0x' || substr(h, {at}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    lv = ", ".join(f"({dbl(float(x))})" for x in lengths)
    return f"""
{name}_g AS (
  SELECT userId, t, sqrt(-2.0::DOUBLE * ln({number(1)})) * cos(2.0::DOUBLE * pi() * {number(9)}) AS g
  FROM (SELECT userId, t, md5(concat('{seed}:g:', CAST(userId AS VARCHAR), ':', CAST(t AS VARCHAR))) AS h
        FROM (SELECT DISTINCT userId FROM {source}) CROSS JOIN range({tables}) r(t))),
{name}_len AS (SELECT t, sqrt(sum(g * g)) AS len FROM {name}_g GROUP BY t),
{name}_p AS (
  SELECT x.movieId, g.t, sum(x.rating * g.g) / (sqrt(sum(x.rating * x.rating)) * any_value(l.len)) AS p
  FROM {source} x JOIN {name}_g g ON g.userId = x.userId JOIN {name}_len l ON l.t = g.t GROUP BY 1, 2),
{name}_buckets AS (
  SELECT b.l AS bucketLength, movieId, CAST(t AS INTEGER) AS hash_table, CAST(floor(p / b.l) AS BIGINT) AS bucket
  FROM {name}_p CROSS JOIN (VALUES {lv}) b(l)),
{name}_cands AS (
  SELECT a.bucketLength AS len, a.movieId AS movie_i, b.movieId AS movie_j, min(a.hash_table) AS first_table
  FROM {name}_buckets a JOIN {name}_buckets b
    ON a.bucketLength = b.bucketLength AND a.hash_table = b.hash_table AND a.bucket = b.bucket AND a.movieId < b.movieId
  GROUP BY 1, 2, 3)"""


def sampled_ctes(source: str, sym: str, sig: str, bands: int, sample: int, seed: int) -> str:
    """``sr_total``: sums over the sampled items per number of bands; ``sym`` holds the true pairs both ways, ``sig`` the buckets."""
    return f"""
sr_items AS (SELECT DISTINCT movieId FROM {source}),
sr_seeds AS (SELECT movieId FROM sr_items ORDER BY md5(concat('{seed}', ':', CAST(movieId AS VARCHAR))), movieId LIMIT {sample}),
sr_truth AS (SELECT movie_i, movie_j FROM {sym} WHERE movie_i IN (SELECT movieId FROM sr_seeds)),
sr_first AS (
  SELECT t.movie_i, t.movie_j, min(a.band) FILTER (WHERE b.band IS NOT NULL) AS first_table
  FROM sr_truth t LEFT JOIN {sig} a ON a.movieId = t.movie_i LEFT JOIN {sig} b ON b.movieId = t.movie_j AND b.band = a.band AND b.bucket = a.bucket
  GROUP BY 1, 2),
sr_item AS (
  SELECT g.t AS num_tables, movie_j, CAST(count(*) AS DOUBLE) AS t, CAST(count_if(first_table < g.t) AS DOUBLE) AS f
  FROM sr_first CROSS JOIN range(1, {bands + 1}) g(t) GROUP BY 1, 2),
sr_total AS (
  SELECT num_tables, sum(t) AS t, sum(f) AS f, sum(f * f) AS ff, sum(f * t) AS ft, sum(t * t) AS tt,
         (SELECT CAST(count(*) AS DOUBLE) FROM sr_seeds) AS m, (SELECT CAST(count(*) AS DOUBLE) FROM sr_items) AS n
  FROM sr_item GROUP BY 1)"""


def sampled_select() -> str:
    from recsim.operators.lsh import Z99
    return f"""SELECT CAST(num_tables AS INTEGER) AS num_tables, CAST(m AS BIGINT) AS sampled_items, CAST(t AS BIGINT) AS true_pairs,
       CAST(f AS BIGINT) AS found_pairs, round(r, 6) AS recall, round(greatest(0.0, r - e), 6) AS low, round(least(1.0, r + e), 6) AS high
FROM (SELECT *, {dbl(Z99)} * n * sqrt((1.0::DOUBLE - m / n) * greatest(0.0, ff - 2 * r * ft + r * r * tt) / (m * greatest(n - 1, 1.0))) / t AS e
      FROM (SELECT *, f / t AS r FROM sr_total))"""


def base_ctes(p: Params) -> str:
    cut = hex_cut(p.test_fraction)
    return f"""
r AS (
  SELECT user_id AS userId, CAST(json_extract_string(props, '$.k') AS BIGINT) AS movieId,
         CAST(least(5.0, 1.0 + floor(max(value) / 20)) AS DOUBLE) AS rating
  FROM events
  WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL
  GROUP BY 1, 2),
tagged AS (
  SELECT userId, movieId, rating,
         CASE WHEN substr(md5(concat(CAST(userId AS VARCHAR), ':', CAST(movieId AS VARCHAR))), 1, 4) < '{cut}'
              THEN 'test' ELSE 'train' END AS split
  FROM r),
train AS (SELECT userId, movieId, rating FROM tagged WHERE split = 'train'),
test AS (SELECT userId, movieId, rating FROM tagged WHERE split = 'test'),
items AS (SELECT p_partkey AS movieId, p_name AS title FROM part),
sup AS (SELECT movieId FROM train GROUP BY movieId
        HAVING count(*) >= {p.min_ratings} AND sum(rating * rating) > 0),
tr AS (SELECT * FROM train WHERE movieId IN (SELECT movieId FROM sup)),
norms AS (SELECT movieId, sum(rating * rating) AS norm2 FROM tr GROUP BY movieId),
dots AS (
  SELECT a.movieId AS movie_i, b.movieId AS movie_j, sum(a.rating * b.rating) AS dot
  FROM tr a JOIN tr b ON a.userId = b.userId AND a.movieId < b.movieId
  GROUP BY 1, 2),
pairs AS (
  SELECT d.movie_i, d.movie_j, d.dot / sqrt(ni.norm2 * nj.norm2) AS cosine_similarity
  FROM dots d JOIN norms ni ON ni.movieId = d.movie_i JOIN norms nj ON nj.movieId = d.movie_j),
cand AS (SELECT * FROM pairs WHERE cosine_similarity > {dbl(p.min_cosine)}),
sym AS (
  SELECT movie_i, movie_j, cosine_similarity FROM cand
  UNION ALL SELECT movie_j AS movie_i, movie_i AS movie_j, cosine_similarity FROM cand),
neigh AS (
  SELECT movie_i, movie_j, cosine_similarity, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY movie_i ORDER BY round(cosine_similarity, 9) DESC, movie_j) AS rank
    FROM sym) WHERE rank <= {p.top_k}),
top_item AS (SELECT movieId FROM train GROUP BY movieId ORDER BY count(*) DESC, movieId LIMIT 1),
top_user AS (SELECT userId FROM r GROUP BY userId ORDER BY count(*) DESC, userId LIMIT 1),
users_tr AS (SELECT DISTINCT userId FROM train),
warm AS (SELECT * FROM test WHERE userId IN (SELECT userId FROM users_tr)),
expanded AS (
  SELECT w.userId, w.movieId AS target_movie, w.rating AS true_rating, n.movie_j AS neighbor_movie,
         n.cosine_similarity
  FROM warm w JOIN neigh n ON n.movie_i = w.movieId),
nrated AS (
  SELECT e.*, t.rating AS neighbor_rating
  FROM expanded e JOIN train t ON t.userId = e.userId AND t.movieId = e.neighbor_movie),
npred AS (
  SELECT userId, target_movie, true_rating,
         sum(cosine_similarity * neighbor_rating) / sum(cosine_similarity) AS predicted_rating,
         count(*) AS num_neighbors
  FROM nrated GROUP BY 1, 2, 3),
preds AS (
  SELECT w.userId, w.movieId, w.rating AS true_rating,
         coalesce(p.predicted_rating, {dbl(p.default_rating)}) AS predicted_rating,
         p.predicted_rating IS NULL AS is_fallback, coalesce(p.num_neighbors, 0) AS num_neighbors
  FROM warm w LEFT JOIN npred p ON p.userId = w.userId AND p.target_movie = w.movieId),
sim_cache AS (
  SELECT n.movie_i, ti.title AS title_i, n.movie_j, tj.title AS title_j, n.cosine_similarity
  FROM neigh n JOIN items ti ON ti.movieId = n.movie_i JOIN items tj ON tj.movieId = n.movie_j),
rc_cand AS (
  SELECT t.userId, n.movie_i, n.cosine_similarity, t.rating
  FROM train t JOIN neigh n ON n.movie_j = t.movieId),
rc_scores AS (
  SELECT userId, movie_i, sum(cosine_similarity * rating) / sum(cosine_similarity) AS score,
         count(*) AS num_neighbors
  FROM rc_cand GROUP BY 1, 2 HAVING count(*) >= {p.min_neighbors}),
rc_unseen AS (
  SELECT s.* FROM rc_scores s
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.userId = s.userId AND t.movieId = s.movie_i)),
recs AS (
  SELECT userId, movie_i AS movieId, title, score, num_neighbors, CAST(rank AS INTEGER) AS rank FROM (
    SELECT u.*, i.title,
           row_number() OVER (PARTITION BY u.userId ORDER BY round(u.score, 9) DESC, u.movie_i) AS rank
    FROM rc_unseen u JOIN items i ON i.movieId = u.movie_i)
  WHERE rank <= {p.user_top_n})"""


def q(p: Params, body: str, extra: str = "") -> str:
    return "WITH " + base_ctes(p) + ("," + extra if extra else "") + "\n" + body


# -- A ------------------------------------------------------------------------------------------

def load_ratings(p):
    return q(p, "SELECT userId, movieId, rating, CAST(NULL AS BIGINT) AS timestamp FROM r")


def load_items(p):
    return "SELECT p_partkey AS movieId, p_name AS title, CAST(NULL AS VARCHAR) AS genres FROM part"


def write_predictions(p):
    return q(p, """SELECT userId, movieId, round(true_rating, 6) AS true_rating,
       round(predicted_rating, 6) AS predicted_rating FROM preds""")


def cache_roundtrip(p):
    return q(p, """SELECT movie_i, title_i, movie_j, title_j, round(cosine_similarity, 6) AS cosine_similarity
FROM sim_cache""")


def recs_cache_roundtrip(p):
    return q(p, "SELECT userId, title, round(score, 6) AS score FROM recs")


def load_rating_folds(p):
    return """SELECT user_id AS userId, CAST(json_extract_string(props, '$.k') AS BIGINT) AS movieId,
       CAST(least(5, 1 + floor(value / 20)) AS DOUBLE) AS rating, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
       strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS "at"
FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL"""


def load_user_table(p):
    return """SELECT c_custkey AS user_id, CAST(c_nationkey AS INTEGER) AS age, substr(c_mktsegment, 1, 1) AS gender,
       c_mktsegment AS occupation, c_name AS zip FROM customer"""


def load_item_flags(p):
    flags = ", ".join(f"CASE WHEN p_size % {i + 1} = 0 THEN '{n.replace(chr(39), chr(39) * 2)}' END" for i, n in enumerate(GENRE_NAMES))
    return f"""SELECT p_partkey AS movieId, p_name || ' é' AS title, p_brand AS release_date, p_type AS url,
       concat_ws(',', {flags}) AS genres FROM part"""


def load_genres(p):
    return "SELECT n_name AS name, CAST(n_nationkey AS INTEGER) AS genre_id FROM nation"


def load_occupations(p):
    return "SELECT DISTINCT c_mktsegment AS occupation FROM customer"


def random_split_invariants(p):
    return q(p, "SELECT count(*) AS num_ratings, count(*) AS num_rows, CAST(0 AS BIGINT) AS overlap FROM r")


def lsh_bucket_invariants(p):
    return q(p, f"""SELECT CAST(t.t AS INTEGER) AS hash_table, count(*) AS num_rows, count(DISTINCT s.movieId) AS num_items,
       true AS in_range FROM sup s, generate_series(0, {p.num_hash_tables - 1}) t(t) GROUP BY t.t""")


def filter_titles(p):
    return q(p, f"""SELECT DISTINCT movie_i AS movieId, title_i AS title FROM sim_cache
WHERE contains(lower(title_i), '{W.SEARCH_QUERY.lower()}')""")


def append_metrics(p):
    row = f"""SELECT 'events' AS dataset,
       round(sqrt(avg((predicted_rating - true_rating) * (predicted_rating - true_rating))), 6) AS rmse,
       round(avg(abs(predicted_rating - true_rating)), 6) AS mae,
       {dbl(p.bucket_length)} AS bucketLength, CAST({p.num_hash_tables} AS INTEGER) AS numHashTables,
       {dbl(p.threshold)} AS threshold, CAST({p.top_k} AS INTEGER) AS top_k,
       '{W.RUN_STAMP}' AS timestamp
FROM preds"""
    return q(p, f"{row}\nUNION ALL\n{row}")


# -- B ------------------------------------------------------------------------------------------

def dataset_stats(p):
    return q(p, """SELECT count(*) AS num_ratings, count(DISTINCT userId) AS num_users,
       count(DISTINCT movieId) AS num_items, round(avg(rating), 6) AS avg_rating FROM r""")


def rating_distribution(p):
    return q(p, "SELECT rating, count(*) AS num_ratings FROM r GROUP BY rating")


def split_stats(p):
    return q(p, """SELECT split, count(*) AS num_ratings, count(DISTINCT userId) AS num_users,
       count(DISTINCT movieId) AS num_items, round(avg(rating), 6) AS avg_rating FROM tagged GROUP BY split""")


def most_rated_items(p):
    return q(p, """SELECT movieId, count(*) AS num_ratings FROM train GROUP BY movieId
ORDER BY num_ratings DESC, movieId LIMIT 10""")


def most_rated_item(p):
    return q(p, """SELECT movieId, count(*) AS num_ratings FROM train GROUP BY movieId
ORDER BY num_ratings DESC, movieId LIMIT 1""")


def item_title(p):
    return q(p, "SELECT movieId, title FROM items WHERE movieId IN (SELECT movieId FROM top_item)")


def sample_rows(p):
    return q(p, f"""SELECT userId, movieId, rating FROM train
ORDER BY md5(concat('{p.seed}', ':', CAST(userId AS VARCHAR), ':', CAST(movieId AS VARCHAR))) LIMIT 5""")


def supported_item_count(p):
    return q(p, f"""SELECT count(*) AS num_items FROM (
  SELECT movieId FROM train GROUP BY movieId HAVING count(*) >= {p.min_ratings})""")


def _histogram(p, expr: str, col: str) -> str:
    bins = W.HIST_BINS
    return q(p, f"""SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * (hi - lo) / {bins}, 8) AS bin_start,
       round(lo + (g.bin + 1) * (hi - lo) / {bins}, 8) AS bin_end, count(v.b) AS num_values
FROM generate_series(0, {bins - 1}) g(bin)
JOIN (SELECT min(round({expr}, 6)) AS lo, max(round({expr}, 6)) AS hi FROM preds) m ON lo IS NOT NULL
LEFT JOIN (
  SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) END AS b
  FROM (SELECT round({expr}, 6) AS x FROM preds) v,
       (SELECT min(round({expr}, 6)) AS lo, max(round({expr}, 6)) AS hi FROM preds) m
  WHERE x IS NOT NULL) v ON v.b = g.bin
GROUP BY g.bin, lo, hi""")


def true_rating_histogram(p):
    return _histogram(p, "true_rating", "true_rating")


def prediction_histogram(p):
    return _histogram(p, "predicted_rating", "predicted_rating")


def error_histogram(p):
    return _histogram(p, "predicted_rating - true_rating", "error")


# -- C ------------------------------------------------------------------------------------------

def hash_split(p):
    return q(p, "SELECT userId, movieId, rating, split FROM tagged")


def kfold_assign(p):
    k = W.KFOLDS
    return q(p, f"""SELECT userId, movieId, rating, CAST(floor(pos * {k} / n) AS INTEGER) + 1 AS fold FROM (
  SELECT *, row_number() OVER (ORDER BY userId, movieId) - 1 AS pos, count(*) OVER () AS n FROM r)""")


def _leave_cte(p) -> str:
    return f"""
ln AS (SELECT userId, movieId, rating, row_number() OVER (PARTITION BY userId ORDER BY movieId) AS k FROM r)"""


def leave_n_out(p):
    return q(p, f"""SELECT userId, movieId, rating,
       CASE WHEN k BETWEEN {W.LEAVE_START} AND {W.LEAVE_STOP} THEN 'test' ELSE 'base' END AS split FROM ln""",
             _leave_cte(p))


def leave_n_out_capped(p):
    return q(p, f"""SELECT l.userId, l.movieId, l.rating,
       CASE WHEN c.userId IS NOT NULL THEN 'test' ELSE 'base' END AS split
FROM ln l LEFT JOIN (
  SELECT userId, movieId FROM ln WHERE k BETWEEN {W.LEAVE_START} AND {W.LEAVE_STOP}
  ORDER BY userId, movieId LIMIT {W.LEAVE_CAP}) c ON c.userId = l.userId AND c.movieId = l.movieId""",
             _leave_cte(p))


def cross_validate(p):
    k = W.KFOLDS
    extra = f"""
cv_pos AS (
  SELECT userId, movieId, rating,
         row_number() OVER (ORDER BY md5(concat('{p.seed}', ':', CAST(userId AS VARCHAR), ':',
                                                CAST(movieId AS VARCHAR))), userId, movieId) - 1 AS pos,
         count(*) OVER () AS n
  FROM r),
cv_fold AS (SELECT userId, movieId, rating, CAST(floor(pos * {k} / n) AS INTEGER) + 1 AS fold FROM cv_pos),
cv_roles AS (
  SELECT f.userId, f.movieId, f.rating, CAST(c.cv AS INTEGER) AS cv,
         CASE WHEN c.cv = f.fold THEN 'test' ELSE 'train' END AS role
  FROM cv_fold f CROSS JOIN (SELECT range + 1 AS cv FROM range({k})) c),
cv_train AS (SELECT cv, userId, movieId, rating FROM cv_roles WHERE role = 'train'),
cv_test AS (SELECT cv, userId, movieId, rating FROM cv_roles WHERE role = 'test'),
cv_sup AS (SELECT cv, movieId FROM cv_train GROUP BY cv, movieId
           HAVING count(*) >= {p.min_ratings} AND sum(rating * rating) > 0),
cv_tr AS (SELECT t.* FROM cv_train t JOIN cv_sup s ON s.cv = t.cv AND s.movieId = t.movieId),
cv_norms AS (SELECT cv, movieId, sum(rating * rating) AS norm2 FROM cv_tr GROUP BY 1, 2),
cv_dots AS (
  SELECT a.cv, a.movieId AS movie_i, b.movieId AS movie_j, sum(a.rating * b.rating) AS dot
  FROM cv_tr a JOIN cv_tr b ON a.cv = b.cv AND a.userId = b.userId AND a.movieId < b.movieId
  GROUP BY 1, 2, 3),
cv_pairs AS (
  SELECT d.cv, d.movie_i, d.movie_j, d.dot / sqrt(ni.norm2 * nj.norm2) AS cosine_similarity
  FROM cv_dots d JOIN cv_norms ni ON ni.cv = d.cv AND ni.movieId = d.movie_i
                 JOIN cv_norms nj ON nj.cv = d.cv AND nj.movieId = d.movie_j),
cv_cand AS (SELECT * FROM cv_pairs WHERE cosine_similarity > {dbl(p.min_cosine)}),
cv_sym AS (
  SELECT cv, movie_i, movie_j, cosine_similarity FROM cv_cand
  UNION ALL SELECT cv, movie_j, movie_i, cosine_similarity FROM cv_cand),
cv_neigh AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cv, movie_i ORDER BY round(cosine_similarity, 9) DESC, movie_j) AS rank
    FROM cv_sym) WHERE rank <= {p.top_k}),
cv_warm AS (
  SELECT * FROM cv_test t
  WHERE EXISTS (SELECT 1 FROM cv_train x WHERE x.cv = t.cv AND x.userId = t.userId)),
cv_np AS (
  SELECT w.cv, w.userId, w.movieId, w.rating,
         sum(n.cosine_similarity * x.rating) / sum(n.cosine_similarity) AS pr
  FROM cv_warm w JOIN cv_neigh n ON n.cv = w.cv AND n.movie_i = w.movieId
       JOIN cv_train x ON x.cv = w.cv AND x.userId = w.userId AND x.movieId = n.movie_j
  GROUP BY 1, 2, 3, 4),
cv_preds AS (
  SELECT w.cv, w.rating AS true_rating, coalesce(p.pr, {dbl(p.default_rating)}) AS predicted_rating,
         p.pr IS NULL AS is_fallback
  FROM cv_warm w LEFT JOIN cv_np p ON p.cv = w.cv AND p.userId = w.userId AND p.movieId = w.movieId)"""
    return q(p, """SELECT cv,
       round(sqrt(avg((predicted_rating - true_rating) * (predicted_rating - true_rating))), 6) AS rmse,
       round(avg(abs(predicted_rating - true_rating)), 6) AS mae, count(*) AS num_predictions,
       round(CAST(100 AS DOUBLE) * count_if(NOT is_fallback) / count(*), 6) AS coverage
FROM cv_preds GROUP BY cv""", extra)


# -- D ------------------------------------------------------------------------------------------

_UI = """
ui AS (SELECT userId, CAST(row_number() OVER (ORDER BY userId) - 1 AS INTEGER) AS user_idx
       FROM (SELECT DISTINCT userId FROM train)),
ui_sup AS (SELECT userId, CAST(row_number() OVER (ORDER BY userId) - 1 AS INTEGER) AS user_idx
           FROM (SELECT DISTINCT userId FROM tr))"""


def user_index(p):
    return q(p, "SELECT userId, user_idx FROM ui", _UI)


def indexed_ratings(p):
    return q(p, "SELECT t.userId, t.movieId, t.rating, u.user_idx FROM train t JOIN ui u ON u.userId = t.userId",
             _UI)


def item_profiles(p):
    return q(p, """SELECT t.movieId, list(u.user_idx ORDER BY u.user_idx) AS user_idx_list,
       list(t.rating ORDER BY u.user_idx) AS rating_list, count(*) AS num_ratings
FROM train t JOIN ui u ON u.userId = t.userId GROUP BY t.movieId""", _UI)


def supported_items(p):
    return q(p, f"""SELECT movieId, count(*) AS num_ratings, sum(rating * rating) AS norm2 FROM train
GROUP BY movieId HAVING count(*) >= {W.SUPPORT_FLOOR} AND sum(rating * rating) > 0""")


def item_vectors(p):
    return q(p, "SELECT t.movieId, u.user_idx, t.rating AS value FROM tr t JOIN ui_sup u ON u.userId = t.userId",
             _UI)


def normalized_profiles(p):
    return q(p, """SELECT t.movieId, t.userId, round(t.rating / sqrt(n.norm2), 6) AS weight
FROM tr t JOIN norms n ON n.movieId = t.movieId""")


# -- E ------------------------------------------------------------------------------------------

def lsh_similar_pairs(p):
    cut = 1.0 - W.LSH_THRESHOLD * W.LSH_THRESHOLD / 2.0
    return q(p, f"""SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM pairs
WHERE cosine_similarity > {dbl(cut)}""")


def join_distance_to_cosine(p):
    cut = 1.0 - W.LSH_THRESHOLD * W.LSH_THRESHOLD / 2.0
    return q(p, f"""SELECT movie_i, movie_j, round(sqrt(greatest(0.0, 2.0 - 2.0 * cosine_similarity)), 6) AS distance,
       round(cosine_similarity, 6) AS cosine_similarity FROM pairs WHERE cosine_similarity > {dbl(cut)}""")


def distance_to_cosine(p):
    return q(p, """SELECT movie_i, movie_j, round(d, 6) AS distance, round(1.0 - d * d / 2.0, 6) AS cosine_similarity
FROM (SELECT movie_i, movie_j, sqrt(greatest(0.0, 2.0 - 2.0 * cosine_similarity)) AS d FROM cand)""")


def exact_cosine_pairs(p):
    return q(p, "SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM pairs")


def projection_buckets(p):
    return q(p, "SELECT movieId, band, bucket FROM pj_sig", sig_ctes("pj", W.PROJ_BANDS, W.PROJ_BITS, p.seed))


def projection_similar_pairs(p):
    return q(p, """SELECT c.movie_i, c.movie_j, k.first_table, round(c.cosine_similarity, 6) AS cosine_similarity
FROM cand c JOIN pj_cands k ON k.movie_i = c.movie_i AND k.movie_j = c.movie_j""",
             sig_ctes("pj", W.PROJ_BANDS, W.PROJ_BITS, p.seed))


def lsh_topk_neighbors(p):
    return f"""WITH {_lineitem_pairs("l_partkey")},{probe_ctes("mp", "lr", W.PROBE_BANDS, W.PART_BUCKET, W.PROBES, p.seed)},
lk AS (SELECT lp.* FROM lp JOIN mp_cands c ON c.movie_i = lp.movie_i AND c.movie_j = lp.movie_j),
ls AS (SELECT movie_i, movie_j, cosine_similarity FROM lk UNION ALL SELECT movie_j, movie_i, cosine_similarity FROM lk)
SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY movie_i ORDER BY round(cosine_similarity, 9) DESC, movie_j) AS rank FROM ls)
WHERE rank <= {p.top_k}"""


def lsh_metrics(p):
    extra = probe_ctes("mp", "tr", W.PROBE_BANDS, W.EVENT_BUCKET, W.PROBES, p.seed) + f""",
mp_pairs AS (SELECT c.* FROM cand c JOIN mp_cands m ON m.movie_i = c.movie_i AND m.movie_j = c.movie_j),
mp_sym AS (SELECT movie_i, movie_j, cosine_similarity FROM mp_pairs UNION ALL SELECT movie_j, movie_i, cosine_similarity FROM mp_pairs),
mp_neigh AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_i ORDER BY round(cosine_similarity, 9) DESC, movie_j) AS rank FROM mp_sym)
  WHERE rank <= {p.top_k}),
mp_np AS (
  SELECT w.userId, w.movieId, sum(n.cosine_similarity * t.rating) / sum(n.cosine_similarity) AS pr
  FROM warm w JOIN mp_neigh n ON n.movie_i = w.movieId JOIN train t ON t.userId = w.userId AND t.movieId = n.movie_j GROUP BY 1, 2),
mp_preds AS (
  SELECT w.rating AS true_rating, coalesce(n.pr, {dbl(p.default_rating)}) AS predicted_rating, n.pr IS NULL AS is_fallback
  FROM warm w LEFT JOIN mp_np n ON n.userId = w.userId AND n.movieId = w.movieId)"""
    return q(p, f"""SELECT round(sqrt(avg({_ERR} * {_ERR})), 6) AS rmse, round(avg(abs({_ERR})), 6) AS mae, count(*) AS num_predictions,
       round(CAST(100 AS DOUBLE) * count_if(NOT is_fallback) / count(*), 6) AS coverage,
       (SELECT round(count(m.movie_i) / count(*), 6) FROM neigh n LEFT JOIN mp_neigh m ON m.movie_i = n.movie_i AND m.movie_j = n.movie_j) AS recall,
       (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM mp_sig GROUP BY band, bucket)) AS pairs
FROM mp_preds""", extra)


def gaussian_buckets(p):
    return q(p, "SELECT bucketLength, movieId, hash_table, bucket FROM ga_buckets",
             gaussian_ctes("ga", "tr", p.num_hash_tables, W.FINE_LENGTHS, p.seed))


def lsh_recall_sampled(p):
    b = W.RECALL_BANDS
    return q(p, sampled_select(), sig_ctes("rs", b, 1, p.seed) + "," + sampled_ctes("tr", "sym", "rs_sig", b, W.RECALL_SAMPLE, p.seed))


def part_recall_sampled(p):
    b = W.RECALL_BANDS
    return f"""WITH {_lineitem_pairs("l_partkey")},{probe_ctes("mp", "lr", b, W.PART_BUCKET, W.PROBES, p.seed)},
ls AS (SELECT movie_i, movie_j FROM lp WHERE cosine_similarity > {dbl(W.PREFIX_COSINE)}
       UNION ALL SELECT movie_j, movie_i FROM lp WHERE cosine_similarity > {dbl(W.PREFIX_COSINE)}),{sampled_ctes("lr", "ls", "mp_sig", b, W.PART_SAMPLE, p.seed)}
{sampled_select()}"""


def lsh_recall(p):
    b = W.RECALL_BANDS
    return q(p, f"""SELECT CAST(g.t AS INTEGER) AS num_tables, CAST(count_if(j.first_table < g.t) AS BIGINT) AS found_pairs,
       count(*) AS exact_pairs, round(count_if(j.first_table < g.t) / count(*), 6) AS recall
FROM (SELECT c.movie_i, c.movie_j, k.first_table FROM cand c
      LEFT JOIN rc7_cands k ON k.movie_i = c.movie_i AND k.movie_j = c.movie_j) j
CROSS JOIN (SELECT range + 1 AS t FROM range({b})) g
GROUP BY g.t""", sig_ctes("rc7", b, 1, p.seed))


def symmetric_pairs(p):
    return q(p, "SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM sym")


def topk_neighbors(p):
    return q(p, "SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity, rank FROM neigh")


def _lineitem_pairs(item_col: str) -> str:
    return f"""
lr AS (
  SELECT o.o_custkey AS userId, l.{item_col} AS movieId, CAST(ceil(max(l.l_quantity) / 10) AS DOUBLE) AS rating
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2),
ln AS (SELECT movieId, sum(rating * rating) AS norm2 FROM lr GROUP BY movieId),
ld AS (
  SELECT a.movieId AS movie_i, b.movieId AS movie_j, sum(a.rating * b.rating) AS dot
  FROM lr a JOIN lr b ON a.userId = b.userId AND a.movieId < b.movieId GROUP BY 1, 2),
lp AS (
  SELECT d.movie_i, d.movie_j, d.dot / sqrt(ni.norm2 * nj.norm2) AS cosine_similarity
  FROM ld d JOIN ln ni ON ni.movieId = d.movie_i JOIN ln nj ON nj.movieId = d.movie_j)"""


def supplier_cosine_pairs(p):
    return f"""WITH {_lineitem_pairs("l_suppkey")}
SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM lp
WHERE cosine_similarity > {dbl(p.min_cosine)}"""


supplier_threshold_pairs = supplier_cosine_pairs


def part_threshold_pairs(p):
    return f"""WITH {_lineitem_pairs("l_partkey")}
SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM lp
WHERE cosine_similarity > {dbl(W.PREFIX_COSINE)}"""


def prefix_join_work(p):
    t, slack = W.PREFIX_COSINE, 1e-9
    return f"""WITH {_lineitem_pairs("l_partkey")},
deg AS (SELECT userId, count(*) AS d FROM lr GROUP BY userId),
ordered AS (
  SELECT l.*, n.norm2, count(*) OVER (PARTITION BY l.movieId) AS n,
         n.norm2 - sum(l.rating * l.rating) OVER (PARTITION BY l.movieId ORDER BY length(bin(d.d)), md5(CAST(l.userId AS VARCHAR)), l.userId
                                                  ROWS UNBOUNDED PRECEDING) AS rest
  FROM lr l JOIN deg d ON d.userId = l.userId JOIN ln n ON n.movieId = l.movieId),
entries AS (SELECT *, rest + rating * rating >= {dbl(t * t - slack)} * norm2 AS inside FROM ordered),
its AS (SELECT movieId, any_value(norm2) AS norm2, any_value(n) AS n, count_if(NOT inside) AS tail, min(rest) FILTER (WHERE inside) AS over
        FROM entries GROUP BY movieId),
cands AS (
  SELECT a.movieId AS movie_i, b.movieId AS movie_j, sum(a.rating * b.rating) AS dot, min(a.rest * b.rest) AS behind
  FROM entries a JOIN entries b ON a.userId = b.userId AND a.movieId < b.movieId WHERE a.inside AND b.inside GROUP BY 1, 2),
opened AS (
  SELECT c.movie_i, c.movie_j, i.tail + j.tail > least(i.n, j.n) AS anew
  FROM cands c JOIN its i ON i.movieId = c.movie_i JOIN its j ON j.movieId = c.movie_j
  WHERE c.dot + least(sqrt(c.behind), sqrt(greatest(i.over * j.norm2, j.over * i.norm2))) >= {dbl(t - slack)} * sqrt(i.norm2 * j.norm2)),
done AS (
  SELECT (SELECT sum(d * (d - 1) // 2) FROM (SELECT count_if(inside) AS d FROM entries GROUP BY userId))
         + (SELECT count(*) FROM opened o JOIN entries a ON a.movieId = o.movie_i JOIN entries b ON b.movieId = o.movie_j AND b.userId = a.userId
            WHERE o.anew OR NOT (a.inside AND b.inside)) AS done)
SELECT (SELECT count(*) FROM lr) AS ratings, (SELECT count(*) FROM entries WHERE inside) AS indexed, (SELECT count(*) FROM cands) AS candidates,
       (SELECT count(*) FROM opened) AS completed, CAST(done AS BIGINT) AS products_done,
       CAST((SELECT sum(d * (d - 1) // 2) FROM deg) - done AS BIGINT) AS products_pruned
FROM done"""


def part_topk_neighbors(p):
    return f"""WITH {_lineitem_pairs("l_partkey")},
ls AS (SELECT movie_i, movie_j, cosine_similarity FROM lp
       UNION ALL SELECT movie_j, movie_i, cosine_similarity FROM lp)
SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY movie_i ORDER BY round(cosine_similarity, 9) DESC, movie_j) AS rank FROM ls)
WHERE rank <= {p.top_k}"""


topk_neighbors_striped = part_topk_neighbors


def embedding_cosine_pairs(p):
    return f"""WITH
e AS (SELECT vec_id AS movieId, CAST(unnest(embedding) AS DOUBLE) AS v,
             generate_subscripts(embedding, 1) AS d FROM embeddings),
en AS (SELECT movieId, sum(v * v) AS norm2 FROM e GROUP BY movieId),
ed AS (SELECT a.movieId AS movie_i, b.movieId AS movie_j, sum(a.v * b.v) AS dot
       FROM e a JOIN e b ON a.d = b.d AND a.movieId < b.movieId AND a.v <> 0 AND b.v <> 0 GROUP BY 1, 2)
SELECT movie_i, movie_j, round(cosine_similarity, 6) AS cosine_similarity FROM (
  SELECT ed.movie_i, ed.movie_j, ed.dot / sqrt(ni.norm2 * nj.norm2) AS cosine_similarity
  FROM ed JOIN en ni ON ni.movieId = ed.movie_i JOIN en nj ON nj.movieId = ed.movie_j)
WHERE cosine_similarity > {dbl(p.min_cosine)}"""


# -- F ------------------------------------------------------------------------------------------

def similar_items(p):
    return q(p, f"""SELECT n.movie_j, i.title, round(n.cosine_similarity, 6) AS cosine_similarity
FROM neigh n JOIN items i ON i.movieId = n.movie_j
WHERE n.movie_i = (SELECT movieId FROM top_item)
ORDER BY round(n.cosine_similarity, 9) DESC, n.movie_j
LIMIT {p.similar_k}""")


def similar_items_bulk(p):
    return q(p, f"""SELECT movie_i, CAST(rk AS INTEGER) AS rank, movie_j, title,
       round(cosine_similarity, 6) AS cosine_similarity FROM (
  SELECT n.movie_i, n.movie_j, i.title, n.cosine_similarity,
         row_number() OVER (PARTITION BY n.movie_i ORDER BY round(n.cosine_similarity, 9) DESC, n.movie_j) AS rk
  FROM neigh n JOIN items i ON i.movieId = n.movie_j)
WHERE rk <= {p.similar_k}""")


# -- G ------------------------------------------------------------------------------------------

def warm_test_ratings(p):
    return q(p, "SELECT userId, movieId, rating FROM warm")


def neighbor_expansion(p):
    return q(p, """SELECT userId, target_movie, true_rating, neighbor_movie,
       round(cosine_similarity, 6) AS cosine_similarity FROM expanded""")


def neighbor_ratings(p):
    return q(p, """SELECT userId, target_movie, true_rating, neighbor_movie,
       round(cosine_similarity, 6) AS cosine_similarity, neighbor_rating FROM nrated""")


bucketed_neighbor_ratings = neighbor_ratings


def neighbor_predictions(p):
    return q(p, """SELECT userId, target_movie, true_rating, round(predicted_rating, 6) AS predicted_rating,
       num_neighbors FROM npred""")


def final_predictions(p):
    return q(p, """SELECT userId, movieId, true_rating, round(predicted_rating, 6) AS predicted_rating,
       is_fallback, num_neighbors FROM preds""")


def user_recommendations(p):
    return q(p, "SELECT userId, movieId, title, round(score, 6) AS score, num_neighbors, rank FROM recs")


# -- H ------------------------------------------------------------------------------------------

_ERR = "(predicted_rating - true_rating)"


def prediction_metrics(p):
    return q(p, f"""SELECT round(sqrt(avg({_ERR} * {_ERR})), 6) AS rmse, round(avg(abs({_ERR})), 6) AS mae,
       count(*) AS num_predictions FROM preds""")


def prediction_coverage(p):
    d = dbl(p.default_rating)
    return q(p, f"""SELECT count(*) AS num_predictions, CAST(count_if(NOT is_fallback) AS BIGINT) AS num_from_neighbors,
       CAST(count_if(predicted_rating <> {d}) AS BIGINT) AS num_not_default,
       round(CAST(100 AS DOUBLE) * count_if(NOT is_fallback) / count(*), 6) AS coverage,
       round(CAST(100 AS DOUBLE) * count_if(predicted_rating <> {d}) / count(*), 6) AS coverage_compat
FROM preds""")


def error_stats(p):
    return q(p, f"""SELECT round(avg({_ERR}), 6) AS mean_error, round(stddev_samp({_ERR}), 6) AS std_error,
       round(avg(abs({_ERR})), 6) AS mae, round(sqrt(avg({_ERR} * {_ERR})), 6) AS rmse FROM preds""")


def true_vs_predicted(p):
    return q(p, """SELECT true_rating, round(round(predicted_rating, 6), 1) AS predicted_bin,
       count(*) AS num_predictions FROM preds GROUP BY 1, 2""")


def _sweep(p, tables, thresholds, top_ks, bucket_lengths):
    """Every setting the plain way.  ``len`` is a bucketLength below 1, or -1 for all others (sign buckets)."""
    fine, coarse = [x for x in bucket_lengths if x < 1], [x for x in bucket_lengths if x >= 1]
    min_cut = min(1.0 - t * t / 2.0 for t in thresholds)
    tv = ", ".join(f"({t})" for t in tables)
    sv = ", ".join(f"({dbl(t)}, {k}, {dbl(1.0 - t * t / 2.0)})" for t in thresholds for k in top_ks)
    lens = ", ".join(f"({dbl(float(x))}, {dbl(float(x if x < 1 else -1))})" for x in bucket_lengths)
    extra = sig_ctes("sw", max(tables), 1, p.seed) + ","
    cands = ["SELECT -1.0::DOUBLE AS len, movie_i, movie_j, first_table FROM sw_cands"] if coarse else []
    if fine:
        extra += gaussian_ctes("sg", "tr", max(tables), fine, p.seed) + ","
        cands.append("SELECT len, movie_i, movie_j, first_table FROM sg_cands")
    extra += f"""
lens AS (SELECT * FROM (VALUES {lens}) v(bucketLength, len)),
all_cands AS ({" UNION ALL ".join(cands)}),
sw_pairs AS (
  SELECT k.len, c.movie_i, c.movie_j, k.first_table, c.cosine_similarity
  FROM pairs c JOIN all_cands k ON k.movie_i = c.movie_i AND k.movie_j = c.movie_j
  WHERE c.cosine_similarity > {dbl(min_cut)}),
sw_sym AS (
  SELECT len, movie_i, movie_j, first_table, cosine_similarity FROM sw_pairs
  UNION ALL SELECT len, movie_j, movie_i, first_table, cosine_similarity FROM sw_pairs),
tv AS (SELECT l.len, v.num_tables FROM (VALUES {tv}) v(num_tables) CROSS JOIN (SELECT DISTINCT len FROM lens) l),
sw_rank AS (
  SELECT * FROM (
    SELECT s.*, tv.num_tables,
           row_number() OVER (PARTITION BY tv.len, tv.num_tables, s.movie_i
                              ORDER BY round(s.cosine_similarity, 9) DESC, s.movie_j) AS rank
    FROM sw_sym s JOIN tv ON s.len = tv.len AND s.first_table < tv.num_tables)
  WHERE rank <= {max(top_ks)}),
sw_rated AS (
  SELECT t.len, t.num_tables, w.userId, w.movieId, w.rating, n.cosine_similarity, n.rank, x.rating AS r2
  FROM warm w CROSS JOIN tv t
  LEFT JOIN sw_rank n ON n.len = t.len AND n.num_tables = t.num_tables AND n.movie_i = w.movieId
  LEFT JOIN train x ON x.userId = w.userId AND x.movieId = n.movie_j),
settings AS (SELECT * FROM (VALUES {sv}) s(threshold, top_k, cut)),
sw_pred AS (
  SELECT r.len, r.num_tables, r.userId, r.movieId, r.rating, s.threshold, s.top_k,
         sum(CASE WHEN r.r2 IS NOT NULL AND r.rank <= s.top_k AND r.cosine_similarity > s.cut
                  THEN r.cosine_similarity * r.r2 END)
         / sum(CASE WHEN r.r2 IS NOT NULL AND r.rank <= s.top_k AND r.cosine_similarity > s.cut
                    THEN r.cosine_similarity END) AS pr
  FROM sw_rated r CROSS JOIN settings s
  GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
    d = dbl(p.default_rating)
    return q(p, f"""SELECT lens.bucketLength, CAST(num_tables AS INTEGER) AS numHashTables, threshold, CAST(top_k AS INTEGER) AS top_k,
       round(sqrt(avg((coalesce(pr, {d}) - rating) * (coalesce(pr, {d}) - rating))), 6) AS rmse,
       round(avg(abs(coalesce(pr, {d}) - rating)), 6) AS mae,
       round(CAST(100 AS DOUBLE) * count_if(pr IS NOT NULL) / count(*), 6) AS coverage,
       count(*) AS num_predictions
FROM sw_pred JOIN lens ON lens.len = sw_pred.len GROUP BY lens.bucketLength, num_tables, threshold, top_k""", extra)


def parameter_sweep(p):
    return _sweep(p, (1, 3, 5, 7), (0.8, 1.0, 1.2), (10, 20, 30), (1.0, 2.0, 3.0, 4.0, 5.0))


def parameter_sweep_fine(p):
    return _sweep(p, **W.FINE_SWEEP)


# -- I ------------------------------------------------------------------------------------------

def user_ids(p):
    return q(p, "SELECT DISTINCT userId FROM r")


def user_history(p):
    return q(p, """SELECT r.userId, r.movieId, i.title, r.rating FROM r JOIN items i ON i.movieId = r.movieId
WHERE r.userId = (SELECT userId FROM top_user)""")


def user_profile_stats(p):
    return q(p, """SELECT round(coalesce(avg(r.rating), 0.0), 6) AS avg_rating, count(*) AS total_ratings
FROM r JOIN items i ON i.movieId = r.movieId WHERE r.userId = (SELECT userId FROM top_user)""")


def recommendations_for_user(p):
    return q(p, f"""SELECT userId, CAST(rk AS INTEGER) AS rank, title, round(score, 6) AS score,
       CAST(greatest(95 - 5 * (rk - 1), 75) AS INTEGER) AS confidence FROM (
  SELECT userId, title, score, row_number() OVER (PARTITION BY userId ORDER BY round(score, 9) DESC, title) AS rk
  FROM recs WHERE userId = (SELECT userId FROM top_user))
WHERE rk <= {p.user_top_n}""")


def item_catalog(p):
    return q(p, "SELECT DISTINCT movie_i AS movieId, title_i AS title FROM sim_cache")


def seed_recommendations(p):
    n = W.SEED_PAGE_N
    extra = f"""
seeds AS (SELECT DISTINCT i.title FROM (
  SELECT movieId FROM train GROUP BY movieId ORDER BY count(*) DESC, movieId LIMIT {W.SEED_BASKET_ITEMS}) t
  JOIN items i ON i.movieId = t.movieId),
sr AS (
  SELECT movie_j, title_j, sum(cosine_similarity) AS score FROM sim_cache
  WHERE title_i IN (SELECT title FROM seeds) GROUP BY 1, 2),
srt AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, movie_j) AS rk
    FROM sr WHERE title_j NOT IN (SELECT title FROM seeds))
  WHERE rk <= {n})"""
    return q(p, """SELECT CAST(rk AS INTEGER) AS rank, movie_j, title_j, round(score, 6) AS score,
       CAST(CASE WHEN max(score) OVER () > 0 THEN round(score / max(score) OVER () * 100) ELSE 0 END AS INTEGER)
         AS relative_score
FROM srt""", extra)


def search_items(p):
    return q(p, f"""SELECT movieId, title FROM (SELECT DISTINCT movie_i AS movieId, title_i AS title FROM sim_cache)
WHERE contains(lower(title), '{W.SEARCH_QUERY.lower()}')
ORDER BY title, movieId LIMIT {p.search_limit}""")


def search_titles_bulk(p):
    return q(p, """SELECT w.query, i.movieId, i.title
FROM (SELECT DISTINCT query FROM (SELECT unnest(string_split(title, ' ')) AS query FROM items) WHERE query <> '') w
JOIN items i ON contains(lower(i.title), lower(w.query))""")


def seed_recommendations_bulk(p):
    n = W.SEED_PAGE_N
    extra = f"""
bk AS (
  SELECT DISTINCT t.userId AS basket_id, i.title FROM train t JOIN items i ON i.movieId = t.movieId),
bh AS (
  SELECT b.basket_id, s.movie_j, s.title_j, sum(s.cosine_similarity) AS score
  FROM sim_cache s JOIN bk b ON b.title = s.title_i GROUP BY 1, 2, 3),
bt AS (
  SELECT * FROM (
    SELECT h.*, row_number() OVER (PARTITION BY h.basket_id ORDER BY round(h.score, 9) DESC, h.movie_j) AS rk
    FROM bh h
    WHERE NOT EXISTS (SELECT 1 FROM bk b WHERE b.basket_id = h.basket_id AND b.title = h.title_j))
  WHERE rk <= {n})"""
    return q(p, """SELECT basket_id, CAST(rk AS INTEGER) AS rank, movie_j, title_j, round(score, 6) AS score,
       CAST(CASE WHEN max(score) OVER (PARTITION BY basket_id) > 0
                 THEN round(score / max(score) OVER (PARTITION BY basket_id) * 100) ELSE 0 END AS INTEGER)
         AS relative_score
FROM bt""", extra)
