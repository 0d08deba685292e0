"""The subpackage's registered queries: thin readers that derive the agreed columns from an
operator's output, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recsim.llm import bpe, lzprint, mixing, negatives, packing, pii, quality, simhash, spelling, substrings, toxicity, vectors, warc
from recsim.llm.common import read_table

#: What op13 takes runs of, and the letters that it lower-cases.
LETTERS, UPPER = r"[A-Za-z\u00C0-\u00FF]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def words_joined(text: Column) -> Column:
    """The words (runs of characters other than 0x20 and 0x09-0x0D) of a text, joined by one space."""
    flat = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    return F.regexp_replace(flat, "^ | $", "")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(read_table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of the SHA-1: 20 bits, five hex digits, make four letters.
SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL
), d AS (
  SELECT page_id, payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST((15 - 5 * (i % 4)) AS INT)) & 31) + 1 AS INT), 1)),
           'string_agg', '') AS payload_digest
  FROM p
), f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                  max_tokens=4096, end_id=1).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def _scored(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(fold(5) != 0))
    return _scored(toxicity.with_toxicity(docs.select("doc_id", "text"), model), fold(5) == 0)


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.where(fold(3) != 1))
    return _scored(quality.with_quality(docs.select("doc_id", "text"), model), fold(3) == 1)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.substring_dedup(docs, window=20)
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(words_joined(F.coalesce("kept_text", F.lit(""))))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


#: Every window's first start by (doc_id, position); words under a later start go.
SQL["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, pos, list_aggregate(words[pos:pos + 19], 'string_agg', ' ') AS body FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM r WHERE n > 1),
cut AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
         GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(cut.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])  # noqa: E731
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", told), ",").alias("spans"))


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.compare_with_next(read_table(spark, sf_dir, "documents"))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"), min_cosine=0.9)


#: Every pair, then everything reachable.
SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_dot_product(e, e) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
                       ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.n, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
least AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(links.n_links, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.n = v.vec_id LEFT JOIN links ON links.a = v.vec_id
"""


@query
def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0, scale=256)


#: Every score of every anchor, ranked.
SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 5
"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixing.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


#: The same schedule by windows over whole tables: streams in md5 order, golden-ratio points over the cumulative widths.
SQL["op12_source_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, source_size, 2 * source_size AS cap, no, CASE no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source))
), u(k, unit) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size) / sum(w) FROM s
  UNION ALL
  SELECT k + 1, (1.5::DOUBLE * sum(source_size) - coalesce(sum(CASE WHEN w * unit > cap THEN cap END), 0)) / sum(CASE WHEN w * unit > cap THEN 0 ELSE w END)
  FROM u, s WHERE k < 30 GROUP BY k
), t AS (
  SELECT s.*, least(w * unit, CAST(cap AS DOUBLE)) AS target, greatest(1, least(128, source_size // 1024)) AS bw FROM s, u WHERE k = 30
), b AS (
  SELECT *, (source_size + bw - 1) // bw AS blocks, CAST(floor(target * 65536 / bw) AS BIGINT) AS width FROM t
), laid AS (SELECT no, blocks, width, CAST(sum(width) OVER (ORDER BY no) - width AS BIGINT) AS low FROM b),
points AS (
  SELECT i AS slot, CAST((CAST(i + 1 AS HUGEINT) * 679535556991) % 1099511627776 AS DOUBLE) / 1099511627776 * whole AS x
  FROM (SELECT CAST(whole AS DOUBLE) AS whole, unnest(range((whole + 65535) // 65536)) AS i FROM (SELECT CAST(sum(width) AS BIGINT) AS whole FROM b))
), slots AS (
  SELECT no, blocks, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS r FROM points JOIN laid ON x >= low AND x < low + width
), each_block AS (
  SELECT no, blocks, p.pass, unnest(range(blocks)) AS block FROM b, (VALUES (0), (1)) p(pass)
), placed AS (
  SELECT no, pass, block, row_number() OVER (PARTITION BY no, pass ORDER BY md5(concat_ws(':', '1', no, pass, block))) - 1 AS place FROM each_block
), uses AS (
  SELECT placed.no, block, count(*) AS times FROM slots JOIN placed ON slots.no = placed.no AND r // blocks = pass AND r % blocks = place GROUP BY 1, 2
), streams AS (
  SELECT doc_id, size, source_size, target, no, bw,
         CAST(sum(size) OVER (PARTITION BY no ORDER BY md5(concat('1:', doc_id)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS f
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), spans AS (
  SELECT doc_id, no, bw, f, size, unnest(range(f // bw, (f + size - 1) // bw + 1)) AS block FROM streams WHERE size > 0
), got AS (
  SELECT doc_id, sum(times * (least(f + size, (spans.block + 1) * bw) - greatest(f, spans.block * bw))) AS taken
  FROM spans JOIN uses ON spans.no = uses.no AND spans.block = uses.block GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM streams LEFT JOIN got USING (doc_id)
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    run = F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    cut = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling.group_variants(runs.withColumn("h", h).select(word.alias("word")), least_length=5, least_n=3).select(
        "word", "form", "root", "n", "n_near", "form_n")
