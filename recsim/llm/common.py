"""Helpers shared by the text and vector operators of this subpackage."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsim.session import cut_lineage, ship_by_value

#: Rows of one side of a cell that a single comparison task takes.
CELL_ROWS = 4096

ship_by_value(__name__)


def ship(module_name: str) -> None:
    """Pickle a module's task functions by value (executors need not import the package)."""
    ship_by_value(module_name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built on ``names`` that clash with none of ``df`` (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add, in any letter case."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, y, text): one row for each id of ``known`` (doc_id, y; few, distinct) that ``docs`` holds.  Of rows
    that repeat an id the smallest text counts, a null one as empty; tasks reduce them before the shuffle."""
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
            .groupBy("doc_id", "y").agg(F.min("text").alias("text")))


def fan_out(df: DataFrame) -> int:
    """How many buckets to deal rows into: as many as the session's shuffle partitions,
    or as the input has partitions where those are more, so a bucket holds about one
    input partition at any size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


# ---------------------------------------------------------------- connected components

def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the links ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
        if np.array_equal(before, root):
            break
    return root


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is two aggregations with
    map-side minima and a join that AQE may split, and ends as a table in the shared
    checkpoint folder, so a lost executor costs one round.  Only two numbers per round
    reach the driver.  Empty links give no rows.
    """
    edges = (links.select(F.col(a).alias("u"), F.col(b).alias("v"))
             .where("u is not null and v is not null and u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges = cut_lineage(edges, "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        edges = cut_lineage(small, "links")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


# ---------------------------------------------------------------- joins inside cells

def cell_blocks(homes: DataFrame, guests: DataFrame, cell: str, key: str, rows: int = CELL_ROWS) -> DataFrame:
    """Both sides of a cell join, dealt into blocks of bounded size.

    ``homes`` and ``guests`` share their columns, among them ``cell`` and ``key``.  A cell
    with more than ``rows`` rows on a side is cut into parts by a hash of ``key``; every
    part of one side meets every part of the other, so each (home, guest) pair of a cell
    falls into exactly one block.  Adds ``guest`` (boolean) and the block's numbers
    ``part_h`` and ``part_g``; rows of a block share (cell, part_h, part_g).
    """
    both = homes.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    sizes = both.groupBy(cell).agg(
        F.ceil(F.count_if(~F.col("guest")) / rows).cast("int").alias("parts_h"),
        F.ceil(F.count_if(F.col("guest")) / rows).cast("int").alias("parts_g")).where("parts_h > 0 and parts_g > 0")
    dealt = both.join(sizes, cell)
    own = F.pmod(F.xxhash64(key), F.when(F.col("guest"), F.col("parts_g")).otherwise(F.col("parts_h"))).cast("int")
    across = F.when(F.col("guest"), F.col("parts_h")).otherwise(F.col("parts_g"))
    dealt = dealt.withColumn("own_part", own).withColumn("across", F.explode(F.sequence(F.lit(0), across - 1)))
    return (dealt.withColumn("part_h", F.when(F.col("guest"), F.col("across")).otherwise(F.col("own_part")))
            .withColumn("part_g", F.when(F.col("guest"), F.col("own_part")).otherwise(F.col("across")))
            .drop("parts_h", "parts_g", "own_part", "across"))


# ---------------------------------------------------------------- word hashing

_SLICE = 1 << 19
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def spark_xxhash64(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for a long: XXH64 of its eight bytes with seed 42.  For several
    columns Spark takes the hash of one as the seed of the next."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63),
                          u(0x27D4EB2F165667C5))
    turn = lambda v, n: (v << u(n)) | (v >> u(64 - n))
    x = np.asarray(x, np.int64).view(u)
    h = (np.asarray(seed, np.int64).view(u) + p5 + u(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return (h ^ (h >> u(32))).view(np.int64)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, _SLICE + 1)
        got = tuple(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))).cumprod(dtype=np.uint64)
                    for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = got
    return got


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of ``values[start:end]`` for each pair, from prefix sums."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start])


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space (0x20, 0x09-0x0D)."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, bases: tuple[int, ...] = _BASES) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of every word per base; works through slices, so memory stays near a few
    times the slice (or the longest word).  Words can be made that collide under every base: equal hashes
    are a hint, not a proof."""
    out: tuple[list, ...] = tuple([] for _ in bases)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        lo = int(starts[i])
        piece = np.frombuffer(data, np.uint8, int(ends[j - 1]) - lo, lo).astype(np.uint64) + np.uint64(1)
        for got, base in zip(out, bases):
            got.append(spans_hash(piece, starts[i:j] - lo, ends[i:j] - lo, base))
        i = j
    return tuple(np.concatenate(got) if got else np.zeros(0, np.uint64) for got in out)


assert sys.byteorder == "little"
