"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits; bit b is set when more than half of the XXH64 values (seed 42,
unsigned) of the text's word shingles have it set.

Links: the anchors are the words of a product covering code.  The 64 bits are cut into
``blocks`` runs; a run's code is the repetition code, so a fingerprint's nearest anchor (its
home) has, in each run, the majority bit of that run, and the covering radius is the sum
of half the run lengths.  Every fingerprint is replicated to each anchor that is the home
of any word within ``max_bits`` of it.  These are the anchors within covering radius plus
threshold that can matter: an anchor that needs more than ``max_bits`` flipped bits to become
the home is further away than any partner's home.  Two fingerprints that differ in at most
``max_bits`` bits therefore meet at the home of either, and each anchor is compared by itself.

Memory: an anchor's homes and guests are dealt into blocks of bounded size; a block gives
back a spanning forest of its links (at most one row per fingerprint in it), never the
pairs.  Equal fingerprints are collapsed before, so copies cost one row per group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import cell_blocks, components, cut_lineage, fan_out, fresh, local_roots, ship, without

#: log2 of the number of anchors; cells hold (rows x replicas / 2**BLOCKS) fingerprints.
BLOCKS = 13
#: A fingerprint of more than 1 / (HOT x partitions) of the rows is joined by broadcast; at most HOT x partitions are.
HOT = 4

ship(__name__)
_U = np.uint64


def fingerprint(data: bytes, words: int = 3, chunk: int = 1 << 15) -> int:
    """SimHash of one text (UTF-8 bytes): A-Z lower-cased, words are runs of bytes other than
    0x20 and 0x09-0x0D, shingles of ``words`` words joined by one space, repeats included.
    Fewer words: the whole sequence is the one shingle.  No word: zero."""
    flat = b" ".join(data.lower().split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(flat)]))
    if len(starts) > words:
        starts, ends = starts[:len(starts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), chunk):
        h = np.array([digest(flat[s:e], 42) for s, e in zip(starts[i:i + chunk].tolist(), ends[i:i + chunk].tolist())], _U)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(_U)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 3, out: str = "fingerprint") -> DataFrame:
    """``docs`` plus ``out`` (long, the fingerprint's 64 bits as a signed number)."""
    @F.pandas_udf("long")
    def prints(texts):
        return texts.map(lambda t: np.int64(np.uint64(fingerprint((t or "").encode(), words)).astype(np.int64)))

    return without(docs, out).withColumn(out, prints(F.coalesce(F.col(text), F.lit(""))))


def _runs(blocks: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _homes_and_guests(fps: np.ndarray, blocks: int, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint, row of each replica, anchor of each replica).

    A run's majority flips at a known number of changed bits, so the replicas are the sets
    of runs whose costs add up to at most ``max_bits``."""
    home = np.zeros(len(fps), np.int64)
    cost = np.empty((blocks, len(fps)), np.int64)
    for k, (at, size) in enumerate(_runs(blocks)):
        weight = np.bitwise_count((fps >> _U(at)) & _U((1 << size) - 1)).astype(np.int64)
        major = 2 * weight > size
        home |= major.astype(np.int64) << k
        need = size // 2 + 1
        cost[k] = np.where(major, weight - need + 1, need - weight)
    rows, anchors = [np.arange(len(fps))], [home]
    for n in range(1, max_bits + 1):
        for runs in combinations(range(blocks), n):
            hit = np.flatnonzero(cost[list(runs)].sum(axis=0) <= max_bits)
            if len(hit):
                rows.append(hit)
                anchors.append(home[hit] ^ sum(1 << k for k in runs))
    return home, np.concatenate(rows), np.concatenate(anchors)


def _spanning(home: np.ndarray, guest: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets of fingerprints."""
    nodes = np.unique(np.concatenate((home, guest)))
    at_h, at_g = np.searchsorted(nodes, home), np.searchsorted(nodes, guest)
    step = max(1, (1 << 21) // max(1, len(guest)))
    root = np.arange(len(nodes))
    for i in range(0, len(home), step):
        near = np.bitwise_count(home[i:i + step, None] ^ guest[None, :]) <= max_bits
        x, y = np.nonzero(near)
        x, y = at_h[i:i + step][x], at_g[y]
        keep = x != y
        root = local_roots(len(nodes), np.concatenate((x[keep], np.arange(len(nodes)))), np.concatenate((y[keep], root)))
    hit = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hit], nodes[root[hit]]


def fingerprint_links(fps: DataFrame, fp: str = "fingerprint", max_bits: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints (distinct longs in column
    ``fp``) reachable from each other by steps of at most ``max_bits`` bits."""
    def spread(batches):
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(v), 2048):
                part = v[i:i + 2048]
                home, row, anchor = _homes_and_guests(part.view(_U), blocks, max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((home, anchor))), pa.array(np.concatenate((part, part[row]))),
                     pa.array(np.concatenate((np.zeros(len(part), bool), np.ones(len(row), bool))))],
                    names=["anchor", "fp", "guest"])

    cells = (fps.select(F.col(fp).alias("fp")).where("fp is not null")
             .mapInArrow(spread, "anchor long, fp long, guest boolean"))
    cells = cut_lineage(cells, "anchors")
    blocks_df = cell_blocks(cells.where("not guest").drop("guest"), cells.where("guest").drop("guest"), "anchor", "fp")

    def compare(table: pa.Table) -> pa.Table:
        v = table.column("fp").to_numpy().view(_U)
        g = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        a, b = _spanning(v[~g], v[g], max_bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return blocks_df.groupBy("anchor", "part_h", "part_g").applyInArrow(compare, "a long, b long")


def simhash_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3,
                    max_bits: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long) and ``component_id``, the
    smallest id reachable by links of at most ``max_bits`` differing bits, itself included.

    Null and empty texts have fingerprint zero and link like any other.  A null id takes
    part in linking but never becomes a component's id unless all its ids are null.
    Repeated rows stay.  Other columns are not read.  An empty table gives an empty one.
    """
    prints = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                               "text", words).select("doc_id", "fingerprint")
    prints = cut_lineage(prints, "fingerprints")
    groups = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "groups")
    roots = components(fingerprint_links(groups, "fingerprint", max_bits, blocks), "a", "b")
    linked = groups.join(roots, groups.fingerprint == roots.node).select("fingerprint", "low", "root")
    least = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = cut_lineage(groups.join(linked.join(least, "root").select("fingerprint", "component_id"), "fingerprint", "left")
                          .select("fingerprint", F.coalesce("component_id", "low").alias("component_id"), "n"), "classes")
    most = prints.count() / (HOT * fan_out(prints))
    hot = classes.where(F.col("n") > most).select(F.col("fingerprint").alias("hot"), F.col("component_id").alias("hot_id"))
    dealt = prints.join(F.broadcast(hot), F.col("fingerprint") == F.col("hot"), "left")
    rest = dealt.where("hot is null").select("doc_id", "fingerprint").join(classes.where(F.col("n") <= most).drop("n"), "fingerprint")
    return (rest.select("doc_id", "fingerprint", "component_id")
            .unionAll(dealt.where("hot is not null").select("doc_id", "fingerprint", F.col("hot_id").alias("component_id"))))


def keep_one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3,
                       max_bits: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Rows of ``docs`` whose id is its component's smallest; all columns as given.  Rows with a
    null id cannot be told apart by it and are all kept."""
    key, = fresh(docs, "kept")
    kept = (simhash_classes(docs, text, doc_id, words, max_bits, blocks)
            .where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct())
    return (docs.join(kept, docs[doc_id] == kept[key], "left_semi")
            .unionAll(docs.where(docs[doc_id].isNull())))
