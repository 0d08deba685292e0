"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2 t).  Pivots (a
bounded number of the vectors, chosen by hash) cut the space into cells: a vector's home is its
nearest pivot.  By the triangle inequality a vector y can have a partner in the cell of pivot p
only if d(y, p) <= R_p + r, where R_p is the cell's radius, and if y lies within r of the plane
between p and its own pivot q: d(y, p)^2 - d(y, q)^2 <= 2 r d(p, q).  Such a y is replicated to
p's cell.  A pair of two cells is compared in the lower-numbered one only.

Cells join independently, in blocks of bounded size.  A block gives one row per vector that
has links in it: how many, and the smallest vector it is connected with inside the block (a
spanning forest), never the pairs.  Equal vectors are collapsed before and counted with
their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import CELL_ROWS, cell_blocks, components, cut_lineage, local_roots, ship

#: Vectors of an average cell, and pivots at most (the driver holds them).
CELL_VECTORS, MAX_PIVOTS = 4096, 1024
#: Rows of one side compared at a time.
STEP = 512
#: Slack for rounding: of distances, and of cosines that are then computed anew.
EPS, NEAR = 1e-7, 1e-9

ship(__name__)


def unit(data: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of rows of doubles."""
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), dim)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)                  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with exactly summed products."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _valid(batches):
    """(vec_id, dim, data): the vector as doubles; null data where it links with nothing."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = None if v is None or None in v else np.array(v, np.float64)
            good = x is not None and len(x) and np.isfinite(x).all() and x.any()
            out.append((x + 0.0).tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // 8 if b else None for b in out], pa.int32()),
                                          pa.array(out, pa.binary())], names=["vec_id", "dim", "data"])


def _spread(classes: DataFrame, r: float, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Homes and replicas: (dim, cell, guest, id, weight, data)."""
    def nearest(batch):
        """For each dimension of a batch: rows, distances to the pivots, homes."""
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows, p = np.flatnonzero(dims == dim), pivots[int(dim)]
            for i in range(0, len(rows), 4096):
                part = rows[i:i + 4096]
                x = unit([batch.column("data")[int(k)].as_py() for k in part], int(dim))
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                yield int(dim), part, d, d.argmin(axis=1)

    def radius(batches):
        for batch in batches:
            for dim, part, d, home in nearest(batch):
                cells = np.unique(home)
                far = [float(d[home == c, c].max()) for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells.astype(np.int32)),
                                                  pa.array(far, pa.float64())], names=["dim", "cell", "far"])

    radii = {dim: np.full(len(p), -np.inf) for dim, p in pivots.items()}
    for row in classes.select("dim", "data").mapInArrow(radius, "dim int, cell int, far double").groupBy("dim", "cell").agg(F.max("far").alias("far")).collect():
        radii[row.dim][row.cell] = row.far

    def deal(batches):
        for batch in batches:
            for dim, part, d, home in nearest(batch):
                p = pivots[dim]
                own = d[np.arange(len(part)), home]
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                guest = (d <= radii[dim][None] + r + EPS) & (d * d - (own * own)[:, None] <= 2 * r * between + EPS)
                guest &= np.arange(len(p))[None] < home[:, None]
                row, cell = np.nonzero(guest)
                take = pa.array(np.concatenate((part, part[row])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(take), dim, np.int32)), pa.array(np.concatenate((home, cell)).astype(np.int32)),
                     pa.array(np.arange(len(take)) >= len(part)), batch.column("id").take(take), batch.column("weight").take(take),
                     batch.column("data").take(take)], names=["dim", "cell", "guest", "id", "weight", "data"])

    return classes.mapInArrow(deal, "dim int, cell int, guest boolean, id long, weight long, data binary")


def block_links(homes: tuple, guests: tuple, own: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, least connected id, linked vectors) of a block.  ``homes`` and ``guests`` are (ids, weights, unit
    vectors); ``own`` marks guests that are homes of the same cell: they only count for the homes."""
    hid, hw, hx = homes
    gid, gw, gx = guests
    ids = np.unique(np.concatenate((hid, gid)))
    at_h, at_g = np.searchsorted(ids, hid), np.searchsorted(ids, gid)
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for i in range(0, len(hid), STEP):
        cos = hx[i:i + STEP] @ gx.T
        near = cos >= min_cosine
        for a, b in zip(*np.nonzero(np.abs(cos - min_cosine) <= NEAR)):
            near[a, b] = exact_cosine(hx[i + a], gx[b]) >= min_cosine
        near &= hid[i:i + STEP, None] != gid[None, :]
        links[at_h[i:i + STEP]] += near @ gw
        a, b = np.nonzero(near)
        np.add.at(links, at_g[b[~own[b]]], hw[i + a[~own[b]]])
        root = local_roots(len(ids), np.concatenate((at_h[i + a], np.arange(len(ids)))), np.concatenate((at_g[b], root)))
    hit = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    return ids[hit], ids[root[hit]], links[hit]


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding",
                    cell_vectors: int = CELL_VECTORS, block_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows with a cosine of at least ``min_cosine``),
    component_id (smallest id reachable, itself included) and kept (vec_id = component_id).

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing,
    as do vectors of different lengths with each other.  Equal vectors link.  Rows that repeat an
    id are rows of their own to the counts and share a component if they link.  Rows without id are
    left out.  Other columns are not read.  An empty table gives an empty one.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must lie above 0 and not above 1")
    r = math.sqrt(2 - 2 * min_cosine)
    rows = cut_lineage(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null")
                       .mapInArrow(_valid, "vec_id long, dim int, data binary"), "vectors")
    classes = cut_lineage(rows.where("data is not null").groupBy("data").agg(
        F.first("dim").alias("dim"), F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    pivots: dict[int, np.ndarray] = {}
    for row in classes.groupBy("dim").count().orderBy("dim").collect():
        k = min(MAX_PIVOTS, -(-row["count"] // cell_vectors))
        chosen = classes.where(F.col("dim") == row.dim).orderBy(F.xxhash64("data"), "id").limit(k).select("data").collect()
        pivots[row.dim] = unit([c.data for c in chosen], row.dim)

    cells = cut_lineage(_spread(classes, r, pivots), "cells").withColumn("cell", F.struct("dim", "cell"))
    homes = cells.where("not guest").drop("guest").withColumn("own", F.lit(True))
    guests = homes.unionByName(cells.where("guest").drop("guest").withColumn("own", F.lit(False)))

    def compare(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        ids, weight, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight", "own"))
        x = unit(table.column("data").to_pylist(), dim)
        a, b, n = block_links((ids[~guest], weight[~guest], x[~guest]), (ids[guest], weight[guest], x[guest]),
                              own[guest].astype(bool), min_cosine)
        return pa.table({"a": a, "b": b, "n": n})

    found = cut_lineage(cell_blocks(homes, guests, "cell", "id", block_rows).groupBy("cell", "part_h", "part_g")
                        .applyInArrow(compare, "a long, b long, n long"), "vector-links")
    roots = components(found, "a", "b")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    told = (classes.join(counts, "id", "left").join(roots, classes.id == roots.node, "left")
            .select("data", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    return (rows.join(told, "data", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
