"""Hard negatives of anchor vectors, by exact scores from subset-sum tables (the Four Russians' trick).

A component x becomes the whole number floor(scale * x).  Of every row the two's complement bits of its
components are kept by planes: plane b packs bit b of eight neighbouring components into one byte.  For
an anchor and a group of eight dimensions a table holds the sums of all 256 subsets of the anchor's eight
components.  The inner product then needs no multiplication: from the sign plane down, the score
so far is shifted by one and each group's byte of the plane adds the sum it looks up.

Anchors and rows meet in cells of bounded size (anchors in parts, rows in parts, each part of one
side with each of the other).  A cell first gives the best rows of the anchor's own label, and in a second pass the
best rows of other labels in the score windows that the anchor's positives set, never all scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recsim.llm.common import cut_lineage, ship

#: Anchors and rows of a cell at most, and the rows of a cell that is cut further to keep all cores busy.
CELL_ANCHORS, CELL_ROWS, LEAST_ROWS = 16384, 65536, 1024
#: Anchors whose tables are held at a time, and rows scored against them at a time.
TABLE_ANCHORS, STEP = 128, 1024
#: Scores must stay below this.
MOST = 2.0 ** 55

ship(__name__)


def bit_planes(q: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups of eight dimensions) bytes of whole numbers; dimension 8 g + i is bit i of group g."""
    planes = (q[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers (padded with zeros to whole groups) of bit planes."""
    bits = planes.shape[1]
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("rbd,b->rd", np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64), weight)


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """(groups, 256, anchors): for every group of eight dimensions the sums of all subsets of each anchor's components."""
    n, dim = anchors.shape
    out = np.zeros((dim // 8, 256, n), kind)
    for i in range(8):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + anchors.T.reshape(dim // 8, 8, n)[:, i, None]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products of rows given as bit planes with the anchors of ``tables``."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for b in range(planes.shape[1] - 1, -1, -1):
        total += total
        for g in range(len(tables)):
            np.take(tables[g], planes[:, b, g], axis=0, out=found, mode="clip")
            total += found
        if b == planes.shape[1] - 1:
            np.negative(total, out=total)              # the sign bit weighs -2**b
    return total


def best_in_windows(anchors: dict, rows: dict, low: np.ndarray, high: np.ndarray, k: int, same_label: bool, kind):
    """The best ``k`` rows of every window (anchor, w) with low <= score <= high: (anchor, w, row, score) positions.

    ``anchors`` and ``rows`` hold id, row (a number of its own), label and planes; rows come in the order of
    their ids.  Rows of the anchor's own label take part if ``same_label``, others if not; the anchor itself never does.
    """
    width = low.shape[1]
    held = [np.zeros(0, np.int64)] * 3
    for a0 in range(0, len(anchors["row"]), TABLE_ANCHORS):
        part = slice(a0, a0 + TABLE_ANCHORS)
        tables = subset_sums(from_planes(anchors["planes"][part]), kind)
        lo, hi = low[part].copy(), high[part]
        got = [np.zeros(0, np.int64)] * 3              # anchor * width + w, row, score
        for i in range(0, len(rows["row"]), STEP):
            s = scores(tables, rows["planes"][i:i + STEP])
            fits = (rows["label"][i:i + STEP, None] == anchors["label"][None, part]) == same_label
            fits &= (s >= lo.min(axis=1)) & (s <= hi.max(axis=1)) & (rows["row"][i:i + STEP, None] != anchors["row"][None, part])
            at, who = np.nonzero(fits)
            if not len(at):
                continue
            s = s[at, who].astype(np.int64)
            for w in range(width):
                take = (s >= lo[who, w]) & (s <= hi[who, w])
                got = [np.concatenate((x, y)) for x, y in zip(got, (who[take] * width + w, i + at[take], s[take]))]
            order = np.lexsort((got[1], -got[2], got[0]))
            got = [x[order] for x in got]
            place = np.arange(len(order)) - np.searchsorted(got[0], got[0])
            got = [x[place < k] for x in got]
            full = place[place < k] == k - 1           # later rows must beat the k-th: on a tie the smaller id stays
            lo.reshape(-1)[got[0][full]] = got[2][full] + 1
        held = [np.concatenate((x, y)) for x, y in zip(held, (got[0] + a0 * width, got[1], got[2]))]
    return held[0] // width, held[0] % width, held[1], held[2]


def _side(table: pa.Table, bits: int) -> dict:
    data = table.column("planes").to_pylist()
    planes = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), bits, -1) if data else np.zeros((0, bits, 0), np.uint8)
    return {"planes": planes, "label": table.column("code").to_numpy()} | {c: table.column(c).to_numpy() for c in ("row", "id")}


def _cells(anchors: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Anchors and rows of equal ``keys`` dealt into cells: every part of the anchors meets every part of the rows once."""
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    count = F.count("*")
    parts = (rows.groupBy(*keys).agg(F.greatest(F.ceil(count / CELL_ROWS), F.least(F.ceil(count / LEAST_ROWS), F.lit(cores))).cast("int").alias("parts_r"))
             .join(anchors.groupBy(*keys).agg(F.ceil(count / CELL_ANCHORS).cast("int").alias("parts_a")), [*keys]))
    parts = cut_lineage(parts, "parts")                # one row per key
    cells = parts.agg(F.sum(F.col("parts_a").cast("long") * F.col("parts_r"))).first()[0] or 1
    deal = lambda df, own, other: (df.join(parts, [*keys])
                                   .withColumn(f"at_{own}", F.pmod(F.xxhash64("row"), F.col(f"parts_{own}")).cast("int"))
                                   .withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1))))
    both = (deal(anchors, "a", "r").withColumn("is_anchor", F.lit(True))
            .unionByName(deal(rows, "r", "a").withColumn("is_anchor", F.lit(False)), allowMissingColumns=True).drop("parts_a", "parts_r"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 100_000))
    return both.repartition(n, *keys, "at_a", "at_r")


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, scale: float = 256, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its positives the hardest negatives: (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score), rank from 1.

    A score is the whole-number inner product with the anchor; higher ones come first, ties by the smaller id.
    An anchor's positives are its first ``positives`` other rows of its label.  A positive's negatives are the first
    ``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score; a positive
    without any gives no row.

    Rows with a null id or label, a null vector or a null or non-finite component take no part.  Rows of different lengths do
    not meet; empty vectors score 0.  Rows that repeat an id are rows of their own (an anchor that is repeated is mined once
    each time, and its copies can be its positives).  Other columns are not read.  An empty table, or one without anchors, gives
    an empty result.  Components too large for scores below 2**55 raise a ValueError.
    """
    def whole(batches):
        for batch in batches:
            out, dims, most = [], [], []
            for v in batch.column("vector").to_pylist():
                x = None if v is None or None in v else np.array(v, np.float64)
                if x is None or not np.isfinite(x).all():
                    out.append(None), dims.append(None), most.append(None)
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(x * scale)
                top = float(np.abs(x).max()) if len(x) else 0.0
                out.append((x if top < 2 ** 31 else x * 0).astype(np.int32).tobytes() if np.isfinite(top) else b"")
                dims.append(len(x)), most.append(top)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "id", "label", "anchor")] + [pa.array(out, pa.binary()),
                                             pa.array(dims, pa.int32()), pa.array(most, pa.float64())], names=["row", "id", "label", "anchor", "q", "dim", "most"])

    plain = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                           F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(embedding).alias("vector")).where("id is not null and label is not null")
    numbers = cut_lineage(plain.mapInArrow(whole, "row long, id long, label string, anchor boolean, q binary, dim int, most double")
                          .where("dim is not null"), "vectors")
    most, dim = numbers.agg(F.max("most"), F.max("dim")).first()
    most, dim = most or 0.0, dim or 0
    bits = max(2, int(min(most, 2.0 ** 31)).bit_length() + 1)
    bound = max(8, dim + 7) * float(most) * 2.0 ** bits
    if most >= 2 ** 31 or bound >= MOST:
        raise ValueError("components are too large for whole-number scores")
    kind = np.int32 if bound < 2 ** 31 else np.int64

    def pack(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            data: list = [None] * batch.num_rows
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                q = np.frombuffer(b"".join(batch.column("q").take(pa.array(at)).to_pylist()), np.int32).reshape(len(at), d)
                for i, planes in zip(at, bit_planes(q, bits)):
                    data[i] = planes.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "id", "label", "anchor", "dim")] + [pa.array(data, pa.binary())],
                                             names=["row", "id", "label", "anchor", "dim", "planes"])

    rows = cut_lineage(numbers.drop("most").mapInArrow(pack, "row long, id long, label string, anchor boolean, dim int, planes binary"), "planes")
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")

    def compare(table: pa.Table, k: int, same_label: bool) -> pa.Table:
        codes = np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        table = table.append_column("code", pa.array(codes))
        first = table.column("is_anchor")
        a, r = _side(table.filter(first), bits), table.filter(pa.compute.invert(first))
        r = _side(r.sort_by([("id", "ascending"), ("row", "ascending")]), bits)
        told = [np.array(x or [], np.int64) for x in table.filter(first).column("told").to_pylist()]
        width = max([len(x) for x in told], default=0) if not same_label else 1
        lo, hi = np.ones((len(told), width), np.int64), np.zeros((len(told), width), np.int64)   # empty windows
        if same_label:
            lo[:], hi[:] = -2 ** 62, 2 ** 62
        else:
            for i, x in enumerate(told):
                lo[i, :len(x)], hi[i, :len(x)] = -(-low * x // 100), high * x // 100
        if not width or not len(r["row"]):
            at = [np.zeros(0, np.int64)] * 4
        else:
            at = best_in_windows(a, r, lo, hi, k, same_label, kind)
        who, w, row, score = at
        return pa.table({"anchor": a["row"][who], "anchor_id": a["id"][who], "id": r["id"][row], "score": score,
                         "told": pa.array([0 if same_label else int(told[i][j]) for i, j in zip(who, w)], pa.int64())})

    def first(df: DataFrame, n: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    out = "anchor long, anchor_id long, id long, score long, told long"
    none = F.lit(None).cast("array<long>").alias("told")
    same = _cells(anchors.select("*", none), rows, "dim", "label").withColumn("told", F.col("told"))
    found = same.groupBy("dim", "label", "at_a", "at_r").applyInArrow(lambda t: compare(t, positives, True), out)
    found = cut_lineage(first(found, positives, "anchor").select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                        "positives")
    told = found.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("told"))
    other = _cells(anchors.join(told, "row"), rows, "dim").groupBy("dim", "at_a", "at_r").applyInArrow(lambda t: compare(t, negatives, False), out)
    other = first(other, negatives, "anchor", "told").select("anchor", F.col("told").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
                                                             F.col("score").alias("negative_score"))
    return found.join(other, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
