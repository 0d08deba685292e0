"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases over its code points: the next phrase is the shortest run that
is not in the dictionary yet.  Texts with much in common share dictionary phrases, as they do
when compressed with each other's dictionary.  The set of phrases is hashed, and a signature of
minimum hashes stands for it; the share of equal signature places estimates the Jaccard
likeness of two phrase sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import fan_out, mix64, ship, spans_hash, without

#: Places of a signature (a power of two); each is printed as four hex digits.
PLACES = 128

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

ship(__name__)


def parse(text: str, known: set[str], sizes: list[int], begun: str = "") -> str:
    """LZ78: adds ``text``'s phrases to the dictionary ``known`` and their lengths to ``sizes``, going on
    from the unfinished phrase ``begun``; returns the phrase that is unfinished at the end."""
    add, size = known.add, sizes.append
    for c in text:
        begun += c
        if begun not in known:
            add(begun)
            size(len(begun))
            begun = ""
    return begun


def signature(text: str, sizes: list[int], places: int = PLACES) -> np.ndarray:
    """Minimum hashes (16 bits of each) of the phrases that ``text`` begins with, given their lengths.

    One hash per phrase: its top bits choose the place, the least value there stays.  A place
    without phrase borrows from the next one that has some.  The unfinished phrase at the end is
    in the dictionary already.  The empty text has a signature of its own."""
    ends = np.cumsum(sizes, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
    h = spans_hash(points, ends - np.asarray(sizes, np.int64), ends, _BASE) if len(ends) else np.zeros(1, _U)
    low = np.full(places, ~_U(0))
    np.minimum.at(low, (h >> _U(64 - places.bit_length() + 1)).astype(np.int64), h)
    full = np.zeros(places, bool)
    full[(h >> _U(64 - places.bit_length() + 1)).astype(np.int64)] = True
    at = np.flatnonzero(full)
    place = np.arange(places)
    source = at[np.searchsorted(at, place) % len(at)]
    far = ((source - place) % places).astype(_U)
    return (mix64(low[source] + far * _U(_BASE)) >> _U(48)).astype(np.uint16)


def fingerprint(text: str | None, places: int = PLACES) -> np.ndarray:
    sizes: list[int] = []
    parse(text or "", set(), sizes)
    return signature(text or "", sizes, places)


def shown(places: np.ndarray) -> str:
    return places.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def lz_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", places: int = PLACES) -> DataFrame:
    """``docs`` plus ``out``: the signature in hex.  Equal texts have equal fingerprints; a null text counts
    as empty.  All rows and columns stay (a column named ``out`` is replaced)."""
    @F.pandas_udf("string")
    def prints(texts):
        return texts.map(lambda t: shown(fingerprint(t, places)))

    return without(docs, out).withColumn(out, prints(F.coalesce(F.col(text), F.lit(""))))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _edit(text: str, after: str) -> tuple[str, str]:
    """(kept, put in): the last floor(n/2) code points give way to the first as many of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half], after[:half]


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int | None = None,
                      places: int = PLACES) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text (the last half of its code points
    replaced by the first as many of the next row's text, or by all of that if it is shorter),
    the likeness of the two, and the likeness to the next row.

    Next: in order of descending id, ties by text, null ids last; after the last row comes the
    first.  A null text counts as empty.  Other columns are not read.  An empty table gives
    an empty one.

    The ids are cut into ``parts`` ranges at quantiles, by default as many as hold an input partition
    each, and every range is one task.  It is sorted and read as a stream that holds one text; the
    first row of the following range is sent along, by every batch its own candidate.  Texts are
    shuffled once.  The driver sees one id per range.  Rows that share an id, and those without one,
    stay in one range: they are sorted on disk where they do not fit into memory.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or fan_out(rows)
    shares = [k / parts for k in range(1, parts)]
    cuts = np.unique(np.array(rows.where("doc_id is not null").approxQuantile("doc_id", shares, 0.2 / parts) if shares else [], np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        """Range of each id: 0 for the largest ids, the last one for null."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return np.where(null, len(cuts) + 1, len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "right")).astype(np.int32)

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0))), batch.column(0)], names=["part", "doc_id"])

    firsts = (rows.select("doc_id").mapInArrow(largest, "part int, doc_id long").groupBy("part")
              .agg(F.max("doc_id").alias("first")).orderBy("part").collect())
    if not firsts:
        return spark.createDataFrame([], OUT)
    top = np.zeros(len(cuts) + 2, np.int64)
    own, before = np.zeros((2, len(cuts) + 2), np.int32)            # numbers of ranges that hold rows
    for k, r in enumerate(firsts):
        top[r.part], own[r.part], before[r.part] = r.first or 0, k, (k - 1) % len(firsts)

    def openers(part: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        """Of each range the row of the batch that may open it: of its largest id, the smallest text."""
        ids, least = batch.column(0), {}
        at = np.flatnonzero((part == len(cuts) + 1) | (ids.fill_null(0).to_numpy() == top[part]))
        for k, number, body in zip(at.tolist(), part[at].tolist(), batch.column(1).take(pa.array(at)).to_pylist()):
            if number not in least or body < least[number][0]:
                least[number] = body, k
        return np.array(sorted(k for _, k in least.values()), np.int64)

    def deal(batches):
        """Every row goes to its range; those that may open it also go to the range before, as its tail."""
        for batch in batches:
            part = place(batch.column(0))
            opens = openers(part, batch)
            for rows_at, target, tail in ((None, own[part], False), (pa.array(opens), before[part[opens]], True)):
                some = batch if rows_at is None else batch.take(rows_at)
                yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(np.full(len(target), tail)), some.column(0), some.column(1)],
                                                 names=["part", "tail", "doc_id", "text"])

    sorted_rows = (rows.mapInArrow(deal, "part int, tail boolean, doc_id long, text string").repartitionById(len(firsts), "part")
                   .sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text"))

    def stream(batches):
        held, done = None, False
        out: list[tuple] = []

        def prepare(key, body):
            """The row, the parse of the part that an edit keeps, and the fingerprint."""
            keep = len(body) - len(body) // 2
            known, sizes = set(), []
            begun = parse(body[:keep], known, sizes)
            half = key, body, known.copy(), sizes.copy(), begun
            parse(body[keep:], known, sizes, begun)
            return half, signature(body, sizes, places)

        def close(half, own, after, after_print):
            key, body, known, sizes, begun = half
            kept, put = _edit(body, after)
            parse(put, known, sizes, begun)
            edited = signature(kept + put, sizes, places)
            digest = hashlib.sha256((kept + put).encode()).hexdigest()
            out.append((key, len(body), digest, shown(own), shown(edited), likeness(own, edited), likeness(own, after_print)))

        def flush():
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in OUT.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return batch

        part_now = None
        for batch in batches:
            for part, tail, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                             batch.column(3).to_pylist()):
                if part != part_now:
                    held, done, part_now = None, False, part
                if done:
                    continue
                if tail:                                    # only the first tail row follows
                    done = True
                    after = fingerprint(body, places)
                else:
                    row, after = prepare(key, body)
                if held is not None:
                    close(held[0], held[1], body, after)
                held = None if tail else (row, after)
                if len(out) >= 256:
                    yield flush()
        yield flush()

    return sorted_rows.mapInArrow(stream, OUT)
