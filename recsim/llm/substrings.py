"""Removal of repeated word windows by difference-cover anchors.

A difference cover D of a period v holds, for every shift s, two members that differ by s
modulo v.  Anchors are windows of ``window`` - v + 1 words that start at positions in D modulo v.
If two windows of ``window`` words are equal, some offset below v puts both at cover positions,
so they share an anchor aligned at that offset.  Therefore:

1. Anchors: every document's anchors are hashed (64 bits) and meet by hash.  Anchors that
   occur once are done with.
2. Extension: only windows around a repeated anchor are digested whole (96 bits of BLAKE2 of their
   words, so also words made to collide under the anchors' hash are told apart); they meet
   by digest, and all but the earliest start (document, then position) of each are marked.
3. The words that marked windows cover are taken out.

Both meetings work on packed arrays.  A task first reduces what it has: of equal hashes inside
a batch only the first occurrence goes to the hash's bucket.  The others are repeats whatever
other batches hold, so they go by their document, and a hot hash meets as one entry per
batch.  Texts are shuffled once, by document; both later steps read that shuffle.  Buckets
grow in number with the input.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import blobs, fan_out, fresh, ship, spans_hash, spark_xxhash64, without, word_edges, word_hashes

#: Difference covers (perfect difference sets) by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: An anchor has at least so many words, where the window allows.
LEAST_ANCHOR = 8
#: Bytes of the documents that a task reduces together.
CHUNK = 3 << 20

_A = 0x9E3779B97F4A7C15
_U = np.uint64

ship(__name__)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """(period, cover) for windows of so many words: the longest period that leaves a long anchor."""
    fits = [v for v in COVERS if window - v + 1 >= min(LEAST_ANCHOR, window)]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class Words:
    """Words of several documents in one row: hashes, and where each document's words begin."""

    def __init__(self, datas: list[bytes]):
        data = b" ".join(datas)
        starts, ends = word_edges(data)
        begin = np.cumsum([0] + [len(d) + 1 for d in datas])
        self.first = np.searchsorted(starts, begin)
        self.data, self.starts, self.ends = data, starts, ends
        self.h1, = word_hashes(data, starts, ends, (_A,))
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(datas)), counts)
        self.at = np.arange(self.first[-1]) - np.repeat(self.first[:-1], counts)
        self.left = np.repeat(counts, counts) - self.at

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of the cover anchors of documents that have a window."""
        period, cover = cover_for(window)
        size = window - period + 1
        covered = np.isin(np.arange(period), cover)[self.at % period]
        i = np.flatnonzero(covered & (self.left >= size) & (self.left + self.at >= window))
        return i, spans_hash(self.h1, i, i + size, _A)

    def windows(self, i: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """96-bit BLAKE2 of the words of the windows that start at words ``i``, as 64 and 32 bits."""
        flat = b" ".join([self.data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())])
        at = np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))
        raw = b"".join([blake2b(flat[a:b], digest_size=12).digest() for a, b in zip(at[i].tolist(), (at[i + window] - 1).tolist())])
        told = np.frombuffer(raw, [("hi", "<u8"), ("lo", "<u4")])
        return told["hi"].astype(_U), told["lo"].astype(np.uint32)


def _chunks(keys: list, datas: list[bytes], limit: int = CHUNK):
    """Runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    at, size = 0, 0
    for k, d in enumerate(datas):
        if size and size + len(d) > limit:
            yield keys[at:k], datas[at:k]
            at, size = k, 0
        size += len(d)
    if at < len(datas):
        yield keys[at:], datas[at:]


PACKED = "bucket int, ids binary, counts binary, hi binary, lo binary, pos binary, more binary"
MARKS = "home int, ids binary, counts binary, pos binary"


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Run lengths of sorted ids."""
    if not len(ids):
        return b"", b""
    cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[cut].astype(np.int64).tobytes(), np.diff(np.append(cut, len(ids))).astype(np.uint32).tobytes()


def _unrun(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32))


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=names)


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of each id: Spark's pmod(xxhash64(id), homes)."""
    return spark_xxhash64(ids) % homes


def _packed(buckets: int, ids: np.ndarray, pos: np.ndarray, hi: np.ndarray, lo: np.ndarray | None) -> pa.RecordBatch:
    """Rows by bucket.  Of equal hashes the first by (id, position) stands for all, in the bucket of the
    hash; ``more`` is 0 for it, 1 if others follow, 2 for those others (which carry no hash and lie in the
    bucket of their document)."""
    order = np.lexsort((pos, ids, *(() if lo is None else (lo,)), hi))
    ids, pos, hi = ids[order], pos[order], hi[order]
    same = hi[1:] == hi[:-1]
    if lo is not None:
        lo = lo[order]
        same &= lo[1:] == lo[:-1]
    again = np.concatenate(([False], same))
    more = np.where(again, 2, np.concatenate((same, [False]))).astype(np.uint8)
    bucket = np.where(again, _home(ids, buckets), (hi % _U(buckets)).astype(np.int64))
    order = np.lexsort((pos, ids, bucket))
    ids, pos, hi, bucket, more = ids[order], pos[order].astype(np.uint32), hi[order], bucket[order], more[order]
    lo = lo[order] if lo is not None else np.zeros(0, np.uint32)
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    columns: list[list] = [[] for _ in range(7)]
    for a, b in zip(cut, np.append(cut[1:], len(bucket))):
        key = more[a:b] != 2
        runs, counts = _runs(ids[a:b])
        for column, value in zip(columns, (int(bucket[a]), runs, counts, hi[a:b][key].tobytes(),
                                           lo[a:b][key].tobytes() if len(lo) else b"", pos[a:b].tobytes(), more[a:b].tobytes())):
            column.append(value)
    return _batch(PACKED, columns)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, positions, more) of all entries, and (index of the entry, hi, lo) of those with a hash."""
    cols = {c: table.column(c).to_pylist() for c in ("ids", "counts", "hi", "lo", "pos", "more")}
    join = lambda c, kind: np.frombuffer(b"".join(cols[c]), kind)
    ids = np.concatenate([_unrun(i, c) for i, c in zip(cols["ids"], cols["counts"])] or [np.zeros(0, np.int64)])
    more = join("more", np.uint8)
    return ids, join("pos", np.uint32), more, np.flatnonzero(more != 2), join("hi", _U), join("lo", np.uint32)


def _marks(homes: int, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Marked positions, packed by the bucket of their document."""
    home = _home(ids, homes)
    order = np.lexsort((pos, ids, home))
    ids, pos, home = ids[order], pos[order].astype(np.uint32), home[order]
    cut = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else np.zeros(0, np.int64)
    columns: list[list] = [[] for _ in range(4)]
    for a, b in zip(cut, np.append(cut[1:], len(home))):
        for column, value in zip(columns, (int(home[a]), *_runs(ids[a:b]), pos[a:b].tobytes())):
            column.append(value)
    return _batch(MARKS, columns)


def _marked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) sorted by id."""
    ids = np.concatenate([_unrun(i, c) for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist())]
                         or [np.zeros(0, np.int64)])
    pos = np.frombuffer(b"".join(table.column("pos").to_pylist()), np.uint32)
    order = np.argsort(ids, kind="stable")
    return ids[order], pos[order].astype(np.int64)


def _of(ids: np.ndarray, pos: np.ndarray, keys: list) -> list[np.ndarray]:
    """The marked positions of each document of ``keys``."""
    want = np.array([0 if k is None else k for k in keys], np.int64)
    a, b = np.searchsorted(ids, want, "left"), np.searchsorted(ids, want, "right")
    return [pos[:0] if k is None else pos[x:y] for k, x, y in zip(keys, a, b)]


def substring_dedup(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` plus ``kept_text``, ``n_words`` and ``n_removed``.

    Words are runs of characters other than 0x20 and 0x09-0x0D.  A word goes if a window of
    ``window`` words over it also starts earlier: in a document with a smaller id, or in the same
    one further left; windows are judged on the input.  ``kept_text`` is the text itself if
    nothing goes, else the remaining words joined by one space.  A null text has no words
    and stays null.  Rows without id are not compared and keep all words.  Rows that
    repeat an id are taken to repeat its text and share its fate.  All rows and columns
    stay (columns with the three names are replaced); an empty table stays empty.
    """
    buckets = fan_out(docs)
    docs = without(docs, "kept_text", "n_words", "n_removed")
    home, = fresh(docs, "home")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def anchors(batches):
        for batch in batches:
            for keys, datas in _chunks(batch.column(0).to_pylist(), blobs(batch.column(1))):
                w = Words(datas)
                i, h = w.anchors(window)
                ids = np.array(keys, np.int64)[w.doc[i]]
                yield _packed(buckets, ids, w.at[i], h, None)

    def repeated(table: pa.Table) -> pa.Table:
        ids, pos, more, own, hi, _ = _unpacked(table)
        _, where, count = np.unique(hi, return_inverse=True, return_counts=True)
        hit = more != 0
        hit[own[count[where] > 1]] = True
        return pa.Table.from_batches([_marks(buckets, ids[hit], pos[hit])])

    def extend(rows: pa.Table, marks: pa.Table) -> pa.Table:
        period, _ = cover_for(window)
        ids, pos = _marked(marks)
        out, keys = [], rows.column(doc_id).to_pylist()
        at = {k: _of(ids, pos, [k])[0] for k in set(keys)}
        some = [i for i, k in enumerate(keys) if len(at[k])]
        datas = blobs(rows.column(text).take(pa.array(some, pa.int64())))
        for part, data in _chunks([keys[i] for i in some], datas):
            w = Words(data)
            change = np.zeros(len(w.at) + 1, np.int64)
            for n, k in enumerate(part):
                p = w.first[n] + at[k][at[k] < w.first[n + 1] - w.first[n]]
                np.add.at(change, np.maximum(p - (period - 1), w.first[n]), 1)
                np.add.at(change, p + 1, -1)
            i = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (w.left >= window))
            hi, lo = w.windows(i, window)
            key_of = np.array(part, np.int64)
            # rows that repeat an id are one document
            ids_i, at_i = key_of[w.doc[i]], w.at[i]
            if len(set(part)) < len(part):
                _, one = np.unique(np.stack((ids_i, at_i)), axis=1, return_index=True)
                ids_i, at_i, hi, lo = ids_i[one], at_i[one], hi[one], lo[one]
            out.append(_packed(buckets, ids_i, at_i, hi, lo))
        return pa.Table.from_batches(out or [_batch(PACKED, [[] for _ in range(7)])])

    def later(table: pa.Table) -> pa.Table:
        ids, pos, more, own, hi, lo = _unpacked(table)
        hit = more == 2
        order = np.lexsort((pos[own], ids[own], lo, hi))
        o, hi, lo = own[order], hi[order], lo[order]
        again = np.concatenate(([False], (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1]))) if len(o) else np.zeros(0, bool)
        # a repeated row brings the first start again: that one stays
        start = np.maximum.accumulate(np.where(again, 0, np.arange(len(o)))) if len(o) else o
        hit[o] = again & ((ids[o] != ids[o[start]]) | (pos[o] != pos[o[start]]))
        return pa.Table.from_batches([_marks(buckets, ids[hit], pos[hit])])

    def cut(rows: pa.Table, marks: pa.Table) -> pa.Table:
        ids, pos = _marked(marks)
        keys, datas = rows.column(doc_id).to_pylist(), rows.column(text).to_pylist()
        texts, words, removed = [], [], []
        for k, at, data in zip(keys, _of(ids, pos, keys), datas):
            starts, ends = word_edges((data or "").encode())
            words.append(len(starts))
            if not len(at):
                texts.append(data)
                removed.append(0)
                continue
            change = np.zeros(len(starts) + 1, np.int64)
            at = at[at + window <= len(starts)]
            change[at] += 1
            np.add.at(change, at + window, -1)
            stay = np.cumsum(change[:-1]) == 0
            raw = data.encode()
            texts.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
            removed.append(int(len(starts) - stay.sum()))
        out = rows.select(names)
        for name, column, kind in (("kept_text", texts, pa.string()), ("n_words", words, pa.int64()), ("n_removed", removed, pa.int64())):
            out = out.append_column(name, pa.array(column, kind))
        return out

    number = F.col(doc_id).cast("long")
    dealt = docs.withColumn(home, F.pmod(F.xxhash64(F.coalesce(number, F.xxhash64(text))), F.lit(buckets)).cast("int"))
    found = (docs.where(number.isNotNull()).select(number.alias("id"), F.col(text).alias("text")).mapInArrow(anchors, PACKED)
             .groupBy("bucket").applyInArrow(repeated, MARKS))
    by_home = dealt.groupBy(home)
    marked = (by_home.cogroup(found.groupBy("home")).applyInArrow(extend, PACKED)
              .groupBy("bucket").applyInArrow(later, MARKS))
    return by_home.cogroup(marked.groupBy("home")).applyInArrow(
        cut, schema + ", kept_text string, n_words long, n_removed long")


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated words taken out of ``text`` (and ``n_chars``, if present, counted anew)."""
    found = substring_dedup(docs, window, text, doc_id)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("kept_text").alias(c))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("kept_text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return found.select(*columns)
