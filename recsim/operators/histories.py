"""Products of item pairs from the users' histories: sparse ratings, where a user has rated few of the items.

Items are dealt into blocks by a hash.  A user's history goes to the blocks that it has an item of, and to no other, so a rating is
sent at most as often as its user has ratings, however many blocks there are; ``gram`` sends it to every block.  The cell of
a block has all ratings that any product of its items needs.  It adds them up stripe by stripe, and its sums are final: pairs
below a threshold and neighbours behind the k-th never leave it, and no table of pairs or partial sums is shuffled.

* Histories travel packed: a batch of users makes one compressed body per block.
* With ``half`` a pair of two blocks is multiplied in the lower one only, which gets the part of a history from its own block on.
* A cell holds the sums of its pairs and one stripe of products, at most ``STEP`` of them unless one rating makes more.
* Where the packed ratings would be many times the ratings, the histories are written once and the blocks take turns: a turn sends to
  its blocks alone, and its shuffle files go before the next, so the disk holds a few packed ratings per rating whatever users rated.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.session import cut_lineage, ship_by_value

ship_by_value(__name__)

LEAST_ROWS = 4_000_000       # rows that the other way would shuffle, below which it is left as it is
SENT = 4                     # packed ratings that weigh as much as one such row
HOTTEST = 1 << 26            # products of one item that a cell may add up
CELL_PRODUCTS = 4_000_000    # products of an average cell
STEP = 1 << 20               # products formed at once
FLUSH = 100_000              # ratings of the users that are packed together, times the turns up to MOST_HELD
MOST_HELD = 8
TURN = 24                    # bytes per rating that a turn sends, a packed rating taken as 2 and one for each of its columns
LEAST_TURN = 128_000_000     # bytes below which there is one turn
STORED = 10_000              # ratings of a stored body: bodies are read many at once
_NARROW = (np.uint8, np.uint16, np.int32, np.float32)


class Layout(NamedTuple):
    blocks: int
    ratings: int
    sent: int            # packed ratings if every history goes whole to the blocks it has an item of

    def turns(self, columns: int, half: bool) -> int:
        """Turns of the blocks so that one sends about ``TURN`` bytes per rating."""
        size = self.sent * (2 + columns) // (1 + half)
        return max(1, min(self.blocks, -(-size // max(TURN * self.ratings, LEAST_TURN))))


def blocks_for(entries: DataFrame, items: int, hottest: int, least: int, most_ratings: int, rows: int,
               products: int | None = None) -> Layout | None:
    """The blocks for ``entries`` of ``items`` items, the most rated of which has ``hottest`` ratings, or None where histories
    are no gain: the other way shuffles few ``rows``, some user has more than ``most_ratings``, some item makes too many products
    for a cell, or users have rated so much of everything that their histories go everywhere.  The results are the same."""
    if rows < LEAST_ROWS or not items:
        return None
    users = cut_lineage(entries.groupBy("userId").agg(F.count(F.lit(1)).alias("_d")), "user-degrees")
    widest, ratings, work = users.agg(F.max("_d"), F.sum("_d"), F.sum(F.col("_d") * F.col("_d"))).first()
    blocks = min(items, max(least, -(-work // (products or CELL_PRODUCTS))))
    if widest > most_ratings or hottest * widest > HOTTEST:
        return None
    sent = users.agg(F.sum(F.col("_d") * F.least(F.col("_d"), F.lit(blocks)))).first()[0]
    return Layout(blocks, ratings, sent) if sent <= SENT * rows else None


def block_of(items: np.ndarray, blocks: int) -> np.ndarray:
    h = items.astype(np.int64).view(np.uint64).copy()
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    return ((h ^ (h >> np.uint64(33))) % np.uint64(blocks)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest type that holds its values exactly."""
    with np.errstate(invalid="ignore", over="ignore"):
        for t in _NARROW if x.dtype.kind == "f" else _NARROW[:-1]:
            y = x.astype(t)
            if np.array_equal(y, x):
                return y
    return x


def _packed(columns: Sequence[np.ndarray]) -> bytes:
    head = struct.pack("<B", len(columns)) + b"".join(struct.pack("<2sQ", c.dtype.str[1:].encode(), len(c)) for c in columns)
    raw = head + b"".join(c.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)
    out, at = [], 1 + 10 * raw[0]
    for c in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * c)
        out.append(np.frombuffer(raw, "<" + kind.decode(), n, at))
        at += out[-1].nbytes
    return out


def _starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of ``count`` runs, one after another."""
    total = np.cumsum(count)
    return np.repeat(first - total + count, count) + np.arange(total[-1] if len(total) else 0)


def _body(size: np.ndarray, items: np.ndarray, values: list[np.ndarray]) -> bytes:
    return _packed([items[:1], _narrow(size), _narrow(np.diff(items, prepend=0)), *map(_narrow, values)])


def _flat(histories: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sizes of the histories, items, values) of unpacked bodies, one after another."""
    items = np.concatenate([h[0][0] - h[2][0].astype(np.int64) + np.cumsum(h[2], dtype=np.int64) for h in histories])
    return (np.concatenate([h[1] for h in histories]).astype(np.int64), items,
            [np.concatenate([h[c] for h in histories]) for c in range(3, len(histories[0]))])


def _in_order(user: np.ndarray, items: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    order = np.lexsort((items, user))
    return user[order], items[order], [v[order] for v in values]


def _bodies(user: np.ndarray, items: np.ndarray, values: list[np.ndarray], blocks: int, half: bool) -> Iterator[tuple[int, bytes]]:
    """(block, body) of whole users; ``user`` numbers them from 0, in order."""
    yield from _sent(*_in_order(user, items, values), blocks, half)


def _sent(user: np.ndarray, items: np.ndarray, values: list[np.ndarray], blocks: int, half: bool, turn: int = 0,
          turns: int = 1) -> Iterator[tuple[int, bytes]]:
    """``_bodies`` of ratings in order, for the blocks of one of ``turns`` turns."""
    block = block_of(items, blocks)
    count = np.bincount(user)
    first = np.cumsum(count) - count
    on = block % turns == turn
    pair = np.unique(block[on] * len(count) + user[on])      # by block, then user
    of, whose = pair // len(count), pair % len(count)
    at = _starts(first[whose], count[whose])
    size = count[whose]
    if half:
        owner = np.repeat(np.arange(len(whose)), size)
        keep = block[at] >= of[owner]
        at, size = at[keep], np.bincount(owner[keep], minlength=len(whose))
    some = size > 1                                            # a single rating makes no product
    at, of, size = at[np.repeat(some, size)], of[some], size[some]
    if not len(of):
        return
    cols = [_narrow(size), _narrow(np.diff(items[at], prepend=0))] + [_narrow(v)[at] for v in values]
    ends = np.cumsum(size)
    begin = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
    for lo, hi in zip(begin, np.r_[begin[1:], len(of)]):
        e0, e1 = ends[lo] - size[lo], ends[hi - 1]
        yield int(of[lo]), _packed([np.array([items[at[e0]]]), cols[0][lo:hi], cols[1][e0:e1], *(c[e0:e1] for c in cols[2:])])


def _column(c: pa.Array) -> np.ndarray:
    return c.cast(pa.float64() if pa.types.is_floating(c.type) else pa.int64()).to_numpy(zero_copy_only=False)


def numbered(who: pa.Array, number: int, last: tuple | None) -> tuple[np.ndarray, tuple]:
    """The users of a batch in order as numbers that rise by one with each new user, on from ``number``, and the mark of the
    last one.  A null user is a user like any other."""
    missing = who.is_null().to_numpy(zero_copy_only=False)
    who = who.fill_null("" if pa.types.is_string(who.type) else 0).to_numpy(zero_copy_only=False)
    new = np.r_[last is None or last != (missing[0], who[0]), (who[1:] != who[:-1]) | (missing[1:] != missing[:-1])]
    return number + np.cumsum(new), (missing[-1], who[-1])


def _by_users(entries: DataFrame, columns: Sequence[str], make: Callable, least: int) -> DataFrame:
    """(cell, body): what ``make`` yields for the users of a task, those of about ``least`` ratings at a time."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, last, number = 0, None, 0

        def flush(cut: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            user, items, *values = [np.concatenate(x) for x in zip(*held)]
            if cut:
                yield from _batches(make(user[:cut] - user[0], items[:cut], [v[:cut] for v in values]))
            held, rows = [[x[cut:] for x in (user, items, *values)]], len(user) - cut

        for batch in batches:
            if not batch.num_rows:
                continue
            user, last = numbered(batch.column(0), number, last)
            number = int(user[-1])
            held.append([user, *(_column(batch.column(c)) for c in range(1, batch.num_columns))])
            rows += len(user)
            if rows >= least:
                whole = np.concatenate([h[0] for h in held])
                yield from flush(int(np.searchsorted(whole, whole[-1])))
        if rows:
            yield from flush(rows)

    plain = entries.select("userId", "movieId", *columns)
    return plain.repartition("userId").sortWithinPartitions("userId").mapInArrow(pack, "cell int, body binary")


def _batches(bodies: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    got = list(bodies)
    for lo in range(0, len(got), 1024):
        part = got[lo:lo + 1024]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], names=["cell", "body"])


def history_cells(entries: DataFrame, columns: Sequence[str], blocks: int, half: bool) -> DataFrame:
    """(cell, body): the histories of ``entries`` (userId, movieId, ``columns``; one row per user and item) that the blocks need.

    Numeric columns without nulls; a null user is a user like any other."""
    return _by_users(entries, columns, lambda user, items, values: _bodies(user, items, values, blocks, half), FLUSH)


def stored_histories(entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cell, body): the histories whole, written once, for ``turn_cells``; a user is in one body, and ``cell`` says nothing."""
    def make(user, items, values):
        user, items, values = _in_order(user, items, values)
        size = np.bincount(user)
        ends = np.cumsum(size)
        cuts = np.r_[0, np.flatnonzero(np.diff(ends // STORED)) + 1, len(size)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = slice(ends[lo] - size[lo], ends[hi - 1])
            yield 0, _body(size[lo:hi], items[part], [v[part] for v in values])

    return cut_lineage(_by_users(entries, columns, make, STORED), "histories", **{"parquet.block.size": 8 << 20, "compression": "none"})


def turn_cells(stored: DataFrame, blocks: int, half: bool, turn: int, turns: int) -> DataFrame:
    """``history_cells`` for the blocks of one turn."""
    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        size, items, values = _flat(held)
        yield from _batches(_sent(np.repeat(np.arange(len(size)), size), items, values, blocks, half, turn, turns))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = (body.as_py() for batch in batches for body in batch.column(0))
        for held in stripes(bodies, FLUSH * min(turns, MOST_HELD)):
            yield from send(held)

    return stored.select("body").mapInArrow(deal, "cell int, body binary")


def by_cells(entries: DataFrame, columns: Sequence[str], layout: Layout, half: bool, cell: Callable, schema: str, name: str,
             write: bool = False) -> DataFrame:
    """What ``cell`` makes of the histories of every block, written if there is more than one turn or ``write`` says so."""
    turns, made = layout.turns(len(columns), half), lambda sent: sent.groupBy("cell").applyInPandas(cell, schema)
    if turns == 1:
        once = made(history_cells(entries, columns, layout.blocks, half))
        return cut_lineage(once, name) if write else once
    stored = stored_histories(entries, columns)
    return reduce(DataFrame.union, [cut_lineage(made(turn_cells(stored, layout.blocks, half, t, turns)), name) for t in range(turns)])


def products(histories: list[list[np.ndarray]], cell: int, blocks: int, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(a, b, columns) of unpacked histories, about ``STEP`` at once: the places of both ratings of every product of an item of the cell in
    ``columns`` (items, then values)."""
    size, items, values = _flat(histories)
    columns = [items] + [v.astype(np.float64) for v in values]
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    block = block_of(items, blocks)
    mine = np.flatnonzero(block == cell)
    total = np.cumsum(size[owner[mine]])
    i = 0
    while i < len(mine):
        base = total[i - 1] if i else 0
        e = max(int(np.searchsorted(total, base + STEP, "right")), i + 1)
        row = mine[i:e]
        a = np.repeat(row, size[owner[row]])
        b = _starts(first[owner[row]], size[owner[row]])
        keep = (block[b] != cell) | (items[b] > items[a]) if half else items[a] != items[b]
        yield a[keep], b[keep], columns
        i = e


def summed(i: np.ndarray, j: np.ndarray, sums: Sequence[np.ndarray], lows: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray, list, list]:
    """The distinct (i, j) in order, with the total of each of ``sums`` and the least of each of ``lows``."""
    if not len(i):
        return i, j, list(sums), list(lows)
    ids_i, ci = np.unique(i, return_inverse=True)
    ids_j, cj = np.unique(j, return_inverse=True)
    key = ci * len(ids_j) + cj
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
    key = key[begin]
    return (ids_i[key // len(ids_j)], ids_j[key % len(ids_j)], [np.add.reduceat(s[order], begin) for s in sums],
            [np.minimum.reduceat(x[order], begin) for x in lows])


class Sums:
    """Totals per pair, added stripe by stripe; what is held grows with the distinct pairs, not with the products."""

    def __init__(self):
        self.parts, self.waiting, self.settled = [], 0, 0

    def add(self, part: tuple) -> None:
        self.parts.append(part)
        self.waiting += len(part[0])
        if self.waiting > max(STEP, self.settled):
            self.settle()

    def settle(self) -> tuple:
        if len(self.parts) > 1:
            i, j = (np.concatenate([p[c] for p in self.parts]) for c in (0, 1))
            sums, lows = ([np.concatenate(x) for x in zip(*(p[c] for p in self.parts))] for c in (2, 3))
            self.parts = [summed(i, j, sums, lows)]
        self.waiting, self.settled = 0, len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), [], [])


def frames(**columns) -> Iterator[pd.DataFrame]:
    n = len(next(iter(columns.values())))
    for lo in range(0, n, STEP):
        yield pd.DataFrame({name: x[lo:lo + STEP] for name, x in columns.items()})


def stripes(bodies, ratings: int) -> Iterator[list[list[np.ndarray]]]:
    """Unpacked histories in stripes of about ``ratings`` ratings or ``STEP``, whichever is less."""
    held, n = [], 0
    for body in bodies:
        held.append(_unpacked(body))
        n += len(held[-1][2])
        if n >= min(ratings, STEP):
            yield held
            held, n = [], 0
    if held:
        yield held
