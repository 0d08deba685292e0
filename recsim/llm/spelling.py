"""Spelling variants: the words one inserted, deleted or replaced code point apart, by search schemes over FM-indexes.

Of two such words one half of the first, cut in the middle, stands unchanged at its end of the second.  So
the vocabulary is indexed in both directions.  The text of an index is the words behind delimiters, read as a circle; its state
is an interval of suffix ranks, and putting a symbol before the pattern is one rank query per bound.  A search starts at a
delimiter, matches one half exactly and extends across the other, at each place going on exactly or spending its one error;
it ends at the next delimiter with the rank of one word.  The index of the reversed words does the same for the other half.

Words meet in shards by the two code points at the exact half's end, so one shard holds all partners of that half; a
large shard is cut into index parts, and each part of its words searches each of them.  A shard returns one row per word
with partners: how many, and the most frequent one, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import cut_lineage, ship

#: Symbols of an index, and words that search it at a time.
INDEX_SYMBOLS, SEARCHES = 1 << 18, 2048
#: Code points at the end of a half that choose a shard.
ENDS = 2

ship(__name__)


class FmIndex:
    """Suffix ranks over the circular text 0 w1 0 w2 ... of distinct words, given as arrays of symbols from 1 on."""

    def __init__(self, words: list[np.ndarray], symbols: int):
        lengths = np.array([len(w) for w in words])
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        self.text = np.zeros(int((lengths + 1).sum()), np.int64)
        for at, w in zip(self.starts, words):
            self.text[at + 1:at + 1 + len(w)] = w
        self.size, self.symbols = len(self.text), symbols
        self.suffixes = self._sorted()
        self.before = self.text[self.suffixes - 1]     # the symbol before each suffix: the transform
        self.ranks = np.sort(self.before * self.size + np.arange(self.size))

    def _sorted(self) -> np.ndarray:
        """Starts of the text's rotations in order: ranks by as many symbols as fit a number, then doubled."""
        bits = max(1, int(self.symbols).bit_length())
        have = max(1, 62 // bits)
        key = np.zeros(self.size, np.int64)
        for i in range(have):
            key = (key << bits) | np.roll(self.text, -i)
        while True:
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], (np.diff(key[order]) != 0).cumsum()))
            if new[-1] == self.size - 1:
                return order
            rank = np.empty(self.size, np.int64)
            rank[order] = new
            key = rank * self.size + np.roll(rank, -have)
            have *= 2

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` before them (none of the text's symbols: empty)."""
        at = np.where(symbol < 0, 0, symbol) * self.size
        low, high = np.searchsorted(self.ranks, at + low), np.searchsorted(self.ranks, at + high)
        return low, np.where(symbol < 0, low, high)

    def choices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) for the symbols that may stand before each interval: those read off a narrow one, all before a wide one."""
        wide = high - low > self.symbols
        narrow = np.flatnonzero(~wide)
        width = (high - low)[narrow]
        at = np.repeat(low[narrow] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        seen = np.unique(np.repeat(narrow, width) * (self.symbols + 1) + self.before[at])
        wide = np.flatnonzero(wide)
        each = np.concatenate((seen // (self.symbols + 1), np.repeat(wide, self.symbols)))
        symbol = np.concatenate((seen % (self.symbols + 1), np.tile(np.arange(1, self.symbols + 1), len(wide))))
        return each[symbol > 0], symbol[symbol > 0]


def one_error(index: FmIndex, queries: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for the words that end in the last ``exact`` symbols of a query and differ by one error before them, once each.

    An insertion or deletion in a run of equal symbols is tried at the run's front only."""
    size = np.array([len(q) for q in queries])
    ends = np.cumsum(size + 1)                         # a zero stands before each query, so the next symbol is the delimiter at last
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    for at, q in zip(ends, queries):
        flat[at - len(q):at] = q
    nxt = lambda q, done: flat[ends[q] - 1 - done]  # noqa: E731  the symbol to match after ``done`` from the end
    q = np.arange(len(queries))
    low, high, done = np.zeros(len(q), np.int64), np.full(len(q), len(index.starts), np.int64), np.zeros(len(q), np.int64)
    while len(go := np.flatnonzero((done < exact[q]) & (low < high))):
        low[go], high[go] = index.extend(low[go], high[go], nxt(q[go], done[go]))
        done[go] += 1
    keep = low < high
    q, low, high, done = (x[keep] for x in (q, low, high, done))
    found: list[tuple] = []
    while len(q):
        open_ = done < size[q]
        each, symbol = index.choices(low, high)
        other = ~open_[each] | (symbol != nxt(q[each], done[each]))
        each, symbol = each[other], symbol[other]
        lo, hi = index.extend(low[each], high[each], symbol)
        hit = lo < hi
        each, lo, hi = each[hit], lo[hit], hi[hit]
        swap = open_[each]                             # replaced: the query's own symbol is passed over
        gone = np.flatnonzero(open_ & ((done + 1 == size[q]) | (nxt(q, done) != nxt(q, np.minimum(done + 1, size[q])))))
        branch = [np.concatenate(x) for x in ((q[each], q[each[swap]], q[gone]), (lo, lo[swap], low[gone]), (hi, hi[swap], high[gone]),
                                              (done[each], done[each[swap]] + 1, done[gone] + 1))]
        found.append(_finish(index, *branch, size, nxt))
        q, low, high, done = (x[open_] for x in (q, low, high, done))
        low, high = index.extend(low, high, nxt(q, done)) if len(q) else (low, high)
        done = done + 1
        keep = low < high
        q, low, high, done = (x[keep] for x in (q, low, high, done))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _finish(index: FmIndex, q, low, high, done, size, nxt) -> tuple[np.ndarray, np.ndarray]:
    """Matches what is left of the queries exactly, delimiter included; the words whose rank is left."""
    out_q, out_word = [], []
    while len(q):
        last = done == size[q]
        low, high = index.extend(low, high, np.where(last, 0, nxt(q, np.minimum(done, size[q]))))
        hit = np.flatnonzero(last & (low < high))
        out_q.append(q[hit])
        out_word.append(np.searchsorted(index.starts, index.suffixes[low[hit]]))
        keep = ~last & (low < high)
        q, low, high, done = q[keep], low[keep], high[keep], done[keep] + 1
    return (np.concatenate(out_q), np.concatenate(out_word)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _code_points(words: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words]


def partners(queries: list[str], words: list[str], front: bool):
    """Yields (query, word) positions of the near words that hold a query's first (``front``) or second half unchanged; the latter
    leave out those that hold the first half too."""
    flip = (lambda w: w[::-1]) if front else (lambda w: w)
    texts = _code_points([flip(w) for w in words])
    alphabet = np.unique(np.concatenate(texts))
    index = FmIndex([np.searchsorted(alphabet, t) + 1 for t in texts], len(alphabet))
    for i in range(0, len(queries), SEARCHES):
        part = queries[i:i + SEARCHES]
        codes = []
        for c in _code_points([flip(w) for w in part]):
            at = np.minimum(np.searchsorted(alphabet, c), len(alphabet) - 1)
            codes.append(np.where(alphabet[at] == c, at + 1, -1))
        half = np.array([len(w) // 2 if front else len(w) - len(w) // 2 for w in part])
        for q, w in zip(*(x.tolist() for x in one_error(index, codes, half))):
            a = part[q]
            if front or not words[w].startswith(a[:len(a) // 2]):
                yield i + q, w


def near_words(vocabulary: DataFrame, ends: int = ENDS, index_symbols: int = INDEX_SYMBOLS) -> DataFrame:
    """(word, n_near, best) for the words of ``vocabulary`` (word, n; distinct) that have near words; best is (-n, word) of the most
    frequent one, ties by code-point order.  Words must have at least 2 * ``ends`` code points."""
    key = F.when(F.col("front"), F.substring("word", 1, ends)).otherwise(F.substring("word", -ends, ends)) if ends else F.lit("")
    shuffle = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    symbols = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(shuffle, -(-symbols // index_symbols))
    words = (vocabulary.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("front"))
             .withColumn("shard", F.pmod(F.xxhash64("front", key), F.lit(shards))))
    sizes = cut_lineage(words.groupBy("front", "shard").agg(F.ceil(F.sum(F.length("word") + 1) / index_symbols).cast("int").alias("parts")), "shards")
    cells = sizes.agg(F.sum(F.col("parts").cast("long") * F.col("parts"))).first()[0] or 1
    dealt = (words.join(sizes, ["front", "shard"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
             .withColumn("across", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    both = (dealt.select("front", "shard", F.col("own").alias("at_q"), F.col("across").alias("at_i"), F.lit(True).alias("asks"), "word", "n")
            .unionByName(dealt.select("front", "shard", F.col("across").alias("at_q"), F.col("own").alias("at_i"), F.lit(False).alias("asks"), "word", "n")))

    def search(table: pa.Table) -> pa.Table:
        front, asks = table.column("front")[0].as_py(), table.column("asks")
        queries = table.filter(asks).column("word").to_pylist()
        held = table.filter(pa.compute.invert(asks))
        words, n = held.column("word").to_pylist(), held.column("n").to_pylist()
        count, best = {}, {}
        for q, w in partners(queries, words, front) if queries and words else ():
            count[q] = count.get(q, 0) + 1
            best[q] = min(best.get(q, (1, "")), (-n[w], words[w]))
        return pa.table({"word": pa.array([queries[q] for q in count], pa.string()), "n_near": pa.array(count.values(), pa.int64()),
                         "best_n": pa.array([best[q][0] for q in count], pa.int64()), "best_word": pa.array([best[q][1] for q in count], pa.string())})

    cell = ["front", "shard", "at_q", "at_i"]
    found = both.repartition(max(shuffle, min(cells, 100_000)), *cell).groupBy(*cell).applyInArrow(search, "word string, n_near long, best_n long, best_word string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("best_n", "best_word")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each ``word`` over its ``form``.  Every round doubles the steps taken and ends as a table in
    the checkpoint folder; forms must not run in circles."""
    state = cut_lineage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut_lineage(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                            "roots")
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def group_variants(occurrences: DataFrame, *, least_length: int = 5, least_n: int = 3, word: str = "word",
                   index_symbols: int = INDEX_SYMBOLS) -> DataFrame:
    """One row per distinct word of ``least_length`` code points and ``least_n`` occurrences: (word, n, n_near, form, form_n, root).

    n counts its rows in ``occurrences``, n_near the other words of the result one inserted, deleted or replaced code point away (0 if none).
    form is the near word of largest n, ties by code-point order, if that n is at least twice the word's own, else null, as
    form_n is; root is the last word reached over forms, the word itself if it has none.

    Null words do not count.  Words of any length are searched whole.  Other columns are not read.  An empty table gives an empty result.
    """
    if least_length < 1:
        raise ValueError("least_length must be at least 1")
    vocabulary = cut_lineage(occurrences.select(F.col(word).cast("string").alias("word")).where(F.length("word") >= least_length)
                             .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n), "vocabulary")
    near = near_words(vocabulary, min(ENDS, least_length // 2), index_symbols)
    best_n = -F.col("best.best_n")
    much = best_n >= 2 * F.col("n")
    told = cut_lineage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.best_word")).alias("form"),
        F.when(much, best_n).alias("form_n")), "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
