"""Packing documents into training sequences of bounded length by swap-based local search.

Tokens: a document's ids by a public tokenizer, then an end id.  Longer documents are cut
into pieces of the sequence length, the last piece may be shorter.

Packing: the pieces are dealt into groups of bounded size.  In a group, best fit decreasing
gives a first packing; then, while there are more bins than the tokens need, documents of
the emptiest bin move to fuller bins, or are exchanged one for one or two for one against
documents there.  Every step raises the sum of squared fills, so the search ends.  The
emptiest bins of all groups (a bounded share of each group) are dealt anew and packed again
in fewer groups, until one group is left.  A round's result is a table in the shared
checkpoint folder; the driver learns only how many pieces are left.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import blobs, cut_lineage, ship

#: Pieces that one task packs.
GROUP_ROWS = 20_000
#: A group hands on at most this share of its pieces.
CARRY = 1 / 16
#: Words whose ids a worker keeps at hand.
CACHE = 1 << 17

ship(__name__)


#: Signs that the tokenizer's pattern parts, as one run, from an ASCII letter before them.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27)
#: Letters that are lowered one by one and need no more than their bytes' signs (up to Latin Extended-A).
_PLAIN = frozenset(chr(c) for c in range(0x180) if chr(c).isalpha() and c not in (0x130, 0x149, 0x17F) and len(chr(c).lower()) == 1)


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself where it is
    printable in Latin-1, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordIds:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer lowers letters, drops white space, never joins across it and parts letters from
    signs, so a text's ids are those of its lower-cased words (split at ASCII white space) one
    after the other, a run of last signs by itself.  Words of plain letters go straight to the
    tokenizer's model, others through all of it.  Ids of words are kept in two tables of bounded
    size: when the newer one is full it becomes the older, whose words move up when met.

    With ``special`` the tokenizer's special tokens ('<|endoftext|>') that a text spells out get their
    own ids, as in the tokenizer as loaded; otherwise they are ordinary signs and letters.  Words
    that may hold one go to the tokenizer whole and in their own case."""

    def __init__(self, path: str, limit: int = CACHE, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.signs = byte_signs()

    def _marked(self, low: bytes) -> bool:
        """Whether a lower-cased text spells out a special token in some case."""
        return any(m in low for m in self.marks)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = 4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _of(self, word: bytes, slow: list[bytes], marked: bool) -> bytes | None:
        """The ids of a word that no table has; None, and the word added to ``slow``, if it needs the whole
        tokenizer.  Only in a ``marked`` text a word may spell out a special token."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
        if ids is None:
            if marked and self._marked(word.lower()):
                slow.append(word)
                return None
            if len(word) <= 64 and word.isalpha():     # ASCII letters
                ids = self.known[word] = array("I", [t.id for t in self.model.tokenize(word.lower().decode())]).tobytes()
                return ids
            stem = word.rstrip(_SIGNS)
            if stem and len(stem) < len(word) and 97 <= stem[-1] <= 122:
                first, last = self._of(stem, slow, marked), self._of(word[len(stem):], slow, marked)
                return None if first is None or last is None else first + last
            text = unicodedata.normalize("NFC", word.decode())
            if len(text) > 64 or not _PLAIN.issuperset(text):
                slow.append(word)
                return None
            text = text.lower()
            raw = text.encode()
            if not raw.isascii():
                text = "".join([self.signs[b] for b in raw])
            ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            self.known[word] = ids
        return ids

    def __call__(self, data: bytes) -> bytes:
        low = data.lower()
        words = low.split()
        marked = self._marked(low)
        if marked:
            words = [w if self._marked(v) else v for w, v in zip(data.split(), words)]
        found = list(map(self.known.get, words))
        if None in found:
            miss = [i for i, ids in enumerate(found) if ids is None]
            slow: list[bytes] = []
            new = {w: self._of(w, slow, marked) for w in {words[i] for i in miss}}
            slow = list(dict.fromkeys(slow))
            for i in range(0, len(slow), 1024):
                part = slow[i:i + 1024]
                self.known.update(zip(part, self._encode(part)))
            for w, ids in new.items():
                self.known[w] = self._of(w, [], marked) if ids is None else ids
            for i in miss:
                found[i] = self.known[words[i]]
            if len(self.known) > self.limit:
                self.older, self.known = self.known if len(self.known) < 2 * self.limit else {}, {}
        return b"".join(found)


def word_ids(path: str) -> WordIds:
    """The ids that this worker process knows: tasks that follow in the same process share them."""
    import tokenizers
    kept = vars(tokenizers).setdefault("_kept_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path, special=True)
    return kept[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1,
                 text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit numbers) and, with ``ids``, those bytes.  Special tokens that a text
    spells out have their own ids, as in the tokenizer as loaded.  A null text is
    empty (its one piece is the end id); null ids and repeated rows stay; other columns are
    not read."""
    schema = PIECE + (", ids binary" if ids else "")

    def cut(batches):
        encode = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, data in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                tokens = encode(data) + end
                for k, at in enumerate(range(0, len(tokens), 4 * max_tokens)):
                    part = tokens[at:at + 4 * max_tokens]
                    for column, value in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            n = 6 if ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


# ---------------------------------------------------------------- packing inside a group

def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit decreasing: bins of indices into ``lengths``.  Bins are found by their gap, through
    a bit set of the gaps in use."""
    bins: list[list[int]] = []
    at_gap: list[list[int]] = [[] for _ in range(size + 1)]
    used = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = used >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = at_gap[gap].pop()
            if not at_gap[gap]:
                used &= ~(1 << gap)
            bins[b].append(i)
        else:
            b, gap = len(bins), size
            bins.append([i])
        gap -= n
        if gap:
            at_gap[gap].append(b)
            used |= 1 << gap
    return bins


class _Search:
    """The state of a local search: which bin each document is in, and the bins' fills.

    A bin without a step gets one only by a change of a bin that it could give to, so it is tried
    again against the bins changed since, and only if its fill and lengths allow a step there."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.size, self.length = size, np.array(lengths, np.int64)
        self.members = [sorted(b) for b in bins]
        self.bin_of = np.empty(len(self.length), np.int64)
        for k, b in enumerate(bins):
            self.bin_of[b] = k
        self.fill = np.bincount(self.bin_of, self.length, len(bins)).astype(np.int64)
        self.least, self.most = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
        self.sums: dict[int, tuple] = {}
        #: By sum of one or two documents, the bins that have it.
        self.has = np.zeros((size + 1, len(bins)), bool)
        for k in range(len(bins)):
            self._changed(k)
        self.able = np.ones(len(bins), bool)
        #: The step of a bin's last change, and the step after which it was last tried in vain.
        self.changed, self.tried = np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64)

    def _changed(self, k: int) -> None:
        self.sums.pop(k, None)
        if self.members[k]:
            lengths = self.length[self.members[k]]
            self.least[k], self.most[k] = lengths.min(), lengths.max()
        self.has[:, k] = False
        if self.members[k]:
            self.has[self._sums(k)[2], k] = True

    def _sums(self, k: int) -> tuple:
        """Distinct lengths in the bin with a document of each, and the distinct sums of one or any two with
        those documents.  Documents of equal length are alike, and a bin has few distinct lengths."""
        if k not in self.sums:
            mine = np.array(self.members[k])
            kinds, first, count = np.unique(self.length[mine], return_index=True, return_counts=True)
            second = mine[first]
            for i in np.flatnonzero(count > 1):
                second[i] = mine[self.length[mine] == kinds[i]][1]
            a, b = np.triu_indices(len(kinds))
            two = (a != b) | (count[a] > 1)
            a, b = a[two], b[two]
            x = np.concatenate((mine[first], mine[first][a]))
            y = np.concatenate((np.full(len(kinds), -1), np.where(a == b, second[b], mine[first][b])))
            sums, at = np.unique(np.concatenate((kinds, kinds[a] + kinds[b])), return_index=True)
            self.sums[k] = kinds, mine[first], sums, x[at], y[at]
        return self.sums[k]

    def _give(self, out: list[int], back: list[int], donor: int, to: int) -> None:
        for xs, old, new in ((out, donor, to), (back, to, donor)):
            for x in xs:
                self.members[old].remove(x)
                self.members[new].append(x)
                self.bin_of[x] = new
                self.fill[old] -= self.length[x]
                self.fill[new] += self.length[x]
        self.members[donor].sort()
        self.members[to].sort()

    def step(self, donor: int) -> int:
        """One move or exchange out of bin ``donor`` that raises the squared fill; the bin it went to, -1 if there
        is none.  A move: into the fullest bin with room.  An exchange: one or any two documents of the donor
        against one of a bin at least as full, with the largest gain that fits there."""
        own, size, fill = self.fill[donor], self.size, self.fill
        kinds, first, sums, one, two = self._sums(donor)
        bins = np.flatnonzero((self.changed > self.tried[donor]) & (fill < size) & (fill > 0))
        bins = bins[bins != donor]
        if not len(bins):
            return -1
        have = fill[bins]
        if have.min() + kinds[0] <= size:
            for n, x in zip(kinds[::-1], first[::-1]):
                fits = (have <= size - n) & (have > own - n)
                if fits.any():
                    to = int(bins[np.argmax(np.where(fits, have, -1))])
                    self._give([int(x)], [], donor, to)
                    return to
        bins = bins[have >= own]
        if not len(bins):
            return -1
        theirs = np.array([x for k in bins.tolist() for x in self.members[k]])
        room = size - fill[self.bin_of[theirs]]
        best = np.searchsorted(sums, room + self.length[theirs], "right") - 1
        gains = np.where(best >= 0, sums[best] - self.length[theirs], 0)
        k = int(np.argmax(gains))
        if gains[k] <= 0:
            return -1
        to = int(self.bin_of[theirs[k]])
        self._give([int(x) for x in (one[best[k]], two[best[k]]) if x >= 0], [int(theirs[k])], donor, to)
        return to

    def run(self) -> None:
        need, turn = -(-int(self.length.sum()) // self.size), 1
        used = np.count_nonzero(self.fill)
        while used > need:
            able = np.flatnonzero(self.able & (self.fill > 0) & (self.fill < self.size))
            if not len(able):
                break
            donor = int(able[np.argmin(self.fill[able])])
            to = self.step(donor)
            if to < 0:
                self.able[donor], self.tried[donor] = False, turn
                continue
            turn += 1
            used -= self.fill[donor] == 0
            for k in (donor, to):
                self._changed(k)
                self.changed[k], self.tried[k], self.able[k] = turn, 0, True
            for k in (donor, to):
                f = self.fill[k]
                if 0 < f < self.size:
                    gains = [self.has[n + 1:n + 1 + self.size - f].any(axis=0) for n in self._sums(k)[0].tolist()]
                    self.able |= (self.fill <= f) & np.logical_or.reduce(gains)
                    self.able |= (self.fill < f + self.most) & (f + self.least <= self.size)


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empties bins while there are more than the tokens need: the emptiest bin that can gives
    documents to fuller ones by moves and exchanges.  Ends when no bin has such a step."""
    if len(bins) <= -(-sum(lengths) // size):
        return bins
    search = _Search(bins, lengths, size)
    search.run()
    return [b for b in search.members if b]


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    return local_search(best_fit(lengths, size), lengths, size)


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``max_tokens``) plus ``sequence_id`` and ``offset``: pieces
    of a sequence follow each other without gaps from 0.  Other columns stay.  Which of
    several pieces of equal length goes where follows from their group and their order by all columns;
    groups follow from the places in a written table, so a task run again gives the same.  No piece, no sequence."""
    names = pieces.columns
    # groups are dealt by a row's place in the staged files, so equal rows spread too
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    schema = pieces.schema.simpleString()[len("struct<"):-1] + ",sequence_id:bigint,offset:bigint,carried:boolean"
    rest, done, turn = cut_lineage(pieces, "pieces"), None, 0
    while True:
        groups = max(1, -(-rest.count() // group_rows))
        last = groups == 1

        def pack(rows: pa.Table) -> pa.Table:
            group = rows.column("group")[0].as_py()
            rows = rows.select(names).sort_by([(c, "ascending") for c in names])
            lengths = rows.column("length").to_pylist()
            bins = pack_lengths(lengths, max_tokens)
            fill = [sum(lengths[i] for i in b) for b in bins]
            sequence, offset, carried = (np.zeros(len(lengths), np.int64) for _ in range(3))
            budget = 0 if last else int(len(lengths) * CARRY)
            for n, k in enumerate(sorted(range(len(bins)), key=lambda k: fill[k])):
                give = len(bins[k]) <= budget and fill[k] < max_tokens
                budget = budget - len(bins[k]) if give else 0
                at = 0
                for i in bins[k]:
                    sequence[i], offset[i], carried[i] = (turn << 56) + (group << 24) + n, at, give
                    at += lengths[i]
            for name, column in (("sequence_id", sequence), ("offset", offset), ("carried", carried.astype(bool))):
                rows = rows.append_column(name, pa.array(column))
            return rows

        dealt = rest.select(*names, F.pmod(F.xxhash64(F.lit(turn), *place), F.lit(groups)).alias("group"))
        packed = cut_lineage(dealt.groupBy("group").applyInArrow(pack, schema), "packed")
        final = packed.where("not carried").drop("carried")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        rest, turn = packed.where("carried"), turn + 1


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1,
                   text: str = "text", doc_id: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is packed at."""
    return pack_pieces(token_pieces(docs, tokenizer, max_tokens, end_id, text, doc_id), max_tokens, group_rows)


def sequence_tokens(docs: DataFrame, packed: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int).  Needs distinct doc_ids."""
    pieces = token_pieces(docs, tokenizer, max_tokens, end_id, ids=True).select("doc_id", "piece", "ids")

    @F.pandas_udf("array<int>")
    def numbers(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: np.frombuffer(b"".join(b), "<u4").astype(np.int32))

    placed = packed.join(pieces, ["doc_id", "piece"])
    ordered = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", numbers(F.col("parts.ids")).alias("ids"))
