"""Byte-level BPE: encoding and decoding.

The text is cut by the vocabulary's pattern; every match is encoded by itself, and every
distinct word of the corpus once:

1. Blocks of documents number their distinct words.  The words travel to buckets by their hash, the
   documents, as numbers of words, to a task of the block's own.
2. A bucket collects the distinct words of all blocks.  Their encoding is a fold in Spark's
   higher-order functions over the word's bytes: each step merges the adjacent pair of lowest rank,
   with the ranks in two arrays, with a perfect hash of the pair as the place.  Decoding folds ids into one
   binary by concatenating pieces from an array.  A broadcast row holds the arrays, once per executor: as literals
   every task would unpack them anew, at each place that reads them.
3. Each block gets the ids and decoded bytes of its words back and puts its documents together.

A word that stands in every block costs a bucket one entry per block.  Everything is packed and compressed;
documents cross the network once, as numbers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recsim.llm.common import fan_out, ship, spark_xxhash64

#: Characters of the documents of one block; a longer document is a block of its own.
BLOCK = 8 << 20
#: Texts of a batch that are unpacked at a time.
TEXTS = 64
#: Ids lie below this; (left * LEFT + right) * LEFT + joined is an entry of the rank map.
LEFT = 1 << 20

ship(__name__)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary in the tiktoken format: base64 piece and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of what they join to, for every split of a piece into two pieces."""
    return {(ranks[p[:k]], ranks[p[k:]]): i for p, i in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}


def perfect_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, entries): ``key`` lies at place xxhash64(key, shift) of the entries, where its shift is at
    place xxhash64(key) of the shifts, all modulo the lengths (hash and displace).  An entry is
    key * LEFT + value, or -1 where there is none."""
    size = max(8, 1 << int(len(keys) * 4 / 3).bit_length())
    shifts = np.zeros(max(1, size // 4), np.int64)
    first = spark_xxhash64(keys)
    bucket = first % len(shifts)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []
    entries = np.full(size, -1, np.int64)
    for group in sorted(groups, key=len, reverse=True):
        shift = 0
        while True:
            place = spark_xxhash64(np.full(len(group), shift), first[group]) % size
            if (entries[place] < 0).all() and len(set(place.tolist())) == len(place):
                break
            shift += 1
        shifts[bucket[group[0]]], entries[place] = shift, keys[group] * LEFT + values[group]
    return shifts, entries


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside a fold."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def piece_list(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The piece of every id."""
    pieces: list = [None] * (max(ranks.values(), default=-1) + 1)
    for p, i in ranks.items():
        pieces[i] = p
    return pieces


def joined(ids: Column, pieces: Column) -> Column:
    """The pieces of the ids in one binary."""
    return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.get(pieces, i.cast("int"))))


class Vocabulary:
    """The arrays that the folds read; the ids of pieces are their ranks.  ``encode`` and ``decode`` read the columns of
    ``table``, so they need a row joined with it."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = merge_pairs(ranks)
        if any(i >= LEFT for i in ranks.values()):
            raise ValueError(f"ids must lie below {LEFT}")
        self.shifts, self.entries = perfect_table(np.array([a * LEFT + b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64))
        self.pieces = piece_list(ranks)
        self.bytes = F.from_json(F.lit(json.dumps([ranks.get(bytes([b]), -1) for b in range(256)])), "array<bigint>")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row with the arrays: _shifts, _entries and _pieces."""
        return F.broadcast(spark.createDataFrame(pa.table(
            {"_shifts": pa.array([self.shifts], pa.list_(pa.int64())), "_entries": pa.array([self.entries], pa.list_(pa.int64())),
             "_pieces": pa.array([self.pieces], pa.list_(pa.binary()))})))

    def merged(self, a: Column, b: Column) -> Column:
        """Id of the piece that two ids join to, null if there is none."""
        def look(key: Column) -> Column:
            shift = F.get("_shifts", F.pmod(F.xxhash64(key), F.lit(len(self.shifts))).cast("int"))
            entry = F.get("_entries", F.pmod(F.xxhash64(key, shift), F.lit(len(self.entries))).cast("int"))
            return let(entry, lambda e: F.when(F.shiftright(e, 20) == key, e.bitwiseAND(F.lit(LEFT - 1).cast("long"))))

        return let(a * LEFT + b, look)

    def encode(self, data: Column) -> Column:
        """Ids of a word given as an array of its bytes (numbers from 0 to 255)."""
        none = F.expr("cast(array() as array<bigint>)")

        def ranked(ids: Column) -> Column:
            """The ids, and of each adjacent pair what it joins to."""
            ranks = F.transform(F.slice(ids, 2, F.size(ids)), lambda b, i: self.merged(F.get(ids, i), b))
            return F.struct(ids.alias("ids"), ranks.alias("ranks"))

        def step(acc: Column, _: Column) -> Column:
            """Joins the leftmost pair of the lowest rank and looks up the pairs beside it anew."""
            ids, ranks = acc["ids"], acc["ranks"]

            def join(low: Column) -> Column:
                def at_place(at: Column) -> Column:            # 1-based, of the left id
                    left = F.when(at > 1, F.array(self.merged(F.get(ids, at - 2), low))).otherwise(none)
                    right = F.when(at < F.size(ranks), F.array(self.merged(low, F.get(ids, at + 1)))).otherwise(none)
                    return F.struct(
                        F.concat(F.slice(ids, 1, at - 1), F.array(low), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                        F.concat(F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, F.size(ids))).alias("ranks"))

                return F.when(low.isNull(), acc).otherwise(let(F.array_position(ranks, low).cast("int"), at_place))

            return let(F.array_min(ranks), join)

        start = let(F.transform(data, lambda b: F.get(self.bytes, b)), ranked)
        return F.aggregate(F.slice(data, 2, F.size(data)), start, step, lambda acc: acc["ids"])

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for; ids without a piece give null."""
        return joined(ids, F.col("_pieces"))


PACKED = "dest long, block long, sizes binary, data binary, doc_ids array<bigint>, counts binary"
PACKED_TYPES = pa.schema([("dest", pa.int64()), ("block", pa.int64()), ("sizes", pa.binary()), ("data", pa.binary()),
                          ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary())])
GATHERED = "bucket long, words array<array<smallint>>, blocks array<bigint>, numbers array<binary>"
GATHERED_TYPES = pa.schema([("bucket", pa.int64()), ("words", pa.list_(pa.list_(pa.int16()))), ("blocks", pa.list_(pa.int64())),
                            ("numbers", pa.list_(pa.binary()))])
SENT = "dest long, bucket long, id_sizes binary, ids binary, sizes binary, bytes binary"
SENT_TYPES = pa.schema([("dest", pa.int64()), ("bucket", pa.int64())] + [(c, pa.binary()) for c in ("id_sizes", "ids", "sizes", "bytes")])


def squeeze(data: bytes | np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def squeeze_numbers(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2**31 - 1, low bytes first: they compress better apart."""
    return squeeze(np.ascontiguousarray(numbers.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T).reshape(-1))


def unsqueeze_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def pick(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[starts[i]:starts[i] + sizes[i]]`` for each i of ``which``, joined."""
    n = sizes[which]
    shift = np.repeat(starts[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, np.int64)
    return values[shift + np.arange(len(shift))]


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that Spark's hash partitioning sends there."""
    rows = (spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
            .orderBy("at").collect())
    return [r.id for r in rows]


def _collector(pattern: str, block: int, buckets: list[int]):
    """The task that packs blocks of documents."""
    def collect(batches):
        import regex
        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        done = 0
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        ids, codes, size = [], [], 0

        def flush():
            words = [w.encode() for w in number]
            place = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % len(buckets)
            counts = np.array([len(c) for c in codes], np.int64).tobytes()
            flat = np.concatenate(codes)
            codes.clear()
            # a block that a task run again fills otherwise has another name
            told = hashlib.blake2b(b"%d,%d," % (task, done), digest_size=8)
            for part in (counts, flat, *words):
                told.update(part)
            name = -1 - (int.from_bytes(told.digest(), "little") >> 1)
            rows: list[list] = [[name], [None], [squeeze_numbers(place)], [squeeze_numbers(flat)], [ids], [counts]]
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(len(buckets) + 1))
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if a < b:
                    some = [words[i] for i in order[a:b].tolist()]
                    sizes = np.fromiter(map(len, some), np.int64, len(some))
                    for column, value in zip(rows, (buckets[k], name, squeeze_numbers(sizes), squeeze(b"".join(some)), None, None)):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, PACKED_TYPES.types)], schema=PACKED_TYPES)

        for batch in batches:
            for key, body in (row for at in range(0, batch.num_rows, TEXTS)
                              for row in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns))):
                if ids and size + len(body or "") > block:
                    yield flush()
                    number.clear()
                    ids, codes, size, done = [], [], 0, done + 1
                words = find(body or "")
                ids.append(key)
                codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(body or "")
        if ids:
            yield flush()

    return collect


def word_blocks(docs: DataFrame, pattern: str, text: str, doc_id: str, block: int = BLOCK, buckets: list[int] | None = None) -> DataFrame:
    """Blocks of documents, packed.  One row per block and bucket: dest (the bucket), block, and the block's
    distinct words of the bucket (sizes, bytes).  One row per block: dest (the block, negative), the bucket's place of
    each word (sizes), the documents as numbers of words (data), their ids and word counts."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_collector(pattern, block, buckets or [0]), PACKED)


def _gather(rows: pa.Table) -> pa.Table:
    """The distinct words of a bucket as numbers from 0 to 255, and each block's words as places among them."""
    blocks = rows.column("block").to_pylist()
    if blocks[0] is None:                                   # a block's documents
        return GATHERED_TYPES.empty_table()
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    numbers = []
    for sizes, data in zip(rows.column("sizes").to_pylist(), rows.column("data").to_pylist()):
        data = unsqueeze(data)
        ends = np.cumsum(unsqueeze_numbers(sizes)).tolist()
        words = [data[a:b] for a, b in zip([0] + ends, ends)]
        numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)).tobytes())
    ends = np.cumsum(np.fromiter(map(len, number), np.int64, len(number)))
    flat = pa.array(np.frombuffer(b"".join(number), np.uint8).astype(np.int16))
    words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), flat)
    return pa.Table.from_arrays(
        [rows.column("dest").combine_chunks().slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
         pa.array([blocks], pa.list_(pa.int64())), pa.array([numbers], pa.list_(pa.binary()))], schema=GATHERED_TYPES)


def _send(batches):
    """The ids and decoded bytes of a bucket's words to each block that asked."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, raw = batch.column("word_ids")[k].values, batch.column("word_bytes")[k].values
            if raw.null_count:
                raise ValueError("a word holds bytes that the vocabulary has no piece for")
            id_ends, ends = ids.offsets.to_numpy().astype(np.int64), np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
            values, data = ids.values.to_numpy(), np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            id_sizes, sizes = np.diff(id_ends), np.diff(ends).astype(np.int64)
            bucket = batch.column("bucket")[k].as_py()
            for block, some in zip(batch.column("blocks")[k].as_py(), batch.column("numbers")[k].as_py()):
                which = np.frombuffer(some, np.int32)
                yield pa.RecordBatch.from_pylist(
                    [{"dest": block, "bucket": bucket, "id_sizes": squeeze_numbers(id_sizes[which]),
                      "ids": squeeze_numbers(pick(values, id_ends[:-1], id_sizes, which)), "sizes": squeeze_numbers(sizes[which]),
                      "bytes": squeeze(pick(data, ends[:-1].astype(np.int64), sizes, which).tobytes())}], schema=SENT_TYPES)


def _answers(told: pa.Table, place: dict[int, int]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The words of a block by bucket: the number of ids of each, its decimal ids joined by commas and its bytes.
    The numbers of one bucket are unpacked at a time."""
    counts, shown, raw = [np.zeros(0, np.int32)], [], []
    for r in sorted(told.to_pylist(), key=lambda r: place[r["bucket"]]):
        counts.append(unsqueeze_numbers(r["id_sizes"]))
        ends, flat = np.cumsum(counts[-1]).tolist(), list(map(str, unsqueeze_numbers(r["ids"]).tolist()))
        shown += [",".join(flat[a:b]).encode() for a, b in zip([0] + ends, ends)]
        ends, data = np.cumsum(unsqueeze_numbers(r["sizes"])).tolist(), unsqueeze(r["bytes"])
        raw += [data[a:b] for a, b in zip([0] + ends, ends)]
    return np.concatenate(counts), shown, raw


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", doc_id: str = "doc_id",
                     ids: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the bytes that the ids decode to) and, with ``ids``, the ids (array of int).

    A null text is empty.  Null ids and repeated rows stay; other columns are not read.  Special
    tokens are ordinary text.  An empty table gives an empty one.  ``docs`` must give the same rows when
    a task is run again (files do); otherwise the job fails rather than mix two versions.
    """
    vocabulary = Vocabulary(ranks)
    n = fan_out(docs)
    buckets = even_keys(docs.sparkSession, n)
    place = {b: k for k, b in enumerate(buckets)}
    packed = word_blocks(docs, pattern, text, doc_id, buckets=buckets).repartition(n, "dest")
    words = packed.groupBy("dest").applyInArrow(_gather, GATHERED)
    encoded = words.crossJoin(vocabulary.table(docs.sparkSession)).withColumn("word_ids", F.transform("words", vocabulary.encode)).drop("words")
    decoded = encoded.withColumn("word_bytes", F.transform("word_ids", vocabulary.decode))
    sent = decoded.select("bucket", "blocks", "numbers", "word_ids", "word_bytes").mapInArrow(_send, SENT)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:5 if ids else 4]
    types = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())))))

    def digest(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or rows.column("doc_ids")[0].as_py() is None:      # words of a bucket
            if not rows.num_rows and told.num_rows:
                raise RuntimeError("a block changed when its task ran again; write the documents to a table first")
            return types.empty_table()
        id_sizes, shown, raw = _answers(told, place)
        homes = unsqueeze_numbers(rows.column("sizes")[0].as_py())
        if len(homes) != len(raw):
            raise RuntimeError("a block changed when its task ran again; write the documents to a table first")
        at = np.empty(len(homes), np.int32)                 # answers come by bucket, then by number
        at[np.argsort(homes, kind="stable")] = np.arange(len(homes))
        codes = at[unsqueeze_numbers(rows.column("data")[0].as_py())]
        out: list[list] = [[] for _ in names]
        begin = 0
        for key, count in zip(rows.column("doc_ids")[0].as_py(), np.frombuffer(rows.column("counts")[0].as_py(), np.int64).tolist()):
            mine = codes[begin:begin + count]
            begin += count
            some = mine.tolist()
            told_ids = b",".join(map(shown.__getitem__, some))
            row = (key, int(id_sizes[mine].sum()), hashlib.sha256(told_ids).hexdigest(),
                   hashlib.sha256(b"".join(map(raw.__getitem__, some))).hexdigest())
            for column, value in zip(out, row if not ids else (*row, [int(i) for i in told_ids.split(b",")] if some else [])):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types.types)], schema=types)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return packed.groupBy("dest").cogroup(sent.groupBy("dest")).applyInArrow(digest, schema)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``: the binary that the array column ``ids`` stands for (null for a null array)."""
    pieces = [p if p is None else base64.b64encode(p).decode() for p in piece_list(ranks)]
    return df.withColumn(out, joined(F.col(ids), F.from_json(F.lit(json.dumps(pieces)), "array<binary>")))
