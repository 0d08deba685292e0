import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from recsim.llm import bpe
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_table_finds_every_pair_and_no_other(ranks):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 39, 3000))
    shifts, entries = bpe.perfect_table(keys, np.arange(len(keys)))
    first = bpe.spark_xxhash64(keys)
    place = bpe.spark_xxhash64(shifts[first % len(shifts)], first) % len(entries)
    assert (entries[place] == keys * bpe.LEFT + np.arange(len(keys))).all()
    assert (entries >= 0).sum() == len(keys)


def test_odd_texts_equal_tiktoken(spark, ranks, encoding, monkeypatch):
    texts = [None, "", " ", "  \n\t x", "Hello  world's end!!  \n\n", "éÉ ñandú 漢字 \U0001F600\U0001F600", "a" * 2000, "\x00\x01\x7f", "don't I'LL 's",
             "1234567 89", "  　 x", "<|endoftext|>", "$$$ %%% ***", "word " * 5000, "\r\n\r\n", "é \u0085 z", "ß" * 300]
    rows = [(k, t, 1, "c") for k, t in enumerate(texts)] + [(1, "", 2, "c"), (None, "null id", 3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words int, codes string").repartition(3)
    got = bpe.encode_documents(df, ranks, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "null id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(encoding, text), repr(text)[:60]
        assert list(r.ids) == encoding.encode_ordinary(text or "")


def test_small_blocks_change_nothing(spark, ranks, encoding):
    df = spark.createDataFrame([(k, f"text number {k} of many texts") for k in range(30)], "doc_id long, text string").coalesce(1)
    assert bpe.word_blocks(df, PATTERN, "text", "doc_id", block=60).count() > 5


def test_many_blocks_and_buckets_equal_tiktoken(spark, ranks, encoding, monkeypatch):
    monkeypatch.setattr(bpe.word_blocks, "__defaults__", (300, None))
    texts = [f"the same words and {k} odd\u00e9{k * 7919} ones \x00\xff \U0001F600{k}" * (k % 5) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: tuple(r)[1:4] for r in bpe.encode_documents(df, ranks, PATTERN, ids=False).collect()}
    assert got == {k: expected(encoding, t) for k, t in enumerate(texts)}


def test_a_word_is_folded_once(spark):
    """Blocks with the same words: a bucket holds each word once, with an entry per block."""
    df = spark.createDataFrame([(k, "alpha beta gamma " * 20) for k in range(40)], "doc_id long, text string").coalesce(2)
    keys = bpe.even_keys(spark, 3)
    packed = bpe.word_blocks(df, PATTERN, "text", "doc_id", 600, keys)
    rows = packed.groupBy("dest").applyInArrow(bpe._gather, bpe.GATHERED).collect()
    words = [bytes(w) for r in rows for w in r.words]
    assert len(words) == len(set(words)) and all(len(r.blocks) > 10 for r in rows)


def test_even_keys_fall_into_one_partition_each(spark):
    from pyspark.sql import functions as F
    keys = bpe.even_keys(spark, 7)
    df = spark.createDataFrame([(k,) for k in keys], "dest long").repartition(7, "dest").withColumn("at", F.spark_partition_id())
    assert sorted(r.at for r in df.collect()) == list(range(7))


def test_numbers_survive_packing():
    x = np.array([0, 1, 255, 256, 1 << 20, (1 << 31) - 1])
    assert (bpe.unsqueeze_numbers(bpe.squeeze_numbers(x)) == x).all() and len(bpe.unsqueeze_numbers(bpe.squeeze_numbers(x[:0]))) == 0
    assert bpe.unsqueeze(bpe.squeeze(b"")) == b""
    values, starts, sizes = np.arange(10), np.array([0, 3, 3, 9]), np.array([3, 0, 6, 1])
    assert bpe.pick(values, starts, sizes, np.array([3, 1, 0])).tolist() == [9, 0, 1, 2]
    assert bpe.pick(values, starts, sizes, np.array([], int)).tolist() == []


def test_decoding_restores_the_bytes(spark, ranks):
    df = spark.createDataFrame([(1, "naïve café \U0001F600"), (2, "")], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_documents(df, ranks, PATTERN), ranks).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {1: "naïve café \U0001F600", 2: ""}


def test_empty_table(spark, ranks):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), ranks, PATTERN).count() == 0


def test_query_equals_tiktoken(spark, encoding):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:4] for r in QUERIES["op1_byte_level_bpe"](spark, SF).collect()}
    assert got == {i: expected(encoding, t) for i, t in docs.items()}


def test_tasks_carry_no_tables(spark, ranks):
    """The arrays of the vocabulary come in a broadcast row; as literals every task would unpack several copies."""
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = bpe.encode_documents(df, ranks, PATTERN)._jdf.queryExecution()
    assert "BroadcastNestedLoopJoin" in plan.executedPlan().toString()
    assert plan.analyzed().toString().count("from_json") < 2      # the ids of the 256 bytes
    fold = [x for x in plan.optimizedPlan().toString().split("\n") if "xxhash64" in x]
    assert fold and all("_shifts" in x and "_entries" in x for x in fold)


def peak(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


class Context:
    """Stands in for a task's context."""

    @staticmethod
    def get():
        return Context

    @staticmethod
    def partitionId():
        return 0


def test_a_batch_is_unpacked_by_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "TaskContext", Context)
    text = "\u0436" + "the same few words again " * 400           # two bytes a character
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"{text}{k}" for k in range(1000)]})
    collect = bpe._collector(PATTERN, 1 << 20, [0, 1])
    n, most = peak(lambda: sum(sum(x is not None for x in b.column("doc_ids").to_pylist()) for b in collect(iter([batch]))))
    assert n >= 10 and most < 12 << 20                              # all texts at once: 23 MB


def test_the_ids_of_one_bucket_are_unpacked_at_a_time():
    rng = np.random.default_rng(0)
    sizes = [rng.integers(0, 9, 2000) for _ in range(100)]
    ids = [rng.integers(0, 50000, x.sum()) for x in sizes]
    raw = [[bytes(rng.integers(0, 256, n, np.uint8)) for n in x] for x in sizes]
    rows = [{"dest": -1, "bucket": 7 * k, "id_sizes": bpe.squeeze_numbers(a), "ids": bpe.squeeze_numbers(b), "sizes": bpe.squeeze_numbers(a),
             "bytes": bpe.squeeze(b"".join(c))} for k, (a, b, c) in enumerate(zip(sizes, ids, raw))]
    told = pa.Table.from_pylist(rows[::-1], schema=bpe.SENT_TYPES)
    (counts, shown, got), most = peak(lambda: bpe._answers(told, {7 * k: k for k in range(100)}))
    assert counts.tolist() == np.concatenate(sizes).tolist() and got == sum(raw, [])
    assert b",".join(x for x in shown if x) == ",".join(map(str, np.concatenate(ids).tolist())).encode()
    assert most < 40 << 20                                          # the texts of all ids at once: 87 MB
    none, shown, got = bpe._answers(told.slice(0, 0), {})
    assert len(none) == len(shown) == len(got) == 0
