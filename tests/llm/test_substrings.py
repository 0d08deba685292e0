import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsim.llm import common, substrings

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    """{id: (words kept, words, words removed)} of distinct documents."""
    docs = {i: WORD.findall(t or "") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = docs[i], set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out[i] = ([x for k, x in enumerate(w) if k not in gone], len(w), len(gone))
    return out


def run(spark, rows, window, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(5)
    return [r.asDict() for r in substrings.substring_dedup(df, window).collect()]


@pytest.mark.parametrize("period", sorted(substrings.COVERS))
def test_covers_hold_every_shift(period):
    cover = substrings.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [1, 2, 5, 10, 20, 50])
def test_equal_windows_share_an_anchor(window):
    period, cover = substrings.cover_for(window)
    assert window - period + 1 >= min(window, substrings.LEAST_ANCHOR)
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_hash_of_ids_is_sparks(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 63), (1 << 63) - 1]
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i").alias("h")).collect()]
    assert common.spark_xxhash64(np.array(ids)).tolist() == got


def test_hashes_do_not_depend_on_slices(monkeypatch):
    data = ("ab c ä  déf\n" * 400 + "x" * 5000 + " end").encode()
    s, e = common.word_edges(data)
    whole = common.word_hashes(data, s, e)
    monkeypatch.setattr(common, "_SLICE", 64)
    again = common.word_hashes(data, s, e)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    words = data.split()
    assert len({(w, h) for w, h in zip(words, whole[0].tolist())}) == len(set(words)) == len(set(whole[0].tolist()))


@pytest.mark.parametrize("window,seed", [(20, 0), (20, 1), (10, 2), (5, 3), (2, 4)])
def test_equals_brute_force(spark, window, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(window - 1, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((i * 7 % 61, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(100, "same " * 300), (101, "same " * 100), (102, rows[3][1]), (103, None), (104, ""), (105, "a " * (window - 1))]
    want = brute(rows, window)
    text = dict(rows)
    got = run(spark, rows, window)
    assert len(got) == len(rows)
    for r in got:
        kept, n, gone = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (n, gone), r["doc_id"]
        assert r["kept_text"] == (" ".join(kept) if gone else text[r["doc_id"]])


def test_small_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    shared = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"u{i}_{k}" for k in range(rng.randint(0, 9))) + " " + shared + f" end{i}") for i in range(40)]
    monkeypatch.setattr(substrings._chunks, "__defaults__", (50,))
    want = brute(rows, 20)
    assert {r["doc_id"]: r["n_removed"] for r in run(spark, rows, 20)} == {i: w[2] for i, w in want.items()}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    shared = " ".join(f"p{k}" for k in range(30))
    rows = [(2, shared, 1, "a"), (2, shared, 1, "b"), (1, "x " + shared, 2, "c"), (None, shared, 3, "d"), (None, shared, 3, "e"), (3, shared + " y", 4, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, home int, bucket string")
    got = {r.bucket: r for r in substrings.substring_dedup(df).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {"a": 30, "b": 30, "c": 0, "d": 0, "e": 0, "f": 30}
    assert got["f"].kept_text == "y" and got["a"].kept_text == "" and got["d"].kept_text == shared
    again = substrings.remove_repeats(df)
    assert again.columns == df.columns and again.schema == df.schema


def test_a_document_repeated_as_a_row_does_not_remove_itself(spark):
    text = " ".join(f"q{k}" for k in range(50))
    assert [r["n_removed"] for r in run(spark, [(5, text), (5, text), (5, text)], 20)] == [0, 0, 0]


def test_empty_table(spark):
    assert run(spark, [], 20) == []


def test_text_is_shuffled_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = substrings.substring_dedup(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("FileScan") <= 2


def test_words_made_to_collide_are_told_apart(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64 under any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
    s = [np.array([0]), np.array([4096])]
    assert common.word_hashes(one.encode(), *s) == common.word_hashes(other.encode(), *s)      # the hint is wrong here
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")]
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_a_hot_hash_meets_as_one_entry_per_batch():
    """Of equal hashes all but the first are spread by document."""
    ids, pos = np.repeat(np.arange(2000), 5), np.tile(np.arange(5), 2000)
    packed = substrings._packed(16, ids, pos, np.full(10_000, 77, np.uint64), None)
    sizes = {r["bucket"]: len(r["more"]) for r in packed.to_pylist()}
    assert sum(sizes.values()) == 10_000 and max(sizes.values()) < 2 * 10_000 / 16
    assert sum(len(r["hi"]) for r in packed.to_pylist()) == 8
