import hashlib
import random

import numpy as np
import pytest

from recsim.llm import lzprint
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def phrases(text):
    out, w = set(), ""
    for c in text:
        w += c
        if w not in out:
            out.add(w)
            w = ""
    return out


def expected(rows, places=lzprint.PLACES):
    """Rows in descending order, nulls last, ties by text; each with its successor."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        a, b, c = (lzprint.fingerprint(x, places) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), lzprint.shown(a), lzprint.shown(b),
                    lzprint.likeness(a, b), lzprint.likeness(a, c)))
    return sorted(out, key=str)


def test_phrases_are_those_of_lz78():
    known, sizes = set(), []
    text = "abababababa rose is a rose is a rose"
    rest = lzprint.parse(text[20:], known, sizes, lzprint.parse(text[:20], known, sizes))
    assert known == phrases(text) and sum(sizes) + len(rest) == len(text) and len(sizes) == len(known)


def test_likeness_estimates_jaccard():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    a = " ".join(rng.choice(words) for _ in range(1500))
    for share in (0.0, 0.3, 0.8, 1.0):
        cut = int(len(a) * share)
        b = a[:cut] + "".join(rng.choice("abcdefgh ") for _ in range(len(a) - cut))
        p, q = phrases(a), phrases(b)
        got = lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b))
        assert abs(got - len(p & q) / len(p | q)) < 0.15


def test_odd_texts():
    assert (lzprint.fingerprint(None) == lzprint.fingerprint("")).all()
    prints = {lzprint.shown(lzprint.fingerprint(t)) for t in ["", "a", "b", "ab", "\U0001F600", "x" * 100_000]}
    assert len(prints) == 6 and all(len(p) == 4 * lzprint.PLACES for p in prints)


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randint(-50, 300), "".join(rng.choice("abc d\U0001F600é") for _ in range(rng.randint(0, 120)))) for _ in range(60)]
    rows += [(5, "twice"), (5, "twice"), (5, None), (None, "nothing"), (None, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, fingerprint string").repartition(4)
    got = sorted((tuple(r) for r in lzprint.compare_with_next(df, parts=parts).collect()), key=str)
    assert got == expected(rows)


def test_many_rows_of_one_id_and_of_none(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 20)))
    rows = [(7, word()) for _ in range(400)] + [(None, word()) for _ in range(400)] + [(i, word()) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in lzprint.compare_with_next(df, parts=9).collect()), key=str)
    assert got == expected(rows)


def test_every_range_is_one_task(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text")
    plan = lzprint.compare_with_next(df, parts=40)
    assert plan.rdd.getNumPartitions() == 40 and all(n > 60 for n in plan.rdd.glom().map(len).collect())


def test_one_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")
    assert [tuple(r) for r in lzprint.compare_with_next(df).collect()] == expected([(1, "abcabc")])
    assert lzprint.compare_with_next(df.where("doc_id > 1")).count() == 0


def test_fingerprint_column(spark):
    df = spark.createDataFrame([(1, "abc", "z"), (2, "abc", "y"), (3, None, "x")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in lzprint.lz_fingerprints(df).collect()}
    assert got[1] == got[2] != got[3] == lzprint.shown(lzprint.fingerprint(""))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op8_document_fingerprints"](spark, SF).collect()), key=str)
    assert got == expected(docs)
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got]) + 0.1
