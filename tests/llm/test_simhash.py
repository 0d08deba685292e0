import numpy as np
import pytest
import xxhash

from recsim.llm import simhash
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute_print(text, words=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[ \t\n\x0b\x0c\r]+", t) if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, prints, bits):
    comp = list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                comp[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            low[r] = min(low.get(r, x), x)
    return [low.get(find(i)) for i in range(len(ids))]


def test_spark_and_xxhash_agree(spark):
    from pyspark.sql import functions as F
    texts = ["", "a", "äöü ß", "x" * 31, "y" * 32, "z" * 77, "漢字 and more words here, a longer text than 32 bytes"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in df.collect())


@pytest.mark.parametrize("text", ["", "   \n", "One", "One two", "a b c d e A B C", "É é É x y z", None, "w " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


@pytest.mark.parametrize("blocks", [5, 13, 32])
def test_links_connect_what_brute_force_connects(spark, blocks):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for v in base[:30].tolist():
        for n in (1, 2, 2, 3):
            for b in rng.choice(64, n, replace=False):
                v ^= 1 << int(b)
            fps.add(v)
    fps = sorted(fps | {0, 1, (1 << 64) - 1})
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in fps], "fingerprint long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.fingerprint_links(df, max_bits=2, blocks=blocks).collect()]
    assert all(a in fps and b in fps for a, b in links)
    root = {v: v for v in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in links:
        root[find(a)] = find(b)
    want = brute_components(fps, fps, 2)
    got = {}
    for v in fps:
        got.setdefault(find(v), []).append(v)
    assert sorted(map(sorted, got.values())) == sorted(
        sorted(v for v, c in zip(fps, want) if c == k) for k in set(want))


def test_classes_on_odd_rows(spark):
    rows = [(1, "a b c d e f"), (2, "A b  c\td e f"), (3, None), (4, ""), (5, "zz yy xx"), (5, "zz yy xx"), (None, "zz yy xx"),
            (None, "lone words of nobody here at all"), (9, "q")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fingerprint string, anchor string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_classes(df).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], prints, 2)
    want = sorted(((i is None, i or 0, int(np.uint64(p).astype(np.int64)), c) for (i, _), p, c in zip(rows, prints, comp)), key=str)
    assert got == want
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "5", "9", "None", "None"]


@pytest.mark.parametrize("hot", [1, 10**9, 1e-9])
def test_a_hot_fingerprint_is_joined_apart(spark, monkeypatch, hot):
    """Some, all and none of the fingerprints are hot."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = [(i, "one text that most rows share") for i in range(100, 5100)] + [(i, f"text number {i} stands alone") for i in range(60)]
    rows += [(None, "one text that most rows share"), (7, None)]
    got = simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    prints = {t: brute_print(t) for _, t in rows}
    some = sorted({t for _, t in rows}, key=str)
    low = {t: min(i for i, u in rows if u == t and i is not None) for t in some}
    comp = dict(zip(some, brute_components([low[t] for t in some], [prints[t] for t in some], 2)))
    want = [(i, int(np.uint64(prints[t]).astype(np.int64)), comp[t]) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_classes(df).count() == 0
    assert simhash.keep_one_per_group(df).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in docs]
    comp = brute_components([r.doc_id for r in docs], prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_near_dedup"](spark, SF).collect()}
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, comp)}
