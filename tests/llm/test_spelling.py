import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from recsim.llm import spelling
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(word):
    """Every text with one code point deleted or masked: near words share one."""
    return {word[:i] + word[i + 1:] for i in range(len(word))} | {f"{word[:i]}\0{word[i + 1:]}" for i in range(len(word))} | {word}


def brute(counts, least_length=5, least_n=3):
    n = {w: c for w, c in counts.items() if w is not None and len(w) >= least_length and c >= least_n}
    shares = {}
    for w in n:
        for v in variants(w):
            shares.setdefault(v, []).append(w)
    out, form = {}, {}
    for w in n:
        close = {b for v in variants(w) for b in shares[v] if near(w, b)}
        best = min(((-n[b], b) for b in close), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None
        out[w] = [n[w], len(close), form[w], n[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def grouped(spark, words, **kw):
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n int").repartition(3)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(df, **kw).collect()}


@pytest.mark.parametrize("seed,letters,longest", [(0, "ab", 7), (1, "abc", 9), (2, "abcdefgh", 6), (3, "a", 40), (4, "aé\U0001F600", 8)])
def test_partners_equal_brute_force(seed, letters, longest):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(200)})
    got = [(words[q], words[w]) for front in (True, False) for q, w in spelling.partners(words, words, front)]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_partners_of_other_words():
    words = ["house", "mouse"]
    got = [(q, words[w]) for front in (True, False) for q, w in spelling.partners(["louse", "hoxxse", "housse", "zzzzz", "mouse"], words, front)]
    assert sorted(got) == [(0, "house"), (0, "mouse"), (2, "house"), (4, "house")]


def test_very_long_words():
    words = ["ab" * 20000, "ab" * 20000 + "a", "a" * 30000, "a" * 30001, "ab" * 8000 + "b" + "ab" * 12000]
    got = sorted((q, w) for front in (True, False) for q, w in spelling.partners(words, words, front))
    assert got == [(0, 1), (0, 4), (1, 0), (2, 3), (3, 2), (4, 0)]


def test_equals_brute_force_with_hot_shards(spark):
    rng = random.Random(5)
    base = ["pre" + "".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    counts = Counter()
    for w in base:
        counts[w] += rng.choice([1, 3, 5, 12, 60])
        counts[w[:3] + w[4:]] += rng.choice([2, 3, 6])
    words = [w for w, c in counts.items() for _ in range(c)] + [None, "", "tiny", "tiny", "tiny"]
    want = brute(counts)
    assert grouped(spark, words) == want
    assert grouped(spark, words, index_symbols=200) == want                   # one shard in many parts
    assert grouped(spark, words, least_length=1, least_n=1) == brute(Counter(words), 1, 1)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 40, "aaaab": 20, "aaabb": 10, "aabbb": 5, "abbbb": 3, "zzzzy": 8, "zzzzx": 8, "zzzzw": 4}
    got = grouped(spark, [w for w, c in counts.items() for _ in range(c)])
    assert got == brute(counts)
    assert got["aabbb"] == (5, 2, "aaabb", 10, "aaaaa") and got["abbbb"][2] is None and got["zzzzw"][2] == "zzzzx" and got["zzzzx"][4] == "zzzzx"


def test_empty(spark):
    assert grouped(spark, []) == {} and grouped(spark, ["lonely"]) == {}


def test_query_equals_brute_force(spark):
    counts = Counter()
    upper = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()}
    assert got == brute(counts) and any(x[2] for x in got.values())
