import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recsim.llm import pii
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


HARD = [None, "", "no data", "a@b.c", "x.y+z%_-@mail-1.example.co.uk, a@b a@b. a@b.c_d@e.f g@h..i @j.k", "a@b.c@d.e", "é a@b.c é 1.2.3.4 é",
        "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.00 1.2.3 1.2.3.4. 1..2.3.4", "a@1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
        "4111111111111111 4111  111111111111", "41111111111111111111111111", "+1 (988) 555-2485", "+1+1 555 555 5555 +5", "+49 30 1234567890123456",
        "+1 555 123 4567 4111 1111 1111 1111", "\U0001F600 +1 555 123 4567 \U0001F600 a@b.cd", "1" * 800, "a" * 800 + "@", "1." * 400,
        "1 " * 400, "x@y.z " * 300, "a@b.c\n1.2.3.4\r\n+12 345 678 90", "00000000000000", "+0 00000000000"]


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 555 123 4567", "+", " ", "-", "9", "é", "x_1",
            "a.b", "\n", "(", ")", "0", "12", "%"]
    return HARD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i long, text string").repartition(8)
    got = {r.i: [(s.kind, s.start, s.end) for s in r.spans] for r in df.select("i", pii.base_spans(F.col("text")).alias("spans")).collect()}
    for i, t in rows:
        assert got[i] == brute(t), (t or "")[:80]


def test_long_texts_take_linear_time(spark):
    long = {"1" * 300_000: 0, "a" * 300_000 + "@": 0, "1 " * 150_000: 0, "+" * 100_000: 0, "1." * 4000: 1000, "x@y.z " * 3000: 3000}
    df = spark.createDataFrame([(t,) for t in long], "text string")
    assert [r.n for r in df.select(F.size(pii.base_spans(F.col("text"))).alias("n")).collect()] == list(long.values())


def corpus(copies=1):
    rows, n = [], 0
    rng = random.Random(2)
    words = ["river", "house", "green", "table", "walk", "music", "stone", "paper", "glass", "cloud"]
    filler = lambda k: " ".join(rng.choice(words) for _ in range(k))
    for _ in range(6):
        rows += [(n, f"{filler(30)} doctor Zebulon wrote to zeb@mail.org about {filler(30)}")] * copies
        n += 1
    for _ in range(40):
        rows.append((n, f"{filler(60)} ask info{n}@mail.org {filler(5)} doctor {filler(3)}"))
        n += 1
    return rows


def disclosed(spark, rows):
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {(s.kind, s.value.lower()) for r in found for s in r.spans if s.kind in ("generalise", "remove")}, found


def test_a_name_that_goes_with_one_entity_is_removed(spark):
    terms, found = disclosed(spark, corpus())
    assert ("remove", "zebulon") in terms and not any(t in ("river", "house", "green") for _, t in terms)
    assert ("remove", "doctor") not in terms        # also stands beside forty other addresses
    one = next(r for r in found if r.doc_id == 0)
    assert "Zebulon" not in one.clean_text and "zeb@mail.org" not in one.clean_text and "<EMAIL>" in one.clean_text
    other = next(r for r in found if r.doc_id == 20)
    assert [s.kind for s in other.spans] == ["email"]


def test_a_name_far_from_the_entity_is_removed_too(spark):
    rng = random.Random(7)
    words = ["river", "house", "green", "table", "walk", "music", "stone", "paper", "glass", "cloud"]
    filler = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, f"Zebulon {filler(14 + 200 * (i % 2))} bob@x.com {filler(5)}") for i in range(40)]
    rows += [(100 + i, f"{filler(30)} info{i}@y.org") for i in range(40)]
    terms, found = disclosed(spark, rows)
    assert terms == {("remove", "zebulon")}
    assert not any("Zebulon" in r.clean_text for r in found)


def test_one_document_is_one_context(spark):
    """An entity named many times in one document is no more evidence than named once."""
    rows = [(1, "Zebulon of stones: z@x.org one two; z@x.org three four; z@x.org five six; z@x.org seven")]
    rows += [(10 + i, "plain words only") for i in range(50)]
    assert disclosed(spark, rows)[0] == set()


def test_copies_are_no_evidence(spark):
    rows = [(i, "Zebulon wrote to zeb@mail.org about stones") for i in range(50)] + [(100 + i, "plain words only") for i in range(50)]
    assert disclosed(spark, rows)[0] == set()


def test_terms_keep_clear_of_base_spans_and_of_other_documents(spark):
    rows = corpus() + [(900, "Zebulon alone, no address"), (901, "Zebulon: zeb@mail.org Zebulon@x.org")]
    _, found = disclosed(spark, rows)
    got = {r.doc_id: r for r in found}
    assert got[900].clean_text == "Zebulon alone, no address" and got[901].clean_text.strip() == ": <EMAIL> <EMAIL>"
    for r in found:
        base = [s for s in r.spans if s.kind in pii.KINDS]
        assert not any(b.start < s.end and s.start < b.end for s in r.spans if s.kind not in pii.KINDS for b in base)
        assert all((r.text or "")[s.start:s.end] == s.value for s in r.spans)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, 1, "a"), (1, None, 1, "a"), (None, "mail a@b.cd", 2, "b"), (2, "", 3, "c"), (3, "clean", 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int, told_id string")
    out = pii.find_pii(df)
    assert out.columns == df.columns + ["spans", "clean_text"]
    got = {(r.told_id, r.clean_text) for r in out.collect()}
    assert out.count() == 5 and got == {("a", None), ("b", "mail <EMAIL>"), ("c", ""), ("d", "clean")}
    assert pii.sanitise(df.withColumn("n_chars", F.lit(1).cast("long"))).where("told_id = 'b'").first().n_chars == 12
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).count() == 0


def test_overlapping_base_spans_are_replaced_once(spark):
    df = spark.createDataFrame([(1, "x@1.2.3.4 y +4111 1111 1111 1111 z")], "doc_id long, text string")
    assert pii.sanitise(df).first().text == "<EMAIL> y <PHONE> z" or pii.sanitise(df).first().text.count("<") >= 2


def test_nothing_of_an_overlapping_span_stays(spark):
    rows = ["a 4111 1111 1111 1111@x.com b", "bob@x.4111 1111 1111 1111 b", "x 1.2.3.4@y.org,bob@x.4111 1111 1111 1111@z.de b"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i, text in enumerate(rows):
        gone = {k for _, a, b in brute(text) for k in range(a, b)}
        rest = "".join(" " if k in gone else c for k, c in enumerate(text)).split()
        assert re.sub("<[A-Z]+>", " ", got[i]).split() == rest, got[i]
    assert got[0] == "a <CARD> b" and got[1] == "<EMAIL> b"


def test_counting_before_the_join_changes_nothing(spark, monkeypatch):
    want = disclosed(spark, corpus())[0]
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert disclosed(spark, corpus())[0] == want


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_pii"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        spans = brute(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[i].spans.startswith(told)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


@pytest.mark.parametrize("name", ["documents"])
def test_no_python_in_the_plan(spark, name):
    plan = pii.find_pii(spark.read.parquet(f"{SF}/{name}.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_occurrences_of_terms_are_counted_before_the_join(spark, monkeypatch):
    """The join with the candidate terms has one row per term, not one per document that holds it."""
    plans = []
    cut = pii.cut_lineage
    monkeypatch.setattr(pii, "cut_lineage", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, name))
    assert ("remove", "zebulon") in disclosed(spark, corpus())[0]
    plan = dict(plans)["terms"]
    assert "known" in plan and plan.index("Join") < plan.index("Aggregate") < plan.index("Generate")
