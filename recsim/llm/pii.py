"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of the
terms that reveal them.  DataFrame functions only.

Base spans: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers.

Disclosure: every distinct base value is a protected entity c.  Its contexts are the documents that
name it; those with the same words beside it (``NEAR`` on each side) count once, so copies of a
document are no evidence.  With N the documents of the corpus, n(c) the entity's contexts,
n(t) the documents that hold a term and n(c, t) the contexts of c whose documents hold t anywhere,

    PMI(c; t) = log2(n(c, t) N / (n(c) n(t))),    IC(c) = log2(N / n(c)).

PMI / IC is the share of the entity's information that the term gives away: 1 if the term stands
in the entity's documents only.  A term seen in at least ``LEAST`` contexts whose share reaches
``GENERALISE`` is generalised in every document that names the entity, from ``REMOVE`` on it is
removed.  Counts cover all documents, whole texts and all distances.  An entity of fewer than ``LEAST``
contexts discloses no terms: every word of a text that stands alone would be one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsim.llm.common import cut_lineage, fresh, without

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an occurrence that tell contexts apart, and characters looked at to find them.
NEAR, REACH = 5, 120
LEAST = 3
GENERALISE, REMOVE = 0.6, 0.9
#: Terms up to which the candidates are sent to every executor (about 10 MB) and the counts of others dropped before
#: they are written; beyond, all counts are joined by term.  The counts are the same.
BROADCAST_TERMS = 200_000

# A match may start where its run of characters starts, or where the last match ended: any other
# start would need a longer match to its left, which would have been found first.  Possessive
# repeats keep Java's matcher linear and off the stack.
_LOCAL = "[A-Za-z0-9._%+-]"
_MATCH = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of digits of which 13 to 19; others fail in any case and never cut a longer run
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _located(text: Column, pattern: Column | str, kind: str) -> Column:
    """All matches with their code point spans: gap and match alternate from the last match's end."""
    whole = F.concat(F.lit(r"\G((?s:.*?))("), F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(")"))
    pairs = F.zip_with(F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2)),
                       lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _small_parts(value: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind as in ``KINDS``, then start.  A null text has none."""
    text = F.coalesce(text, F.lit(""))
    checks = {"ip": lambda s: _small_parts(s["value"]), "card": lambda s: _luhn(s["value"]),
              "phone": lambda s: F.length(_digits(s["value"])).between(9, 15)}
    out = []
    for kind in KINDS:
        found = _located(text, _MATCH[kind], kind)
        if kind in checks:
            found = F.filter(found, checks[kind])
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINT[kind])
        out.append(F.when(hint, found).otherwise(F.expr(f"cast(array() as {_SPAN})")))
    return F.concat(*out)


def entity_of(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))


def _blank(text: Column) -> Column:
    """The text without e-mail addresses, the only base spans that hold terms."""
    return F.regexp_replace(text, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9.-]++", " ")


def _context(text: Column, span: Column) -> Column:
    """The ``NEAR`` terms on each side, without those of other base spans."""
    at = F.greatest(span["start"] - REACH, F.lit(0))
    left = F.substring(text, at + 1, span["start"] - at)
    left = F.when(at > 0, F.regexp_replace(left, r"^\S+", "")).otherwise(left)
    right = F.substring(text, span["end"] + 1, F.lit(REACH))
    right = F.when(F.length(right) == REACH, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
    before, after = _terms(_blank(left)), _terms(_blank(right))
    return F.concat(F.slice(F.reverse(before), 1, NEAR), F.slice(after, 1, NEAR))


def disclosing_terms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST,
                     generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, generalise, remove): for the documents that name an entity which terms disclose, the
    arrays of those terms.  Rows without id give evidence but get no row."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), base_spans(body).alias("spans"))
    near = lambda s: F.struct(entity_of(s).alias("entity"), F.xxhash64(_context(F.col("text"), s)).alias("context"))
    found = cut_lineage(found.where(F.size("spans") > 0).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.transform("spans", near).alias("named"),
        F.array_distinct(_terms(_blank(F.col("text")))).alias("terms")), "found")
    # one context per entity and document
    named = cut_lineage(found.select("row", "doc_id", F.inline("named")).groupBy("row", "doc_id", "entity")
                        .agg(F.min("context").alias("context")), "named")
    sizes = named.groupBy("entity").agg(F.count_distinct("context").alias("n_c")).where(F.col("n_c") >= least)
    evidence = named.join(sizes.select("entity"), "entity").select("row", "entity", "context")
    pairs = cut_lineage(
        found.select("row", "terms").join(evidence, "row").select("entity", "context", F.explode("terms").alias("term")).distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= least).join(sizes, "entity"), "pairs")
    terms = pairs.select(F.col("term").alias("known")).distinct()
    # counted before the join: its rows are terms, not their occurrences
    counts = docs.select(F.explode(F.array_distinct(_terms(body))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    if pairs.count() <= BROADCAST_TERMS:
        counts = counts.join(F.broadcast(terms), F.col("term") == F.col("known")).select("term", "n_t")
    counts = cut_lineage(counts, "terms")
    size = float(docs.count())
    share = F.log2(F.col("n_ct") * size / (F.col("n_c") * F.col("n_t"))) / F.log2(size / F.col("n_c"))
    told = (pairs.join(counts, "term").where(F.col("n_c") < size).withColumn("share", share).where(F.col("share") >= generalise)
            .groupBy("entity").agg(F.collect_set("term").alias("all"),
                                   F.collect_set(F.when(F.col("share") >= remove, F.col("term"))).alias("remove")))
    by_doc = named.where("doc_id is not null").select("doc_id", "entity").distinct().join(told, "entity")
    return by_doc.groupBy("doc_id").agg(
        F.array_distinct(F.flatten(F.collect_set("remove"))).alias("remove"),
        F.array_distinct(F.flatten(F.collect_set("all"))).alias("all")).select(
        "doc_id", F.sort_array(F.array_except("all", "remove")).alias("generalise"), F.sort_array("remove").alias("remove"))


def _term_spans(text: Column, terms: Column, kind: str) -> Column:
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    none = F.expr(f"cast(array() as {_SPAN})")
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, _located(text, pattern, kind)).otherwise(none)


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced: base spans by <KIND>, generalised terms by <TERM>, removed
    ones by nothing.  Overlapping spans go together, under the name of the one that starts first, then the
    longest."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        tag = (F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "generalise", F.lit("<TERM>"))
               .otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        step = F.struct((-s["back"]).alias("at"),
                        F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag).alias("out"))
        both = F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], both).otherwise(step)

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(order, begin, put, end))


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST,
             generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` plus ``spans`` (kind, start, end, value: base spans by kind and start, then terms that do not
    overlap one, kinds ``generalise`` and ``remove``, by start) and ``clean_text``.

    Offsets are code points, end exclusive.  A null text has no spans and stays null.  Rows without
    id have base spans only.  Rows that repeat an id share its terms.  All rows and columns
    stay (columns named ``spans`` and ``clean_text`` are replaced); an empty table stays empty.
    """
    told = cut_lineage(disclosing_terms(docs, text, doc_id, least, generalise, remove), "told")
    docs = without(docs, "spans", "clean_text")
    key, one, two, base = fresh(docs, "told_id", "told_generalise", "told_remove", "base")
    told = told.select(F.col("doc_id").alias(key), F.col("generalise").alias(one), F.col("remove").alias(two))
    body = F.col(f"`{text}`")
    both = docs.join(told, docs[doc_id].cast("long") == told[key], "left").withColumn(base, base_spans(body))
    clear = lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    terms = F.concat(*(F.filter(_term_spans(body, F.col(c), kind), clear) for c, kind in ((one, "generalise"), (two, "remove"))))
    out = both.withColumn("spans", F.concat(F.col(base), F.when(body.isNull() | F.col(key).isNull(), F.expr(f"cast(array() as {_SPAN})")).otherwise(terms)))
    return out.withColumn("clean_text", _sanitised(body, F.col("spans"))).drop(key, one, two, base)


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (and ``n_chars``, if present, counted anew)."""
    found = find_pii(docs, text, doc_id)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("clean_text").alias(c))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("clean_text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return found.select(*columns)
