"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, shuffled by a hash of their ids, form one stream of words, cut into blocks of equal length.
The mix is a row of slots, each of which takes one block.  Slot i has the golden-ratio point
frac((i + 1) / phi), held as a whole number of 2**-40; the sources lie side by side on [0, 1) with widths in proportion to the
slots that their targets need, and the slot belongs to the source under its point.  So every stretch of the mix, not only the
whole, holds the sources in their shares up to a few slots.

The r-th slot of a source takes the block at place r of the source's shuffled blocks; once all blocks are
used a second pass goes over them in another order.  Ranks and offsets are running totals over ranges of the order:
a source's rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recsim.llm.common import cut_lineage
from recsim.operators.indexing import dense_index

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: 2**40 / phi: a multiple modulo 2**40 is a golden-ratio point.
GOLDEN, POINTS = 679535556991, 40
#: Parts of a slot that a source's width is measured in.
WIDTH = 1 << 16
#: Cells of the unit interval at least, and rows of a range of a shuffled order at most.
GRID, RANGE = 4096, 2048


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], amount: Column) -> DataFrame:
    """``df`` with ``before``: the total of ``amount`` over the rows of equal ``keys`` that come earlier in (bucket, order).

    Totals per bucket run on over the buckets; inside a bucket a window runs over its rows.  ``df`` is read twice."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*keys).orderBy(bucket))), F.lit(0)).alias("_off"))
    inside = earlier(Window.partitionBy(*keys, bucket).orderBy(*order))
    return (df.join(offsets, [*keys, bucket])
            .withColumn("before", F.col("_off") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_off"))


def _range_of(key: str, rows: int) -> Column:
    """The range of an md5 order: so many leading hex digits that a range holds about ``RANGE`` of ``rows`` rows."""
    digits = 0
    while rows > RANGE * 16 ** digits:
        digits += 1
    return F.substring(key, 1, digits)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, no, target): the words that the mix shall take of each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all words by weight.  A target
    stops at ``most`` times its source's size; the excess goes to the others by weight until none is above.  Each
    round of that is one aggregate whose two numbers reach the driver.
    """
    ranked = dense_index(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], "no").drop("last")
    table = cut_lineage(ranked.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
                        .withColumn("cap", F.col("source_size") * most), "sources")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0                                         # what a weight of 1 gets
    above = F.lit(False)
    while True:
        capped, open_w = table.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        last, unit = unit, (total - capped) / open_w if open_w else float("inf")
        if unit == last:
            break
        above = F.col("w") * F.lit(unit) > F.col("cap")
    return table.select("source", "source_size", "no", F.least(F.col("w") * F.lit(unit), F.col("cap").cast("double")).alias("target"))


def golden_points(spark: SparkSession, n: int) -> DataFrame:
    """Slots 0 .. n-1 with ``point``, the golden-ratio sequence in units of 2**-40 (products kept below 2**63)."""
    i, one = F.col("slot") + 1, 1 << POINTS
    high = F.pmod(F.shiftright(i, 20) * GOLDEN, F.lit(one)) * (1 << 20)
    low = F.pmod(i, F.lit(1 << 20)) * GOLDEN
    return spark.range(n).withColumnRenamed("id", "slot").withColumn("point", F.pmod(high + low, F.lit(one)))


def schedule(sources: DataFrame, most: int) -> DataFrame:
    """(slot, no, pass, place): which place of which pass over a source's blocks each slot takes.

    ``sources`` has no, blocks and width (the source's share in 1/65536 of a slot).  Slots that would begin a pass beyond ``most`` are
    left out."""
    laid = cut_lineage(running_total(sources.where("width > 0").withColumn("at", F.shiftright("no", 12)).withColumn("all", F.lit(0)), ["all"], "at",
                                     ["no"], F.col("width")).select("no", "blocks", "width", F.col("before").alias("low")), "schedule")
    whole, count = laid.agg(F.coalesce(F.sum("width"), F.lit(0)), F.count("*")).first()
    grid = max(GRID, min(count, 1 << 22))
    cell_of = lambda c: F.floor(c * float(grid) / float(max(whole, 1)))
    cells = laid.withColumn("cell", F.explode(F.sequence(F.greatest(F.lit(0), cell_of(F.col("low")) - 1),
                                                         F.least(F.lit(grid - 1), cell_of(F.col("low") + F.col("width")) + 1))))
    at = F.col("point").cast("double") / float(1 << POINTS) * float(whole)
    slots = (golden_points(sources.sparkSession, -(-whole // WIDTH)).withColumn("cell", F.shiftright(F.col("point") * grid, POINTS)).withColumn("x", at)
             .join(cells, "cell").where("x >= low and x < low + width").select("slot", "no", "blocks", F.shiftright("slot", 16).alias("at")))
    ranked = running_total(cut_lineage(slots, "slots"), ["no"], "at", ["slot"], F.lit(1))
    return (ranked.withColumn("pass", F.floor(F.col("before") / F.col("blocks"))).where(F.col("pass") < most)
            .select("slot", "no", "pass", (F.col("before") - F.col("pass") * F.col("blocks")).alias("place")))


def mix_documents(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 128,
                  least_blocks: int = 1024, seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as spans: (slot, pass, block, doc_id, copy, size, start, words, no, source, source_size, target).

    A row says that slot ``slot`` takes the ``words`` words of a document from word ``start`` on.  Read in the order of slot and place in the
    block it is the mix.  Spans that no slot takes come once with a null slot, as do documents without words (block and start null
    too), so the rows show every document.

    A block has ``block_words`` words, in a source of less than ``least_blocks`` such blocks size / least_blocks (one at least), so the
    targets of small sources are met too; a source's last block may be shorter.  The words taken of a source
    differ from its target by a few blocks.  No document is taken more than ``most`` times.

    A null text has no words; a null source is a source, a null id an id.  Rows with equal id, source and size are copies of one
    another, numbered by ``copy``; which is which does not matter to the mix.  Texts without words get no slot; an empty table
    gives an empty result.  The same documents give the same mix in any layout.  Other columns are not read.
    """
    if most < 1 or int(most) != most:
        raise ValueError("most must be a whole number of passes")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    classes = cut_lineage(plain.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / least_blocks)))
    sources = cut_lineage(targets.withColumn("block_words", block.cast("long"))
                          .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")))
                          .withColumn("width", F.floor(F.col("target") * WIDTH / F.col("block_words"))), "targets")

    # the streams: where each document starts in its source
    same = classes["source"].eqNullSafe(sources["source"])
    shuffled = (classes.join(sources, same).drop(classes["source"])
                .withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
                .withColumn("at", _range_of("key", classes.count())))
    streams = running_total(cut_lineage(shuffled, "streams"), ["no"], "at", ["key", "doc_id", "size"], F.col("size") * F.col("copies"))
    from_word = F.col("before") + F.col("copy") * F.col("size")
    first = F.floor(F.col("from") / F.col("block_words"))
    last = F.floor((F.col("from") + F.col("size") - 1) / F.col("block_words"))
    spans = (streams.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("from", from_word)
             .withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
             .withColumn("start", F.greatest(F.lit(0), F.col("block") * F.col("block_words") - F.col("from")))
             .withColumn("words", F.least("size", (F.col("block") + 1) * F.col("block_words") - F.col("from")) - F.col("start"))
             .select("no", "block", "doc_id", "copy", "size", "start", "words", "source", "source_size", "target"))

    # the shuffled blocks of every pass
    blocks = (sources.where("blocks > 0").select("no", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))).alias("pass"), "blocks")
              .select("no", F.col("pass").cast("long").alias("pass"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
              .withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), "no", "pass", "block"))))
    total = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    blocks = cut_lineage(blocks.withColumn("at", _range_of("key", int(most) * total)), "blocks")
    placed = running_total(blocks, ["no", "pass"], "at", ["key"], F.lit(1)).select("no", "pass", "block", F.col("before").alias("place"))
    taken = schedule(sources, int(most)).join(placed, ["no", "pass", "place"]).select("slot", "no", "pass", "block")
    return spans.join(taken, ["no", "block"], "left").select("slot", "pass", "block", "doc_id", "copy", "size", "start", "words", "no", "source",
                                                             "source_size", "target")


def taken_words(spans: DataFrame) -> DataFrame:
    """One row per document of a mix: (doc_id, size, source, source_size, target, taken), taken counting repeats."""
    return (spans.groupBy("no", "doc_id", "copy", "size", "source", "source_size", "target")
            .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).alias("taken"))
            .select("doc_id", "size", "source", "source_size", "target", "taken"))
