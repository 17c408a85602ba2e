"""Mixing sources to target weights: hash thresholds that meet each source's budget of words.

A document's size is its number of words, maximal stretches without ASCII white space (null:
0).  Sources, in order of code points and null last, weigh 1, 2, 3, ..., repeating, and share
all words; no target exceeds `most` times its source's size, and the excess is shared again
by weight until none does.  Targets are met by whole documents: every document of a source
as often as its target allows, and some once more, those whose hash lies below a threshold.

A threshold is found by histograms: sizes are summed by source and bucket of the hash,
running sums over the buckets name the one that the budget ends in, and only that bucket is
divided again, until it holds one hash.  Documents are never sorted.  What then is left of
the budget is less than the next document, so it is spent in the same way on the documents
above the threshold that are no larger than it, `passes` times in all: a long document
at the threshold doesn't leave a hole of its size.

The hash is of the doc_id, the text and the number of the copy among equal rows, so results
don't depend on the order of rows; repeated rows are counted first and told apart by that
number.  Null and empty texts have size 0, are taken with 0 words, and belong to a source
(null is one) whose target may be 0.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import BROADCAST_ROWS, cut, prepare, ranked, stored

#: Bits of the hash, and of each refinement.
HASH_BITS, STEP_BITS = 60, 12
#: Equal rows that one task writes out again at once.
CHUNK_ROWS = 100_000


def word_count(text: Column) -> Column:
    """The number of words: the places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of HASH_BITS for every row of (doc_id, text, source)."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    slim = docs.select("doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), text.alias("_text"))
    # equal rows are counted first and written out again in chunks, so a repeated row is no task of its own
    groups = cut(slim.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_n")))
    once = groups.filter("_n = 1").withColumn("_copy", F.lit(0).cast("long"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK_ROWS).cast("long")))
    chunks = groups.filter("_n > 1").withColumn("_from", chunk).repartition("doc_id", "_text", "_from")
    more = chunks.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK_ROWS, "_n") - 1))).drop("_from")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text", F.col("_copy").cast("string")).cast("binary"))
    return once.unionByName(more).select("doc_id", "source", "size", F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds weight and target to rows (source, source_size), one for each source; distributed, one aggregate a round."""
    ordered = ranked(sources.withColumn("_all", F.lit(0)).withColumn("_none", F.col("source").isNull().cast("int")), "_all", ["_none", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    rows = cut(ordered.select("source", "source_size", weight.alias("weight")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    # (numerator, denominator): words for each unit of weight, among sources below their caps
    share, before = (total, rows.agg(F.sum("weight")).first()[0] or 1), None
    while share != before:
        before = share
        over = F.col("weight").cast("decimal(38,0)") * F.lit(share[0]).cast("decimal(20,0)") > F.col("source_size").cast("decimal(20,0)") * most * F.lit(share[1]).cast("decimal(18,0)")
        capped, free = rows.agg(F.sum(F.when(over, F.col("source_size") * most)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        share = (total - (capped or 0), free)
    even = F.col("weight") * (F.lit(share[0]).cast("double") / F.lit(share[1]).cast("double"))
    return rows.withColumn("target", F.least(even, F.col("source_size").cast("double") * most))


def budgets(sources: DataFrame) -> DataFrame:
    """Adds copies, how often all of a source is taken, and left, the words that its target holds besides, rounded half up."""
    rounded = sources.withColumn("_words", F.floor(F.col("target") + 0.5))
    whole = rounded.withColumn("copies", F.expr("CASE WHEN source_size > 0 THEN _words div source_size ELSE 0L END"))
    return whole.withColumn("left", F.col("_words") - F.col("copies") * F.col("source_size")).drop("_words")


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(docs: DataFrame, sources: DataFrame, small: bool = False) -> DataFrame:
    """source, threshold, spent: the documents (source, size, hash) with a smaller hash are those that the budget `left` covers.

    sources: source, left; small: they have been counted and may be broadcast.  The first
    document that the budget doesn't cover ends it; rows of one hash go together.  Each
    round divides every source's last bucket into 2^STEP_BITS.
    """
    end = F.lit(1 << HASH_BITS)
    state = sources.select("source", "left", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("spent"), (F.col("left") <= 0).alias("done"))
    shift, state = HASH_BITS, cut(state)
    while shift > 0 and not state.filter("not done").isEmpty():
        width, shift = 1 << shift, max(0, shift - STEP_BITS)
        open_ = state.filter("not done").select(F.col("source").alias("_source"), "left", "low", "spent")
        inside = docs.join(_hint(open_, small), _same("source", "_source")).filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width))
        bucket = F.shiftright(F.col("hash") - F.col("low"), shift)
        sums = inside.groupBy("_source", "left", "low", "spent", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        # at most 2^STEP_BITS buckets of each source
        run = Window.partitionBy("_source").orderBy("bucket")
        summed = sums.withColumn("upto", F.col("spent") + F.sum("n").over(run))
        # the first bucket that the budget doesn't cover; without one all documents there are covered
        at = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("spent"), "first", "last"))).alias("at")
        found = summed.groupBy("_source", F.col("low").alias("_low")).agg(F.max("upto").alias("_upto"), at)
        one = F.col("at.first") == F.col("at.last")
        bound = F.when(F.col("at").isNull(), end).when(one, F.col("at.first")).otherwise(F.col("_low") + F.col("at.bucket") * F.lit(1 << shift).cast("long"))
        moved = found.select(F.col("_source"), bound.alias("_bound"), F.coalesce("at.spent", "_upto").alias("_spent"), (F.col("at").isNull() | one).alias("_done"))
        joined = state.join(_hint(moved, small), _same("source", "_source"), "left")
        # a source without documents there has none to leave out
        low = F.when(F.col("done"), F.col("low")).otherwise(F.coalesce("_bound", end))
        state = cut(joined.select("source", "left", low.alias("low"), F.coalesce("_spent", "spent").alias("spent"), (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done")))
    return state.select("source", F.col("low").alias("threshold"), "spent", "left")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, passes: int = 4) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies times size) for every row of (doc_id, text, source)."""
    prepare(docs.sparkSession)
    rows = stored(hashed_documents(docs))
    plan = cut(budgets(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)))
    small = plan.count() <= BROADCAST_ROWS
    open_ = rows.select("source", "size", "hash").filter("size > 0")
    left = plan.select("source", "left")
    named = plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("copies").alias("_whole"))
    once = F.lit(False)
    for k in range(passes):
        limit = thresholds(open_, left, small)
        rest = F.col("left") - F.col("spent")
        # the next pass: documents above the threshold that still fit
        step = limit.select(F.col("source").alias("_source"), "threshold", rest.alias("_left"))
        open_ = open_.join(_hint(step, small), _same("source", "_source")).filter("hash >= threshold and size <= _left").select("source", "size", "hash")
        left = limit.select("source", rest.alias("left"))
        named = named.join(_hint(limit.select(F.col("source").alias(f"_source{k}"), F.struct("threshold", "left").alias(f"_pass{k}")), small), _same("_source", f"_source{k}")).drop(f"_source{k}")
        once = once | ((F.col("size") <= F.col(f"_pass{k}.left")) & (F.col("hash") < F.col(f"_pass{k}.threshold")))
    mixed = rows.join(_hint(cut(named), small), _same("source", "_source"))
    mixed = mixed.withColumn("copies", F.col("_whole") + F.when((F.col("size") > 0) & once, 1).otherwise(0))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
