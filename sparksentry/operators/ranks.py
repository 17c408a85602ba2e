"""Dense row numbers, seeded permutations and stratified folds, for tables whose groups may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut

#: Groups and partitions that meet, up to which their offsets are broadcast.
BROADCAST_ROWS = 200_000


def numbered(df: DataFrame, order: list[Column], by: list[Column] | None = None, name: str = "nth") -> DataFrame:
    """Adds the number of each row, from 0, among the rows of one group (all rows without `by`), in `order`; nulls first.

    Rows are range-sorted by group, order and their own number, so a group of any size, even of
    equal rows, spreads over partitions and no task holds one whole.  Where a partition's part
    of a group begins follows from the counts of the parts before it.  df's columns are
    carried along whatever their names; a column called `name` is replaced.  Rows that are equal
    in group and order get their numbers in the order in which they are stored.
    """
    spark = df.sparkSession
    # in one column, so that no name can clash; the number is taken from a checkpoint, so that a repeated task gives it again
    keyed = cut(df.select(F.struct("*").alias("_row"), F.struct(*(by or [F.lit(0)])).alias("_by"), F.struct(*order).alias("_order")))
    tied = keyed.withColumn("_tie", F.monotonically_increasing_id())
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = tied.repartitionByRange(many, "_by", "_order", "_tie").sortWithinPartitions("_by", "_order", "_tie")
    spread = cut(spread.select("_row", "_by", F.monotonically_increasing_id().alias("_at"))).withColumn("_part", F.shiftright("_at", 33))
    parts = cut(spread.groupBy("_by", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    # at most one row for each partition and group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("_by").alias("_group"), F.col("_part").alias("_piece"), (before - F.col("_first")).alias("_shift"))
    offsets = F.broadcast(offsets) if parts.count() <= BROADCAST_ROWS else offsets
    found = spread.join(offsets, (F.col("_by") == F.col("_group")) & (F.col("_part") == F.col("_piece")))
    nth = (F.col("_at") + F.col("_shift")).alias(name)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in df.columns if c != name), nth)


def seeded(seed: int, *columns: Column) -> Column:
    """A hash that orders rows at random, and again in the same order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns)).cast("binary"))


def permuted(df: DataFrame, key: list[str], seed: int = 42, name: str = "nth") -> DataFrame:
    """Adds each row's place, from 0, in a permutation that depends on the seed and the key columns; rows of one key stand together."""
    columns = [F.col(c) for c in key]
    return numbered(df, [seeded(seed, *columns), *columns], name=name)


def stratified(df: DataFrame, label: str, key: list[str], folds: int = 3, seed: int = 42, name: str = "fold") -> DataFrame:
    """Adds a fold, from 0: each label's rows, and all rows, are dealt to the folds with counts that are one apart at most.

    Rows are permuted within their labels and dealt in turn, each label going on where the one before it ended.
    """
    if folds < 1:
        raise ValueError("one fold at least")
    columns = [F.col(c) for c in key]
    dealt = numbered(df, [F.col(label), seeded(seed, *columns), *columns], name=name)
    return dealt.withColumn(name, F.pmod(F.col(name), F.lit(folds)).cast("int"))
