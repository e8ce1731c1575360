"""Column functions over words, and the numbering of equal rows, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.runtime import fits_broadcast, stash

#: White space of the word contract: space and TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    def blank(c: Column) -> Column:
        code = F.ascii(c)
        return ((code == 32) | code.between(9, 13)).cast("int")

    n = F.size(F.split(text, SPACE)) - blank(text) - blank(F.right(text, F.lit(1)))
    return F.when(text.isNull() | (text == ""), 0).otherwise(n).cast("long")


def words(text: Column) -> Column:
    """The words in order; empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def numbered(docs: DataFrame, key: Column) -> DataFrame:
    """docs with ``__row_key``, and ``__k``, from 0 among the rows of equal keys.

    Only narrow keys are shuffled, pre-aggregated by task; rows of a repeated key come together as one row and a count,
    however many there are, and are dealt out again.
    """
    docs = docs.withColumn("__row_key", key)
    often = stash(docs.groupBy("__row_key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "repeated-rows")
    if not often.limit(1).count():
        return docs.withColumn("__k", F.lit(0).cast("long"))
    side = F.broadcast(often) if fits_broadcast(often) else often
    single = docs.join(side, "__row_key", "left_anti").withColumn("__k", F.lit(0).cast("long"))
    row = F.struct(*[c for c in docs.columns if c != "__row_key"])
    again = docs.join(side.select("__row_key"), "__row_key", "left_semi").groupBy("__row_key").agg(F.first(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
    dealt = again.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return single.unionByName(dealt.select("__row.*", "__row_key", "__k"))
