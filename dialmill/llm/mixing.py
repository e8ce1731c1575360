"""Mixing sources to target weights, in DataFrame operations only.

Token totals per source give targets by water filling; a document is emitted ``floor(rate)`` times plus one more
time when a number hashed from the row, its number among equal rows, and the seed falls below the fraction of the rate.

Each row draws for itself: the number comes from the id, the text's digest, the source and the other columns, so rows
without an id, or with a repeated one, don't draw alike; rows that are equal in every column are numbered.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, last in
order; an empty table gives an empty result; null ids and repeated rows draw one by one; columns that clash with the output
names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialmill.llm.text import numbered, word_count
from dialmill.runtime import lookup_join, stash, without

WEIGHTS, CEILING, SEED = (5, 2, 1), 3, "mix-1"
OWN = ["size", "source_size", "target", "rate", "copies", "taken"]


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> the same with ``target`` and ``rate``.

    Weights go to the sources by code point, null last, repeating. A target stops at ceiling * source_size and the
    excess is shared again by weight. With sources ordered by cap/weight, the water level is the largest of
    (total - caps before) / (weights from here on), so no iteration is needed. The windows are over one row per
    source, never over documents.
    """
    everything = Window.partitionBy()
    t = totals.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("idx") % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * ceiling)
    order = Window.orderBy(F.col("cap") / F.col("w"), "idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, all_w = F.sum("source_size").over(everything), F.sum("w").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (all_w - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(everything))
    t = t.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "source_size", "target", F.least(rate, F.lit(float(ceiling))).alias("rate"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of key and seed; 52 bits, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def digest(text: Column) -> Column:
    """The md5 of a text, empty for null: it stands for the text wherever a row's key is needed."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, sized: bool = False) -> DataFrame:
    """Every document with size, source_size, target, rate, copies and taken (copies * size).

    sized: docs hold their sizes in ``size`` already, and their texts' digests in text_col; no text is read.
    """
    docs = without(docs, [c for c in OWN if not (sized and c == "size")])
    mark = F.col(text_col) if sized else digest(F.col(text_col))
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    others = [c for c in docs.columns if c not in (id_col, text_col, source_col, "size")]
    more = [F.md5(F.to_json(F.struct(*others)).cast("binary"))] if others else []
    docs = numbered(docs, F.concat_ws("|", part(F.col(id_col)), mark, part(F.col(source_col)), *more))
    docs = docs if sized else docs.withColumn("size", word_count(F.col(text_col)))
    totals = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = stash(source_targets(totals, weights, ceiling), "mix-targets").withColumnRenamed("source", source_col)
    out = lookup_join(docs, targets, source_col, F.col("__row_key"))
    whole = F.floor("rate")
    extra = (uniform(F.concat_ws("|", "__row_key", F.col("__k").cast("string")), seed) < F.col("rate") - whole).cast("long")
    return out.withColumn("copies", whole + extra).withColumn("taken", F.col("copies") * F.col("size")).drop("__row_key", "__k")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document's row repeated ``copies`` times, with the columns of docs (less those named like OWN)."""
    out = plan_mix(docs, **how).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[c for c in docs.columns if c.lower() not in OWN])
