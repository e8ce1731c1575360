"""Pairwise arena: sides, two-way consensus, win rates, rating gaps, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.operators.metrics import require
from dialmill.operators.score import DIMS


def normal(verdict: Column) -> Column:
    """A, B or TIE: trimmed, upper case, anything else a tie; null (no verdict) stays null."""
    v = F.upper(F.trim(verdict))
    return F.when(verdict.isNull(), F.lit(None)).when(v.isin("A", "B"), v).otherwise("TIE")


def longer_wins(a: Column, b: Column) -> Column:
    """The stub judge: the longer text wins, ties go to A."""
    return F.when(F.length(F.coalesce(a, F.lit(""))) >= F.length(F.coalesce(b, F.lit(""))), "A").otherwise("B")


def consensus(rows: DataFrame, judge: Callable[[Column, Column], Column] = longer_wins, both: bool = True, fallback: int = 2) -> DataFrame:
    """rows (key columns, candidate, baseline, coin, total_candidate, total_baseline) with verdict and method.

    The coin puts the candidate on side A or B; with both, the sides are swapped for a second verdict. Equal verdicts
    stand, different ones are a tie, a missing one leaves the other, and without any the totals decide if they differ by
    fallback or more.
    """
    def side(first: Column) -> Column:
        said = normal(judge(F.when(first, F.col("candidate")).otherwise(F.col("baseline")), F.when(first, F.col("baseline")).otherwise(F.col("candidate"))))
        won = F.when(first, "A").otherwise("B")
        return F.when(said.isNull(), F.lit(None)).when(said == "TIE", "tie").when(said == won, "candidate").otherwise("baseline")

    out = rows.withColumn("__1", side(F.col("coin"))).withColumn("__2", side(~F.col("coin")) if both else F.lit(None).cast("string"))
    gap = F.col("total_candidate") - F.col("total_baseline")
    rule = F.when(gap >= fallback, "candidate").when(gap <= -fallback, "baseline").otherwise("tie")
    one, two = F.col("__1"), F.col("__2")
    verdict = F.when(one.isNull() & two.isNull(), rule).when(one.isNull(), two).when(two.isNull(), one).when(one == two, one).otherwise("tie")
    method = F.when(one.isNull() & two.isNull(), "rule").when(one.isNull() | two.isNull(), "single").otherwise("both")
    return out.withColumn("verdict", verdict).withColumn("method", method).drop("__1", "__2")


def elo(w: Column, t: Column, n: Column) -> Column:
    """Rating gap from wins, ties and losses, clipped to 800 either way, one decimal."""
    won, lost = w + t / 2, n - w - t / 2
    gap = F.when(won <= 0, -800.0).when(lost <= 0, 800.0).otherwise(400 * F.log10(won / lost))
    return F.round(F.least(F.lit(800.0), F.greatest(F.lit(-800.0), gap)), 1)


def outcome_columns() -> list[Column]:
    v = F.col("verdict")
    n, w, t = F.count(F.lit(1)), F.count_if(v == "candidate"), F.count_if(v == "tie")
    return [n.alias("n"), w.alias("wins"), t.alias("ties"), (n - w - t).alias("losses"), F.round(100 * w / n, 1).alias("win_rate"), F.when(n > t, F.round(100 * w / (n - t), 1)).alias("decided_rate"), elo(w, t, n).alias("elo")]


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, win rates and rating gap, overall or by columns."""
    return rows.groupBy(*by).agg(*outcome_columns())


def overview(rows: DataFrame, by: str) -> DataFrame:
    """The same overall and per group in one pass; the overall row has a null group."""
    return rows.rollup(by).agg(*outcome_columns())


def change(delta: Column, flat: float) -> Column:
    return F.when(delta > flat, "improved").when(delta < -flat, "degraded").otherwise("flat")


def compare_dimensions(both: DataFrame) -> DataFrame:
    """Per dimension the two models' means, their difference and its class (A21, A30). Columns c_<dim>, b_<dim>."""
    means = both.agg(*[F.avg(f"{s}_{d}").alias(f"{s}_{d}") for s in "cb" for d in DIMS])
    parts = ", ".join(f"'{d}', c_{d}, b_{d}" for d in DIMS)
    one = means.selectExpr(f"stack({len(DIMS)}, {parts}) AS (dimension, candidate, baseline)")
    return one.withColumn("delta", F.col("candidate") - F.col("baseline")).withColumn("change", change(F.col("delta"), 0.05))


def rejoin(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """Stored results with their seeds' columns, so that an arena reruns without scoring (R5, J13); an unknown seed raises."""
    s = seeds.withColumnRenamed("seed_id", "__seed")
    out = items.join(s, items["seed_id"] == s["__seed"], "left")
    return require(out, F.col("__seed").isNotNull(), "a stored result has no seed").drop("__seed")


#: A category or the total has moved from this difference of means on; dimensions may lose as much as BASE_LOSS.
MOVED, BASE_LOSS = 0.25, 0.3


def compare_categories(both: DataFrame) -> DataFrame:
    """Per category both means, their difference and its class, bad cases of both, wins, losses and ties."""
    won = lambda v: F.count_if(F.col("verdict") == v)
    out = both.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.avg("c_total").alias("candidate"), F.avg("b_total").alias("baseline"), F.count_if("c_bad").alias("bad_candidate"), F.count_if("b_bad").alias("bad_baseline"), won("candidate").alias("wins"), won("baseline").alias("losses"), won("tie").alias("ties"))
    delta = F.col("candidate") - F.col("baseline")
    return out.withColumn("delta", delta).withColumn("change", F.when(F.round(delta, 6) >= MOVED, "improved").when(F.round(delta, 6) <= -MOVED, "degraded").otherwise("flat"))


def cards(both: DataFrame) -> DataFrame:
    """One row of headline figures: means, bad cases, win rate, rating gap, movements."""
    n, w, t = F.count(F.lit(1)), F.count_if(F.col("verdict") == "candidate"), F.count_if(F.col("verdict") == "tie")
    c, b = F.avg("c_total"), F.avg("b_total")
    return both.agg(c.alias("mean_candidate"), b.alias("mean_baseline"), F.count_if("c_bad").alias("bad_candidate"), F.count_if("b_bad").alias("bad_baseline"), (c - b).alias("delta"), F.round(100 * w / n, 1).alias("win_rate"), elo(w, t, n).alias("elo"), F.count_if(F.col("gap") >= 2).alias("up"), F.count_if(F.col("gap") <= -2).alias("down"))


def conclusion(both: DataFrame) -> DataFrame:
    """One row: whether base skills are kept, whether rules are followed better, and the outcome of both."""
    moved = compare_categories(both).agg(F.count_if(F.col("change") == "improved").alias("improved"), F.count_if(F.col("change") == "degraded").alias("degraded"))
    lost = lambda d: F.avg(f"c_{d}") - F.avg(f"b_{d}")
    one = both.agg(
        lost("total").alias("d"), lost("understanding").alias("u"), lost("completeness").alias("p"), F.round(100 * F.count_if(F.col("verdict") == "candidate") / F.count(F.lit(1)), 1).alias("win"),
        *[F.count_if(F.col(f"{s}_fabrication") < 2).alias(f"{s}_made_up") for s in "cb"], *[F.count_if(F.col(f"{s}_prohibited") == 0).alias(f"{s}_broken") for s in "cb"],
    )
    base = (F.col("d") > -MOVED) & (F.col("u") >= -BASE_LOSS) & (F.col("p") >= -BASE_LOSS) & (F.col("degraded") <= F.col("improved"))
    rules = (F.col("win") >= 50) & (F.col("c_made_up") <= F.col("b_made_up")) & (F.col("c_broken") <= F.col("b_broken"))
    out = one.withColumn("__k", F.lit(1)).join(moved.withColumn("__k", F.lit(1)), "__k").select(base.alias("base_kept"), rules.alias("rules_kept"))
    return out.withColumn("conclusion", F.when(F.col("base_kept") & F.col("rules_kept"), "yes").when(F.col("rules_kept"), "rules only").when(F.col("base_kept"), "base only").otherwise("no"))


#: (topic, test over the aggregates of ``advice``), in order; the default comes when none fires.
NEXT = (
    ("safety phrases", "c_safety > 0"), ("rescue phrases", "c_rescue > 0"), ("made-up details", "c_made_up > 0"), ("missing calls", "c_call > 0"),
    ("half answers", "c_half > 0"), ("prohibited statements", "c_broken > b_broken"), ("little gain", "d <= 0.3 OR w <= l"), ("keep", "improved <> ''"),
)


def advice(both: DataFrame, candidate: DataFrame) -> DataFrame:
    """(rank, topic): what the next round should add, from the candidate's remaining defects and the comparison."""
    won = lambda v: F.count_if(F.col("verdict") == v)
    one = both.agg((F.avg("c_total") - F.avg("b_total")).alias("d"), won("candidate").alias("w"), won("baseline").alias("l"), F.count_if(F.col("c_fabrication") < 2).alias("c_made_up"), *[F.count_if(F.col(f"{s}_prohibited") == 0).alias(f"{s}_broken") for s in "cb"])
    left = candidate.agg(*[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(n) for n, f in (("c_safety", "safety_missing"), ("c_rescue", "rescue_missing"), ("c_call", "call_missing"), ("c_half", "half_answer"))])
    better = compare_categories(both).filter("change = 'improved'").agg(F.array_join(F.sort_array(F.collect_list("category_id")).cast("array<string>"), ",").alias("improved"))  # a row per category
    key = lambda df: df.withColumn("__k", F.lit(1))
    row = key(one).join(key(left), "__k").join(key(better), "__k")
    fired = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(topic)) for topic, test in NEXT]))
    return row.select(F.posexplode(F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit("none")))).alias("rank", "topic")).select((F.col("rank") + 1).alias("rank"), "topic")


def final_verdict(both: DataFrame) -> DataFrame:
    """One row: whether the candidate's mean isn't lower and its bad cases aren't more, and the outcome of both."""
    one = both.agg(F.avg("c_total").alias("mean_candidate"), F.avg("b_total").alias("mean_baseline"), F.count_if("c_bad").alias("bad_candidate"), F.count_if("b_bad").alias("bad_baseline"))
    better, cleaner = F.col("mean_candidate") >= F.col("mean_baseline"), F.col("bad_candidate") <= F.col("bad_baseline")
    return one.withColumn("verdict", F.when(better & cleaner, "accept").when(better, "mean only").when(cleaner, "bad cases only").otherwise("reject"))
