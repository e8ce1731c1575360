"""Aggregates over scored rows, records and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialmill.operators.score import DIMS, is_bad

FLAGS = ("half_answer", "safety_missing", "rescue_missing", "call_missing", "bad_call", "needless_call")


def rate(total: Column, n: Column) -> Column:
    """Sum of 0..2 scores as a percentage, one decimal; 0 for no row."""
    return F.when(n > 0, F.round(100 * total / (2 * n), 1)).otherwise(F.lit(0.0))


def seed_counts(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("category_id").agg(F.first("category").alias("category"), F.count(F.lit(1)).alias("n"), F.count_if("tool_required").alias("n_tool"))


def by_type(records: DataFrame, types: list[str]) -> DataFrame:
    """Records per category, a column for each sample type (A2)."""
    return records.groupBy("category_id").pivot("sample_type", types).count().na.fill(0)


def scores_by_category(scored: DataFrame) -> DataFrame:
    """Mean total and the rate of each dimension per category."""
    n = F.count(F.lit(1))
    return scored.groupBy("category_id").agg(n.alias("n"), F.avg("total").alias("mean_total"), *[rate(F.sum(d), n).alias(f"rate_{d}") for d in DIMS])


def model_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Mean total, seven means, bad cases and rows."""
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean_total"), *[F.avg(d).alias(f"mean_{d}") for d in DIMS], F.count_if(is_bad()).alias("n_bad"))


def defect_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Hits of each defect flag as rows (flag, n): one aggregate, then an unpivot."""
    one = scored.groupBy(*by).agg(*[F.count_if(F.col(f)).alias(f) for f in FLAGS])
    return one.unpivot(list(by), list(FLAGS), "flag", "n")


def top_defects(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent defects; ties in the order of FLAGS."""
    place = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("flag"))
    return defect_counts(scored).filter("n > 0").orderBy(F.desc("n"), place).limit(k)


def worst_per_category(scored: DataFrame, k: int = 6, key: str = "seed_id") -> DataFrame:
    """The first k bad cases of each category with how many more there are."""
    w = Window.partitionBy("category_id")
    out = scored.filter(is_bad()).withColumn("place", F.row_number().over(w.orderBy("total", key)))
    sizes = scored.filter(is_bad()).groupBy("category_id").agg(F.count(F.lit(1)).alias("in_category"))
    return out.filter(F.col("place") <= k).join(sizes, "category_id").withColumn("more", F.greatest(F.col("in_category") - k, F.lit(0)))


def good_cases(items: DataFrame, least: int = 2, most: int = 8, top_up: int = 5, key: str = "seed_id") -> DataFrame:
    """Wins by largest gap, then longest answer (``len``): those with a gap of least, most at most, topped up to top_up."""
    order = [F.desc("gap"), F.desc("len"), F.col(key)]
    first = items.filter("verdict = 'candidate'").orderBy(*order).limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.filter((F.col("gap") >= least) | (F.col("place") <= top_up))


def pair_stats(pairs: DataFrame, *by: str) -> DataFrame:
    """Rows, distinct seeds, lengths and margins."""
    m = F.col("score_chosen") - F.col("score_rejected")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("seed_id").alias("seeds"), F.avg("len_chosen").alias("len_chosen_avg"), F.min("len_chosen").alias("len_chosen_min"), F.max("len_chosen").alias("len_chosen_max"),
        F.avg("len_rejected").alias("len_rejected_avg"), F.avg(m).alias("margin_avg"), F.min(m).alias("margin_min"), F.max(m).alias("margin_max"),
    )


def pairs_by_category(pairs: DataFrame) -> DataFrame:
    """Pairs of each category, those of the safety class among them, and the mean length of the chosen text."""
    return pairs.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("defect") == "safety").alias("n_safety"), F.avg("len_chosen").alias("len_chosen_avg"))


def capped_shares(candidates: DataFrame, by: str, cap: int) -> DataFrame:
    """Per class the candidates, min(candidates, cap), and its share of the capped total."""
    n = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.least("n", F.lit(cap).cast("long")))
    return n.withColumn("share", F.col("kept") / F.sum("kept").over(Window.partitionBy()))


def reasons(rows: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """Counts of the codes in an array or plain column, the most frequent first (A4); a row counts weight times, or once."""
    c = F.explode(column) if dict(rows.dtypes)[column].startswith("array") else F.col(column)
    times = F.lit(1).cast("long") if weight is None else weight
    return rows.select(c.alias("reason"), times.alias("n")).filter("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason")


def pass_fail(rows: DataFrame, *by: str) -> DataFrame:
    """Records without and with errors (A5)."""
    ok = F.size("errors") == 0
    return rows.groupBy(*by).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def zero_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Rows that lost a dimension, as rows (A17); fabrication counts from its first lost point."""
    one = scored.groupBy(*by).agg(*[F.count_if(F.col(d) < 2 if d == "fabrication" else F.col(d) == 0).alias(d) for d in DIMS])
    return one.unpivot(list(by), list(DIMS), "dimension", "n")


def mean(c: str) -> Column:
    """The mean, 0 for no row."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def categories(seeds: DataFrame) -> DataFrame:
    """The distinct categories, in order."""
    return seeds.select("category_id", "category").distinct().orderBy("category_id")


def require(df: DataFrame, test: Column, message: str) -> DataFrame:
    """df, failing at run time with message where test isn't true."""
    return df.filter(F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def moves(both: DataFrame, step: int = 2) -> DataFrame:
    """One row: items whose total rose or fell by step or more, and the rest (A25). Columns c_total, b_total."""
    gap = F.col("c_total") - F.col("b_total")
    return both.agg(F.count_if(gap >= step).alias("up"), F.count_if(gap <= -step).alias("down"), F.count_if(F.abs(gap) < step).alias("same"))


def radar(scored: DataFrame, *by: str) -> DataFrame:
    """Means of the dimensions on a scale of 0 to 1, as rows."""
    one = scored.groupBy(*by).agg(*[(F.avg(d) / 2).alias(d) for d in DIMS])
    return one.unpivot(list(by), list(DIMS), "dimension", "value")


def judge_coverage(rows: DataFrame) -> DataFrame:
    """Rows judged, taken from the cache, and scored by rules only (A23). Columns judged, cached."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("judged").alias("judged"), F.count_if("cached").alias("cached"), F.count_if(~F.col("judged")).alias("by_rules"))


def quota_warnings(rows: DataFrame, by: str, need: dict[str, int]) -> DataFrame:
    """Per required class the rows there are, the rows needed, and whether they are too few; classes without rows included."""
    spark = rows.sparkSession
    want = spark.createDataFrame(sorted(need.items()), f"{by} string, need int")
    have = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), "need", (F.coalesce("n", F.lit(0)) < F.col("need")).alias("short"))


#: (name, test over the aggregates of ``suggestions``, advice), in order; the default comes when none fires.
ADVICE = (
    ("half_answer", "n_half > 0.05 * n", "add examples with complete steps"),
    ("call_missing", "n_call_missing > 0", "add examples that start a query"),
    ("bad_call", "n_bad_call > 0", "add examples that ask for missing arguments"),
    ("safety", "n_safety > 0", "add safety phrases for fault scenarios"),
    ("mean", "mean_total < 10", "raise coverage of facts and actions"),
)


def suggestions(scored: DataFrame) -> DataFrame:
    """(rank, topic, advice): the rules that fire on the aggregates, in order, or one default row."""
    one = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if("half_answer").alias("n_half"), F.count_if("call_missing").alias("n_call_missing"), F.count_if("bad_call").alias("n_bad_call"), F.count_if(F.coalesce("safety_missing", F.lit(False))).alias("n_safety"), F.avg("total").alias("mean_total"))
    fired = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit(topic).alias("topic"), F.lit(text).alias("advice"))) for topic, test, text in ADVICE]))
    default = F.array(F.struct(F.lit("none").alias("topic"), F.lit("keep the current mix").alias("advice")))
    return one.select(F.posexplode(F.when(F.size(fired) > 0, fired).otherwise(default)).alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), "x.topic", "x.advice")


def signed(c: Column, places: int = 2) -> Column:
    """A number with its sign and fixed places."""
    return F.format_string(f"%+.{places}f", c.cast("double"))
