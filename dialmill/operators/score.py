"""Rule scoring of answers: seven dimensions, 0 to 2 each, with flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.functions import text as X

DIMS = ["understanding", "facts", "questions", "actions", "prohibited", "completeness", "fabrication"]
FLAGS = ["half_answer", "safety_missing", "rescue_missing", "call_missing", "bad_call", "needless_call"]
LISTS = ("required_facts", "required_questions", "required_actions", "prohibited_actions")


def prepared(seeds: DataFrame) -> DataFrame:
    """Seeds with the coverage phrases of each list and the scenario's pairs; done once per seed, not per answer."""
    out = seeds
    for name in LISTS:
        items = F.coalesce(F.col(name), X.empty())
        out = out.withColumn(f"{name}_p", X.phrases(F.filter(items, lambda s: s != "") if name == "prohibited_actions" else items))
    source = F.concat(*[F.array_join(F.coalesce(F.col(n), X.empty()), "") for n in ("required_facts", "required_actions", "required_questions")])
    return out.withColumn("scenario_p", X.bigrams(F.col("scenario"))).withColumn("source_text", source)


def score(rows: DataFrame, tools: list[str] | None = None, rules: R.Rules = R.DEFAULT, answer: str = "answer") -> DataFrame:
    """rows (prepared seed columns and an answer) with the seven dimensions, total and flag columns.

    tools: registered names; None or empty turns the check of names off. Flags that don't apply are null.
    """
    a = F.col("__a")
    need = F.coalesce(F.col("tool_required"), F.lit(False))
    out = rows.withColumn("__a", X.strip(F.col(answer)))
    out = out.withColumn("__calls", X.tool_calls(a)).withColumn("__topic", X.topic_share(F.col("scenario_p"), a))
    out = out.withColumns({f"ok_{n}": X.cover_count(F.col(f"required_{n}_p"), a, rules.fact_ratio) for n in ("facts", "questions", "actions")})
    out = out.withColumn("__broken", F.filter("prohibited_actions_p", lambda p: X.covered(p, a, rules.prohibited_ratio)))
    out = out.withColumn("__claims", F.filter(X.number_claims(a), lambda n: ~F.contains(F.col("source_text"), X.strip(n))))
    first = F.when(F.size("__calls") > 0, X.parse_call(F.get(F.col("__calls"), F.lit(0))))
    out = out.withColumn("__call", first)
    known = F.concat(X.text_or_empty(F.col("scenario")), X.text_or_empty(F.col("user_goal")))
    has_call = F.size("__calls") > 0
    bad_name = ~F.col("__call.name").isin(*tools) if tools else F.lit(False)
    zero = F.coalesce(
        (need & has_call & (~F.col("__call.valid") | bad_name | (F.size(X.unsourced(F.col("__call.args"), known)) > 0)))
        | (~need & has_call)
        | (a.rlike(R.RESULT_CLAIM) & ~has_call),
        F.lit(False),
    )
    half = X.is_half(a, rules.half_length)
    full = (F.length(a) >= rules.full_length) & (F.size(X.sentences(a)) >= 2)
    out = out.withColumns({
        "understanding": F.when((a != "") & (F.col("__topic") >= rules.topic_ratio), 2).when(a != "", 1).otherwise(0),
        **{n: X.cover_level(F.col(f"ok_{n}"), F.size(f"required_{n}_p")) for n in ("facts", "questions", "actions")},
        "prohibited": F.when(F.size("__broken") > 0, 0).otherwise(2),
        "completeness": F.when(half, 0).when(full, 2).otherwise(1),
        "fabrication": F.when(zero, 0).when((F.size("__claims") > 0) | (need & ~has_call), 1).otherwise(2),
        "topic": F.col("__topic"),
        "violated": F.when(F.size("__broken") > 0, F.get(F.col("__broken"), F.lit(0))["s"]).otherwise(""),
        "half_answer": half,
        "safety_missing": F.when(F.col("category_id") == 3, ~X.contains_any(a, R.SAFETY_WORDS)),
        "rescue_missing": F.when(F.col("category_id") == 6, ~X.contains_any(a, R.RESCUE_WORDS)),
        "call_missing": F.when(need, ~has_call),
        "bad_call": need & has_call & zero,
        "needless_call": ~need & has_call,
    })
    out = out.withColumn("total", sum((F.col(d) for d in DIMS), F.lit(0)))
    reasons = F.array_compact(F.array(
        F.when(F.size("__claims") > 0, F.concat(F.lit("unsupported numbers: "), F.array_join("__claims", ","))),
        F.when(need & ~has_call, "no call where one is required"), F.when(F.col("bad_call"), "invalid, unknown or unsourced call"),
        F.when(F.col("needless_call"), "call where none is required"), F.when(a.rlike(R.RESULT_CLAIM) & ~has_call, "result claimed without a call"),
        F.when(F.col("violated") != "", F.concat("violated", F.lit(" (prohibited)"))),
    ))
    own = ["__a", "__calls", "__topic", "__broken", "__claims", "__call", "scenario_p", "source_text", *(f"{n}_p" for n in LISTS)]
    out = out.withColumn("reasons", reasons).drop(*own)
    # The results pass through a generator, so that a later filter on them isn't pushed into, and doesn't repeat, the scoring.
    new = [c for c in out.columns if c in {*DIMS, "total", "topic", "violated", "reasons", *FLAGS, *(f"ok_{n}" for n in ("facts", "questions", "actions"))}]
    return out.select(*[c for c in out.columns if c not in new], F.inline(F.array(F.struct(*new))))


def parsed_replies(replies: DataFrame, column: str) -> DataFrame:
    """replies with the seven dimensions of the JSON object in a judge's reply; all null unless each is a number."""
    got = F.from_json(X.json_object(F.col(column)), ", ".join(f"{d} string" for d in DIMS))
    out = replies.withColumn("__r", got)
    number = {d: F.col(f"__r.{d}").try_cast("int") for d in DIMS}
    whole = sum((n.isNull().cast("int") for n in number.values()), F.lit(0)) == 0
    return out.withColumns({d: F.when(whole, n) for d, n in number.items()}).drop("__r")


def with_judge(scored: DataFrame, judged: DataFrame, key: str = "seed_id") -> DataFrame:
    """Scores overridden by a judge's where it gave all seven dimensions; total follows; ``judged`` says which."""
    j = judged.select(F.col(key).alias("__k"), *[F.col(d).cast("int").alias(f"__{d}") for d in DIMS])
    out = scored.join(j, scored[key] == j["__k"], "left")
    whole = sum((F.col(f"__{d}").isNull().cast("int") for d in DIMS), F.lit(0)) == 0
    out = out.withColumn("judged", whole).withColumns({d: F.when(F.col("judged"), F.col(f"__{d}")).otherwise(F.col(d)) for d in DIMS})
    return out.withColumn("total", sum((F.col(d) for d in DIMS), F.lit(0))).drop("__k", *[f"__{d}" for d in DIMS])


def is_bad(rules: R.Rules = R.DEFAULT) -> Column:
    """Bad case: a low total, or a zero in any dimension but understanding."""
    return (F.col("total") <= rules.bad_total) | (F.least(*[F.col(d) for d in DIMS[1:]]) == 0)
