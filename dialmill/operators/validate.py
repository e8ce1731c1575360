"""Validation of conversation records (V1 to V21): one array of error codes per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.runtime import fits_broadcast, stash


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn rows (key, turn, role, text) as one row per conversation with ``messages`` in turn order.

    A conversation is a record: its turns come together here as they do in its file.
    """
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(m.alias("m")).select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def text_of(messages: Column, role: str | None = None) -> Column:
    """Contents of the messages of a role (or all), joined by line ends."""
    own = messages if role is None else F.filter(messages, lambda m: m["role"] == role)
    return F.array_join(F.transform(own, lambda m: X.text_or_empty(m["content"])), "\n")


def structure_errors(messages: Column, rules: R.Rules = R.DEFAULT, roles: tuple[str, ...] = ("user", "assistant")) -> Column:
    """Codes of V3 to V10; V3 stops the others."""
    n = F.size(messages)
    content = lambda m: X.text_or_empty(m["content"])
    size = lambda m: F.length(content(m))
    each = lambda code, test: F.transform(F.filter(messages, test), lambda m: F.lit(code))
    last = F.element_at(messages, -1)["role"]
    found = F.concat(
        F.when(~F.element_at(messages, 1)["role"].eqNullSafe("user"), F.array(F.lit("V4"))).otherwise(X.empty()),
        F.when(~last.eqNullSafe("assistant"), F.array(F.lit("V5"))).otherwise(X.empty()),
        each("V6", lambda m: ~F.coalesce(m["role"].isin(*roles), F.lit(False))),
        F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & F.get(messages, i)["role"].eqNullSafe(F.get(messages, i - 1)["role"])), lambda i: F.lit("V7")),
        each("V8", lambda m: ~content(m).rlike(r"(?U)\S")),
        each("V9", lambda m: (m["role"] == "user") & (size(m) > rules.user_most)),
        each("V10", lambda m: (m["role"] == "assistant") & ~size(m).between(rules.reply_least, rules.reply_most)),
    )
    return F.when(n < 2, F.array(F.lit("V3"))).otherwise(found)


def content_errors(messages: Column, is_tool: Column, tool_name: Column, required: Column) -> Column:
    """Codes of V11 to V19 against the seed's columns; empty prohibited cores never fire."""
    everything = X.normalize(text_of(messages, "assistant"))
    missing = lambda code, items: F.transform(F.filter(F.coalesce(items, X.empty()), lambda x: ~F.contains(everything, X.normalize(x))), lambda x: F.lit(code))
    core = lambda x: X.normalize(X.strip_negation(x))
    broken = F.filter(F.coalesce(F.col("prohibited_actions"), X.empty()), lambda x: (core(x) != "") & F.contains(everything, core(x)))
    calls = X.tool_calls(F.array_join(F.transform(messages, lambda m: X.text_or_empty(m["content"])), ""))
    call = X.parse_call(F.get(calls, F.lit(0)))
    called = F.when(F.size(calls) == 0, F.array(F.lit("V15"))).when(~call["valid"], F.array(F.lit("V16"))).otherwise(
        F.concat(
            F.when(~call["name"].eqNullSafe(tool_name), F.array(F.lit("V17"))).otherwise(X.empty()),
            F.transform(F.array_except(F.coalesce(required, X.empty()), F.map_keys(call["own"])), lambda x: F.lit("V18")),
        )
    )
    tool = F.concat(called, F.transform(X.hits(text_of(messages, "assistant"), R.FABRICATION_PHRASES), lambda x: F.lit("V19")))
    return F.concat(
        missing("V11", F.col("required_facts")), missing("V12", F.col("required_questions")), missing("V13", F.col("required_actions")),
        F.transform(broken, lambda x: F.lit("V14")), F.when(is_tool, tool).otherwise(X.empty()),
    )


def validate(records: DataFrame, seeds: DataFrame, tools: DataFrame, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """records with ``errors``: unknown seed (V1), test seed (V2), structure, content and duplicates (V20, keep first by ``ord``)."""
    s = seeds.select(F.col("seed_id").alias("__id"), F.col("split").alias("seed_split"), *[F.col(c) for c in ("required_facts", "required_questions", "required_actions", "prohibited_actions", "tool_name")]).withColumnRenamed("tool_name", "seed_tool")
    t = tools.select(F.col("tool_name").alias("__tool"), F.col("required").alias("__required"))
    own = ["seed_split", "required_facts", "required_questions", "required_actions", "prohibited_actions", "seed_tool"]
    out = records.drop(*own).join(s, records["seed_id"] == s["__id"], "left").join(t, F.col("seed_tool") == F.col("__tool"), "left")
    whole = F.col("__id").isNotNull() & (F.size("messages") >= 2)
    out = out.withColumn("__h", F.when(whole, F.sha2(F.to_json("messages"), 256)))
    # Digests that occur twice, with the first record of each: pre-aggregated, so a hot one is no window in one task.
    first = stash(out.filter("__h IS NOT NULL").groupBy("__h").agg(F.min("ord").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h", "__first"), "repeated")
    out = out.join(F.broadcast(first) if fits_broadcast(first) else first, "__h", "left")
    structure = structure_errors(F.col("messages"), rules)
    content = content_errors(F.col("messages"), F.col("sample_type") == "tool_call", F.col("seed_tool"), F.col("__required"))
    later = F.concat(
        F.when(F.col("seed_split") == "final_test", F.array(F.lit("V2"))).otherwise(X.empty()), structure,
        F.when(F.size("messages") < 2, X.empty()).otherwise(F.concat(content, F.when(F.col("ord") > F.col("__first"), F.array(F.lit("V20"))).otherwise(X.empty()))),
    )
    return out.withColumn("errors", F.when(F.col("__id").isNull(), F.array(F.lit("V1"))).otherwise(later)).drop("__id", "__tool", "__required", "__h", "__first", *own)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of equal keys, by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def length_filter(messages: Column, rules: R.Rules = R.DEFAULT) -> Column:
    """Whether all turns have acceptable lengths."""
    size = lambda m: F.length(X.text_or_empty(m["content"]))
    return ~F.exists(messages, lambda m: ((m["role"] == "user") & (size(m) > rules.user_most)) | ((m["role"] == "assistant") & ~size(m).between(rules.reply_least, rules.reply_most)))
