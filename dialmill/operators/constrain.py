"""Constraint gate: violations of an answer, retry guidance, rule repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.functions import text as X

GUIDE = {
    "unknown_tool": "use the tool of this scenario and its exact name", "unsourced_argument": "leave arguments empty or use what the customer said; ask for the rest",
    "call_missing": "start the query with the tool of this scenario", "call_needless": "answer without a tool call", "bad_json": "write the call as valid JSON",
    "safety_missing": "tell the customer to stop driving", "rescue_missing": "confirm that rescue was arranged", "half_answer": "add steps, follow-up and a closing",
}


def violations(answer: Column, tools: list[str] | None = None, rules: R.Rules = R.DEFAULT) -> Column:
    """Codes of all violations; every call is looked at. Seed columns: tool_required, category_id, scenario, user_goal."""
    a = X.text_or_empty(answer)
    need = F.coalesce(F.col("tool_required"), F.lit(False))
    calls = X.tool_calls(a)
    known = F.concat(X.text_or_empty(F.col("scenario")), X.text_or_empty(F.col("user_goal")))

    def of_call(j: Column) -> Column:
        c = X.parse_call(j)
        name = F.when(~c["name"].isin(*tools), F.array(F.lit("unknown_tool"))).otherwise(X.empty()) if tools else X.empty()
        return F.when(~c["valid"], F.array(F.lit("bad_json"))).otherwise(F.concat(name, F.transform(X.unsourced(c["args"], known), lambda e: F.lit("unsourced_argument"))))

    one = lambda test, code: F.when(test, F.array(F.lit(code))).otherwise(X.empty())
    return F.concat(
        one(need & (F.size(calls) == 0), "call_missing"),
        F.when(need, F.flatten(F.transform(calls, of_call))).otherwise(one(F.size(calls) > 0, "call_needless")),
        one((F.col("category_id") == 3) & ~X.contains_any(a, R.SAFETY_WORDS), "safety_missing"),
        one((F.col("category_id") == 6) & ~X.contains_any(a, R.RESCUE_WORDS), "rescue_missing"),
        one(X.is_half(a, rules.half_length), "half_answer"),
    )


def retry_guide(found: Column, tool_name: Column) -> Column:
    """One line for each violation, with the right tool's name where it is the answer."""
    table = F.create_map(*[F.lit(x) for kv in GUIDE.items() for x in kv])
    line = lambda v: F.concat(F.lit("- "), F.coalesce(F.element_at(table, v), v), F.when(v.isin("unknown_tool", "call_missing") & tool_name.isNotNull(), F.concat(F.lit(": "), tool_name)).otherwise(""))
    return F.array_join(F.transform(found, line), "\n")


def repair(rows: DataFrame, column: str, tools: list[str] | None = None) -> DataFrame:
    """rows with the answers in column repaired (C3): unknown calls replaced, a missing call added, needless calls dropped,
    safety and rescue phrases added.

    Text is cut around the calls and put together again, each call looked at by itself. The steps are columns of their
    own, so that none is computed twice.
    """
    def kept(block: Column) -> Column:
        c = X.parse_call(F.regexp_extract(block, R.TOOL_CALL, 1))
        return F.when(c["valid"] & (c["name"].isin(*tools) if tools else F.lit(True)), block).otherwise(R.CALL_BLANK)

    need = F.coalesce(F.col("tool_required"), F.lit(False))
    out = rows.withColumn("__whole", F.regexp_extract_all(X.text_or_empty(F.col(column)), F.lit(R.TOOL_CALL), F.lit(0))).withColumn("__pieces", F.split(X.text_or_empty(F.col(column)), R.TOOL_CALL))
    checked = F.array_join(F.transform("__pieces", lambda p, i: F.concat(p, F.when(i < F.size("__whole"), kept(F.get(F.col("__whole"), i))).otherwise(""))), "")
    out = out.withColumn("__a", F.when(need, checked).otherwise(F.array_join("__pieces", "")))
    a = F.col("__a")
    call = F.concat(F.lit('<tool_call>{"name": "'), F.col("tool_name"), F.lit('", "arguments": {}}</tool_call>'))
    ask = F.when(X.contains_any(a, R.ASKS_ALREADY), "").otherwise(R.CALL_ASK)
    added = F.concat(F.regexp_replace(a, "。+$", ""), F.lit(R.CALL_LEAD), call, ask, F.lit(R.CALL_TAIL))
    out = out.withColumn("__b", F.when(need & F.col("tool_name").isNotNull() & ~a.rlike(R.TOOL_CALL), added).otherwise(a))
    b = F.col("__b")
    out = out.withColumn("__c", F.when((F.col("category_id") == 3) & ~X.contains_any(b, R.SAFETY_WORDS), F.concat(F.lit(R.STOP_REPAIR), b)).otherwise(b))
    c = F.col("__c")
    done = F.when((F.col("category_id") == 6) & ~X.contains_any(c, R.RESCUE_WORDS), F.concat(c, F.lit(R.RESCUE_REPAIR))).otherwise(c)
    return out.withColumn(column, done).drop("__whole", "__pieces", "__a", "__b", "__c")


def first_passing(attempts: DataFrame, tools: list[str] | None = None, key: str = "seed_id") -> DataFrame:
    """Of each key's attempts (key, attempt from 0, answer, seed columns) the first without violations, else the last repaired.

    status: pass, retryN, or fallback (C4 over given attempts).
    """
    found = attempts.withColumn("violations", violations(F.col("answer"), tools))
    ok = F.size("violations") == 0
    best = found.groupBy(key).agg(F.coalesce(F.min_by("attempt", F.when(ok, F.col("attempt"))), F.max("attempt")).alias("__n"))
    out = found.join(best.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & (F.col("attempt") == F.col("__n"))).drop("__k", "__n")
    status = F.when(~ok, "fallback").when(F.col("attempt") == 0, "pass").otherwise(F.concat(F.lit("retry"), F.col("attempt").cast("string")))
    out = repair(out.withColumn("__ok", ok).withColumn("status", status).withColumn("__fixed", F.col("answer")), "__fixed", tools)
    return out.withColumn("answer", F.when(F.col("__ok"), F.col("answer")).otherwise(F.col("__fixed"))).drop("__ok", "__fixed")


def generate(inputs: DataFrame, model: Callable[[pd.DataFrame], pd.Series], name: str = "answer") -> DataFrame:
    """inputs with a column of the model's answers: the only place where a model is called, batch by batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: model(pdf)})

    return inputs.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in inputs.dtypes) + f", `{name}` string")
