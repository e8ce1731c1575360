"""Queries over scored answers: coverage, scores, aggregates, constraint gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.operators import arena, constrain, metrics
from dialmill.operators import score as S
from dialmill.plans import derive as D

CATALOG: dict = {}


def query(sql: str | None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


_P = D.PHRASE_SQL
COVER_SQL = D.ANSWERS_SQL + f""",
p AS (SELECT doc_id, lang, answer AS a, {_P.format('required_facts')} AS fp FROM answers),
k AS (SELECT lang, len(fp)::INT AS n, len(list_filter(fp, lambda p: {D.covered_sql('p', 'a', 0.45)}))::INT AS ok FROM p)
"""


@query(f"WITH {COVER_SQL} SELECT lang, count(*) AS n, sum(ok)::BIGINT AS ok, count(*) FILTER (ok = n) AS level_2, count(*) FILTER (ok < n AND ok >= 1) AS level_1, count(*) FILTER (ok = 0) AS level_0 FROM k GROUP BY lang")
def coverage_level(spark, sf_dir):
    rows = D.answers(spark, sf_dir).select("lang", F.size("required_facts_p").alias("n"), X.cover_count(F.col("required_facts_p"), F.col("answer"), R.DEFAULT.fact_ratio).alias("ok"))
    level = X.cover_level(F.col("ok"), F.col("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"), *[F.count_if(level == i).alias(f"level_{i}") for i in (2, 1, 0)])


@query(f"WITH {D.SCORED_SQL} SELECT doc_id, round(topic, 6) AS topic FROM scored")
def topic_ratio(spark, sf_dir):
    rows = D.answers(spark, sf_dir)
    return rows.select("doc_id", F.round(X.topic_share(F.col("scenario_p"), X.strip(F.col("answer"))), 6).alias("topic"))


SCORE_COLUMNS = ["doc_id", "seed_id", *S.DIMS, "total", "ok_facts", "ok_questions", "ok_actions", "half_answer", "safety_missing", "rescue_missing", "call_missing", "bad_call", "needless_call"]


@query(f"WITH {D.SCORED_SQL} SELECT {', '.join(SCORE_COLUMNS)} FROM scored")
def rule_score(spark, sf_dir):
    return D.scored(spark, sf_dir).select(*SCORE_COLUMNS)


_RATES = ", ".join(f"round(100.0 * sum({d}) / (2 * count(*)), 1) AS rate_{d}" for d in S.DIMS)


@query(f"WITH {D.SCORED_SQL} SELECT category_id, count(*) AS n, round(avg(total), 6) AS mean_total, {_RATES} FROM scored GROUP BY category_id")
def rule_score_by_category(spark, sf_dir):
    return metrics.scores_by_category(D.scored(spark, sf_dir)).withColumn("mean_total", F.round("mean_total", 6))


@query(f"WITH {D.SCORED_SQL} SELECT doc_id, seed_id, total, coalesce(broken[1].s, '') AS violated FROM scored WHERE bad")
def bad_cases(spark, sf_dir):
    return D.scored(spark, sf_dir).filter(S.is_bad()).select("doc_id", "seed_id", "total", "violated")


_FLAGS = ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in metrics.FLAGS)
_UNPIVOT = f"UNPIVOT (SELECT {{0}}{_FLAGS} FROM scored {{1}}) ON {', '.join(metrics.FLAGS)} INTO NAME flag VALUE n"


@query(f"WITH {D.SCORED_SQL}, u AS ({_UNPIVOT.format('', '')}) SELECT flag, n FROM u WHERE n > 0 ORDER BY n DESC, list_position([{', '.join(repr(f) for f in metrics.FLAGS)}], flag) LIMIT 3")
def top_defects(spark, sf_dir):
    return metrics.top_defects(D.narrow(spark, sf_dir))


@query(f"WITH {D.SCORED_SQL}, l AS (SELECT doc_id % 2 = 0 AS even, * FROM scored), u AS (SELECT even, {_FLAGS} FROM l GROUP BY even) SELECT even, flag, n FROM (UNPIVOT u ON {', '.join(metrics.FLAGS)} INTO NAME flag VALUE n)")
def defect_compare(spark, sf_dir):
    return metrics.defect_counts(D.narrow(spark, sf_dir).withColumn("even", F.col("doc_id") % 2 == 0), "even")


_MEANS = ", ".join(f"round(avg({d}), 6) AS mean_{d}" for d in S.DIMS)


@query(f"WITH {D.SCORED_SQL} SELECT lang, count(*) AS n, round(avg(total), 6) AS mean_total, {_MEANS}, count(*) FILTER (bad) AS n_bad FROM scored GROUP BY lang")
def model_summary(spark, sf_dir):
    out = metrics.model_summary(D.narrow(spark, sf_dir), "lang")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("mean_")})


@query(f"WITH {D.SCORED_SQL}, r AS (SELECT doc_id, category_id, total, row_number() OVER (PARTITION BY category_id ORDER BY total, doc_id) AS place, count(*) OVER (PARTITION BY category_id) AS k FROM scored WHERE bad) SELECT doc_id, category_id, total, place::INT AS place, greatest(k - 6, 0) AS more FROM r WHERE place <= 6")
def bad_cases_top6(spark, sf_dir):
    return metrics.worst_per_category(D.narrow(spark, sf_dir), key="doc_id").select("doc_id", "category_id", "total", "place", "more")


@query(f"WITH {D.SCORED_SQL} SELECT doc_id, len(claims)::INT AS n_claims, n_sentences FROM scored")
def number_claims_and_sentences(spark, sf_dir):
    rows = D.answers(spark, sf_dir).withColumn("a", X.strip(F.col("answer")))
    claims = F.filter(X.number_claims(F.col("a")), lambda n: ~F.contains(F.col("source_text"), X.strip(n)))
    return rows.select("doc_id", F.size(claims).alias("n_claims"), F.size(X.sentences(F.col("a"))).alias("n_sentences"))


@query(f"WITH {D.SCORED_SQL} SELECT doc_id, len(calls)::INT AS n_calls, valid, call_name, len(invented)::INT AS n_invented FROM scored")
def tool_call_parse(spark, sf_dir):
    rows = D.answers(spark, sf_dir, prepared=False).withColumn("calls", X.tool_calls(F.col("answer"))).withColumn("call", X.parse_call(F.get(F.col("calls"), F.lit(0))))
    known = F.concat("scenario", "user_goal")
    return rows.select("doc_id", F.size("calls").alias("n_calls"), F.coalesce("call.valid", F.lit(False)).alias("valid"), F.when(F.col("call.valid"), F.col("call.name")).otherwise("").alias("call_name"), F.when(F.col("call.valid"), F.size(X.unsourced(F.col("call.args"), known))).otherwise(0).alias("n_invented"))


@query(f"""WITH {D.ANSWERS_SQL}, r(tool_name, required) AS (VALUES {', '.join(f"('{t}', {['topic', 'when', 'store_id'][: i % 3 + 1]})" for i, t in enumerate(D.TOOLS))}),
c AS (SELECT doc_id, regexp_extract_all(answer, '{R.TOOL_CALL}', 1)[1] AS j FROM answers),
v AS (SELECT doc_id, json_extract_string(j, '$.name') AS name, CASE WHEN json_exists(j, '$.arguments') THEN json_keys(j, '$.arguments') ELSE [] END AS got FROM c WHERE j IS NOT NULL AND json_valid(j))
SELECT doc_id, name, array_to_string(list_filter(required, lambda x: NOT list_contains(got, x)), ',') AS missing FROM v JOIN r ON r.tool_name = v.name""")
def tool_call_missing_args(spark, sf_dir):
    c = D.answers(spark, sf_dir, prepared=False).select("doc_id", X.parse_call(F.get(X.tool_calls(F.col("answer")), F.lit(0))).alias("c")).filter("c.valid")
    t = D.tools(spark)  # a registry of as many rows as there are tools
    return c.join(F.broadcast(t), F.col("c.name") == t["tool_name"]).select("doc_id", F.col("c.name").alias("name"), F.array_join(F.array_except("required", F.map_keys("c.own")), ",").alias("missing"))


def _hits(words) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(answer, w))"


@query(f"WITH {D.ANSWERS_SQL} SELECT doc_id, len({_hits(R.SAFETY_WORDS)})::INT AS safety, len({_hits(R.RESCUE_WORDS)})::INT AS rescue, array_to_string({_hits(R.FABRICATION_PHRASES)}, ',') AS claims, regexp_matches(answer, '{R.RESULT_CLAIM}') AS result_claim FROM answers")
def keyword_flags(spark, sf_dir):
    a = F.col("answer")
    return D.answers(spark, sf_dir, prepared=False).select("doc_id", F.size(X.hits(a, R.SAFETY_WORDS)).alias("safety"), F.size(X.hits(a, R.RESCUE_WORDS)).alias("rescue"), F.array_join(X.hits(a, R.FABRICATION_PHRASES), ",").alias("claims"), a.rlike(R.RESULT_CLAIM).alias("result_claim"))


def any_sql(a: str, words) -> str:
    return "(" + " OR ".join(f"contains({a}, '{w}')" for w in words) + ")"


_TOOLS = ", ".join(f"'{t}'" for t in D.TOOLS)
GATE_SQL = D.ANSWERS_SQL + f""",
q AS (SELECT *, regexp_extract_all(answer, '{R.TOOL_CALL}', 1) AS calls FROM answers),
g AS (SELECT *, CASE WHEN tool_required AND len(calls) = 0 THEN ['call_missing'] ELSE [] END
 || CASE WHEN tool_required THEN flatten(list_transform(calls, lambda j: CASE WHEN NOT json_valid(j) THEN ['bad_json'] ELSE
      CASE WHEN coalesce(json_extract_string(j, '$.name'), '') NOT IN ({_TOOLS}) THEN ['unknown_tool'] ELSE [] END
      || list_transform(list_filter({D.ARGS_SQL.format("(CASE WHEN json_valid(j) THEN j ELSE '{}' END)")}, lambda v: v <> '' AND NOT contains(scenario || user_goal, v) AND NOT regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}')), lambda v: 'unsourced_argument') END))
    WHEN len(calls) > 0 THEN ['call_needless'] ELSE [] END
 || CASE WHEN category_id = 3 AND NOT {any_sql('answer', R.SAFETY_WORDS)} THEN ['safety_missing'] ELSE [] END
 || CASE WHEN category_id = 6 AND NOT {any_sql('answer', R.RESCUE_WORDS)} THEN ['rescue_missing'] ELSE [] END
 || CASE WHEN length(answer) < 80 AND NOT contains(answer, '①') AND NOT contains(answer, '<tool_call>') THEN ['half_answer'] ELSE [] END AS found FROM q)
"""


@query(f"WITH {GATE_SQL} SELECT doc_id, array_to_string(found, ',') AS violations FROM g")
def constraint_violations(spark, sf_dir):
    return D.answers(spark, sf_dir, prepared=False).select("doc_id", F.array_join(constrain.violations(F.col("answer"), D.TOOLS), ",").alias("violations"))


#: Every call is looked at by itself: the text between calls and the calls, kept or replaced, are put together again.
REPAIR_SQL = GATE_SQL + f""",
r0 AS (SELECT *, regexp_split_to_array(answer, '{R.TOOL_CALL}') AS pieces, list_transform(list_zip(regexp_extract_all(answer, '{R.TOOL_CALL}', 0), calls), lambda z:
  CASE WHEN NOT json_valid(z[2]) OR coalesce(json_extract_string(CASE WHEN json_valid(z[2]) THEN z[2] ELSE '{{}}' END, '$.name'), '') NOT IN ({_TOOLS}) THEN '{R.CALL_BLANK}' ELSE z[1] END) AS kept FROM g),
r1 AS (SELECT *, CASE WHEN NOT tool_required THEN array_to_string(pieces, '') ELSE array_to_string(list_transform(pieces, lambda x, i: x || coalesce(kept[i], '')), '') END AS a1 FROM r0),
r2 AS (SELECT *, CASE WHEN tool_required AND tool_name IS NOT NULL AND NOT regexp_matches(a1, '{R.TOOL_CALL}') THEN regexp_replace(a1, '。+$', '') || '{R.CALL_LEAD}' || '<tool_call>{{"name": "' || tool_name || '", "arguments": {{}}}}</tool_call>'
  || CASE WHEN {any_sql('a1', R.ASKS_ALREADY)} THEN '' ELSE '{R.CALL_ASK}' END || '{R.CALL_TAIL}' ELSE a1 END AS a2 FROM r1),
r3 AS (SELECT *, CASE WHEN category_id = 3 AND NOT {any_sql('a2', R.SAFETY_WORDS)} THEN '{R.STOP_REPAIR.strip()}' || chr(10) || a2 ELSE a2 END AS a3 FROM r2)
"""


@query(f"WITH {REPAIR_SQL} SELECT doc_id, CASE WHEN category_id = 6 AND NOT {any_sql('a3', R.RESCUE_WORDS)} THEN a3 || chr(10) || '{R.RESCUE_REPAIR.strip()}' ELSE a3 END AS repaired FROM r3")
def constraint_repair(spark, sf_dir):
    return constrain.repair(D.answers(spark, sf_dir, prepared=False), "answer", D.TOOLS).select("doc_id", F.col("answer").alias("repaired"))


@query(f"""WITH {GATE_SQL}, k AS (SELECT doc_id // 3 AS batch, doc_id % 3 AS attempt, len(found) = 0 AS ok FROM g),
b AS (SELECT batch, min(attempt) FILTER (ok) AS first FROM k GROUP BY batch)
SELECT CASE WHEN first IS NULL THEN 'fallback' WHEN first = 0 THEN 'pass' ELSE 'retry' || first END AS status, count(*) AS n FROM b GROUP BY 1""")
def status_counts(spark, sf_dir):
    tries = D.answers(spark, sf_dir, prepared=False).withColumn("batch", F.floor(F.col("doc_id") / 3)).withColumn("attempt", F.col("doc_id") % 3)
    return constrain.first_passing(tries, D.TOOLS, key="batch").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GATE_SQL} SELECT doc_id, array_to_string(list_transform(found, lambda v: '- ' || CASE v {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in constrain.GUIDE.items())} ELSE v END || CASE WHEN v IN ('unknown_tool', 'call_missing') AND tool_name IS NOT NULL THEN ': ' || tool_name ELSE '' END), chr(10)) AS guide FROM g WHERE len(found) > 0""")
def retry_guide(spark, sf_dir):
    out = D.answers(spark, sf_dir, prepared=False).withColumn("found", constrain.violations(F.col("answer"), D.TOOLS)).filter(F.size("found") > 0)
    return out.select("doc_id", constrain.retry_guide(F.col("found"), F.col("tool_name")).alias("guide"))


_ELO = "round(least(800.0, greatest(-800.0, CASE WHEN w + t / 2.0 <= 0 THEN -800.0 WHEN n - w - t / 2.0 <= 0 THEN 800.0 ELSE 400 * log10((w + t / 2.0) / (n - w - t / 2.0)) END)), 1)"
_OUTCOME = f"n, w AS wins, t AS ties, n - w - t AS losses, round(100.0 * w / n, 1) AS win_rate, CASE WHEN n > t THEN round(100.0 * w / (n - t), 1) END AS decided_rate, {_ELO} AS elo"
_COUNT = "count(*) AS n, count(*) FILTER (verdict = 'candidate') AS w, count(*) FILTER (verdict = 'tie') AS t FROM matches"


@query(f"WITH {D.MATCHES_SQL} SELECT doc_id, verdict, method FROM matches")
def arena_consensus(spark, sf_dir):
    return D.matches(spark, sf_dir).select("doc_id", "verdict", "method")


@query(f"WITH {D.MATCHES_SQL}, k AS (SELECT {_COUNT}) SELECT {_OUTCOME} FROM k")
def arena_winrate_elo(spark, sf_dir):
    return arena.rates(D.matches(spark, sf_dir))


@query(f"WITH {D.MATCHES_SQL}, k AS (SELECT category_id, {_COUNT} GROUP BY category_id) SELECT category_id, {_OUTCOME} FROM k")
def arena_by_category(spark, sf_dir):
    return arena.rates(D.matches(spark, sf_dir), "category_id")


@query(f"WITH {D.MATCHES_SQL}, k AS (SELECT lang, {_COUNT} GROUP BY ROLLUP (lang)) SELECT lang, {_OUTCOME} FROM k")
def grouping_sets_overview(spark, sf_dir):
    return arena.overview(D.matches(spark, sf_dir), "lang")


@query(f"WITH {D.MATCHES_SQL}, firsts AS (SELECT doc_id, gap, row_number() OVER (ORDER BY gap DESC, cl DESC, doc_id) AS place FROM matches WHERE verdict = 'candidate') SELECT doc_id, gap, place::INT AS place FROM firsts WHERE place <= 8 AND (gap >= 2 OR place <= 5)")
def good_cases_topk(spark, sf_dir):
    return metrics.good_cases(D.matches(spark, sf_dir).withColumnRenamed("candidate", "len"), key="doc_id").select("doc_id", "gap", "place")


_SIDES = D.SCORED_SQL + ", both2 AS (SELECT " + ", ".join(f"c.{d} AS c_{d}, r.{d} AS b_{d}" for d in [*S.DIMS, "total", "bad"]) + " FROM scored c JOIN scored r ON r.doc_id = c.doc_id + 1 WHERE c.doc_id % 2 = 0)"


def both_models(spark, sf_dir):
    n = D.narrow(spark, sf_dir)
    c = n.filter("doc_id % 2 = 0").select("doc_id", *[F.col(d).alias(f"c_{d}") for d in [*S.DIMS, "total", "bad"]])
    return c.join(n.select((F.col("doc_id") - 1).alias("doc_id"), *[F.col(d).alias(f"b_{d}") for d in [*S.DIMS, "total", "bad"]]), "doc_id")


@query(f"WITH {_SIDES}, d AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, avg(c_{d}) AS c, avg(b_{d}) AS b FROM both2" for d in S.DIMS) + ") SELECT dimension, round(c, 6) AS candidate, round(b, 6) AS baseline, round(c - b, 6) AS delta, CASE WHEN c - b > 0.05 THEN 'improved' WHEN c - b < -0.05 THEN 'degraded' ELSE 'flat' END AS change FROM d")
def dim_compare(spark, sf_dir):
    out = arena.compare_dimensions(both_models(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("candidate", "baseline", "delta")})


@query(f"WITH {_SIDES}, o AS (SELECT avg(c_total) AS mc, avg(b_total) AS mb, count(*) FILTER (c_bad) AS bc, count(*) FILTER (b_bad) AS bb FROM both2) SELECT round(mc, 6) AS mean_candidate, round(mb, 6) AS mean_baseline, bc AS bad_candidate, bb AS bad_baseline, CASE WHEN mc >= mb AND bc <= bb THEN 'accept' WHEN mc >= mb THEN 'mean only' WHEN bc <= bb THEN 'bad cases only' ELSE 'reject' END AS verdict FROM o")
def final_verdict(spark, sf_dir):
    out = arena.final_verdict(both_models(spark, sf_dir))
    return out.withColumn("mean_candidate", F.round("mean_candidate", 6)).withColumn("mean_baseline", F.round("mean_baseline", 6))


@query(f"WITH {_SIDES} SELECT count(*) FILTER (c_total - b_total >= 2) AS up, count(*) FILTER (c_total - b_total <= -2) AS down, count(*) FILTER (abs(c_total - b_total) < 2) AS same FROM both2")
def score_moves(spark, sf_dir):
    return metrics.moves(both_models(spark, sf_dir))


@query(f"WITH {D.SCORED_SQL} SELECT lang, dimension, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT lang, '{d}' AS dimension, avg({d}) / 2 AS value FROM scored GROUP BY lang" for d in S.DIMS) + ")")
def radar_means(spark, sf_dir):
    return metrics.radar(D.narrow(spark, sf_dir), "lang").withColumn("value", F.round("value", 6))


@query(f"""WITH {D.SCORED_SQL}, agg AS (SELECT count(*) AS n, count(*) FILTER (half_answer) AS n_half, count(*) FILTER (call_missing) AS n_call_missing, count(*) FILTER (bad_call) AS n_bad_call, count(*) FILTER (safety_missing) AS n_safety, avg(total) AS mean_total FROM scored),
fired AS ({' UNION ALL '.join(f"SELECT {i} AS k, '{t}' AS topic, '{a}' AS advice FROM agg WHERE {test}" for i, (t, test, a) in enumerate(metrics.ADVICE))})
SELECT (row_number() OVER (ORDER BY k))::INT AS rank, topic, advice FROM fired UNION ALL SELECT 1, 'none', 'keep the current mix' WHERE NOT EXISTS (SELECT 1 FROM fired)""")
def suggestion_rules(spark, sf_dir):
    return metrics.suggestions(D.narrow(spark, sf_dir))


@query(f"WITH {D.SCORED_SQL}, want(defect, need) AS (VALUES ('safety', 40), ('tool', 200), ('fabrication', 10), ('completeness', 5), ('other', 1)), have AS (SELECT defect, count(*) AS n FROM scored GROUP BY defect) SELECT defect, coalesce(n, 0) AS n, need, coalesce(n, 0) < need AS short FROM want LEFT JOIN have USING (defect)")
def quota_warnings(spark, sf_dir):
    return metrics.quota_warnings(D.narrow(spark, sf_dir), "defect", {"safety": 40, "tool": 200, "fabrication": 10, "completeness": 5, "other": 1})
