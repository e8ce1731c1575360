"""Seeds, answers and calls derived from the driver's tables, by the same formulas in Spark and in SQL.

The tables hold no seeds and no calls, so rules come from pieces of benchmark items, answers are whole documents, and
defects (short answers, calls, claims, phrases) are put in by the remainder of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.operators import score as S
from dialmill.runtime import fits_broadcast, placed, stash, table

TOOLS = [f"tool_{i}" for i in range(5)]
PARAMS = ["vehicle_id", "issue_summary", "store_id", "description", "colour"]


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = placed(table(spark, sf_dir, "benchmark"), [], [F.asc_nulls_last("item_id")]).withColumn("w", F.split(F.coalesce("text", F.lit("")), " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    i = F.col("item_id")
    cat = (i % 8 + 1).cast("int")
    need = (i % 3 == 0) & (cat != 3)
    return b.select(
        F.col("__place").alias("idx"), i.alias("item_id"), F.concat(F.lit("s"), i.cast("string")).alias("seed_id"),
        F.when(i % 10 == 0, "final_test").when(i % 10 == 1, "validation").otherwise("train").alias("split"), cat.alias("category_id"), F.concat(F.lit("cat"), cat.cast("string")).alias("category"),
        F.concat(F.lit("sub"), (i % 3).cast("string")).alias("subcategory"), part(1, 12).alias("scenario"), part(3, 6).alias("user_goal"), F.when(i % 4 == 0, R.PROXY_ROLES[0]).otherwise("owner").alias("customer_role"),
        F.array(part(1, 8), part(9, 8)).alias("required_facts"), F.slice(F.array(part(2, 4), part(6, 4), part(10, 4)), F.lit(1), (i % 4).cast("int")).alias("required_questions"),
        F.array(part(11, 5)).alias("required_actions"), F.array(F.concat(F.lit("不得"), part(7, 5))).alias("prohibited_actions"),
        need.alias("tool_required"), F.when(need, F.concat(F.lit("tool_"), (i % 5).cast("string"))).alias("tool_name"),
    )


SEEDS_SQL = """
bw AS (SELECT item_id AS i, string_split(coalesce(text, ''), ' ') AS w FROM benchmark),
seeds AS (SELECT row_number() OVER (ORDER BY i) - 1 AS idx, i AS item_id, 's' || i AS seed_id,
  CASE i % 10 WHEN 0 THEN 'final_test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
  (i % 8 + 1)::INT AS category_id, 'cat' || (i % 8 + 1) AS category, 'sub' || (i % 3) AS subcategory,
  array_to_string(w[1:12], ' ') AS scenario, array_to_string(w[3:8], ' ') AS user_goal,
  CASE WHEN i % 4 = 0 THEN '家属或代办人' ELSE 'owner' END AS customer_role,
  [array_to_string(w[1:8], ' '), array_to_string(w[9:16], ' ')] AS required_facts,
  [array_to_string(w[2:5], ' '), array_to_string(w[6:9], ' '), array_to_string(w[10:13], ' ')][1:i % 4] AS required_questions,
  [array_to_string(w[11:15], ' ')] AS required_actions, ['不得' || array_to_string(w[7:11], ' ')] AS prohibited_actions,
  (i % 3 = 0 AND i % 8 + 1 <> 3) AS tool_required,
  CASE WHEN i % 3 = 0 AND i % 8 + 1 <> 3 THEN 'tool_' || (i % 5) END AS tool_name FROM bw)
"""


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, ["topic", "when", "store_id"][: i % 3 + 1], PARAMS[i:] + PARAMS[: min(i, 2)]) for i, t in enumerate(TOOLS)], "tool_name string, required array<string>, properties array<string>")


_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
TOOLS_SQL = "tools(tool_name, required, properties) AS (VALUES " + ", ".join(f"('{t}', {_LIST(['topic', 'when', 'store_id'][: i % 3 + 1])}, {_LIST(PARAMS[i:] + PARAMS[: min(i, 2)])})" for i, t in enumerate(TOOLS)) + ")"


#: A second call, to an unknown tool and with ``parameters``, behind every twelfth answer.
SECOND_CALL = '<tool_call>{"name": "tool_9", "parameters": {"topic": "yy"}}</tool_call>'


def call(doc_id: Column, first_word: Column) -> Column:
    value = F.when(doc_id % 3 == 0, first_word).otherwise(F.concat(F.lit("zz"), doc_id.cast("string")))
    lead = F.when(doc_id % 14 == 0, '", "arguments": {}, "parameters": {"topic": "').otherwise('", "arguments": {"topic": "')
    good = F.concat(F.lit('<tool_call>{"name": "tool_'), (doc_id % 7).cast("string"), lead, value, F.lit('", "when": "2026-01-0'), (doc_id % 9 + 1).cast("string"), F.lit('"}}</tool_call>'))
    return F.when(doc_id % 2 == 1, "").when(doc_id % 13 == 0, '<tool_call>{"name": oops}</tool_call>').otherwise(good)


def attach_seeds(spark: SparkSession, sf_dir: str, docs: DataFrame, prepared: bool = True, s: DataFrame | None = None) -> DataFrame:
    """docs (doc_id and more) with a seed's columns each, by the remainder of doc_id; as in the SQL, a negative remainder has no seed.

    Coverage phrases are computed once per seed. The seed table is broadcast when its size was checked; otherwise both
    sides are shuffled by the seed's number.
    """
    s = seeds(spark, sf_dir) if s is None else s
    s = stash(S.prepared(s) if prepared else s, "seeds")
    n = max(1, s.count())
    side = F.broadcast(s) if fits_broadcast(s.select("seed_id", "scenario", "user_goal", F.to_json("required_facts").alias("a"))) and n <= 2000 else s
    return docs.withColumn("__i", F.col("doc_id") % n).join(side, F.col("__i") == F.col("idx")).drop("__i")


def answers(spark: SparkSession, sf_dir: str, prepared: bool = True, s: DataFrame | None = None) -> DataFrame:
    """Every document as the answer to a seed (of s, where given), with injected defects."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter("doc_id IS NOT NULL")
    out = attach_seeds(spark, sf_dir, d, prepared, s)
    i = F.col("doc_id")
    extra = lambda test, c: F.when(test, F.concat(F.lit(" "), c)).otherwise("")
    lists = F.concat_ws(" ", F.array_join("required_facts", " "), F.array_join("required_questions", " "), F.array_join("required_actions", " "))
    full = F.concat(
        F.coalesce("text", F.lit("")), extra(i % 5 == 0, lists), extra(i % 11 == 0, F.get(F.col("prohibited_actions"), F.lit(0))), call(i, F.get(F.split("scenario", " "), F.lit(0))),
        extra(i % 6 == 0, F.lit("30天")), extra(i % 7 == 0, F.lit(R.SAFETY_WORDS[0])), extra(i % 4 == 0, F.lit(R.RESCUE_WORDS[1])), extra(i % 9 == 0, F.lit("查询到")), extra(i % 8 == 0, F.lit(R.FABRICATION_PHRASES[1])),
        extra(i % 12 == 0, F.lit(SECOND_CALL)),
    )
    return out.withColumn("answer", F.when(i % 10 == 3, "ok").otherwise(full)).drop("text")


ANSWERS_SQL = SEEDS_SQL + """,
answers AS (SELECT d.doc_id, d.lang, s.*, CASE WHEN doc_id % 10 = 3 THEN 'ok' ELSE coalesce(d.text, '')
  || CASE WHEN doc_id % 5 = 0 THEN ' ' || array_to_string(required_facts, ' ') || ' ' || array_to_string(required_questions, ' ') || ' ' || array_to_string(required_actions, ' ') ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN ' ' || prohibited_actions[1] ELSE '' END
  || CASE WHEN doc_id % 2 = 1 THEN '' WHEN doc_id % 13 = 0 THEN '<tool_call>{"name": oops}</tool_call>' ELSE
     '<tool_call>{"name": "tool_' || (doc_id % 7) || CASE WHEN doc_id % 14 = 0 THEN '", "arguments": {}, "parameters": {"topic": "' ELSE '", "arguments": {"topic": "' END || CASE WHEN doc_id % 3 = 0 THEN string_split(scenario, ' ')[1] ELSE 'zz' || doc_id END
     || '", "when": "2026-01-0' || (doc_id % 9 + 1) || '"}}</tool_call>' END
  || CASE WHEN doc_id % 6 = 0 THEN ' 30天' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' 请勿继续行驶' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN ' 已为您安排' ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN ' 查询到' ELSE '' END || CASE WHEN doc_id % 8 = 0 THEN ' 查询结果显示' ELSE '' END
  || CASE WHEN doc_id % 12 = 0 THEN ' <tool_call>{"name": "tool_9", "parameters": {"topic": "yy"}}</tool_call>' ELSE '' END END AS answer
  FROM documents d JOIN seeds s ON d.doc_id % greatest(1, (SELECT count(*) FROM benchmark)) = s.idx)
"""

PUNCT = R.PUNCTUATION
_T = f"regexp_replace(s, '{PUNCT}', '', 'g')"
PHRASE_SQL = f"""list_transform({{0}}, lambda s: {{{{'s': s,
  'pairs': CASE WHEN length({_T}) = 1 THEN [{_T}] WHEN length({_T}) >= 2 THEN list_distinct(list_transform(range(1, length({_T})), lambda k: substr({_T}, k, 2))) ELSE [] END,
  'windows': CASE WHEN length({_T}) >= 8 THEN list_distinct(list_transform(range(1, length({_T}) - 6), lambda k: substr({_T}, k, 8))) ELSE [] END}}}})"""


def covered_sql(p: str, a: str, ratio: float) -> str:
    return f"(contains({a}, {p}.s) OR len(list_filter({p}.windows, lambda y: contains({a}, y))) > 0 OR len({p}.pairs) = 0 OR len(list_filter({p}.pairs, lambda y: contains({a}, y)))::DOUBLE / len({p}.pairs) >= {ratio})"


#: Empty arguments fall through to parameters.
ARGS_SQL = "CASE WHEN len(coalesce(json_keys({0}, '$.arguments'), [])) > 0 THEN json_extract_string({0}, '$.arguments.*') ELSE json_extract_string({0}, '$.parameters.*') END"
_LEVEL = "CASE WHEN {0} = {1} THEN 2 WHEN {0} >= greatest(1, ({1} + 1) // 2) THEN 1 ELSE 0 END"
_ANY = lambda words: "(" + " OR ".join(f"contains(a, '{w}')" for w in words) + ")"

SCORE_SQL = f""",
prep AS (SELECT *, regexp_replace(regexp_replace(answer, '^\\s+', ''), '\\s+$', '') AS a, {PHRASE_SQL.format('required_facts')} AS fp, {PHRASE_SQL.format('required_questions')} AS qp,
  {PHRASE_SQL.format('required_actions')} AS ap, {PHRASE_SQL.format('prohibited_actions')} AS pp, {PHRASE_SQL.format('[scenario]')}[1].pairs AS sp,
  array_to_string(required_facts, '') || array_to_string(required_actions, '') || array_to_string(required_questions, '') AS source_text FROM answers),
m AS (SELECT *, regexp_extract_all(a, '{R.TOOL_CALL}', 1) AS calls,
  CASE WHEN len(sp) > 0 THEN len(list_filter(sp, lambda g: contains(a, g)))::DOUBLE / len(sp) ELSE 0.0 END AS topic,
  len(list_filter(fp, lambda p: {covered_sql('p', 'a', 0.45)}))::INT AS ok_facts, len(list_filter(qp, lambda p: {covered_sql('p', 'a', 0.45)}))::INT AS ok_questions,
  len(list_filter(ap, lambda p: {covered_sql('p', 'a', 0.45)}))::INT AS ok_actions, list_filter(pp, lambda p: {covered_sql('p', 'a', 0.5)}) AS broken,
  list_filter(regexp_extract_all(a, '{R.NUMBER_CLAIM}'), lambda n: NOT contains(source_text, trim(n))) AS claims FROM prep),
c AS (SELECT *, len(calls) > 0 AS has_call, coalesce(len(calls) > 0 AND json_valid(calls[1]), false) AS valid,
  CASE WHEN len(calls) > 0 AND json_valid(calls[1]) THEN coalesce(json_extract_string(calls[1], '$.name'), '') ELSE '' END AS call_name,
  CASE WHEN len(calls) > 0 AND json_valid(calls[1]) THEN list_filter({ARGS_SQL.format('calls[1]')}, lambda v: v <> '' AND NOT contains(scenario || user_goal, v) AND NOT regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) ELSE [] END AS invented,
  regexp_matches(a, '{R.RESULT_CLAIM}') AS claimed, (length(a) < 80 AND NOT contains(a, '①') AND NOT contains(a, '<tool_call>')) AS half_answer,
  len(list_filter(regexp_split_to_array(a, '{R.SENTENCE_END}'), lambda s: regexp_matches(s, '\\S')))::INT AS n_sentences FROM m),
f AS (SELECT *, (tool_required AND has_call AND (NOT valid OR call_name NOT IN ({', '.join(f"'{t}'" for t in TOOLS)}) OR len(invented) > 0)) AS bad_call, (NOT tool_required AND has_call) AS needless_call FROM c),
s7 AS (SELECT *, CASE WHEN a <> '' AND topic >= 0.12 THEN 2 WHEN a <> '' THEN 1 ELSE 0 END AS understanding,
  {_LEVEL.format('ok_facts', 'len(fp)')} AS facts, {_LEVEL.format('ok_questions', 'len(qp)')} AS questions, {_LEVEL.format('ok_actions', 'len(ap)')} AS actions,
  CASE WHEN len(broken) > 0 THEN 0 ELSE 2 END AS prohibited, CASE WHEN half_answer THEN 0 WHEN length(a) >= 100 AND n_sentences >= 2 THEN 2 ELSE 1 END AS completeness,
  CASE WHEN bad_call OR needless_call OR (claimed AND NOT has_call) THEN 0 WHEN len(claims) > 0 OR (tool_required AND NOT has_call) THEN 1 ELSE 2 END AS fabrication,
  CASE WHEN category_id = 3 THEN NOT {_ANY(R.SAFETY_WORDS)} END AS safety_missing, CASE WHEN category_id = 6 THEN NOT {_ANY(R.RESCUE_WORDS)} END AS rescue_missing,
  CASE WHEN tool_required THEN NOT has_call END AS call_missing FROM f),
scored AS MATERIALIZED (SELECT *, understanding + facts + questions + actions + prohibited + completeness + fabrication AS total, length(a) AS len,
  (understanding + facts + questions + actions + prohibited + completeness + fabrication <= 10 OR least(facts, questions, actions, prohibited, completeness, fabrication) = 0) AS bad,
  CASE WHEN category_id IN (3, 6) AND (coalesce(safety_missing, false) OR coalesce(rescue_missing, false)) THEN 'safety' WHEN bad_call THEN 'fabrication'
       WHEN coalesce(call_missing, false) OR needless_call THEN 'tool' WHEN half_answer OR completeness <= 1 THEN 'completeness' END AS defect FROM s7)
"""
SCORED_SQL = ANSWERS_SQL + SCORE_SQL


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with its scores and flags; the answer text stays."""
    return S.score(answers(spark, sf_dir), TOOLS)


PAIRS_SQL = SCORED_SQL + """,
pairs AS (SELECT c.doc_id, c.seed_id, c.category_id, c.lang, coalesce(r.defect, 'none') AS defect, c.total AS score_chosen, r.total AS score_rejected, c.len AS len_chosen, r.len AS len_rejected
  FROM scored c JOIN scored r ON r.doc_id = c.doc_id + 1 WHERE c.doc_id % 2 = 0)
"""


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, flags, defect and length of every answer, written once: later steps join it without its text."""
    from dialmill.operators.pairs import defect_type

    s = scored(spark, sf_dir)
    flags = ["half_answer", "safety_missing", "rescue_missing", "call_missing", "bad_call", "needless_call"]
    return stash(s.select("doc_id", "seed_id", "category_id", "lang", *S.DIMS, "total", *flags, defect_type().alias("defect"), F.length(F.regexp_replace("answer", r"(?U)^\s+|\s+$", "")).alias("len"), S.is_bad().alias("bad")), "scored")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of even documents as chosen, of the next document as rejected."""
    n = narrow(spark, sf_dir)
    r = n.select((F.col("doc_id") - 1).alias("doc_id"), F.coalesce("defect", F.lit("none")).alias("defect"), F.col("total").alias("score_rejected"), F.col("len").alias("len_rejected"))
    return n.filter("doc_id % 2 = 0").select("doc_id", "seed_id", "category_id", "lang", F.col("total").alias("score_chosen"), F.col("len").alias("len_chosen")).join(r, "doc_id")


MATCHES_SQL = SCORED_SQL + """,
sides AS (SELECT c.doc_id, c.category_id, c.lang, c.total AS ct, r.total AS rt, c.len AS cl, r.len AS rl, c.doc_id % 4 = 0 AS coin FROM scored c JOIN scored r ON r.doc_id = c.doc_id + 1 WHERE c.doc_id % 2 = 0),
said AS (SELECT *, CASE WHEN cl % 7 = 0 THEN NULL WHEN cl >= rl THEN 'candidate' ELSE 'baseline' END AS cand_first,
  CASE WHEN rl % 7 = 0 THEN NULL WHEN rl >= cl THEN 'baseline' ELSE 'candidate' END AS base_first FROM sides),
matches AS (SELECT doc_id, category_id, lang, ct AS total_candidate, rt AS total_baseline, ct - rt AS gap, cl,
  CASE WHEN cand_first IS NULL AND base_first IS NULL THEN CASE WHEN ct - rt >= 2 THEN 'candidate' WHEN ct - rt <= -2 THEN 'baseline' ELSE 'tie' END
       WHEN cand_first IS NULL THEN base_first WHEN base_first IS NULL THEN cand_first WHEN cand_first = base_first THEN cand_first ELSE 'tie' END AS verdict,
  CASE WHEN cand_first IS NULL AND base_first IS NULL THEN 'rule' WHEN cand_first IS NULL OR base_first IS NULL THEN 'single' ELSE 'both' END AS method FROM said)
"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents' answers against the next document's, judged by length; the stub gives no verdict on some lengths."""
    from dialmill.operators.arena import consensus

    n = narrow(spark, sf_dir)
    c = n.filter("doc_id % 2 = 0").select("doc_id", "category_id", "lang", F.col("total").alias("total_candidate"), F.col("len").alias("candidate"))
    r = n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("total").alias("total_baseline"), F.col("len").alias("baseline"))
    judge = lambda a, b: F.when(a % 7 == 0, F.lit(None)).when(a >= b, "A").otherwise("B")
    out = c.join(r, "doc_id").withColumn("coin", F.col("doc_id") % 4 == 0).withColumn("gap", F.col("total_candidate") - F.col("total_baseline"))
    return consensus(out, judge)
