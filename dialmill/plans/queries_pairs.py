"""Queries over preference pairs: candidates, filters, quotas, samples, statistics, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialmill.functions import phrases as T
from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.operators import metrics
from dialmill.operators import pairs as P
from dialmill.operators import validate as V
from dialmill.plans import derive as D
from dialmill.runtime import table
from dialmill.streaming import incremental

CATALOG: dict = {}


def query(sql: str | None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def numbered_sql(items: str) -> str:
    marks = "[" + ", ".join(f"'{c}'" for c in R.CIRCLED) + "]"
    return f"CASE WHEN len({items}) > 0 THEN array_to_string(list_transform({items}, lambda x, k: {marks}[k] || x), '；') || '。' ELSE '' END"


def listed_sql(lead: str, items: str, counted: str | None = None) -> str:
    count = "CASE len({0}) WHEN 2 THEN '两' {1} ELSE len({0})::VARCHAR END || '{2}' || ".format(items, " ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(R.NUMERALS) if i != 1), counted) if counted else ""
    return f"CASE WHEN len({items}) > 0 THEN {lead} || {count}{numbered_sql(items)} ELSE '' END"


def label_sql(name: str, names: dict, default: str) -> str:
    return f"coalesce(CASE {name} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END, {default})"


def by_category_sql(texts: tuple) -> str:
    three, six, rest = (f"replace('{t}', '{{sc}}', scenario)" for t in texts)
    return f"CASE category_id WHEN 3 THEN {three} WHEN 6 THEN {six} ELSE {rest} END"


def rotated_sql(options: tuple, variant: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][{variant} % {len(options)} + 1]"


def pick_sql(options: tuple, key: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][(('0x' || substr(md5({key}), 1, 7))::BIGINT % {len(options)} + 1)::INT]"


_CALL = "'<tool_call>' || chr(10) || '{\"name\": \"' || tool_name || '\", \"arguments\": {' || array_to_string({0}, ',') || '}}' || chr(10) || '</tool_call>'".replace("{0}", "%s")
_KNOWN = _CALL % """list_transform(free_args, lambda n: '"' || n || '":' || to_json(user_goal)::VARCHAR)"""
_FREE = f"n IN ({', '.join(f"'{x}'" for x in T.FREE_TEXT)}) AND user_goal <> ''"
_SAFE_TAIL = f"CASE WHEN category_id IN (3, 6) THEN '{T.TAIL_SAFE}' ELSE '{T.TAIL}' END"
_asked = lambda lead, default: listed_sql(f"'{lead}'", f"list_transform(asked, lambda n: {label_sql('n', T.LABELS, default)})")


def call_sql(lead: str, after: str, ask: str) -> str:
    return f"CASE WHEN calls_it THEN {lead} || {_KNOWN} || '{after}' || {ask} ELSE '' END"


def chosen_sql(v: str) -> str:
    call = call_sql(f"CASE WHEN category_id = 6 THEN '{T.CALL_RESCUE_1}' ELSE '{T.CALL_1}' END", T.CALL_AFTER_1, _asked(T.MISSING_1, "'「' || n || '」对应信息'"))
    return f"CASE WHEN {v} = 0 THEN {by_category_sql(T.OPEN_1[0])} ELSE {by_category_sql(T.OPEN_1[1])} END || {listed_sql(f"'{T.FACTS_1}'", 'required_facts', T.COUNTED_1)} || {call} || {listed_sql(f"'{T.QUESTIONS_1}'", 'required_questions', '点：')} || {listed_sql(f"'{T.ACTIONS_1}'", 'required_actions')} || '{T.CLOSE_1}' || {_SAFE_TAIL}"


def style_sql(v: str) -> str:
    call = call_sql(f"CASE WHEN category_id = 6 THEN '{T.CALL_RESCUE_2}' ELSE {rotated_sql(T.CALLS_2, v)} END", T.CALL_AFTER_2, _asked(T.MISSING_2, "n"))
    rest = f"{call} || {listed_sql(rotated_sql(T.QUESTIONS_2, v), 'required_questions', '点：')} || {listed_sql(rotated_sql(T.ACTIONS_2, v) + " || '：'", 'required_actions')}"
    safe = lambda t: f"CASE category_id WHEN 3 THEN '{t[0]}' WHEN 6 THEN '{t[1]}' ELSE '' END"
    opener = f"replace({pick_sql(T.OPEN_A, "seed_id || '|style'")}, '{{sc}}', scenario)"
    return (
        f"CASE {v} WHEN 0 THEN {opener} || {safe(T.SAFE_A)} || {listed_sql(f"'{T.FACTS_2[0]}'", 'required_facts')} || {rest} || '{T.CLOSE_2[0]}'"
        f" WHEN 1 THEN {by_category_sql(T.OPEN_B)} || {listed_sql(f"'{T.FACTS_2[1][0]}'", 'required_facts', T.FACTS_2[1][1])} || {rest} || {_SAFE_TAIL}"
        f" ELSE replace('{T.OPEN_C}', '{{sc}}', scenario) || {safe(T.SAFE_C)} || {listed_sql(f"'{T.FACTS_2[2]}'", 'required_facts')} || {rest} || '{T.CLOSE_2[1]}' END"
    )


def rejected_sql(defect: str, idx: str, second: bool = False) -> str:
    fake, unsafe, claim = (T.FAKE_2, T.UNSAFE_2, T.CLAIM_2) if second else (T.FAKE_1, T.UNSAFE_1, T.CLAIM_1)
    default = "'VID' || right('00000' || (('0x' || substr(md5(seed_id || '|vid'), 1, 12))::BIGINT)::VARCHAR, 5)" if second else f"'{T.INVENTED['feature_name']}' || ({idx} % 10)::VARCHAR"
    call = _CALL % f"""list_transform(props, lambda n: '"' || n || '":"' || {label_sql('n', T.INVENTED, default)} || '"')"""
    return f"""base || CASE WHEN {defect} = 'tool' THEN '{T.NOTED}' WHEN {defect} = 'fabrication' AND (tool_name IS NULL OR properties IS NULL) THEN '{claim}' WHEN {defect} = 'fabrication' THEN '{fake[0]}' || {call} || '{fake[1]}'
  WHEN {defect} = 'safety' AND category_id = 3 THEN '{unsafe[0]}' WHEN {defect} = 'safety' THEN '{unsafe[1]}' ELSE '' END"""


PARTS_SQL = D.SEEDS_SQL + f""",
{D.TOOLS_SQL},
p AS (SELECT s.*, properties, coalesce(properties, []) AS props, (tool_required AND tool_name IS NOT NULL AND properties IS NOT NULL) AS calls_it, list_filter(coalesce(properties, []), lambda n: {_FREE}) AS free_args, list_filter(coalesce(properties, []), lambda n: NOT ({_FREE})) AS asked,
  '{T.HALF}' || coalesce(nullif(left(regexp_split_to_array(coalesce(required_questions[1], ''), '以及|和|、|，')[1], 14), ''), '{T.HALF_DEFAULT}') || '。' AS base FROM seeds s LEFT JOIN tools USING (tool_name)),
v3(num) AS (VALUES (0), (1), (2)), v4(cls, ord) AS (VALUES ('safety', 1), ('tool', 2), ('fabrication', 3), ('completeness', 4))
"""
TOOL_NAMES = D.TOOLS
registered = lambda spark, sf_dir: P.with_registry(D.seeds(spark, sf_dir), D.tools(spark))


@query(f"WITH {PARTS_SQL} SELECT seed_id, num AS variant, md5({chosen_sql('num')}) AS chosen FROM p, v3 WHERE num < 2")
def chosen_texts(spark, sf_dir):
    return P.exploded(registered(spark, sf_dir), "variant", (0, 1)).select("seed_id", "variant", F.md5(P.chosen(F.col("variant")).cast("binary")).alias("chosen"))


@query(f"WITH {PARTS_SQL} SELECT seed_id, num AS style, md5({style_sql('num')}) AS chosen FROM p, v3")
def chosen_styles(spark, sf_dir):
    return P.exploded(registered(spark, sf_dir), "style", (0, 1, 2)).select("seed_id", "style", F.md5(P.chosen_style(F.col("style")).cast("binary")).alias("chosen"))


@query(f"WITH {PARTS_SQL} SELECT seed_id, cls AS defect, num AS idx, md5({rejected_sql('cls', 'num')}) AS first, md5({rejected_sql('cls', 'num', True)}) AS second FROM p, v3, v4")
def rejected_texts(spark, sf_dir):
    s = P.exploded(P.exploded(registered(spark, sf_dir), "defect", P.DEFECT_ORDER), "idx", (0, 1, 2))
    text = lambda second: F.md5(P.rejected(F.col("defect"), F.col("idx"), second).cast("binary"))
    return s.select("seed_id", "defect", "idx", text(False).alias("first"), text(True).alias("second"))


@query(f"WITH {PARTS_SQL} SELECT seed_id, array_to_string(free_args, ',') AS known, array_to_string(list_transform(asked, lambda n: {label_sql('n', T.LABELS, 'n')}), ',') AS asked FROM p WHERE properties IS NOT NULL")
def argument_sources(spark, sf_dir):
    """Arguments that the customer's goal fills, and labels of those to ask for."""
    args, missing = P.known_arguments()
    s = registered(spark, sf_dir).filter("properties IS NOT NULL")
    return s.select("seed_id", F.array_join(F.map_keys(args), ",").alias("known"), F.array_join(F.transform(missing, lambda n: X.label(n, T.LABELS, n)), ",").alias("asked"))


#: Chosen texts of both variants (kind c), scored with their seeds; ``best`` has the one that P2 takes.
BEST_SQL = """best AS (SELECT seed_id, num AS variant, total AS score_chosen, length(answer) AS len_chosen, total >= 12 AS reached FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY CASE WHEN total >= 12 THEN 0 ELSE 1 END, CASE WHEN total >= 12 THEN num END, CASE WHEN total < 12 THEN -total END, num) AS place FROM scored WHERE kind = 'c') WHERE place = 1)"""
_C1 = f"SELECT 'c' AS kind, num, '' AS cls, p.*, {chosen_sql('num')} AS answer FROM p, v3 WHERE num < 2"


@query(f"WITH {PARTS_SQL}, answers AS ({_C1}){D.SCORE_SQL}, {BEST_SQL} SELECT seed_id, variant, score_chosen, len_chosen, reached FROM best")
def chosen_best_text(spark, sf_dir):
    return P.best_chosen(registered(spark, sf_dir), TOOL_NAMES).select("seed_id", "variant", "score_chosen", "len_chosen", "reached")


_MARGIN = "(c.score_chosen - r.total < 4 OR (length(r.answer) > 0 AND c.len_chosen >= 1.5 * length(r.answer) AND c.score_chosen - r.total < 6))"
_R1 = f"SELECT 'r', 0, cls, p.*, {rejected_sql('cls', '0')} FROM p, v4"
REAL_OF = "SELECT seed_id, CASE item_id % 4 WHEN 0 THEN 'safety' WHEN 1 THEN 'tool' WHEN 2 THEN 'fabrication' ELSE 'completeness' END AS defect FROM seeds WHERE item_id % 7 = 0"
FILL_SQL = f"""WITH {PARTS_SQL}, answers AS ({_C1} UNION ALL {_R1}){D.SCORE_SQL}, {BEST_SQL},
used AS ({REAL_OF}), have AS (SELECT cls, ord, greatest(0, 6 - count(defect)) AS need FROM v4 LEFT JOIN used ON cls = defect GROUP BY cls, ord),
pool AS (SELECT seed_id, cls, ord, need, CASE WHEN cls = 'completeness' AND tool_required THEN 1 ELSE 0 END AS priority FROM seeds, have WHERE split = 'train' AND need > 0 AND seed_id NOT IN (SELECT seed_id FROM used)
  AND CASE cls WHEN 'safety' THEN category_id IN (3, 6) WHEN 'completeness' THEN true ELSE tool_required AND category_id NOT IN (3, 6) END),
placed AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY priority, seed_id) - 1 AS spot, greatest(1, count(*) OVER (PARTITION BY cls) // (2 * need)) AS step FROM pool),
cands AS (SELECT * FROM placed WHERE spot % step = 0 AND spot / step < 2 * need),
ok AS (SELECT k.*, c.score_chosen, r.total AS score_rejected, length(r.answer) AS len_rejected, c.len_chosen, row_number() OVER (PARTITION BY k.cls ORDER BY spot) - 1 AS idx FROM cands k JOIN best c USING (seed_id) JOIN scored r ON r.kind = 'r' AND r.seed_id = k.seed_id AND r.cls = k.cls WHERE c.reached AND NOT {_MARGIN}),
al AS (SELECT *, row_number() OVER (ORDER BY ord, idx) AS n FROM ok WHERE idx < need)
SELECT al.seed_id, al.cls AS defect, al.idx::INT AS idx, score_chosen, score_rejected, len_chosen, md5({rejected_sql('al.cls', 'al.idx')}) AS rejected FROM al JOIN p USING (seed_id) WHERE n <= 22 - (SELECT count(*) FROM used)"""


@query(FILL_SQL)
def synthetic_pairs(spark, sf_dir):
    """Classes brought to six pairs each, 22 pairs at most, beside real pairs of every seventh seed."""
    s = registered(spark, sf_dir)
    real = s.filter("item_id % 7 = 0").select("seed_id", F.element_at(F.array(*map(F.lit, P.DEFECT_ORDER)), (F.col("item_id") % 4 + 1).cast("int")).alias("defect"))
    out = P.filled(s.filter("split = 'train'"), real, TOOL_NAMES, dict.fromkeys(P.DEFECT_ORDER, 6), 22)
    return out.select("seed_id", "defect", F.col("idx").cast("int").alias("idx"), "score_chosen", "score_rejected", "len_chosen", F.md5(F.col("rejected").cast("binary")).alias("rejected"))


@query(f"""WITH {D.SEEDS_SQL}, v4(cls) AS (VALUES ('safety'), ('tool'), ('fabrication'), ('completeness')) SELECT cls AS defect, CASE WHEN cls = 'completeness' AND tool_required THEN 1 ELSE 0 END AS priority, count(*) AS n FROM seeds, v4
WHERE item_id % 7 <> 0 AND CASE cls WHEN 'safety' THEN category_id IN (3, 6) WHEN 'completeness' THEN true ELSE tool_required AND category_id NOT IN (3, 6) END GROUP BY 1, 2""")
def candidate_pools(spark, sf_dir):
    s = D.seeds(spark, sf_dir)
    return P.pools(s, s.filter("item_id % 7 = 0").union(s.filter("item_id % 14 = 0"))).groupBy("defect", "priority").agg(F.count(F.lit(1)).alias("n"))


#: Evaluated answers, some of unknown seeds, against the best chosen text of their seed.
_TYPE = "CASE WHEN category_id IN (3, 6) AND (coalesce(safety_missing, false) OR coalesce(rescue_missing, false)) THEN 'safety' WHEN bad_call THEN 'fabrication' WHEN coalesce(call_missing, false) OR needless_call THEN 'tool' WHEN half_answer THEN 'completeness' END"
_ANSWER_COLUMNS = "doc_id, seed_id, item_id, category_id, tool_required, tool_name, scenario, user_goal, required_facts, required_questions, required_actions, prohibited_actions, answer"
REAL_SQL = PARTS_SQL + D.ANSWERS_SQL[len(D.SEEDS_SQL) :].replace("answers AS (", "doc_answers AS (") + f""",
answers AS (SELECT 'd' AS kind, 0 AS num, {_ANSWER_COLUMNS} FROM doc_answers UNION ALL SELECT 'c', num, NULL, {_ANSWER_COLUMNS.removeprefix('doc_id, ').removesuffix(', answer')}, {chosen_sql('num')} FROM p, v3 WHERE num < 2){D.SCORE_SQL}, {BEST_SQL},
e AS (SELECT d.*, {_TYPE} AS by_flags, b.seed_id IS NOT NULL AS known, score_chosen, len_chosen, coalesce(reached, false) AS ok, CASE WHEN score_chosen - total < 4 THEN 'margin' WHEN len > 0 AND len_chosen >= 1.5 * len AND score_chosen - total < 6 THEN 'length' END AS why
  FROM scored d LEFT JOIN best b ON b.seed_id = d.seed_id AND d.doc_id % 31 <> 0 WHERE kind = 'd'),
ea AS (SELECT *, CASE WHEN NOT bad THEN '-' WHEN NOT known THEN 'bad case: no seed' WHEN NOT ok THEN 'bad case: chosen too low' WHEN why IS NOT NULL THEN 'bad case: ' || coalesce(defect, 'completeness') || ' filtered' ELSE 'pair' END AS sa FROM e),
eb AS (SELECT *, CASE WHEN sa = 'pair' OR NOT known OR by_flags IS NULL THEN '-' WHEN NOT ok THEN 'supplement: chosen too low' WHEN why IS NOT NULL THEN 'supplement: ' || by_flags || ' filtered' ELSE 'pair' END AS sb FROM ea)
"""


def real_pair_sets(spark, sf_dir):
    n = D.narrow(spark, sf_dir)
    unknown = F.when(F.col("doc_id") % 31 == 0, F.lit("unknown")).otherwise(F.col("seed_id"))
    return P.collect_real(n.withColumn("seed_id", unknown), registered(spark, sf_dir), TOOL_NAMES)


@query(f"WITH {REAL_SQL} SELECT doc_id, seed_id, CASE WHEN sa = 'pair' THEN 'bad_case' ELSE 'eval_supplement' END AS source, CASE WHEN sa = 'pair' THEN coalesce(defect, 'completeness') ELSE by_flags END AS defect, score_chosen, total AS score_rejected, len_chosen FROM eb WHERE sa = 'pair' OR sb = 'pair'")
def real_pairs(spark, sf_dir):
    return real_pair_sets(spark, sf_dir)[0].select("doc_id", "seed_id", "source", "defect", "score_chosen", "score_rejected", "len_chosen")


@query(f"WITH {REAL_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest([sa, sb]) AS reason FROM eb) WHERE reason NOT IN ('-', 'pair') GROUP BY reason")
def real_pair_drops(spark, sf_dir):
    return real_pair_sets(spark, sf_dir)[1]


SECOND_SQL = f"""{PARTS_SQL}, answers AS (SELECT 'c' AS kind, num, '' AS cls, p.*, {style_sql('num')} AS answer FROM p, v3 UNION ALL SELECT 'r', 0, cls, p.*, {rejected_sql('cls', '0', True)} FROM p, v4){D.SCORE_SQL},
full_c AS (SELECT seed_id, category_id, num AS style, total AS score_chosen, length(answer) AS len_chosen, answer AS chosen FROM scored WHERE kind = 'c' AND total >= 12 AND split = 'train'),
second AS (SELECT c.*, r.cls AS defect, r.total AS score_rejected, length(r.answer) AS len_rejected FROM full_c c JOIN scored r USING (seed_id) WHERE r.kind = 'r' AND NOT {_MARGIN})
"""


def second(spark, sf_dir):
    return P.second_set(registered(spark, sf_dir).filter("split = 'train'"), TOOL_NAMES)


@query(f"WITH {SECOND_SQL} SELECT seed_id, style, defect, score_chosen, score_rejected, len_chosen, len_rejected FROM second")
def pair_v2(spark, sf_dir):
    return second(spark, sf_dir).select("seed_id", "style", "defect", "score_chosen", "score_rejected", "len_chosen", "len_rejected")


_KEY = "seed_id || '|' || style || '|' || defect"


@query(f"""WITH {SECOND_SQL}, k AS (SELECT *, {_KEY} AS key FROM second), q AS (SELECT *, row_number() OVER (PARTITION BY defect ORDER BY md5('quota|' || key), key) AS n FROM k)
SELECT key, defect FROM q WHERE n <= CASE defect WHEN 'safety' THEN 12 ELSE 9 END ORDER BY md5('final|' || key), key LIMIT 30""")
def pair_v2_select(spark, sf_dir):
    k = second(spark, sf_dir).withColumn("key", F.concat_ws("|", "seed_id", F.col("style").cast("string"), "defect"))
    return P.selected(k, "defect", "key", {"safety": 12}, 9, 30).select("key", "defect")


@query(f"WITH {SECOND_SQL} SELECT category_id, count(*) AS n, count(*) FILTER (defect = 'safety') AS n_safety, round(avg(len_chosen), 6) AS len_chosen_avg FROM second GROUP BY category_id")
def pairs_by_category(spark, sf_dir):
    """Pairs per category with those of the safety class, and mean lengths."""
    return metrics.pairs_by_category(second(spark, sf_dir)).withColumn("len_chosen_avg", F.round("len_chosen_avg", 6))


_REASON = "CASE WHEN score_chosen - score_rejected < 4 THEN 'margin' WHEN len_rejected > 0 AND len_chosen >= 1.5 * len_rejected AND score_chosen - score_rejected < 6 THEN 'length' END"


@query(f"WITH {D.PAIRS_SQL} SELECT doc_id, {_REASON} AS reason FROM pairs")
def pair_margin_filter(spark, sf_dir):
    return D.pairs(spark, sf_dir).select("doc_id", P.margin_reason().alias("reason"))


@query(f"WITH {D.SCORED_SQL} SELECT doc_id, defect FROM scored")
def pair_type_priority(spark, sf_dir):
    return D.narrow(spark, sf_dir).select("doc_id", "defect")


@query(f"WITH {D.PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY defect ORDER BY md5('quota|' || doc_id), doc_id) AS n FROM pairs) SELECT doc_id, defect FROM r WHERE n <= CASE defect WHEN 'safety' THEN 12 ELSE 11 END")
def pair_quota_select(spark, sf_dir):
    return P.quota(D.pairs(spark, sf_dir), "defect", "doc_id", {"safety": 12}, 11).select("doc_id", "defect")


@query(f"WITH {D.PAIRS_SQL}, r AS (SELECT doc_id, defect, row_number() OVER (PARTITION BY defect ORDER BY doc_id) - 1 AS n, greatest(1, count(*) OVER (PARTITION BY defect) // 20) AS step FROM pairs) SELECT doc_id, defect FROM r WHERE n % step = 0 AND n / step < 20")
def pair_systematic_sample(spark, sf_dir):
    return P.every_nth(D.pairs(spark, sf_dir), "defect", "doc_id", 10).select("doc_id", "defect")


@query("SELECT doc_id FROM documents ORDER BY md5('sample|' || doc_id), doc_id LIMIT 10")
def review_sample(spark, sf_dir):
    return P.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10)


_M = "score_chosen - score_rejected"


@query(f"""WITH {D.PAIRS_SQL} SELECT defect, count(*) AS n, count(DISTINCT seed_id) AS seeds, round(avg(len_chosen), 6) AS len_chosen_avg, min(len_chosen)::INT AS len_chosen_min, max(len_chosen)::INT AS len_chosen_max,
round(avg(len_rejected), 6) AS len_rejected_avg, round(avg({_M}), 6) AS margin_avg, min({_M}) AS margin_min, max({_M}) AS margin_max FROM pairs GROUP BY defect""")
def pair_stats(spark, sf_dir):
    out = metrics.pair_stats(D.pairs(spark, sf_dir), "defect")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_avg")})


@query(f"WITH {D.PAIRS_SQL}, k AS (SELECT defect, count(*) AS n, least(count(*), 100) AS kept FROM pairs GROUP BY defect) SELECT defect, n, kept, round(kept / sum(kept) OVER (), 6) AS share FROM k")
def pair_report_shares(spark, sf_dir):
    return metrics.capped_shares(D.pairs(spark, sf_dir), "defect", 100).withColumn("share", F.round("share", 6))


@query(f"""WITH {D.SCORED_SQL}, r AS (SELECT seed_id, doc_id, total, row_number() OVER (PARTITION BY seed_id ORDER BY CASE WHEN total >= 12 THEN 0 ELSE 1 END, CASE WHEN total >= 12 THEN doc_id END NULLS FIRST, CASE WHEN total < 12 THEN -total END NULLS FIRST, doc_id) AS n FROM scored) SELECT seed_id, doc_id AS variant, total FROM r WHERE n = 1""")
def chosen_best_variant(spark, sf_dir):
    return P.best_variant(D.narrow(spark, sf_dir).withColumn("variant", F.col("doc_id")), "seed_id").select("seed_id", "variant", "total")


_QUESTION = f"replace(replace('{T.QUESTION_2}', '{{sc}}', scenario), '{{goal}}', user_goal)"


@query(f"WITH {SECOND_SQL}, t AS (SELECT second.*, {_QUESTION} AS question FROM second JOIN seeds USING (seed_id)) SELECT md5(question || '|' || chosen) AS key, 'system' AS first_role, 2 AS n_prompt, 'assistant' AS chosen_role FROM t")
def trainer_projection(spark, sf_dir):
    rows = P.trainer_rows(second(spark, sf_dir).withColumn("question", X.fill(T.QUESTION_2, sc=F.col("scenario"), goal=F.col("user_goal"))), "system text")
    text = lambda c, i: F.get(F.col(c), F.lit(i))["content"]
    return rows.select(F.md5(F.concat_ws("|", text("prompt", 1), text("chosen", 0)).cast("binary")).alias("key"), F.get(F.col("prompt"), F.lit(0))["role"].alias("first_role"), F.size("prompt").alias("n_prompt"), F.get(F.col("chosen"), F.lit(0))["role"].alias("chosen_role"))


@query("SELECT conv_id FROM (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY conv_id) WHERE r[1] IS DISTINCT FROM 'system' OR r[-1] IS DISTINCT FROM 'assistant'")
def trainer_guard(spark, sf_dir):
    """Conversations as prompts, with their last turn as both replies: those a trainer would refuse."""
    c = V.conversations(table(spark, sf_dir, "conversations"))
    last = F.slice("messages", -1, 1)
    return P.bad_trainer_rows(c.select("conv_id", F.col("messages").alias("prompt"), last.alias("chosen"), last.alias("rejected"))).select("conv_id")


@query(f"WITH {D.SCORED_SQL} SELECT doc_id, total FROM scored WHERE bad AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def real_pair_candidates(spark, sf_dir):
    """Bad cases that aren't used yet."""
    bad = D.narrow(spark, sf_dir).filter("bad").select("doc_id", "total")
    return incremental.todo(bad, table(spark, sf_dir, "labels"), "doc_id")
