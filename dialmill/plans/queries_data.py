"""Queries over conversations, seeds and documents: validation, deduplication, leakage, generation, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.operators import generate as G
from dialmill.operators import metrics
from dialmill.operators import validate as V
from dialmill.plans import derive as D
from dialmill.runtime import fits_broadcast, shared_path, stash, table
from dialmill.sources import readers
from dialmill.streaming import incremental

CATALOG: dict = {}


def query(sql: str | None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


# --- seeds ----------------------------------------------------------------------------------------------------------


@query(f"WITH {D.SEEDS_SQL} SELECT category_id, any_value(category) AS category, count(*) AS n, count(*) FILTER (tool_required) AS n_tool FROM seeds GROUP BY category_id")
def seed_distribution(spark, sf_dir):
    return metrics.seed_counts(D.seeds(spark, sf_dir))


_KINDS = """kinds AS (SELECT s.*, v.variant, CASE WHEN v.variant = 2 THEN 'multi_turn' WHEN v.variant = 1 AND tool_required AND tool_name IS NOT NULL THEN 'tool_call' ELSE 'single_turn' END AS sample_type
  FROM seeds s, (VALUES (0), (1), (2)) v(variant) WHERE v.variant < 2 OR len(required_questions) > 0)"""


@query(f"WITH {D.SEEDS_SQL}, {_KINDS} SELECT category_id, count(*) FILTER (sample_type = 'single_turn') AS single_turn, count(*) FILTER (sample_type = 'tool_call') AS tool_call, count(*) FILTER (sample_type = 'multi_turn') AS multi_turn FROM kinds GROUP BY category_id")
def variant_type_pivot(spark, sf_dir):
    return metrics.by_type(G.records(D.seeds(spark, sf_dir), D.tools(spark)), ["single_turn", "tool_call", "multi_turn"])


@query(f"WITH {D.SEEDS_SQL}, {_KINDS} SELECT seed_id, variant, sample_type, CASE WHEN sample_type = 'multi_turn' THEN 2 + 2 * least(2, len(required_questions) - 1) ELSE 2 END::INT AS n_messages, CASE WHEN sample_type = 'tool_call' THEN tool_name END AS called FROM kinds")
def record_projection(spark, sf_dir):
    return G.records(D.seeds(spark, sf_dir), D.tools(spark)).select("seed_id", "variant", "sample_type", F.size("messages").alias("n_messages"), F.col("tool_call.name").alias("called"))


@query(f"WITH {D.SEEDS_SQL} SELECT seed_id, len(CASE WHEN item_id % 2 = 0 THEN required_facts WHEN item_id % 3 = 0 THEN required_actions ELSE [] END)::INT AS n_facts, (item_id % 5 = 0 AND tool_required) AS tool_required FROM seeds")
def rule_alias_defaults(spark, sf_dir):
    i = F.col("item_id")
    rows = D.seeds(spark, sf_dir).select("seed_id", F.when(i % 2 == 0, F.col("required_facts")).alias("required_facts"), F.when(i % 3 == 0, F.col("required_actions")).alias("facts"), F.when(i % 5 == 0, F.col("tool_required")).alias("tool_required"))
    return readers.with_aliases(rows).select("seed_id", F.size("required_facts").alias("n_facts"), "tool_required")


# --- conversations --------------------------------------------------------------------------------------------------

#: Turns with injected defects, equal in both engines: repeated roles, blanks, long user turns, short and very long replies.
TURNS_SQL = """
turns AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'user' ELSE role END AS role,
  CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN '  ' WHEN conv_id % 13 = 0 AND role = 'user' THEN repeat(coalesce(text, ''), 8) WHEN conv_id % 17 = 0 AND role = 'assistant' THEN 'ok'
       WHEN conv_id % 19 = 0 AND role = 'assistant' THEN repeat(coalesce(text, ''), 20) ELSE text END AS text FROM conversations WHERE NOT (conv_id % 23 = 0 AND turn > 0)),
conv AS (SELECT conv_id, list({'role': role, 'content': coalesce(text, '')} ORDER BY turn, role, text) AS m FROM turns GROUP BY conv_id)
"""


def turns(spark, sf_dir):
    i, role, t = F.col("conv_id"), F.col("role"), F.coalesce("text", F.lit(""))
    text = F.when((i % 11 == 0) & (F.col("turn") == 1), "  ").when((i % 13 == 0) & (role == "user"), F.repeat(t, F.lit(8))).when((i % 17 == 0) & (role == "assistant"), "ok").when((i % 19 == 0) & (role == "assistant"), F.repeat(t, F.lit(20))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").filter(~((i % 23 == 0) & (F.col("turn") > 0)))
    return rows.select("conv_id", "turn", F.when((i % 7 == 0) & (F.col("turn") == 1), "user").otherwise(role).alias("role"), text.alias("text"))


_EACH = lambda code, test: f"list_transform(list_filter(m, lambda x: {test}), lambda x: '{code}')"
ERRORS_SQL = TURNS_SQL + f""",
errs AS (SELECT conv_id, m, CASE WHEN len(m) < 2 THEN ['V3'] ELSE CASE WHEN m[1].role IS DISTINCT FROM 'user' THEN ['V4'] ELSE [] END || CASE WHEN m[-1].role IS DISTINCT FROM 'assistant' THEN ['V5'] ELSE [] END
 || {_EACH('V6', "x.role NOT IN ('user', 'assistant')")} || list_transform(list_filter(range(2, len(m) + 1), lambda k: m[k].role = m[k - 1].role), lambda k: 'V7') || {_EACH('V8', "NOT regexp_matches(x.content, '[^ ]')")}
 || {_EACH('V9', "x.role = 'user' AND length(x.content) > 600")} || {_EACH('V10', "x.role = 'assistant' AND length(x.content) NOT BETWEEN 20 AND 2500")} END AS errors FROM conv)
"""


def conv_errors(spark, sf_dir):
    c = V.conversations(turns(spark, sf_dir))
    return c.withColumn("errors", V.structure_errors(F.col("messages")))


@query(f"WITH {ERRORS_SQL} SELECT conv_id, array_to_string(errors, ',') AS errors FROM errs")
def conv_structure_errors(spark, sf_dir):
    return conv_errors(spark, sf_dir).select("conv_id", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {ERRORS_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(errors) AS reason FROM errs) GROUP BY reason")
def drop_reason_counts(spark, sf_dir):
    return metrics.reasons(conv_errors(spark, sf_dir), "errors")


@query(f"WITH {ERRORS_SQL} SELECT len(m)::INT AS n_turns, count(*) FILTER (len(errors) = 0) AS passed, count(*) FILTER (len(errors) > 0) AS failed FROM errs GROUP BY len(m)")
def validation_summary(spark, sf_dir):
    ok = F.size("errors") == 0
    return conv_errors(spark, sf_dir).groupBy(F.size("messages").alias("n_turns")).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query(f"WITH {ERRORS_SQL} SELECT conv_id FROM conv WHERE len(list_filter(m, lambda x: (x.role = 'user' AND length(x.content) > 600) OR (x.role = 'assistant' AND length(x.content) NOT BETWEEN 20 AND 2500))) = 0")
def conv_length_filter(spark, sf_dir):
    return V.conversations(turns(spark, sf_dir)).filter(V.length_filter(F.col("messages"))).select("conv_id")


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role = 'assistant')) AS digest FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0")
def conv_assistant_text(spark, sf_dir):
    c = V.conversations(table(spark, sf_dir, "conversations")).filter(F.exists("messages", lambda m: m["role"] == "assistant"))
    return c.select("conv_id", F.md5(V.text_of(F.col("messages"), "assistant").cast("binary")).alias("digest"))


@query("""WITH u AS (SELECT conv_id, turn, text, 0 AS part FROM conversations UNION ALL SELECT conv_id + 1000000, turn, text, 1 FROM conversations WHERE conv_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY turn, text ORDER BY part, conv_id) AS n FROM u) SELECT part, count(*) AS n FROM r WHERE n = 1 GROUP BY part""")
def conv_dedup_keep_first(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    u = c.withColumn("part", F.lit(0)).unionByName(c.filter("conv_id % 2 = 0").withColumn("conv_id", F.col("conv_id") + 1000000).withColumn("part", F.lit(1)))
    return V.keep_first(u, ["turn", "text"], ["part", "conv_id"]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def doc_exact_dups(spark, sf_dir):
    """Groups of equal texts by SHA-256: only digests are shuffled, pre-aggregated by task."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("digest")


_WINDOWS = "unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')))) AS g"
LEAK_SQL = f"""WITH dw AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), bw AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
dg AS (SELECT doc_id, {_WINDOWS} FROM dw WHERE len(w) >= 8), bg AS (SELECT item_id, {_WINDOWS} FROM bw WHERE len(w) >= 8)
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id"""


@query(LEAK_SQL)
def split_leakage(spark, sf_dir):
    """Documents that share eight-word windows with benchmark items: equi join on windows, never text against text.

    The benchmark's windows are broadcast when their number was checked; otherwise the windows' hashes are shuffled.
    """
    def windows(df, key):
        w = df.select(key, F.split("text", " ").alias("w"))
        n = F.size("w") - 7
        return w.filter(F.size("w") >= 8).withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(8)), " "))))).select(key, "g")

    b = stash(windows(table(spark, sf_dir, "benchmark"), "item_id"), "benchmark-windows")
    b = F.broadcast(b) if fits_broadcast(b) else b
    return windows(table(spark, sf_dir, "documents"), "doc_id").join(b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '不得' ELSE '' END || coalesce(text, ''), '^({'|'.join(R.NEGATIONS)})', ''), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, R.NEGATIONS[0]).otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize(X.strip_negation(t)).cast("binary")).alias("digest"))


# --- resume and cache -----------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_todo(spark, sf_dir):
    return incremental.todo(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id, 'b' AS missing_in FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'a' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def missing_answers(spark, sf_dir):
    return incremental.missing(table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("WITH k AS (SELECT doc_id, 'score|stub|' || doc_id || '|v1|' || left(sha1(coalesce(text, '')), 16) AS k FROM documents), c AS (SELECT k, doc_id % 15 AS value FROM k WHERE doc_id % 4 = 0) SELECT doc_id, value FROM k LEFT JOIN c USING (k)")
def cache_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.cache_key("score", "stub", F.col("doc_id"), "v1", F.coalesce("text", F.lit(""))).alias("k"))
    return incremental.cached(d, d.filter("doc_id % 4 = 0").select("k", (F.col("doc_id") % 15).alias("value")), "k", "value").select("doc_id", "value")


def length_judge(row: dict) -> str | None:
    """The stub judge: a score from the length, no answer for every eleventh document."""
    return None if row["doc_id"] % 11 == 0 else str(row["n"] % 15)


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (length(coalesce(text, '')) % 15)::VARCHAR END AS value FROM documents")
def judge_stub_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return incremental.ask(d, length_judge).select("doc_id", "value")


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (length(coalesce(text, '')) % 15)::VARCHAR END AS value, doc_id % 2 = 0 AND doc_id % 11 <> 0 AS cached FROM documents")
def judge_cache_rerun(spark, sf_dir):
    """Even documents are judged first; then all, where failures of the first pass are asked again (ST2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    path = shared_path(spark, "judge-cache")
    incremental.answered(d.filter("doc_id % 2 = 0"), path, "doc_id", length_judge)
    return incremental.answered(d, path, "doc_id", length_judge).select("doc_id", "value", "cached")


@query("SELECT md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text")
def streaming_dedup(spark, sf_dir):
    """Documents as a stream of files, deduplicated by digest in state, drained to a table."""
    base = shared_path(spark, "stream")
    table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5("text").alias("digest")).repartition(4).write.parquet(f"{base}/in")
    stream = incremental.first_seen(incremental.stream_table(spark, f"{base}/in", "digest string", 2), ["digest"])
    incremental.drain(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema("digest string").parquet(f"{base}/out/batch=*")
