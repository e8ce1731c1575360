"""Scenarios of the rule engine over small fixtures."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.operators import arena, constrain, generate, metrics
from dialmill.operators import pairs as P
from dialmill.operators import score as S
from dialmill.operators import validate as V
from dialmill.sources import readers, sinks
from dialmill.streaming import incremental

SEED = "seed_id string, split string, category_id int, category string, subcategory string, scenario string, user_goal string, customer_role string, required_facts array<string>, required_questions array<string>, required_actions array<string>, prohibited_actions array<string>, tool_required boolean, tool_name string"
BASE = dict(seed_id="s1", split="train", category_id=1, category="c", subcategory="sub", scenario="客户询问电池保修政策的年限", user_goal="了解电池保修", customer_role="owner", required_facts=["动力电池质保八年", "以合同约定为准"], required_questions=["请提供车型年款"], required_actions=["查询保修政策"], prohibited_actions=["不得承诺免费更换电池"], tool_required=False, tool_name=None)


def seeds(spark, *changes):
    return spark.createDataFrame([Row(**{**BASE, **c}) for c in changes or ({},)], SEED)


def scored(spark, answer, **change):
    return S.score(S.prepared(seeds(spark, change)).withColumn("answer", F.lit(answer)), ["lookup"]).first()


GOOD = "您好，关于电池保修政策：①动力电池质保八年；②以合同约定为准。请提供车型年款，我们会查询保修政策并尽快答复您。" + "感谢您的耐心等待，祝您用车愉快。" * 5


def test_good_answer_scores_high(spark):
    r = scored(spark, GOOD)
    assert r.total >= 12 and r.prohibited == 2 and not r.half_answer and r.reasons == []


def test_half_answer(spark):
    r = scored(spark, "您好，我先确认一个信息：车型年款。")
    assert r.half_answer and r.completeness == 0


def test_prohibited_and_claims(spark):
    r = scored(spark, GOOD + "不得承诺免费更换电池，质保30年。")
    assert r.prohibited == 0 and r.violated == "不得承诺免费更换电池" and r.fabrication == 1


@pytest.mark.parametrize(
    ("call", "need", "level"),
    [('{"name": "lookup", "arguments": {"topic": "电池保修"}}', True, 2), ('{"name": "lookup", "arguments": {"topic": "发明值"}}', True, 0), ('{"name": "other", "arguments": {}}', True, 0), ("{bad}", True, 0), ('{"name": "lookup", "arguments": {}}', False, 0), ('{"name": "lookup", "arguments": {}, "parameters": {"d": "2025-01-02"}}', True, 2)],
)
def test_tool_calls(spark, call, need, level):
    r = scored(spark, GOOD + f"<tool_call>\n{call}\n</tool_call>", tool_required=need, tool_name="lookup")
    assert r.fabrication == level and r.needless_call is not need


def test_missing_call_and_result_claim(spark):
    assert scored(spark, GOOD, tool_required=True, tool_name="lookup").fabrication == 1
    assert scored(spark, GOOD + "查询到结果正常", tool_required=True, tool_name="lookup").fabrication == 0


def test_safety_flags_and_null_answer(spark):
    assert scored(spark, GOOD, category_id=3).safety_missing and scored(spark, GOOD + "请勿继续行驶", category_id=3).safety_missing is False
    assert scored(spark, GOOD).safety_missing is None
    empty = S.score(S.prepared(seeds(spark)).withColumn("answer", F.lit(None).cast("string"))).first()
    assert empty.understanding == 0 and empty.half_answer


def test_judge_override(spark):
    base = S.score(S.prepared(seeds(spark, {}, {"seed_id": "s2"})).withColumn("answer", F.lit(GOOD)))
    judged = spark.createDataFrame([("s1", *[1] * 7), ("s2", *[None] + [1] * 6)], "seed_id string, " + ", ".join(f"{d} int" for d in S.DIMS))
    got = {r.seed_id: r for r in S.with_judge(base, judged).collect()}
    assert got["s1"].total == 7 and got["s1"].judged and got["s2"].total >= 12 and not got["s2"].judged


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab。，x ", max_size=12), st.text(alphabet="ab。，x ", max_size=30), st.text(alphabet="ab。，x ", max_size=8))
def test_coverage_is_monotone(spark, phrase, answer, more):
    row = spark.range(1).select(X.phrase(F.lit(phrase)).alias("p")).select(X.covered(F.col("p"), F.lit(answer), 0.45).alias("a"), X.covered(F.col("p"), F.lit(answer + more), 0.45).alias("b")).first()
    assert row.b or not row.a


def test_text_functions(spark):
    r = spark.range(1).select(
        X.normalize(F.lit("é a_1，。!")).alias("n"), X.strip_negation(F.lit("不得不能x")).alias("s"), X.numbered(F.array(F.lit("a"), F.lit("b"))).alias("m"), X.numeral(F.lit(2)).alias("two"), X.numeral(F.lit(12)).alias("many"),
        X.situation(F.lit("客户询问客户的车"), F.lit(R.PROXY_ROLES[0])).alias("sit"), X.head(F.lit("甲和乙"), "和", 14, "d").alias("h"), X.head(F.lit(None).cast("string"), "和", 14, "d").alias("h0"), X.duration(F.lit(3661)).alias("t"), X.html_escape(F.lit('<a "&">')).alias("e"),
        X.number_claims(F.lit("5km/h 30 天 1.5万")).alias("c"), F.size(X.sentences(F.lit("a。 。b\n\nc"))).alias("k"),
    ).first()
    assert (r.n, r.s, r.m, r.two, r.many) == ("éa_1", "不能x", "①a；②b。", "两", "12")
    assert r.sit == "想问一下，车主的车" and (r.h, r.h0, r.t, r.e) == ("甲", "d", "1:01:01", "&lt;a &quot;&amp;&quot;&gt;") and r.c == ["5km", "30 天", "1.5万"] and r.k == 3


def conv(spark, *turns):
    m = "array<struct<role:string, content:string>>"
    return spark.createDataFrame([(list(turns),)], f"messages {m}").select(V.structure_errors(F.col("messages")).alias("e")).first().e


def test_structure_errors(spark):
    ok = ("assistant", "x" * 30)
    assert conv(spark, ("user", "hi"), ok) == []
    assert conv(spark, ("user", "hi")) == ["V3"] and conv(spark, ("system", "s"), ok) == ["V4", "V6"]
    assert conv(spark, ("user", "a"), ("user", " "), ("user", "b" * 601)) == ["V5", "V7", "V7", "V8", "V9"]
    assert conv(spark, ("user", "a"), ("assistant", "short")) == ["V10"] and "V8" in conv(spark, ("user", None), ok)


def test_validate_records(spark):
    tools = spark.createDataFrame([("lookup", ["topic", "date"])], "tool_name string, required array<string>")
    s = seeds(spark, {"tool_required": True, "tool_name": "lookup"}, {"seed_id": "t1", "split": "final_test"})
    call = '<tool_call>{"name": "lookup", "arguments": {"topic": "x"}}</tool_call>'
    body = "动力电池质保八年。以合同约定为准。请提供车型年款。查询保修政策。" + call
    rec = [("s1", "tool_call", 1, [("user", "q"), ("assistant", body)]), ("s1", "tool_call", 2, [("user", "q"), ("assistant", body)]), ("zz", "single_turn", 3, [("user", "q")]), ("t1", "single_turn", 4, [("user", "q"), ("assistant", "承诺免费更换电池" * 4)]), ("s1", "tool_call", 5, [("user", "q"), ("assistant", body.replace(call, "处理成功"))])]
    df = spark.createDataFrame(rec, "seed_id string, sample_type string, ord int, messages array<struct<role:string, content:string>>")
    got = {r.ord: sorted(r.errors) for r in V.validate(df, s, tools).collect()}
    assert got == {1: ["V18"], 2: ["V18", "V20"], 3: ["V1"], 4: ["V11", "V11", "V12", "V13", "V14", "V2"], 5: ["V15", "V19"]}


def test_generated_records_pass_validation(spark):
    tools = spark.createDataFrame([("lookup", ["vehicle_id", "date"])], "tool_name string, required array<string>")
    s = seeds(spark, {"tool_required": True, "tool_name": "lookup", "required_questions": ["甲", "乙", "丙"]}, {"seed_id": "s2", "required_questions": []})
    r = generate.records(s, tools).withColumn("ord", F.monotonically_increasing_id())
    assert r.count() == 5 and {x.sample_type for x in r.collect()} == {"single_turn", "tool_call", "multi_turn"}
    assert V.validate(r, s, tools).filter(F.size("errors") > 0).select("seed_id", "variant", "errors").collect() == []
    multi = r.filter("sample_type = 'multi_turn'").first().messages
    assert [m.role for m in multi] == ["user", "assistant"] * 3 and multi[2].content != multi[4].content
    assert generate.records(s, tools, kinds=("single_turn", "tool_call")).count() == 3


def test_repair(spark):
    tools = ["lookup"]
    rows = seeds(spark, {"tool_required": True, "tool_name": "lookup"}, {"seed_id": "s2", "category_id": 3}, {"seed_id": "s3", "category_id": 6})
    bad = '一<tool_call>{"name": "nope"}</tool_call>二<tool_call>{"name": "lookup", "arguments": {}}</tool_call>三<tool_call>{oops}</tool_call>'
    got = {r.seed_id: r.a for r in constrain.repair(rows.withColumn("a", F.lit(bad)), "a", tools).collect()}
    assert got["s1"] == f'一{R.CALL_BLANK}二<tool_call>{{"name": "lookup", "arguments": {{}}}}</tool_call>三{R.CALL_BLANK}'
    assert got["s2"] == R.STOP_REPAIR + "一二三" and got["s3"] == "一二三" + R.RESCUE_REPAIR
    once = constrain.repair(rows.withColumn("a", F.lit(bad)), "a", tools)
    again = constrain.repair(once.withColumn("b", F.col("a")), "b", tools)
    assert all(r.a == r.b for r in again.collect())
    added = constrain.repair(rows.filter("seed_id = 's1'").withColumn("a", F.lit("好的。。")), "a", tools).first().a
    assert added.startswith("好的" + R.CALL_LEAD) and R.CALL_ASK in added


def test_violations_and_attempts(spark):
    s = seeds(spark, {"tool_required": True, "tool_name": "lookup"})
    v = s.select(constrain.violations(F.lit('<tool_call>{"name": "no", "arguments": {"a": "发明"}}</tool_call><tool_call>{x}</tool_call>'), ["lookup"]).alias("v")).first().v
    assert v == ["unknown_tool", "unsourced_argument", "bad_json"]
    good = '<tool_call>{"name": "lookup", "arguments": {}}</tool_call>'
    tries = s.withColumn("x", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("no").alias("a")), F.struct(F.lit(1).alias("n"), F.lit(good).alias("a"))))).withColumn("attempt", F.col("x.n")).withColumn("answer", F.col("x.a"))
    assert constrain.first_passing(tries, ["lookup"]).first().status == "retry1"
    last = constrain.first_passing(tries.filter("attempt = 0"), ["lookup"]).first()
    assert last.status == "fallback" and good.split('"arguments"')[0] in last.answer
    made = constrain.generate(s.select("seed_id"), lambda pdf: pdf["seed_id"] + "!")
    assert made.first().answer == "s1!"


def test_margins(spark):
    df = spark.createDataFrame([(12, 9, 100, 100), (12, 8, 100, 100), (12, 8, 150, 100), (14, 8, 150, 100), (12, 8, 5, 0)], "score_chosen int, score_rejected int, len_chosen int, len_rejected int")
    assert [r.x for r in df.select(P.margin_reason().alias("x")).collect()] == ["margin", None, "length", None, None]


def registry(spark):
    return spark.createDataFrame([("lookup", ["topic"], ["issue_summary", "vehicle_id", "other"])], "tool_name string, required array<string>, properties array<string>")


def test_first_set_of_pairs(spark):
    """Chosen texts reach twelve points and beat every degraded text by four; calls hold only what the customer said."""
    s = P.with_registry(seeds(spark, {"category_id": 3, "tool_required": True, "tool_name": "lookup"}, {"seed_id": "s2", "category_id": 6, "tool_required": True, "tool_name": "lookup"}, {"seed_id": "s3", "category_id": 1}), registry(spark))
    best = {r.seed_id: r for r in P.best_chosen(s, ["lookup"]).collect()}
    assert len(best) == 3 and all(r.score_chosen >= 12 and r.reached and r.variant == 0 for r in best.values())
    assert '"arguments": {"issue_summary":"了解电池保修"}}' in best["s1"].chosen and "①车辆识别代号/车架号；②「other」对应信息。" in best["s1"].chosen and "<tool_call>" not in best["s3"].chosen
    bad = P.totals(P.exploded(s, "defect", P.DEFECT_ORDER).withColumn("text", P.rejected(F.col("defect"), F.lit(3))), "text", ["lookup"], "rejected").collect()
    assert len(bad) == 12 and all(best[r.seed_id].score_chosen - r.score_rejected >= R.DEFAULT.margin for r in bad)
    made_up = next(r.text for r in bad if r.seed_id == "s1" and r.defect == "fabrication")
    assert '"vehicle_id":"VID264381759016661"' in made_up and '"other":"2024款长续航版3"' in made_up
    second = P.second_set(s, ["lookup"])
    assert second.count() == 36 and second.filter("score_chosen < 12 OR score_chosen - score_rejected < 4").count() == 0
    t = P.trainer_rows(second.withColumn("question", generate.question()), "be kind")
    assert P.bad_trainer_rows(t).count() == 0 and P.bad_trainer_rows(t.withColumn("prompt", F.slice("prompt", 2, 1))).count() == 36 and t.first().prompt[0].content == "be kind"
    with pytest.raises(ValueError, match="rejected"):
        P.bad_trainer_rows(t.drop("rejected"))


def test_filled_pairs_stop_at_their_targets(spark):
    rows = seeds(spark, *[{"seed_id": f"s{i:03}", "category_id": 3 if i % 2 else 1} for i in range(80)])
    train = P.with_registry(rows, registry(spark))
    real = spark.createDataFrame([("s000", "completeness"), ("s001", "safety")], "seed_id string, defect string")
    got = P.filled(train, real, [], dict.fromkeys(P.DEFECT_ORDER, 6), 9).collect()
    assert [r.defect for r in got].count("safety") == 5 and [r.defect for r in got].count("completeness") == 2  # nine pairs with the real ones
    assert not {r.seed_id for r in got} & {"s000", "s001"} and sorted(r.idx for r in got if r.defect == "safety") == list(range(5))


def test_places_in_classes(spark):
    """Places over several parts, with a hot class, null classes and ties."""
    from dialmill.runtime import placed

    rows = [(i, "hot" if i % 3 else None if i % 2 else "b", i // 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, c string, o int").repartition(7)
    got = placed(df, ["c"], ["o", "k"]).collect()
    for c in ("hot", "b", None):
        own = sorted((r for r in got if r.c == c), key=lambda r: r["__place"])
        assert [r["__place"] for r in own] == list(range(len(own))) and [r.k for r in own] == sorted(r.k for r in own) and all(r["__size"] == len(own) for r in own)
    assert placed(df.limit(0), ["c"], ["o"]).count() == 0 and [r.k for r in placed(df, [], ["k"]).orderBy("__place").collect()] == list(range(1000))


def test_supplement_styles(spark):
    s = P.with_registry(seeds(spark, {"tool_required": True, "tool_name": "lookup", "required_facts": ["a", "b", "c", "d"]}, {"seed_id": "s2", "category_id": 6}), registry(spark))
    got = {(r.seed_id, r.variant): r.answer for r in generate.supplement(s).collect()}
    assert len(got) == 6 and "①a；①b；①c。" in got["s1", 0] and "• a；• b；• c。" in got["s1", 1] and "1. 查询保修政策。" in got["s1", 1] and "<tool_call>" in got["s1", 2] and "先确保安全" in got["s2", 2]


def test_quota_sample_variant(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("c"))
    assert {r.c: r["count"] for r in P.quota(df, "c", "k", {"1": 5}, 3).groupBy("c").count().collect()} == {"0": 3, "1": 5}
    assert [r.k for r in P.every_nth(df.filter("c = '0'"), "c", "k", 5).orderBy("k").collect()] == list(range(0, 100, 10))
    assert P.sample(df, "k", 7).count() == 7 and P.sample(df, "k", 7).collect() == P.sample(df.repartition(3), "k", 7).collect()
    v = spark.createDataFrame([("a", 0, 9), ("a", 1, 12), ("a", 2, 14), ("b", 0, 9), ("b", 1, 9)], "seed_id string, variant int, total int")
    assert {r.seed_id: r.variant for r in P.best_variant(v, "seed_id").collect()} == {"a": 1, "b": 0}


def test_arena(spark):
    rows = [(i, c, b, coin, 8, 8) for i, (c, b) in enumerate([("long", "x"), ("x", "long"), ("ab", "cd"), ("abc", "ab")]) for coin in (True, False)]
    df = spark.createDataFrame(rows, "id int, candidate string, baseline string, coin boolean, total_candidate int, total_baseline int")
    got = {(r.id, r.coin): r.verdict for r in arena.consensus(df).collect()}
    assert all(got[i, True] == got[i, False] for i in range(4))  # the side makes no difference
    assert [got[i, True] for i in range(4)] == ["candidate", "baseline", "tie", "candidate"]
    none = arena.consensus(df.withColumn("total_candidate", F.lit(10)), lambda a, b: F.lit(None).cast("string")).first()
    assert (none.verdict, none.method) == ("candidate", "rule")
    one = arena.rates(spark.createDataFrame([("candidate",)] * 3 + [("tie",)], "verdict string")).first()
    assert (one.win_rate, one.decided_rate, one.elo) == (75.0, 100.0, 338.0)
    assert arena.rates(spark.createDataFrame([("candidate",)], "verdict string")).first().elo == 800.0


def test_asserted_readers_and_array_sink(spark, tmp_path):
    rows = [BASE | {"seed_id": f"s{i}", "split": "final_test", "category_id": i % 2 + 1} for i in (3, 1, 2, 0)]
    (tmp_path / "final_test").mkdir()
    for k in (0, 1):
        (tmp_path / "final_test" / f"c{k}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[2 * k : 2 * k + 2]) + "\n")
    got = readers.checked_seeds(spark, f"{tmp_path}/final_test/*.jsonl", expect=4, split="final_test", per_category=2)
    assert [r.seed_id for r in got.collect()] == ["s0", "s1", "s2", "s3"]
    for wrong in ({"expect": 5}, {"expect": 4, "split": "train"}, {"expect": 4, "per_category": 3}):
        with pytest.raises(ValueError):
            readers.checked_seeds(spark, f"{tmp_path}/final_test/*.jsonl", **wrong)
    assert readers.keyed_folder(spark, f"{tmp_path}/final_test", "seed_id").count() == 4
    assert readers.tool_names(spark, f"{tmp_path}/none.json") == []
    (tmp_path / "prompt.md").write_text("be\nkind\n")
    assert readers.prompt(spark, f"{tmp_path}/prompt.md") == "be\nkind\n"
    assert readers.first_existing(spark, f"{tmp_path}/no", f"{tmp_path}/prompt.md").endswith("prompt.md") and readers.first_existing(spark, f"{tmp_path}/no") is None
    sinks.json_array(got.select("seed_id"), f"{tmp_path}/array.json")
    assert [r.seed_id for r in readers.array_file(spark, f"{tmp_path}/array.json", "seed_id string").collect()] == ["s0", "s1", "s2", "s3"]
    sinks.frozen_questions(got, f"{tmp_path}/frozen")
    assert spark.read.json(f"{tmp_path}/frozen").first().question == "您好，客户询问电池保修政策的年限。我的诉求是：了解电池保修。请帮我处理。"
    (tmp_path / "odd.jsonl").write_text('{"seed_id": "a"}\n\n{oops\n{"seed_id": "b"}\nx\n')
    good, bad = readers.tolerant(spark, f"{tmp_path}/odd.jsonl", "seed_id string")
    assert good.count() == 2 and sorted((r.line_number, r.line) for r in bad.collect()) == [(3, "{oops"), (5, "x")]
    with pytest.raises(ValueError, match="more than 3"):
        sinks.dashboard("t", got.select("seed_id"), got.withColumn("verdict", F.lit("tie")), most=3)
    assert readers.questions(spark, ["a", "b"]).count() == 2


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "seeds.jsonl"
    p.write_text("\n".join([json.dumps(BASE, ensure_ascii=False), "", json.dumps(BASE | {"seed_id": "s2"})]) + "\n")
    assert readers.seeds(spark, str(p), expect=2).count() == 2
    with pytest.raises(ValueError):
        readers.seeds(spark, str(p), expect=3)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"seed_id": "a"}\n{oops\n')
    good, lines = readers.tolerant(spark, str(bad), "seed_id string")
    assert good.first().seed_id == "a" and lines.first().line == "{oops" and lines.first().file == "bad.jsonl"
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict(spark, str(bad), "seed_id string").collect()
    reg = tmp_path / "tools.json"
    reg.write_text(json.dumps({"tools": [{"name": "t", "description": "d", "parameters": {"properties": {"a": {"type": "string", "enum": ["x"]}}, "required": ["a"]}}]}))
    t = readers.tools(spark, str(reg)).first()
    assert t.tool_name == "t" and t.required == ["a"] and t.properties["a"].enum == ["x"]
    arr = tmp_path / "a.json"
    arr.write_text(json.dumps([{"seed_id": "s1", "answer": "x"}, {"seed_id": "s2", "answer": "y"}]))
    assert readers.answers(spark, str(arr)).count() == 2
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    out = str(tmp_path / "cache")
    assert sinks.append_new(df, out, "k") == 2 and sinks.append_new(df.union(spark.createDataFrame([("k3", 3)], df.schema)), out, "k") == 1
    sinks.dual(df, df.select("k"), str(tmp_path / "dual"))
    assert spark.read.json(str(tmp_path / "dual/trainer")).columns == ["k"]
    assert "| k1 | 1 |" in sinks.markdown("t", {"s": df.orderBy("k")})
    with pytest.raises(ValueError):
        sinks.markdown("t", {"s": df}, most=1)
    page = sinks.dashboard("<t>", df, spark.createDataFrame([("tie", "<b>")], "verdict string, text string"))
    assert "&lt;b&gt;" in page and "&lt;t&gt;" in page
    last = readers.last_by_key(spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "k string, v int, n int"), "k", "n")
    assert last.first().v == 2


def test_incremental(spark, tmp_path):
    a, b = spark.range(6).toDF("k"), spark.range(3, 9).toDF("k")
    assert sorted(r.k for r in incremental.todo(a, b, "k").collect()) == [0, 1, 2]
    assert incremental.missing(a, b, "k").count() == 6
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("x",), ("y",), ("x",)], "k string").write.parquet(src)
    run = lambda: incremental.drain(incremental.first_seen(incremental.stream_table(spark, src, "k string"), ["k"]), out, state)
    run()
    spark.createDataFrame([("y",), ("z",)], "k string").write.mode("append").parquet(src)
    run()
    got = [r.k for r in spark.read.schema("k string").parquet(f"{out}/batch=*").collect()]
    assert sorted(got) == ["x", "y", "z"]


def test_ask_retries(spark):
    def judge(row):
        if row["k"] == 1:
            raise OSError("down")
        return str(row["k"])

    assert [r.value for r in incremental.ask(spark.range(2).toDF("k"), judge).orderBy("k").collect()] == ["0", None]


def test_cache_keeps_answers_and_asks_again_for_failures(spark, tmp_path):
    path, d = str(tmp_path / "cache"), spark.range(6).toDF("k")
    first = incremental.answered(d.filter("k < 4"), path, "k", lambda row: None if row["k"] == 2 else f"first {row['k']}")
    assert {r.k: r.value for r in first.collect()} == {0: "first 0", 1: "first 1", 2: None, 3: "first 3"}
    again = incremental.answered(d, path, "k", lambda row: f"second {row['k']}", pause=0.01)
    assert {r.k: (r.value, r.cached) for r in again.collect()} == {0: ("first 0", True), 1: ("first 1", True), 2: ("second 2", False), 3: ("first 3", True), 4: ("second 4", False), 5: ("second 5", False)}
    text = spark.createDataFrame([(" a ", "b"), (" ", "b"), (None, None)], "r string, t string").select(incremental.said(F.col("r"), F.col("t")).alias("x"))
    assert [r.x for r in text.collect()] == ["a", "b", None]
    page = spark.range(1).select(X.html_answer(F.lit("<tool_call>{}</tool_call> & x")).alias("x")).first().x
    assert page == '<span class="tc">&lt;tool_call&gt;{}&lt;/tool_call&gt;</span> &amp; x'


def test_metrics(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", [])], "k string, e array<string>")
    assert {r.reason: r.n for r in metrics.reasons(df, "e").collect()} == {"x": 2, "y": 1}
    with pytest.raises(Exception, match="too few"):
        metrics.require(df, F.size("e") > 0, "too few").collect()
    shares = metrics.capped_shares(spark.range(10).select((F.col("id") < 8).cast("string").alias("c")), "c", 4)
    assert {r.c: round(r.share, 3) for r in shares.collect()} == {"true": 0.667, "false": 0.333}


def test_stash_and_clean(spark):
    from dialmill.runtime import clean, fits_broadcast, lookup_join, stash, without

    clean(spark)
    df = stash(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"))
    assert df.count() == 2 and fits_broadcast(df)
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, i int")
    assert sorted((r.i, r.v) for r in lookup_join(left, df, "k", F.col("i")).fillna(0).collect()) == [(1, 1), (2, 2), (3, 0)]
    assert without(df.withColumn("Size", F.lit(1)), ["size"]).columns == ["k", "v"]
    assert clean(spark) == 1 and clean(spark) == 0


def test_no_local_folder_on_a_cluster():
    """Without spark.checkpoint.dir a temp folder serves only where Spark is one process."""
    from types import SimpleNamespace

    from dialmill import runtime

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://https://host"):
        fake = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            runtime.shared_dir(fake)


def test_spread_small_inputs(spark, tmp_path):
    from dialmill.runtime import spread

    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert spread(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = str(tmp_path / "many")
    spark.range(100).repartition(9).write.parquet(many)
    plan = spread(spark.read.parquet(many))._jdf.queryExecution().toString()
    assert "Repartition" not in plan


def test_reports(spark, sf):
    from dialmill.plans import derive, queries_more, queries_pairs, reports

    n = derive.narrow(spark, sf)
    m = derive.matches(spark, sf)
    assert "## Advice" in reports.score_report(n) and reports.final_report(queries_more.evaluated(spark, sf), m, n).count("\n## ") == 11
    assert "data-verdict" in reports.arena_page(m.limit(300)) and "## Matches" in reports.arena_report(m.limit(100))
    pairs, drops = queries_pairs.real_pair_sets(spark, sf)
    said = reports.pair_report(pairs.withColumn("len_rejected", F.lit(1)), drops=drops)
    assert all(f"## {x}" in said for x in ("Shares", "By source", "Dropped"))
    cov = metrics.judge_coverage(spark.createDataFrame([(True, False), (False, False)], "judged boolean, cached boolean")).first()
    assert (cov.n, cov.judged, cov.by_rules) == (2, 1, 1) and spark.range(1).select(metrics.signed(F.lit(1.5)).alias("s")).first().s == "+1.50"
