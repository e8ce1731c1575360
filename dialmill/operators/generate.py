"""Conversation generation from seeds (G1 to G14), in column expressions.

Choices depend on md5 of seed and variant, so any engine and any partitioning gives the same text. Phrase pools are
parameters; the defaults are this library's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.functions import phrases as T
from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.operators import pairs as P


@dataclass(frozen=True)
class Phrases:
    """Openers, closings and lead-ins to choose from."""

    openers: tuple[str, ...] = ("Hello, a question: ", "Good day, could you help: ", "Hi, there is something: ")
    proxy_openers: tuple[str, ...] = ("Hello, asking for the owner: ", "Hi, on behalf of my family: ")
    care_openers: tuple[str, ...] = ("Hello, about your reminder: ", "Hi, your message came in: ")
    empathy: tuple[str, ...] = ("Thank you for your message. ", "We will look after this. ", "Let us go through it. ")
    safe_empathy: tuple[str, ...] = ("Please make sure that you are safe first. ", "Safety first, please stand clear of traffic. ")
    care_empathy: tuple[str, ...] = ("Thank you for reading our reminder. ", "Glad to explain our message. ")
    facts: tuple[str, ...] = ("What matters here: ", "Good to know: ")
    one_question: tuple[str, ...] = ("One thing to confirm: ", "Please add one detail: ")
    questions: tuple[str, ...] = ("Please confirm: ", "Some details are needed: ")
    actions: tuple[str, ...] = ("Please do this: ", "The next steps: ")
    closings: tuple[str, ...] = (" We are here for any question.", " Thank you and have a good day.")
    requests: tuple[str, ...] = (" What should be done?", " Please advise.")
    waits: tuple[str, ...] = (" The result will follow as soon as it is there.", " No result is known yet, it will be passed on.")
    #: (keywords, replies): the first rule with a keyword in the question answers it.
    replies: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = tuple((words, tuple(x.replace("{work_order}", "WO2600000000") for x in said)) for words, said in T.REPLIES)
    generic: tuple[str, ...] = T.REPLIES_GENERIC


DEFAULT = Phrases()


def _pick(options: tuple[str, ...], salt: str) -> Column:
    return X.pick(options, F.col("seed_id"), F.col("variant"), salt)


def is_proxy() -> Column:
    return F.coalesce(F.col("customer_role").isin(*R.PROXY_ROLES), F.lit(False))


def sentence(items: Column, lead: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(lead, X.numbered(items))).otherwise("")


def empathy(p: Phrases) -> Column:
    """By category: 3 and 6 are about safety, 8 about reminders."""
    return F.when(F.col("category_id").isin(3, 6), _pick(p.safe_empathy, "e")).when(F.col("category_id") == 8, _pick(p.care_empathy, "e")).otherwise(_pick(p.empathy, "e"))


def first_message(p: Phrases, extra: Column | None = None, ask: bool = True) -> Column:
    """The caller's first message (G5); the scenario in the caller's voice is in __situation."""
    opener = F.when(is_proxy(), _pick(p.proxy_openers, "o")).when(F.col("category_id") == 8, _pick(p.care_openers, "o")).otherwise(_pick(p.openers, "o"))
    return F.concat(opener, F.col("__situation"), F.lit("。"), extra if extra is not None else F.lit(""), _pick(p.requests, "r") if ask else F.lit(""))


def ordered(questions: Column, shuffle: Column) -> Column:
    """Questions in their order, or sorted by md5 of seed, variant and question."""
    keyed = F.array_sort(F.transform(questions, lambda q: F.struct(F.md5(F.concat_ws("|", F.col("seed_id"), F.col("variant").cast("string"), q).cast("binary")).alias("k"), q.alias("q"))))
    return F.when(shuffle, F.transform(keyed, lambda e: e["q"])).otherwise(questions)


def question_sentence(questions: Column, p: Phrases) -> Column:
    return F.when(F.size(questions) == 1, F.concat(_pick(p.one_question, "q"), F.get(questions, F.lit(0)), F.lit("。"))).otherwise(sentence(questions, _pick(p.questions, "q")))


def single_reply(p: Phrases) -> Column:
    """Empathy, facts, questions, actions, closing."""
    lists = {n: F.coalesce(F.col(f"required_{n}"), X.empty()) for n in ("facts", "questions", "actions")}
    return F.concat(empathy(p), sentence(lists["facts"], _pick(p.facts, "f")), question_sentence(ordered(lists["questions"], F.col("variant") == 1), p), sentence(lists["actions"], _pick(p.actions, "a")), _pick(p.closings, "c"))


def arguments(required: Column) -> Column:
    """Placeholder values for required arguments, by name (X30, X31): digits behind a prefix, fixed texts, or the subcategory."""
    subject = F.coalesce(F.nullif(F.col("subcategory"), F.lit("")), F.lit(T.SUBJECT_DEFAULT))

    def value(n: Column) -> Column:
        key = (F.col("seed_id"), n)
        number = F.conv(F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, 12), 16, 10).cast("long")
        out = F.when((n == "preferred_date") & X.contains_any(F.col("scenario"), T.SOON), X.pick(T.DATES_SOON, *key)).when(n == "preferred_date", X.pick(T.DATES, *key))
        for name, (prefix, size) in T.ARGUMENT_DIGITS.items():
            out = out.when(n == name, F.concat(F.lit(prefix), X.digits(size, *key)))
        for name, (prefix, a, b) in T.ARGUMENT_RANGES.items():
            out = out.when(n == name, F.concat(F.lit(prefix), (number % (b - a + 1) + a).cast("string")))
        for name, text in T.ARGUMENT_TEXTS.items():
            out = out.when(n == name, F.lit(text))
        out = out.when(n == "issue_summary", F.left(X.clean_scenario(F.col("scenario")), F.lit(40))).when(n == "followup_note", F.left(F.coalesce("user_goal", F.lit(T.GOAL_DEFAULT)), F.lit(40)))
        return out.when(n.isin(*T.ARGUMENT_TRUE), "true").otherwise(subject)

    return F.map_from_entries(F.transform(F.coalesce(required, X.empty()), lambda n: F.struct(n.alias("key"), value(n).alias("value"))))


def reply_to(question: Column, p: Phrases = DEFAULT, last: Column | None = None) -> Column:
    """The caller's answer to a question: the first rule with a keyword in it, else a generic one; not the last one again."""
    q = X.text_or_empty(question)

    def one(options: tuple[str, ...]) -> Column:
        if len(options) == 1:
            return F.lit(options[0])
        every = F.array(*map(F.lit, options))
        return X.pick_from(every if last is None else F.filter(every, lambda g: ~g.eqNullSafe(last)), q)

    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for words, said in p.replies:
        out = out.when(X.contains_any(q, words), one(said))
    return out.otherwise(one(p.generic))


def question() -> Column:
    """The question put to a model: the scenario and the goal."""
    return X.fill(T.QUESTION_2, sc=F.col("scenario"), goal=F.col("user_goal"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def multi_turn(p: Phrases) -> Column:
    """One question a turn while more than one is left and fewer than two were asked; the rest in the last reply.

    The caller's replies are in __reply1 and __reply2.
    """
    q = F.coalesce(F.col("required_questions"), X.empty())
    asked = F.least(F.lit(2), F.greatest(F.size(q) - 1, F.lit(0)))
    first, second = F.get(q, F.lit(0)), F.get(q, F.lit(1))
    turns = F.array(
        F.struct(message("assistant", F.concat(empathy(p), _pick(p.one_question, "q"), first, F.lit("。"))).alias("a"), message("user", F.col("__reply1")).alias("u")),
        F.struct(message("assistant", F.concat(F.lit("Thank you. One more thing to confirm: "), second, F.lit("。"))).alias("a"), message("user", F.col("__reply2")).alias("u")),
    )
    middle = F.flatten(F.transform(F.slice(turns, F.lit(1), asked), lambda t: F.array(t["a"], t["u"])))
    rest = F.slice(q, asked + 1, F.greatest(F.size(q) - asked, F.lit(0)))
    facts, actions = (F.coalesce(F.col(f"required_{n}"), X.empty()) for n in ("facts", "actions"))
    last = F.concat(sentence(facts, _pick(p.facts, "f")), sentence(rest, _pick(p.questions, "q")), sentence(actions, _pick(p.actions, "a")), _pick(p.closings, "c"))
    return F.concat(F.array(message("user", first_message(p, ask=False))), middle, F.array(message("assistant", last)))


def records(seeds: DataFrame, tools: DataFrame, p: Phrases = DEFAULT, kinds: tuple[str, ...] = ("single_turn", "tool_call", "multi_turn")) -> DataFrame:
    """Up to three records a seed: v0 single; v1 tool call, else single with shuffled questions; v2 multi-turn if it has questions.

    tools: (tool_name, required), joined by name. One explode of a literal array; no seed is joined with another.
    """
    t = tools.select(F.col("tool_name").alias("__tool"), F.col("required").alias("__required"))
    out = seeds.join(t, seeds["tool_name"] == t["__tool"], "left").withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    has_tool = F.coalesce(F.col("tool_required"), F.lit(False)) & F.col("tool_name").isNotNull()
    kind = F.when(F.col("variant") == 2, "multi_turn").when((F.col("variant") == 1) & has_tool, "tool_call").otherwise("single_turn")
    out = out.withColumn("sample_type", kind)
    out = out.filter((F.col("sample_type") != "multi_turn") | (F.size(F.coalesce(F.col("required_questions"), X.empty())) > 0))
    out = out.filter(F.col("sample_type").isin(*kinds))
    if "multi_turn" not in kinds:
        out = out.filter((F.col("variant") == 0) | (F.col("sample_type") == "tool_call"))
    q = F.coalesce(F.col("required_questions"), X.empty())
    # Long expressions that are read more than once are columns of their own.
    out = out.withColumn("__args", arguments(F.col("__required"))).withColumn("__situation", X.situation(F.col("scenario"), F.col("customer_role")))
    out = out.withColumn("__reply1", reply_to(F.get(q, F.lit(0)), p)).withColumn("__reply2", reply_to(F.get(q, F.lit(1)), p, F.col("__reply1")))
    args = F.col("__args")
    given = lambda name, before: F.when(F.map_contains_key(args, F.lit(name)), F.concat(F.lit(before), F.element_at(args, F.lit(name)), F.lit("，")))
    told = F.coalesce(given("vehicle_id", "我的车架号（VIN）是"), given("work_order_id", "我的工单号是"), given("city", "我在"), F.lit(""))
    call = F.concat(empathy(p), sentence(F.coalesce(F.col("required_facts"), X.empty()), _pick(p.facts, "f")), X.call_block(F.col("tool_name"), args), _pick(p.waits, "w"), question_sentence(F.coalesce(F.col("required_questions"), X.empty()), p), sentence(F.coalesce(F.col("required_actions"), X.empty()), _pick(p.actions, "a")), _pick(p.closings, "c"))
    is_call = F.col("sample_type") == "tool_call"
    pair = lambda user, reply: F.array(message("user", user), message("assistant", reply))
    m = F.when(is_call, pair(first_message(p, told), call)).when(F.col("sample_type") == "multi_turn", multi_turn(p)).otherwise(pair(first_message(p), single_reply(p)))
    made = F.when(is_call, F.struct(F.col("tool_name").alias("name"), args.alias("arguments")))
    return out.withColumn("messages", m).withColumn("tool_call", made).select("seed_id", "split", "category_id", "category", "subcategory", "scenario", "sample_type", "variant", "tool_name", "messages", "tool_call")


def supplement(seeds: DataFrame) -> DataFrame:
    """Seeds (with ``properties`` of their tools) times three styles, only the first two or three items of each list used."""
    def cut(lead: str, name: str, k: int, mark: str | None) -> Column:
        items = F.slice(F.coalesce(F.col(f"required_{name}"), X.empty()), 1, k)
        each = F.transform(items, lambda x, i: F.concat(F.lit(mark) if mark else F.concat((i + 1).cast("string"), F.lit(". ")), x))
        return F.when(F.size(items) > 0, F.concat(F.lit(lead), F.array_join(each, "；"), F.lit("。"))).otherwise("")

    def opener(v: int) -> Column:
        texts = T.SUPPLEMENT_OPEN[v]
        cat, sc = F.col("category_id"), F.col("scenario")
        return F.when(cat == 3, X.fill(texts[0], sc=sc)).when(cat == 6, X.fill(texts[1], sc=sc)).otherwise(X.fill_any(X.pick(texts[2:], F.col("seed_id"), str(v), "s"), sc=sc))

    call = F.when(P.parts()["calls"], F.concat(F.lit(T.SUPPLEMENT_CALL[0]), X.call_text(F.col("tool_name"), P.known_arguments()[0]), F.lit(T.SUPPLEMENT_CALL[1]))).otherwise("")
    tail = lambda v: F.when(F.col("category_id").isin(3, 6), T.TAIL_SAFE).otherwise(T.SUPPLEMENT_CLOSE[v])
    facts, questions, actions = T.SUPPLEMENT_FACTS, T.SUPPLEMENT_QUESTIONS, T.SUPPLEMENT_ACTIONS
    replies = (
        F.concat(opener(0), cut(facts[0], "facts", 3, "①"), call, cut(questions[0], "questions", 3, "①"), cut(actions[0], "actions", 2, "①"), tail(0)),
        F.concat(opener(1), cut(facts[1], "facts", 3, "• "), call, cut(questions[1], "questions", 3, "• "), cut(actions[1], "actions", 3, None), tail(1)),
        F.concat(opener(2), cut(actions[2], "actions", 2, "①"), call, cut(facts[2], "facts", 3, "• "), cut(questions[2], "questions", 2, "• "), tail(2)),
    )
    out = seeds.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return out.withColumn("answer", F.when(F.col("variant") == 0, replies[0]).when(F.col("variant") == 1, replies[1]).otherwise(replies[2]))
