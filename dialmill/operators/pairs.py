"""Preference pairs: candidates, filters, quotas and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialmill.functions import phrases as T
from dialmill.functions import rules as R
from dialmill.functions import text as X
from dialmill.operators import score as S
from dialmill.runtime import fits_broadcast, placed, stash


def margin_reason(rules: R.Rules = R.DEFAULT) -> Column:
    """null where a pair passes, else why not: ``margin`` or ``length``. Columns: score_chosen, score_rejected, len_chosen, len_rejected."""
    m = F.col("score_chosen") - F.col("score_rejected")
    longer = (F.col("len_rejected") > 0) & (F.col("len_chosen") >= rules.length_ratio * F.col("len_rejected")) & (m < rules.length_margin)
    return F.when(m < rules.margin, "margin").when(longer, "length")


def defect_type(scores: bool = True) -> Column:
    """Defect class of a scored answer: safety, then fabrication, then tool use, then completeness; null for none (P5).

    Without scores the completeness class needs the flag of a half answer.
    """
    safety = F.col("category_id").isin(3, 6) & (F.coalesce(F.col("safety_missing"), F.lit(False)) | F.coalesce(F.col("rescue_missing"), F.lit(False)))
    tool = F.coalesce(F.col("call_missing"), F.lit(False)) | F.col("needless_call")
    return F.when(safety, "safety").when(F.col("bad_call"), "fabrication").when(tool, "tool").when(F.col("half_answer") | (F.col("completeness") <= 1) if scores else F.col("half_answer"), "completeness")


def half_base(questions: Column) -> Column:
    """A reply that only asks the head of the first question."""
    return F.concat(F.lit(T.HALF), X.head(F.get(questions, F.lit(0)), "以及|和|、|，", 14, T.HALF_DEFAULT), F.lit("。"))


def parts() -> dict[str, Column]:
    """Seed columns under short names; properties are the parameter names of a registered tool, null for others."""
    lists = {n: F.coalesce(F.col(f"required_{n}"), X.empty()) for n in ("facts", "questions", "actions")}
    return lists | {"cat": F.col("category_id"), "sc": F.col("scenario"), "goal": X.text_or_empty(F.col("user_goal")), "props": F.coalesce(F.col("properties"), X.empty()), "calls": F.coalesce(F.col("tool_required"), F.lit(False)) & F.col("tool_name").isNotNull() & F.col("properties").isNotNull()}


def with_registry(seeds: DataFrame, tools: DataFrame) -> DataFrame:
    """seeds with ``properties`` of their tool (J2); a registry is small by its nature, and its size is checked."""
    t = stash(tools.select(F.col("tool_name").alias("__tool"), "properties"), "registry")
    return seeds.join(F.broadcast(t) if fits_broadcast(t.select("__tool")) else t, seeds["tool_name"] == t["__tool"], "left").drop("__tool")


def known_arguments() -> tuple[Column, Column]:
    """Arguments filled from the customer's goal (free-text names only), and the names still to be asked for."""
    p = parts()
    is_free = lambda n: n.isin(*T.FREE_TEXT) & (p["goal"] != "")
    filled = F.transform(F.filter(p["props"], is_free), lambda n: F.struct(n.alias("key"), p["goal"].alias("value")))
    return F.map_from_entries(filled), F.filter(p["props"], lambda n: ~is_free(n))


def by_category(texts: tuple, **values: Column) -> Column:
    """The text for category 3, for 6, or the last one, filled."""
    cat = F.col("category_id")
    return F.when(cat == 3, X.fill(texts[0], **values)).when(cat == 6, X.fill(texts[1], **values)).otherwise(X.fill(texts[2], **values))


def listed(lead: Column | str, items: Column, counted: str | None = None) -> Column:
    """A lead, the number of items where a counter follows, and the numbered items; nothing for no item."""
    lead = F.lit(lead) if isinstance(lead, str) else lead
    count = [X.numeral(F.size(items)), F.lit(counted)] if counted else []
    return F.when(F.size(items) > 0, F.concat(lead, *count, X.numbered(items))).otherwise("")


def chosen(variant: Column) -> Column:
    """A full reply of the first pair set (P1): opener, facts, call with what is missing, questions, actions, closing."""
    p = parts()
    args, missing = known_arguments()
    lead = F.when(p["cat"] == 6, T.CALL_RESCUE_1).otherwise(T.CALL_1)
    ask = listed(T.MISSING_1, F.transform(missing, lambda n: X.label(n, T.LABELS, F.concat(F.lit("「"), n, F.lit("」对应信息")))))
    call = F.when(p["calls"], F.concat(lead, X.call_text(F.col("tool_name"), args), F.lit(T.CALL_AFTER_1), ask)).otherwise("")
    return F.concat(
        F.when(variant == 0, by_category(T.OPEN_1[0], sc=p["sc"])).otherwise(by_category(T.OPEN_1[1], sc=p["sc"])), listed(T.FACTS_1, p["facts"], T.COUNTED_1), call,
        listed(T.QUESTIONS_1, p["questions"], "点："), listed(T.ACTIONS_1, p["actions"]), F.lit(T.CLOSE_1), F.when(p["cat"].isin(3, 6), T.TAIL_SAFE).otherwise(T.TAIL),
    )


def chosen_style(style: Column, salt: str = "style") -> Column:
    """A full reply of the second pair set in one of three styles."""
    p = parts()
    args, missing = known_arguments()
    lead = F.when(p["cat"] == 6, T.CALL_RESCUE_2).otherwise(X.rotated(T.CALLS_2, style))
    ask = listed(T.MISSING_2, F.transform(missing, lambda n: X.label(n, T.LABELS, n)))
    call = F.when(p["calls"], F.concat(lead, X.call_text(F.col("tool_name"), args), F.lit(T.CALL_AFTER_2), ask)).otherwise("")
    rest = F.concat(call, listed(X.rotated(T.QUESTIONS_2, style), p["questions"], "点："), listed(F.concat(X.rotated(T.ACTIONS_2, style), F.lit("：")), p["actions"]))
    safe = lambda texts: F.when(p["cat"] == 3, texts[0]).when(p["cat"] == 6, texts[1]).otherwise("")
    opener = X.fill_any(X.pick(T.OPEN_A, F.col("seed_id"), salt), sc=p["sc"])
    tail = F.when(p["cat"].isin(3, 6), T.TAIL_SAFE).otherwise(T.TAIL)
    return (
        F.when(style % 3 == 0, F.concat(opener, safe(T.SAFE_A), listed(T.FACTS_2[0], p["facts"]), rest, F.lit(T.CLOSE_2[0])))
        .when(style % 3 == 1, F.concat(by_category(T.OPEN_B, sc=p["sc"]), listed(T.FACTS_2[1][0], p["facts"], T.FACTS_2[1][1]), rest, tail))
        .otherwise(F.concat(X.fill(T.OPEN_C, sc=p["sc"]), safe(T.SAFE_C), listed(T.FACTS_2[2], p["facts"]), rest, F.lit(T.CLOSE_2[1])))
    )


def invented(default: Column) -> Column:
    """Every parameter of the seed's tool with an invented value."""
    return F.map_from_entries(F.transform(parts()["props"], lambda n: F.struct(n.alias("key"), X.label(n, T.INVENTED, default).alias("value"))))


def rejected(defect: Column, idx: Column, second: bool = False) -> Column:
    """A reply degraded by defect class, of the first pair set (P4) or the second."""
    p = parts()
    base, fake, unsafe = half_base(p["questions"]), T.FAKE_2 if second else T.FAKE_1, T.UNSAFE_2 if second else T.UNSAFE_1
    default = F.concat(F.lit("VID"), X.digits(5, F.col("seed_id"), "vid")) if second else F.concat(F.lit(T.INVENTED["feature_name"]), (idx % 10).cast("string"))
    registered = F.col("tool_name").isNotNull() & F.col("properties").isNotNull()
    return (
        F.when(defect == "tool", F.concat(base, F.lit(T.NOTED)))
        .when((defect == "fabrication") & ~registered, F.concat(base, F.lit(T.CLAIM_2 if second else T.CLAIM_1)))
        .when(defect == "fabrication", F.concat(base, F.lit(fake[0]), X.call_text(F.col("tool_name"), invented(default)), F.lit(fake[1])))
        .when((defect == "safety") & (p["cat"] == 3), F.concat(base, F.lit(unsafe[0])))
        .when(defect == "safety", F.concat(base, F.lit(unsafe[1])))
        .otherwise(base)
    )


def exploded(seeds: DataFrame, name: str, values: tuple) -> DataFrame:
    """Seeds times literals: an explode, no join."""
    return seeds.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def totals(rows: DataFrame, text: str, tools: list[str], name: str) -> DataFrame:
    """rows (seed columns and a text) with the text's rule score and length as score_<name> and len_<name>."""
    lists = list(S.LISTS)
    done = S.score(S.prepared(rows.withColumn("answer", F.col(text))), tools)
    kept = [c for c in rows.columns if c not in lists]
    return done.select(*[c for c in kept if c in done.columns], *lists, F.col("total").alias(f"score_{name}"), F.length(text).alias(f"len_{name}"))


def best_chosen(seeds: DataFrame, tools: list[str], least: int = R.DEFAULT.chosen_least) -> DataFrame:
    """Each seed with the first variant of ``chosen`` that reaches least, else the best (P2, W4); ``reached`` says which."""
    both = exploded(seeds, "variant", (0, 1)).withColumn("chosen", chosen(F.col("variant")))
    return best_variant(totals(both, "chosen", tools, "chosen").withColumnRenamed("score_chosen", "total"), "seed_id", least).withColumnRenamed("total", "score_chosen").withColumn("reached", F.col("score_chosen") >= least)


DEFECT_ORDER = ("safety", "tool", "fabrication", "completeness")


def pools(train: DataFrame, used: DataFrame) -> DataFrame:
    """(seed columns, defect, priority): candidate seeds of each defect class that aren't used yet."""
    need, cat = F.coalesce(F.col("tool_required"), F.lit(False)), F.col("category_id")
    fits = {"safety": cat.isin(3, 6), "tool": need & ~cat.isin(3, 6), "fabrication": need & ~cat.isin(3, 6), "completeness": F.lit(True)}
    free = train.join(used.select("seed_id").distinct(), "seed_id", "left_anti")
    each = F.array_compact(F.array(*[F.when(fits[d], F.lit(d)) for d in DEFECT_ORDER]))
    return free.withColumn("defect", F.explode(each)).withColumn("priority", F.when((F.col("defect") == "completeness") & need, 1).otherwise(0))


def filled(train: DataFrame, real: DataFrame, tools: list[str], targets: dict[str, int], most: int, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Synthetic pairs (P8) that bring each class of the real pairs (seed_id, defect) to its target.

    Of each class's pool every step-th seed is a candidate, twice as many as are needed (W6); the first that pass the
    filters are taken until the class has enough or all pairs together are ``most`` (W7). A candidate's number among
    those accepted goes into its invented values.
    """
    have = {r.defect: r.n for r in real.groupBy("defect").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    need = {d: max(0, targets[d] - have.get(d, 0)) for d in DEFECT_ORDER}
    room = most - sum(have.get(d, 0) for d in DEFECT_ORDER)
    need_of = F.element_at(F.create_map(*[F.lit(x) for kv in need.items() for x in kv]), F.col("defect"))
    pool = placed(pools(train, real).withColumn("__need", need_of).filter("__need > 0"), ["defect"], ["priority", "seed_id"])
    step = F.greatest(F.lit(1), F.floor(F.col("__size") / (2 * F.col("__need"))))
    cands = pool.filter((F.col("__place") % step == 0) & (F.col("__place") / step < 2 * F.col("__need")))
    cands = stash(cands.withColumnRenamed("__place", "at").drop("__size", "priority"), "pair-candidates")
    best = best_chosen(cands.drop("defect", "at", "__need").dropDuplicates(["seed_id"]), tools, rules.chosen_least).filter("reached").select("seed_id", "chosen", "score_chosen", "len_chosen")
    rows = cands.join(best, "seed_id").withColumn("rejected", rejected(F.col("defect"), F.lit(0)))
    ok = totals(rows, "rejected", tools, "rejected").filter(margin_reason(rules).isNull())
    ok = ok.withColumn("idx", F.row_number().over(Window.partitionBy("defect").orderBy("at")) - 1).filter(F.col("idx") < F.col("__need"))  # 2 * need rows a class
    order = F.array_position(F.array(*map(F.lit, DEFECT_ORDER)), F.col("defect"))
    ok = ok.withColumn("__all", F.row_number().over(Window.orderBy(order, "idx"))).filter(F.col("__all") <= room)  # the targets' sum at most
    return ok.withColumn("rejected", rejected(F.col("defect"), F.col("idx"))).select("seed_id", "category_id", "defect", "idx", "scenario", "user_goal", "chosen", "rejected", "score_chosen", "score_rejected", "len_chosen", "len_rejected")


def collect_real(evaluated: DataFrame, seeds: DataFrame, tools: list[str], rules: R.Rules = R.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(pairs, drops) from evaluated answers (key, seed_id, total, len, flags, completeness, bad): P7, J4 to J6.

    Bad cases come first, completeness standing in for an unknown class; then whatever else has a defect by its flags
    alone, which takes in bad cases that the filters refused. Drops are (reason, n), the most frequent first.
    """
    best = best_chosen(seeds, tools, rules.chosen_least).select(F.col("seed_id").alias("__seed"), "category_id", "score_chosen", "len_chosen", "reached")
    best = stash(best, "pair-chosen")
    rows = evaluated.drop("category_id").join(F.broadcast(best) if fits_broadcast(best.select("__seed")) else best, F.col("seed_id") == F.col("__seed"), "left")
    rows = rows.withColumnsRenamed({"total": "score_rejected", "len": "len_rejected"})
    known, reached = F.col("__seed").isNotNull(), F.coalesce(F.col("reached"), F.lit(False))
    rows = rows.withColumn("typed", defect_type()).withColumn("by_flags", defect_type(scores=False)).withColumn("why", margin_reason(rules))
    a = F.when(~F.col("bad"), "-").when(~known, "bad case: no seed").when(~reached, "bad case: chosen too low").when(F.col("why").isNotNull(), F.concat(F.lit("bad case: "), F.coalesce("typed", F.lit("completeness")), F.lit(" filtered"))).otherwise("pair")
    rows = rows.withColumn("__a", a)
    b = F.when((F.col("__a") == "pair") | ~known | F.col("by_flags").isNull(), "-").when(~reached, "supplement: chosen too low").when(F.col("why").isNotNull(), F.concat(F.lit("supplement: "), F.col("by_flags"), F.lit(" filtered"))).otherwise("pair")
    rows = stash(rows.withColumn("__b", b), "pair-real")
    source = F.when(F.col("__a") == "pair", "bad_case").when(F.col("__b") == "pair", "eval_supplement")
    defect = F.when(F.col("__a") == "pair", F.coalesce("typed", F.lit("completeness"))).otherwise(F.col("by_flags"))
    pairs = rows.withColumn("source", source).filter("source IS NOT NULL").withColumn("defect", defect).drop("__a", "__b", "__seed", "typed", "by_flags", "why", "reached")
    drops = rows.select(F.explode(F.array("__a", "__b")).alias("reason")).filter("reason NOT IN ('-', 'pair')").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return pairs, drops.orderBy(F.desc("n"), "reason")


def second_set(train: DataFrame, tools: list[str], rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Pairs of the second set (P14): seeds times three styles times four defects, each text scored once, then filtered."""
    full = totals(exploded(train, "style", (0, 1, 2)).withColumn("chosen", chosen_style(F.col("style"))), "chosen", tools, "chosen").filter(F.col("score_chosen") >= rules.chosen_least)
    poor = totals(exploded(train, "defect", DEFECT_ORDER).withColumn("rejected", rejected(F.col("defect"), F.lit(0), True)), "rejected", tools, "rejected")
    both = full.select("seed_id", "category_id", "style", "scenario", "user_goal", "chosen", "score_chosen", "len_chosen").join(poor.select("seed_id", "defect", "rejected", "score_rejected", "len_rejected"), "seed_id")
    return both.filter(margin_reason(rules).isNull())


def shuffled(key: str, seed: str) -> Column:
    """Order of a reproducible shuffle: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def quota(pairs: DataFrame, by: str, key: str, caps: dict[str, int], default: int, seed: str = "quota") -> DataFrame:
    """At most cap rows of each class, in shuffled order (W5); ties by key."""
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(by)), F.lit(default)) if caps else F.lit(default)
    return placed(pairs, [by], [shuffled(key, seed), key]).filter(F.col("__place") < cap).drop("__place", "__size")


def selected(pairs: DataFrame, by: str, key: str, caps: dict[str, int], default: int, most: int) -> DataFrame:
    """Quotas per class, then a shuffle cut to ``most``."""
    return sample(quota(pairs, by, key, caps, default), key, most, "final")


def sample(rows: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows by shuffled order."""
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def every_nth(pool: DataFrame, by: str, key: str, need: int) -> DataFrame:
    """Systematic sample of each class: every step-th row in key order, step = max(1, size // (2 need)), 2 need rows at most."""
    step = F.greatest(F.lit(1), F.floor(F.col("__size") / (2 * need)))
    out = placed(pool, [by], [key]).filter((F.col("__place") % step == 0) & (F.col("__place") / step < 2 * need))
    return out.drop("__place", "__size")


def best_variant(variants: DataFrame, key: str, least: int = R.DEFAULT.chosen_least) -> DataFrame:
    """Per key the first variant whose total reaches least, else the best, ties to the first."""
    reached = F.col("total") >= least
    order = [F.when(reached, 0).otherwise(1), F.when(reached, F.col("variant")), F.when(~reached, -F.col("total")), F.col("variant")]
    return variants.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def trainer_rows(pairs: DataFrame, system: str) -> DataFrame:
    """prompt (the system's text and the question), chosen and rejected as message arrays."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return pairs.select(F.array(m("system", F.lit(system)), m("user", F.col("question"))).alias("prompt"), F.array(m("assistant", F.col("chosen"))).alias("chosen"), F.array(m("assistant", F.col("rejected"))).alias("rejected"))


def bad_trainer_rows(rows: DataFrame) -> DataFrame:
    """Rows that a trainer would refuse: a list missing or empty, or a wrong first role (F14). A missing column raises."""
    if lacking := {"prompt", "chosen", "rejected"} - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(lacking)}")
    first = lambda c, role: F.coalesce((F.size(c) > 0) & (F.get(F.col(c), F.lit(0))["role"] == role), F.lit(False))
    return rows.filter(~(first("prompt", "system") & first("chosen", "assistant") & first("rejected", "assistant")))
