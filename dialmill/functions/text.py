"""Column functions over text: normalisation, fuzzy coverage, tool calls, formats. No Python runs on executors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialmill.functions import rules as R

NO_STRINGS = "array<string>"


def empty() -> Column:
    return F.array().cast(NO_STRINGS)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Letters, digits and underscores only; null gives an empty string."""
    return F.regexp_replace(text_or_empty(c), r"[^\p{L}\p{N}_]+", "")


def strip_negation(c: Column) -> Column:
    """c without one leading negation."""
    return F.regexp_replace(c, "^(" + "|".join(R.NEGATIONS) + ")", "")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), "(?U)" + R.PUNCTUATION, "")


def strip(c: Column) -> Column:
    """c without white space at its ends, as Unicode defines it."""
    return F.regexp_replace(text_or_empty(c), r"(?U)^\s+|\s+$", "")


def grams(t: Column, n: int) -> Column:
    """Distinct n-character pieces of t; none where t is shorter."""
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))).otherwise(empty())


def bigrams(c: Column) -> Column:
    """Distinct adjacent pairs after punctuation is stripped; a single character stands for itself."""
    t = strip_punctuation(c)
    return F.when(F.length(t) == 1, F.array(t)).otherwise(grams(t, 2))


def phrase(c: Column, window: int = R.DEFAULT.window) -> Column:
    """What coverage needs of a phrase, computed once on the rule's side: the phrase, its pairs, its windows."""
    return F.struct(text_or_empty(c).alias("s"), bigrams(c).alias("pairs"), grams(strip_punctuation(c), window).alias("windows"))


def phrases(items: Column) -> Column:
    return F.transform(F.coalesce(items, empty()), lambda x: phrase(x))


def hit_share(pairs: Column, answer: Column) -> Column:
    """Share of the pairs found in the answer."""
    return F.size(F.filter(pairs, lambda g: F.contains(answer, g))) / F.size(pairs)


def covered(p: Column, answer: Column, ratio: float) -> Column:
    """Whether the answer has the phrase: whole, by one window, or by enough pairs; an empty phrase is covered."""
    return (
        F.when(F.contains(answer, p["s"]), True)
        .when(F.exists(p["windows"], lambda w: F.contains(answer, w)), True)
        .when(F.size(p["pairs"]) == 0, True)
        .otherwise(hit_share(p["pairs"], answer) >= ratio)
    )


def cover_count(items: Column, answer: Column, ratio: float) -> Column:
    return F.size(F.filter(items, lambda p: covered(p, answer, ratio)))


def cover_level(ok: Column, total: Column) -> Column:
    """2 for all (or nothing to cover), 1 for half or more, else 0."""
    return F.when(ok == total, 2).when(ok >= F.greatest(F.lit(1), F.floor((total + 1) / 2)), 1).otherwise(0)


def topic_share(pairs: Column, answer: Column) -> Column:
    return F.when(F.size(pairs) > 0, hit_share(pairs, answer)).otherwise(F.lit(0.0))


def number_claims(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(R.NUMBER_CLAIM), F.lit(0))


def sentences(c: Column) -> Column:
    """Pieces between sentence ends that aren't blank."""
    return F.filter(F.split(text_or_empty(c), R.SENTENCE_END), lambda s: s.rlike(r"(?U)\S"))


def tool_calls(c: Column) -> Column:
    """The JSON texts of all tagged calls."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(R.TOOL_CALL), F.lit(1))


CALL_TYPE = "struct<name:string, arguments:map<string,string>, parameters:map<string,string>>"


def parse_call(json: Column) -> Column:
    """valid, name, args and own of a call's JSON: empty ``arguments`` fall through to ``parameters`` in args, not in own."""
    got = F.from_json(json, CALL_TYPE)
    args = F.when(F.size(got["arguments"]) > 0, got["arguments"]).otherwise(F.coalesce(got["parameters"], F.create_map().cast("map<string,string>")))
    return F.struct(F.try_parse_json(json).isNotNull().alias("valid"), F.coalesce(got["name"], F.lit("")).alias("name"), args.alias("args"), F.coalesce(got["arguments"], F.create_map().cast("map<string,string>")).alias("own"))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} replaced by the values."""
    return fill_any(F.lit(template), **values)


def fill_any(template: Column, **values: Column) -> Column:
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), text_or_empty(value))
    return out


def coverage_text(ok: Column, total: Column) -> Column:
    """Covered of all, as k/n."""
    return F.concat_ws("/", ok.cast("string"), total.cast("string"))


def pick_from(options: Column, *key: Column | str) -> Column:
    """As ``pick``, from an array that isn't empty."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]).cast("binary")), 1, 7), 16, 10).cast("long")
    return F.element_at(options, (n % F.size(options) + 1).cast("int"))


def label(name: Column, names: dict[str, str], default: Column) -> Column:
    """The label of a name, or the default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), name), default)


def rotated(options: Sequence[str], variant: Column) -> Column:
    """The options in turn."""
    return F.element_at(F.array(*map(F.lit, options)), (variant % len(options) + 1).cast("int"))


def json_object(c: Column) -> Column:
    """From the first { to the last } of a reply, null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def call_text(name: Column, args: Column) -> Column:
    """The tagged text of a call with compact arguments."""
    return F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), F.to_json(args), F.lit("}\n</tool_call>"))


def unsourced(args: Column, known: Column) -> Column:
    """Argument entries whose value is neither empty, nor in the known text, nor shaped like a date; null counts as unsourced."""
    value = lambda e: F.coalesce(e["value"], F.lit("None"))
    return F.filter(F.map_entries(args), lambda e: (value(e) != "") & ~F.contains(known, value(e)) & ~value(e).rlike(R.DATE_SHAPE))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text_or_empty(c), F.lit(w)) for w in words], F.lit(False))


def hits(c: Column, words: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text_or_empty(c), w))


def is_half(c: Column, limit: int = R.DEFAULT.half_length) -> Column:
    """A short reply without numbered items or a call."""
    return (F.length(c) < limit) & ~F.contains(c, F.lit(R.CIRCLED[0])) & ~F.contains(c, F.lit("<tool_call>"))


def clean_scenario(c: Column) -> Column:
    """c without the known prefixes, each at most once and in order, then without a leading customer noun."""
    out = strip(c)
    for p in (*R.SCENARIO_PREFIXES, R.CUSTOMER):  # anchored replacements: each step reads the last one once
        out = F.regexp_replace(out, f"^\\Q{p}\\E", "")
    return out


def situation(scenario: Column, role: Column) -> Column:
    """The scenario in the caller's voice."""
    s = F.regexp_replace(clean_scenario(scenario), f"^\\Q{R.ASKING}\\E", R.ASKED)
    return F.replace(s, F.lit(R.CUSTOMER), F.when(role.isin(*R.PROXY_ROLES), R.OWNER).otherwise(R.SELF))


def numeral(n: Column) -> Column:
    """Number as a numeral; 2 counts things, beyond the table plain digits."""
    return F.when(n == 2, R.PAIR).when(n.between(1, len(R.NUMERALS)), F.element_at(F.array(*map(F.lit, R.NUMERALS)), F.greatest(n, F.lit(1)).cast("int"))).otherwise(n.cast("string"))


def numbered(items: Column) -> Column:
    """Items with circled marks, joined and closed; beyond the marks the number in brackets."""
    marks = F.array(*map(F.lit, R.CIRCLED))
    each = F.transform(items, lambda x, i: F.concat(F.coalesce(F.get(marks, i), F.format_string("(%d)", i + 1)), x))
    return F.when(F.size(items) > 0, F.concat(F.array_join(each, "；"), F.lit("。"))).otherwise("")


def head(c: Column, separators: str, most: int, default: str) -> Column:
    """The first piece of c between separators, cut to most characters; default where empty."""
    return F.coalesce(F.nullif(F.left(F.get(F.split(text_or_empty(c), separators), F.lit(0)), F.lit(most)), F.lit("")), F.lit(default))


def pick(options: Sequence[str], *key: Column | str) -> Column:
    """A choice that depends on the key alone: the first seven hex digits of its md5 count round the options."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]).cast("binary")), 1, 7), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))


def digits(n: int, *key: Column | str) -> Column:
    """n digits that depend on the key alone."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]).cast("binary")), 1, 12), 16, 10)
    return F.right(F.concat(F.lit("0" * n), h), F.lit(n))


def call_block(name: Column, args: Column) -> Column:
    """The tagged text of a call; args is a map."""
    return F.concat(F.lit("<tool_call>\n"), F.to_json(F.struct(name.alias("name"), args.alias("arguments"))), F.lit("\n</tool_call>"))


def cache_key(kind: str, judge: str, key: Column, tag: str, *parts: Column) -> Column:
    """kind|judge|key|tag|first 16 hex digits of the parts' sha1."""
    return F.concat_ws("|", F.lit(kind), F.lit(judge), key.cast("string"), F.lit(tag), F.left(F.sha1(F.concat_ws("\n", *parts).cast("binary")), F.lit(16)))


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def html_answer(c: Column) -> Column:
    """An answer for a page: escaped, its call tags in a span."""
    out = F.replace(html_escape(c), F.lit("&lt;tool_call&gt;"), F.lit('<span class="tc">&lt;tool_call&gt;'))
    return F.replace(out, F.lit("&lt;/tool_call&gt;"), F.lit("&lt;/tool_call&gt;</span>"))


def html_escape(c: Column) -> Column:
    out = text_or_empty(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
