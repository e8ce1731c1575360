"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Word unigrams and bigrams are hashed to BUCKETS. Counts over all documents give the raw multinomial; counts over all
trusted documents (good and not toxic by label) give the target's, smoothed towards the raw one. A document's score is
the mean of log(target/raw) over its n-grams, in millionths; it is kept when no base rule fails it and its score reaches
the threshold: the exact KEEP quantile of the scores of all trusted documents of 50 words or more, less MARGIN. Nothing
is sampled. The table of ratios has BUCKETS integers whatever the corpus, and travels as a literal in the plan; the
trusted documents' buckets are kept in the shared folder, since their counts and, with the table, their scores need them.

Defined cases: a null text has no word, line or symbol; a document without a word scores 0 and fails the base rules; an
empty label table leaves the base rules alone; repeated rows keep a row each; clashing columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.llm.text import words
from dialmill.runtime import fits_broadcast, placed, stash, without

BUCKETS, KEEP, MARGIN, SMOOTH = 1 << 14, 0.002, 20_000, 20_000.0
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def hashes(df: DataFrame, text_col: str) -> DataFrame:
    """df with __w, the words, and __h, their hashes. Each array is read more than once later, so plans keep it apart."""
    return df.withColumn("__w", words(F.col(text_col))).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))


def buckets() -> Column:
    """The buckets of the unigrams and bigrams over __h."""
    one = F.transform("__h", lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(F.slice("__h", F.lit(1), F.greatest(F.size("__h") - 1, F.lit(0))), F.slice("__h", F.lit(2), F.greatest(F.size("__h") - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every id whose labels are all good, once, in the shared folder."""
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good")).filter("good")
    return stash(good.select("__id"), "trusted-ids")


def trusted_grams(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__n, the number of words, and __b, the buckets, of every trusted document, in the shared folder.

    The ids are broadcast when they fit; otherwise texts are shuffled once, past tables of ids, so that none is sorted.
    """
    side = F.broadcast(trusted) if fits_broadcast(trusted) else trusted.hint("shuffle_hash")
    known = docs.select(id_col, text_col).join(side, F.col(id_col) == F.col("__id"), "left_semi")
    return stash(hashes(known, text_col).select(F.size("__h").alias("__n"), buckets().alias("__b")), "trusted-grams")


def counted(df: DataFrame, grams: Column) -> dict[int, int]:
    """How often each bucket is in grams; BUCKETS rows at most. A generator takes grams as it is, so that no filter repeats it."""
    return {r.b: r.n for r in df.select(F.explode(grams).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> list[int]:
    """Millionths of log(target/raw) by bucket; raw counts come from all documents, target counts from all trusted ones (known)."""
    target = counted(trusted_grams(docs, trusted, id_col, text_col) if known is None else known, F.col("__b"))
    raw = counted(hashes(docs.select(text_col), text_col), buckets())
    n, m = sum(raw.values()), sum(target.values())
    out = [0] * BUCKETS
    if m:
        for b, k in raw.items():
            p = (k + 1) / (n + BUCKETS)
            out[b] = round(1e6 * math.log((target.get(b, 0) + SMOOTH * p) / (m + SMOOTH) / p))
    return out


def quantile(df: DataFrame, col: str, share: float) -> float | None:
    """The exact quantile of a column without nulls, between its two nearest values as percentile has it; None for no rows.

    A range sort finds the values by their places: percentile would hold every distinct one in a single task. Equal
    values are told apart, so that many of them are spread over tasks.
    """
    at = F.lit(share) * (F.col("__size") - 1)
    near = placed(df.select(col, F.monotonically_increasing_id().alias("__tie")), [], [col, "__tie"]).filter(F.col("__place").between(F.floor(at), F.ceil(at)))
    rows = near.select("__place", F.col(col).alias("x"), at.alias("at")).orderBy("__place").collect()  # two at most
    if not rows:
        return None
    low, high = rows[0], rows[-1]
    return low.x + (low.at - low["__place"]) * (high.x - low.x)


def score(table: list[int]) -> Column:
    """The mean of the table's entries over __b; the table is folded to a literal once per task."""
    llr = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    total = F.aggregate("__b", F.lit(0).cast("long"), lambda a, b: a + F.get(llr, b))
    return F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(F.lit(0.0))


def repeated_words(df: DataFrame) -> DataFrame:
    """df with n_repeat_words from __h: the words that lie in a three-word window found twice or more.

    Windows are sorted with their places; equal neighbours mark repeats; each marked place covers the words up to the
    next marked place, three at most. Linear memory and n log n time in the length of a text.
    """
    n = F.size("__h")
    spots = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__g", F.transform(spots, lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2))))
    twice = F.size(F.array_distinct("__g")) < F.size("__g")
    df = df.withColumn("__s", F.when(twice, F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    again = F.filter("__s", lambda e, k: F.coalesce(e["g"] == F.get(F.col("__s"), k - 1)["g"], F.lit(False)) | F.coalesce(e["g"] == F.get(F.col("__s"), k + 1)["g"], F.lit(False)))
    df = df.withColumn("__p", F.sort_array(F.transform(again, lambda e: e["i"])))
    gaps = F.aggregate(F.sequence(F.lit(0), F.size("__p") - 1), F.lit(0).cast("long"), lambda a, k: a + F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), k + 1) - F.get(F.col("__p"), k), F.lit(3))))
    return df.withColumn("n_repeat_words", F.when(F.size("__p") > 0, gaps).otherwise(F.lit(0).cast("long"))).drop("__g", "__s", "__p")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """docs' columns (text included) with the base columns, base_failed, score and kept."""
    docs = without(docs, [*OWN, "__id", "__w", "__h", "__b"])
    trusted = trusted_ids(labels, label_id)
    known = trusted_grams(docs, trusted, id_col, text_col)
    table = ratios(docs, trusted, id_col, text_col, known)
    low = quantile(known.filter("__n >= 50").select(score(table).alias("s")), "s", KEEP)
    least = -math.inf if low is None else low - MARGIN
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = hashes(docs, text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long"), "__l": lines, "__b": buckets(),
    })
    out = out.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).withColumn("score", score(table))
    out = repeated_words(out).drop("__l", "__b", "__w", "__h")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
    # The results pass through a generator, so that no later filter is pushed into, and repeats, the expressions above.
    return out.select(*docs.columns, F.inline(F.array(F.struct(*OWN))))
