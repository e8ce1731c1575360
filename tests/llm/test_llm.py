"""The training-data operators against brute force, round trips and held-out accuracy, and on edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from dialmill import runtime
from dialmill.llm import bpe, langid, mixing, neardup, pii, quality, queries, sharding, topk, urlrules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, equal texts."""
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    rows = [(1, "the cat sat on the mat and then it slept", "en", "a", 1), (1, "the cat sat on the mat and then it slept", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "fr", None, 3), (5, long, "en", "a", len(long)), (None, "le chat est sur la table et il dort", "fr", "b", 5), (6, "123 456 !!", None, "a", 10), (7, "le chat est sur la table et il dort", "fr", "é", 5), (8, "x", "de", "z", 1)]
    return spark.createDataFrame(rows, DOCS)


def clash(df):
    """Extra columns named like outputs."""
    names = ["size", "target", "taken", "rate", "copies", "source_size", "lang_pred", "Score", "n_tokens", "IDS", "spans", "n_email", "kept", "host", "rule", "verdict", "shard", "slot", "block", "class_id", "rank", "digest"]
    return df.withColumns({n: F.lit("clash") for n in names})


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, sf):
    got = queries.op1_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_language_brute_force():
    texts = ["Über den Wolken!", "l'été, où ça", "A b", "", None, "??"]
    codes, starts = langid.letters(texts)
    got = defaultdict(Counter)
    for own, bucket in langid.grams(codes, starts):
        for o, b in zip(own, bucket):
            got[o][b] += 1
    for i, t in enumerate(texts):
        s = "\0" + re.sub(r"[^a-zäöüßéèàçêôâîûù]+", "\0", (t or "").lower()) + "\0"
        s = re.sub("\0+", "\0", s)
        n = sum(sum(1 for k in range(len(s) - j + 1) if j > 1 or s[k] != "\0") for j in langid.ORDERS)
        assert sum(got[i].values()) == n


def test_language_windows_agree(monkeypatch):
    counts = np.random.default_rng(0).integers(0, 50, (1 << langid.BITS, 3)).astype(float)
    model = langid.Model(["a", "b", "c"], counts, np.array([5.0, 1.0, 1.0]))
    texts = ["hello world this is a text", "x", None, "ééé " * 100]
    one = model.predict(texts)
    monkeypatch.setattr(langid, "WINDOW", 7)
    two = model.predict(texts)
    assert one[0] == two[0] and np.array_equal(one[1], two[1]) and [model.predict([t])[0][0] for t in texts] == one[0]


def test_language_posterior_brute_force(spark):
    """Every prediction and score against Bayes' rule over counted n-grams; letterless texts teach nothing, no language either."""
    train = [("a", "the cat and the dog"), ("a", "the end of the day"), ("b", "le chat et le chien"), ("b", "la fin du jour"), ("b", "où est le chat"), ("zz", "123"), ("zz", "?!"), ("zz", ""), ("a", "42"), (None, "the cat"), ("b", None)]
    rows = [(i, t, v) for i, (v, t) in enumerate(train)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["a", "b"]
    own = {v: [t for w, t in train if w == v and t and any(c.isalpha() for c in t)] for v in "ab"}

    def counted(texts):
        got = Counter()
        for _, bucket in langid.grams(*langid.letters(texts)):
            got.update(bucket.tolist())
        return got

    counts, n = {v: counted(t) for v, t in own.items()}, 1 << langid.BITS
    for text in ["the chat", "le jour", "où the", "cat cat cat", "xyz"]:
        log = {v: math.log((len(own[v]) + 1) / (5 + 2)) + sum(k * math.log((counts[v][b] + 0.5) / (counts[v].total() + 0.5 * n)) for b, k in counted([text]).items()) for v in "ab"}
        best = max(log, key=log.get)
        (lang,), (score,) = model.predict([text])
        assert lang == best and score == pytest.approx(1 / sum(math.exp(x - log[best]) for x in log.values()), abs=1e-3)


def test_language_odd_rows(spark):
    d = clash(odd_docs(spark))
    model = langid.train(d)
    got = langid.predict(d, model)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == 10 and "Score" not in got.columns and rows[2, None].lang_pred == "und" and rows[6, "123 456 !!"].lang_pred == "und" and rows[3, ""].score == 0
    assert langid.predict(d, langid.train(d.limit(0))).filter("lang_pred <> 'und'").count() == 0 and langid.predict(d.limit(0), model).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def brute_top(vectors, k):
    v = {i: [math.floor(1024 * x) for x in e] for i, e in vectors if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in sorted(v):
        s = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:k]
        out += [(q, n + 1, c, -m) for n, (m, c) in enumerate(s)]
    return out


def test_top_k_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(5)]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [float("nan")] * 5), (63, [float("inf")] * 5), (None, [1.0] * 5), (64, []), (65, [1.0, 1.0]), (66, [0.0] * 5)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>").drop("rank"))
    want = brute_top([(i, list(e) + [0.0] * (5 - len(e)) if e is not None else None) for i, e in rows], 4)
    for block in (7, 8192):
        got = topk.top_k(df, df, k=4, block_rows=block, query_rows=11)
        assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(two, two).collect())) == [(0, 1, 100, 2 * 1024 * 1024), (100, 1, 0, 2 * 1024 * 1024)]
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    assert topk.top_k(huge, huge).first().score == (1 << 63) - 1


def test_top_k_repeated_ids(spark):
    """A repeated id with different vectors: every row is a candidate, and asks, as in OP2_SQL."""
    rows = [(0, [1.0]), (1, [1.0]), (1, [3.0]), (1, [3.0]), (2, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.filter("vec_id = 0"), k=10)
    assert [(r.vec_id, r.score >> 20) for r in got.orderBy("rank").collect()] == [(1, 3), (2, 2), (1, 1)]


def test_top_k_stops_early():
    block = np.zeros((1000, 3))
    block[:, 0] = np.arange(1000)
    lists = topk.Lists(np.arange(1000), block)
    assert lists.top(-1, np.array([1.0, 0.0, 0.0]), 3)[0].tolist() == [999, 998, 997] and lists.scored == topk.DEPTH and lists.top(-1, np.array([-1.0, 0.0, 0.0]), 3)[0].tolist() == [0, 1, 2]


# --- 3 ---------------------------------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), ceiling=3):
    """Targets by rounds: whoever is above its ceiling stops there, the rest is shared again by weight."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[i % 3] for i in free)
        share = {i: rest * weights[i % 3] / w for i in free}
        over = [i for i in free if share[i] > ceiling * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: ceiling * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 1], [1, 1000, 1, 5, 80, 3], [7], [0, 5, 9]])
def test_targets_by_rounds(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(water(sizes))


def test_mix(spark, sf):
    d = odd_docs(spark)
    plan = mixing.plan_mix(clash(d))
    rows = plan.collect()
    assert len(rows) == 10 and all(r.taken <= 3 * r.size for r in rows) and {r.doc_id: r.size for r in rows}[2] == 0
    assert all(r.size == len(WORD.findall(r.text or "")) for r in rows)
    assert sorted(map(str, mixing.plan_mix(d.repartition(3)).select("doc_id", "taken").collect())) == sorted(map(str, plan.select("doc_id", "taken").collect()))
    assert mixing.mix(d).count() == sum(r.copies for r in rows) and mixing.mix(d).columns == d.columns and mixing.plan_mix(d.limit(0)).count() == 0
    full = mixing.plan_mix(documents(spark, sf)).groupBy().agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).first()
    assert 0.7 < full.t / full.s < 1.3


@pytest.mark.parametrize("ids", ["null", "same", "rows"])
def test_mix_without_distinct_ids(spark, ids):
    """Null ids, one repeated id, and one row 9,000 times: each source's words still come near its target."""
    rows = [(None if ids == "null" else 7 if ids == "same" else i, "one two three" if ids == "rows" and i % 3 == 0 else f"text {i} of {'many ' * (i % 5)}", f"s{i % 5}", "en") for i in range(30_000)]
    if ids == "rows":
        rows = [(0, r[1], "s0", "en") if r[1] == "one two three" else r for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plan = mixing.plan_mix(df)
    assert plan.count() == len(rows)
    for r in plan.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t / r.g - 1) < 0.05
    again = mixing.plan_mix(df.repartition(7))
    assert plan.groupBy("text", "source").agg(F.sum("copies")).exceptAll(again.groupBy("text", "source").agg(F.sum("copies"))).count() == 0
    assert mixing.mix(df).count() == plan.agg(F.sum("copies")).first()[0]


def test_mix_without_broadcast(spark, monkeypatch):
    import dialmill.runtime as rt

    want = sorted(map(str, mixing.plan_mix(odd_docs(spark)).select("doc_id", "size", "target", "taken").collect()))
    monkeypatch.setattr(rt, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.plan_mix(odd_docs(spark)).select("doc_id", "size", "target", "taken").collect())) == want


# --- 4 ---------------------------------------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in urlrules.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [None, "", "no scheme.org/", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/12/", "http://notexample.org/es/1", "http://x.com/fr/", "http://com/de/1", "http://x.com?u=http://y.org/", "http://x.org", "http://x.org:80/", "ftp://É.org/", "http://a.com/de", "://b.org/", "http://x.net/en/1\n2"]


def test_url_rules(spark):
    pages = clash(spark.createDataFrame(list(enumerate(URLS)) + [(0, None), (3, URLS[3])], "page_id long, url string"))
    index = spark.createDataFrame([], "token string, items array<string>, confidence double")
    got = urlrules.judge(pages, index).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule) == brute_rule(r.url)[:3] and r.verdict == (brute_rule(r.url)[3] or "allow")


def brute_rules(baskets, least=urlrules.LEAST_COUNT):
    """Every token combination with enough bad urls, lift and significance, with its confidence."""
    n, bad = len(baskets), sum(b for _, b in baskets)
    seen, wrong = Counter(), Counter()
    for items, b in baskets:
        for m in range(1, 1 << len(items)):
            s = tuple(sorted(t for k, t in enumerate(items) if m >> k & 1))
            seen[s] += 1
            wrong[s] += b
    base = bad / n
    return {s: wrong[s] / k for s, k in seen.items() if wrong[s] >= least and wrong[s] / k >= urlrules.LIFT * base and wrong[s] / k - base >= urlrules.DEVIATIONS * math.sqrt(base * (1 - base) / k)}


def test_url_association_rules(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.net/{'win' if i % 8 == 0 else 'read'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 8 == 0 else 1, 0) for i in range(400)] + [(None, 0, None)], "doc_id long, quality int, toxic int")
    index = urlrules.mine(pages, labels)
    baskets = [(r.t, i % 8 == 0) for i, r in enumerate(pages.select(urlrules.tokens(F.col("url")).alias("t")).collect())]
    want = brute_rules(baskets)
    got = index.collect()
    assert {tuple(r.items): r.confidence for r in got} == pytest.approx(want) and len(want) > 10
    assert all(r.token in r.items for r in got)
    fresh = spark.createDataFrame([(1, "http://spam.net/win/9000"), (2, "http://good.net/read/9"), (2, "http://spam.net/win/9000"), (3, None), (4, "http://example.org/win/1")], "page_id long, url string")
    said = sorted((r.page_id, r.verdict) for r in urlrules.judge(clash(fresh), index).collect())
    assert said == [(1, "block"), (2, "allow"), (2, "block"), (3, "allow"), (4, "allow")]
    assert urlrules.mine(pages.limit(0), labels).count() == 0 and urlrules.judge(pages.limit(0), index).count() == 0


def test_url_rules_without_broadcast(spark, monkeypatch):
    import dialmill.runtime as rt

    index = spark.createDataFrame([("host:a.b", ["host:a.b"], 1.0)], "token string, items array<string>, confidence double")
    pages = spark.createDataFrame([(i, "http://a.b/x" if i % 3 else None) for i in range(60)] + [(None, "http://c.b/")], "page_id long, url string")
    monkeypatch.setattr(rt, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(urlrules, "fits_broadcast", lambda df: False)
    got = urlrules.judge(pages, index).collect()
    assert len(got) == 61 and all((r.verdict == "block") == (r.url == "http://a.b/x") for r in got)


def test_url_with_many_segments(spark):
    """A hot url of 30 segments and 30 query keys makes nine tokens, so few itemsets; its rules still fire."""
    hot = "http://x.y.z.net/" + "/".join(f"s{i}" for i in range(30)) + "/f.html?" + "&".join(f"k{i}=1" for i in range(30))
    rows = [(i, hot if i % 2 else f"http://ok{i}.org/a") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    index = urlrules.mine(pages, labels)
    assert 0 < index.count() < 1 << 9 and urlrules.judge(pages, index).filter("verdict = 'block'").count() == 100


# --- 5 ---------------------------------------------------------------------------------------------------------------


def shingles(t):
    w = WORD.findall(t or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_links(rows):
    """(class, links) per row of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    link = [[i != j and a and b and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = [i for i, _ in rows]
    while True:
        new = [min([label[i], *(label[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
        if new == label:
            return [(label[i], sum(map(bool, link[i]))) for i in range(len(rows))]
        label = new


def near_rows(n=90, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(base[min(3, int(r.random() ** 2 * 4))])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, (" " if r.random() < 0.8 else "\n").join(w)))
    return rows + [(n, "a b c"), (n + 1, "a  b c"), (n + 2, "a b d"), (n + 3, ""), (n + 4, None), (n + 5, "\t"), (n + 6, ""), (n + 7, rows[0][1]), (n + 7, rows[0][1]), (n + 8, rows[0][1] + " " + " ".join(vocab[:7]))]


def test_near_duplicates_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_links(rows)))
    got = neardup.jaccard_join(df).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == want and len(got) == len(rows) + 1
    monkeypatch.setattr(neardup, "CELL_ROWS", 7)  # clusters over many cells
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_join(df).collect() if r.doc_id is not None) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.jaccard_join(empty).count() == 0 and neardup.drop_near_copies(empty).count() == 0
    kept = neardup.drop_near_copies(df.drop("class_id"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c, _ in want}) and kept.filter("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("hot, block, leaf", [(1000, 512, 8), (1, 5, 3)])
def test_near_duplicates_across_clusters(spark, monkeypatch, hot, block, leaf):
    """Without clusters every link comes from candidate pairs: the forest alone finds them, with hot nodes named or joined, and in blocks."""
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "NODE_ROWS", block)
    monkeypatch.setattr(neardup, "LEAF", leaf)
    rows = near_rows(60, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "clusters", lambda reps: reps.limit(0).select("rid", F.col("rid").alias("cluster")))
    monkeypatch.setattr(neardup, "adopted", lambda nodes, cluster, reps: cluster)
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_links(rows)))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_join(df).collect()) == want


def test_near_copies_of_repeated_ids(spark):
    """A repeated id with different texts loses only the rows that are near copies, whatever the order of rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    rows = [(5, a, "x"), (5, b, "x"), (3, near, "x"), (7, c, "z"), (7, c, "y"), (7, b + " end", "x"), (8, None, "x"), (8, None, "x"), (8, " ", "x"), (None, a, "x"), (9, a, "x")]
    rows += [(11, f"text {i} of one id that holds many rows {i * 7}", "x") for i in range(30)]
    want = sorted([(5, b, "x"), (3, near, "x"), (7, c, "y"), (8, None, "x"), (8, " ", "x"), (None, a, "x"), *rows[11:]], key=str)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_near_duplicates_short_texts(spark, monkeypatch):
    """8- against 9-word texts share 4 of 5 shingles: no pair that meets in the forest is lost to the sketch filter."""
    r = random.Random(4)
    rows = []
    for i in range(0, 4000, 2):
        w = [f"w{r.randrange(10**9)}" for _ in range(9)]
        rows += [(i, " ".join(w[:8])), (i + 1, " ".join(w))]
    monkeypatch.setattr(neardup, "clusters", lambda reps: reps.limit(0).select("rid", F.col("rid").alias("cluster")))
    monkeypatch.setattr(neardup, "adopted", lambda nodes, cluster, reps: cluster)
    heads = [neardup.labels(neardup.signature(neardup.shingle_set(t)))[0][: neardup.FIRST_LOT].tolist() for _, t in rows]
    want = {i for i in range(0, 4000, 2) if any(a == b for a, b in zip(heads[i], heads[i + 1]))}  # every leaf is at depth 2 here
    got = neardup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links = 1 AND doc_id % 2 = 0")
    assert {r.doc_id for r in got.collect()} == want and len(want) >= 1995


def test_recall_of_each_text():
    """A text that stays in the first lot reaches the recall by its own depths; with all trees at full depth any text does."""
    first = neardup.FIRST_LOT
    assert 1 - math.exp(first * neardup.miss(2)) >= neardup.RECALL and 1 - math.exp(neardup.TREES * neardup.miss(neardup.DEPTH)) >= neardup.RECALL
    short = math.log(1 - neardup.RECALL) - first * neardup.miss(2)
    for deep in range(first + 1):
        lost = deep * (neardup.miss(4) - neardup.miss(2))
        assert (lost <= short) == (1 - math.exp((first - deep) * neardup.miss(2) + deep * neardup.miss(4)) >= neardup.RECALL)


def test_shingles_of_long_words(monkeypatch):
    text = "aaa " + "b" * 500 + " c\x0bd " + "é" * 300 + " x"
    whole = neardup.word_hashes(text)
    monkeypatch.setattr(neardup, "CHUNK", 64)
    assert np.array_equal(whole, neardup.word_hashes(text)) and len(whole) == 6
    assert 1 - math.exp(neardup.TREES * neardup.miss(neardup.DEPTH)) >= neardup.RECALL


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    a, b = "<p>é" + "x" * 2000, "y" * 999
    rows = [(1, "http://u/1", a), (2, "http://u/2", a), (3, None, b), (4, "http://u/4", b), (5, "http://u/5", None), (6, "u\r\n6", ""), (2, "http://u/2", a), (7, "u", "z\r\n\r\nWARC/1.1\r\n" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    rec = warc.read_archive(spark, path)
    got = sorted((r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to, r.sha1) for r in rec.collect())
    kind = lambda i, h: ("revisit", 2) if i == 1 else ("response", None)
    assert got == sorted((i, h or "", *kind(i, h), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    warc.export_warc(rec.coalesce(1), str(tmp_path / "files"))
    import gzip

    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "files").glob("*.gz")))
    parsed = warc.parse_warc(data)
    assert len(parsed) == len(rows)
    want = Counter((bytes(r.header), b"" if r.record_type == "revisit" else bytes(r.payload)) for r in rec.collect())
    assert Counter(parsed) == want
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("bad").cast("binary")).write.parquet(str(tmp_path / "d/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, str(tmp_path / "d")).select("n_bytes").collect()
    heads = spark.read.parquet(f"{path}/headers")
    assert heads.columns == ["digest", "header"]  # types, ids and references come from the headers alone
    (tmp_path / "g").mkdir()
    heads.withColumn("header", F.replace(F.col("header").cast("string"), F.lit("Content-Length: 999"), F.lit("Content-Length: 998")).cast("binary")).write.parquet(str(tmp_path / "g/headers"))
    spark.read.parquet(f"{path}/payloads").write.parquet(str(tmp_path / "g/payloads"))
    with pytest.raises(Exception, match="doesn't agree"):
        warc.read_archive(spark, str(tmp_path / "g")).select("record_type").collect()
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_against_whole_texts(spark, sf):
    t = tokenizer()
    r = random.Random(2)
    pool = "aAbB.,!?;:'<|>_0129éÉ́̈  　\x1c\x85ßΣσςİıÅ한하 \n\tst re ve"
    texts = ["", None, "<|endoftext|>. a<|ENDOFTEXT|> don't, we'll!! ²."] + ["".join(r.choice(pool) for _ in range(r.randint(1, 50))) for _ in range(400)]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(documents(spark, sf).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")))
    got = bpe.encode(df, queries.vocabulary(), with_ids=True)
    assert "IDS" not in got.columns or got.columns.count("ids") == 1
    for x in got.select("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect():
        ids = t.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = got.filter("doc_id < 50").select("doc_id", bpe.decoded(F.col("ids"), queries.vocabulary()).alias("decoded"))
    assert all(r.decoded == t.decode(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in back.collect())
    assert bpe.encode(df.limit(0), queries.vocabulary()).count() == 0


def test_bpe_refuses_other_files(tmp_path):
    with pytest.raises(ValueError, match="word-end"):
        bpe.pieces(queries.vocabulary("byte_bpe_50k.json"))


def test_bpe_table_is_bounded():
    t = bpe.WordTable(queries.vocabulary(), most=5)
    import pyarrow as pa

    for k in range(6):
        t.rows(pa.array([f"word{k}{i}" for i in range(4)]), np.full(4, 2))
        assert len(t.known) <= 5


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_min_cost_flow():
    r = random.Random(4)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 6)
        supply = [r.randint(0, 50) for _ in range(n)]
        total = sum(supply)
        caps = [total // m + (j < total % m) for j in range(m)]
        flow = sharding.min_cost_flow(supply, caps)
        assert [sum(row) for row in flow] == supply and [sum(c) for c in zip(*flow)] == caps and min(map(min, flow)) >= 0
        assert sum(map(sum, flow)) - sum(flow[i][i] for i in range(min(n, m))) == total - sum(min(supply[i], caps[i]) for i in range(min(n, m)))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_reshard(spark, sf, tmp_path):
    d = documents(spark, sf)
    rows = sharding.reshard(clash(d)).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    assert len(rows) == len(text) and all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) == set(range(8)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sums, most = [sum(r.size for r in x) for x in by.values()], max(r.size for r in rows)
    assert max(sums) - min(sums) <= 4 * most
    odd = sharding.reshard(odd_docs(spark)).collect()
    assert len(odd) == 10 and all(0 <= r.shard < 8 for r in odd) and sharding.reshard(d.limit(0)).count() == 0
    plan = {(r.doc_id, r.shard, r.slot, r.old_shard) for r in sharding.reshard(d).collect()}
    moves = sharding.rewrite_affected(d, str(tmp_path / "m"))
    files = sharding.read_shards(d, str(tmp_path / "m"))
    assert {(r.doc_id, r.shard, r.slot, r.old_shard) for r in files.collect()} == plan and files.select(*d.columns).exceptAll(d).count() == 0 and files.count() == d.count()
    assert moves.agg(F.sum("documents")).first()[0] == d.count() and sharding.rewrite_affected(d.limit(0), str(tmp_path / "e")).count() == 0


def test_untouched_shards_are_not_written(spark, tmp_path, monkeypatch):
    """Shards that neither lose nor gain keep their files; the others are whole again."""
    d = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(sharding, "min_cost_flow", lambda supply, room: [[supply[0] // 2, supply[0] - supply[0] // 2, 0], [0, supply[1], 0], [0, 0, supply[2]]])
    plan = sharding.reshard(d, 3, 3)
    moves = sharding.rewrite_affected(d, str(tmp_path / "m"), 3, 3)
    files = sharding.read_shards(d, str(tmp_path / "m"))
    assert {r.shard for r in files.select("shard").distinct().collect()} == {0, 1} and {(r.old_shard, r.shard) for r in moves.collect()} == {(0, 0), (0, 1), (1, 1), (2, 2)}
    assert files.select("doc_id", "shard", "slot").exceptAll(plan.select("doc_id", "shard", "slot")).count() == 0 and files.count() == plan.filter("shard < 2").count()


def test_reshard_rows_without_distinct_ids(spark, tmp_path):
    """Null ids, a repeated id and repeated rows spread over blocks and shards; moved rows keep their shard."""
    rows = [(None, f"text {i}") for i in range(600)] + [(7, f"other {i}") for i in range(600)] + [(8, "same text")] * 600 + [(i, f"text {i}") for i in range(100, 1900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = sharding.reshard(docs).cache()
    got = plan.collect()
    bytes_by, slots = Counter(), defaultdict(list)
    for r in got:
        bytes_by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(bytes_by.values()) - min(bytes_by.values()) < 0.05 * sum(bytes_by.values()) / 8
    assert max(Counter((r.old_shard, r.block) for r in got).values()) < 20
    sharding.rewrite_affected(docs, str(tmp_path / "m"))
    files = sharding.read_shards(docs, str(tmp_path / "m")).collect()
    key = lambda r: (r.doc_id, len(r.text) + 1, zlib.crc32(r.text.encode()), r.shard, r.slot)
    assert sorted(map(key, files), key=str) == sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str)


# --- 9 ---------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def naive_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_spans():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice("ab1239@@..-+ (%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == naive_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_gradients():
    m, r = pii.Tagger(size=3, width=2), np.random.default_rng(0)
    x, y = r.integers(0, pii.N_CLASSES, (2, 6)), r.integers(0, pii.N_TAGS, (2, 6))
    _, grads = m.gradients(x, y)
    for p, g in zip(m.p, grads):
        i = (x[0, 0], 0) if p is m.p[0] else tuple(r.integers(0, s) for s in p.shape)
        old, e = p[i], 1e-5
        p[i] = old + e
        up = m.gradients(x, y)[0]
        p[i] = old - e
        down = m.gradients(x, y)[0]
        p[i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[i], abs=1e-6)


def test_viterbi_is_best():
    import itertools

    m, r = pii.Tagger(size=2, width=2), np.random.default_rng(1)
    m.p[9] = r.normal(size=m.p[9].shape)
    x = r.integers(0, pii.N_CLASSES, (1, 3))
    s = m.emissions(x)[0][0]
    best = max(itertools.product(range(pii.N_TAGS), repeat=3), key=lambda y: sum(s[i, t] for i, t in enumerate(y)) + m.p[9][y[0], y[1]] + m.p[9][y[1], y[2]])
    assert m.decode(x)[0][0].tolist() == list(best)


def test_tagger_held_out():
    model, hit, said, all_ = pii.default_model(), 0, 0, 0
    for text, spans in pii.invented(150, seed=99):
        got = pii.model_spans(model, [text])[0]
        hit, said, all_ = hit + len(set(got) & set(spans)), said + len(got), all_ + len(spans)
    assert hit / said > 0.95 and hit / all_ > 0.85


def test_reconcile_and_windows():
    assert pii.reconcile([(0, 10, 0, 0.9), (5, 20, 1, 0.95), (20, 25, 2, 0.9), (5, 20, 1, 0.5)]) == [(5, 20, 1), (20, 25, 2)]
    text = "x" * 300 + "1" * 200 + "y" * 300 + "@"
    starts = pii.windows(text)
    assert all(any(s <= i < s + pii.WINDOW for s in starts) for i, c in enumerate(text) if c in "1@") and pii.windows("none") == []


def test_personal_data_odd_rows(spark, sf):
    more = spark.createDataFrame([(90, "mail a.b@c.example.org and +1 555 123 4567 or 10.0.0.255", "en", "a", 1)], DOCS)
    got = pii.detect(clash(odd_docs(spark).unionByName(more)), pii.default_model()).collect()
    assert len(got) == 11
    for r in got:
        base = naive_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(pii.said(base).encode()).hexdigest() and r.n_email == sum(s[0] == "email" for s in base)
        assert set(pii.said(base).split(",")) <= set(r.spans.split(","))
    masked = pii.detect(more, pii.default_model(), masked=True).first()
    assert masked.text == "mail <email> and <phone> or <ip>" and pii.detect(more.limit(0), pii.default_model()).count() == 0
    for r in queries.op9_personal_data(spark, sf).join(documents(spark, sf).select("doc_id", "text"), "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(pii.said(naive_spans(r.text or "")).encode()).hexdigest()


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_base_rules(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab \n#é$\t") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["a b c a b c", "a a a a a", "x", "", None, "a b\na b\n \na b"]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for x in quality.judge(df, labels).collect():
        want = brute_base(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x.kept == (not x.base_failed)
    assert quality.judge(df.limit(0), labels).count() == 0


def test_quality_scores(spark, sf):
    out = queries.op10_quality_rules(spark, sf).filter("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and r.toxic == 0]
    assert sum(good) / len(good) > 0.97 and not any(r.kept for r in out if r.quality == 0)


def test_quality_brute_force_score(spark):
    texts = {i: " ".join(random.Random(i).choice("alpha beta gamma delta".split()) for _ in range(60)) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(10, 0, 0), (11, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_ids(labels)
    assert sorted(r[0] for r in trusted.collect()) == list(range(10))
    table = quality.ratios(df, trusted)
    b = {r.doc_id: r.b for r in quality.hashes(df, "text").select("doc_id", quality.buckets().alias("b")).collect()}
    raw, target = Counter(x for v in b.values() for x in v), Counter(x for i in range(10) for x in b[i])
    n, m = sum(raw.values()), sum(target.values())
    for k in raw:
        p = (raw[k] + 1) / (n + quality.BUCKETS)
        assert table[k] == round(1e6 * math.log((target[k] + quality.SMOOTH * p) / (m + quality.SMOOTH) / p))
    for r in quality.judge(df, labels).collect():
        assert r.score == pytest.approx(sum(table[x] for x in b[r.doc_id]) / len(b[r.doc_id]))


def test_quality_all_trusted(spark, monkeypatch):
    """Counts and threshold come from every trusted document, whichever way the ids meet the texts."""
    def text(i):
        r = random.Random(i)
        return " ".join(f"w{r.randrange(40) + (20 if i % 7 == 0 else 0)}" for _ in range(50 + i % 3))

    df = spark.createDataFrame([(i, text(i)) for i in range(8000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(7000)] + [(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(7000) if i % 10 > 0} - {6}
    trusted = quality.trusted_ids(labels)
    assert trusted.count() == len(good) and {r[0] for r in trusted.collect()} == good
    b = {r.doc_id: r.b for r in quality.hashes(df, "text").select("doc_id", quality.buckets().alias("b")).collect()}
    raw, target = Counter(x for v in b.values() for x in v), Counter(x for i in good for x in b[i])
    n, m = sum(raw.values()), sum(target.values())
    p = {k: (v + 1) / (n + quality.BUCKETS) for k, v in raw.items()}
    want = {k: round(1e6 * math.log((target[k] + quality.SMOOTH * p[k]) / (m + quality.SMOOTH) / p[k])) for k in raw}
    mean = {i: sum(want[x] for x in v) / len(v) for i, v in b.items()}
    least = np.quantile([mean[i] for i in good], quality.KEEP) - quality.MARGIN
    for rows in (runtime.BROADCAST_ROWS, 0):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
        table = quality.ratios(df, trusted)
        assert all(table[k] == v for k, v in want.items())
        got = quality.judge(df, labels).collect()
        assert len(got) == 8000 and all(r.score == pytest.approx(mean[r.doc_id], abs=1e-6) for r in got)
        assert all(r.kept == (not r.base_failed and r.score >= least) for r in got if abs(r.score - least) > 1e-3)


def test_quality_quantile(spark):
    for n in (1, 2, 3, 1000, 4001):
        df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(977)) / 7).alias("s")).repartition(4)
        for share in (0.0, 0.002, 0.5, 1.0):
            assert quality.quantile(df, "s", share) == pytest.approx(df.agg(F.percentile("s", F.lit(share))).first()[0])
    assert quality.quantile(spark.range(0).select(F.lit(1.0).alias("s")), "s", 0.5) is None


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_workers_need_little_memory(spark, sf, monkeypatch):
    """A worker decodes many windows in bounded memory, loads no pandas and no rules, and there is one set of workers."""
    model = pii.Tagger()
    x = np.random.default_rng(1).integers(0, pii.N_CLASSES, (2048, pii.WINDOW)).astype(np.uint8)
    whole = model.best_tags(x) if hasattr(model, "best_tags") else model.decode(x)
    tracemalloc.start()
    got = model.decode(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and (got[0] == whole[0]).all() and np.allclose(got[1], whole[1])
    assert model.decode(x[:0])[0].shape == (0, pii.WINDOW)
    code = "import sys; from dialmill.llm import bpe, langid, neardup, pii; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(corpus_pipeline.__file__)).returncode == 0
    code = bpe.encoder(queries.vocabulary())
    monkeypatch.setattr(bpe, "pieces", None)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "__words": [["the", "cat"]]})
    assert [b.column("n_tokens").to_pylist() for b in code(iter([batch]))] == [[2]]
    monkeypatch.setattr(SparkContext, "parallelize", None)
    assert langid.train(documents(spark, sf)).langs


def test_pipeline(spark, sf):
    docs = documents(spark, sf)
    text = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    a = stage["language_id"](spark, docs, sf).cache()
    assert a.columns == corpus_pipeline.COLUMNS and a.count() >= 0.97 * len(text)
    b = stage["near_duplicates"](spark, a, sf).cache()
    rows = sorted((r.doc_id, r.text) for r in a.collect())
    assert sorted(r.doc_id for r in b.collect()) == sorted({c for c, _ in brute_links(rows)})
    c = stage["personal_data"](spark, b, sf).cache()
    assert c.count() == b.count() and c.filter("length(text) <> n_chars").count() == 0
    assert all(not naive_spans(r.text) for r in c.collect())
    d = stage["mixing"](spark, c, sf).cache()
    assert d.columns == corpus_pipeline.COLUMNS and d.count() == mixing.plan_mix(c).agg(F.sum("copies")).first()[0]
    t = tokenizer()
    e = stage["bpe"](spark, d, sf).collect()
    masked = {r.doc_id: r.text for r in c.collect()}
    assert len(e) == d.count() and all(r.ids == t.encode(masked[r.doc_id], add_special_tokens=False).ids for r in e[:50])


def test_pipeline_odd_rows(spark, tmp_path):
    for name, rows in (("odd", odd_docs(spark)), ("none", odd_docs(spark).limit(0))):
        path = str(tmp_path / name)
        rows.write.parquet(f"{path}/documents.parquet")
        out = corpus_pipeline.run(spark, path)
        assert out.filter("doc_id IN (2, 3, 4, 6)").count() == 0 and (name == "odd" or out.count() == 0)
