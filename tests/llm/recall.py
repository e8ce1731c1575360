"""Recall of the n-gram Jaccard join: ``python tests/llm/recall.py /root/testdata/sf0.1`` holds every link against an exact join."""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
from pyspark.sql import SparkSession

from dialmill.llm import neardup


def exact_links(texts: list[tuple[int, str | None]]) -> tuple[dict[int, int], dict[int, int]]:
    """(links, class) by id, from an exact join with prefix filtering: a pair at 0.8 shares one of the rarest fifth of shingles."""
    sets = {i: neardup.shingle_set(t) for i, t in texts}
    groups = defaultdict(list)
    for i, s in sets.items():
        if len(s):
            groups[s.tobytes()].append(i)
    reps = [(min(ids), len(ids), np.frombuffer(b, np.uint64)) for b, ids in groups.items()]
    often = Counter()
    for _, _, s in reps:
        often.update(s.tolist())
    index, links, label = defaultdict(list), Counter(), {i: i for i, _, _ in reps}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(range(len(reps)), key=lambda k: len(reps[k][2]))
    for k in order:
        i, n, s = reps[k]
        rare = sorted(s.tolist(), key=lambda x: (often[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for m in {m for x in rare for m in index[x]}:
            j, n_j, t = reps[m]
            if 5 * len(t) >= 4 * len(s) and neardup.linked(np.intersect1d(s, t, True).size, len(s), len(t)):
                links[i] += n_j
                links[j] += n
                a, b = sorted((root(i), root(j)))
                label[b] = a
        for x in rare:
            index[x].append(k)
    by_id = {i: (links[min(ids)] + len(ids) - 1, root(min(ids))) for ids in groups.values() for i in ids}
    return {i: by_id.get(i, (0, i))[0] for i, _ in texts}, {i: by_id.get(i, (0, i))[1] for i, _ in texts}


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet").select("doc_id", "text")
    links, classes = exact_links([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r for r in neardup.jaccard_join(docs).collect()}
    found, real = sum(r.n_links for r in got.values()), sum(links.values())
    wrong = sum(got[i].class_id != c for i, c in classes.items())
    print(f"links found {found} of {real}: recall {found / max(real, 1):.6f}; documents in another class {wrong} of {len(got)}")


if __name__ == "__main__":
    main()
