"""Minimum-cost-flow resharding.

The corpus lies in old shards cut into blocks by a hash of id, text_crc32, size and the number among rows equal in these.
From old shard bytes and new capacities a minimum cost flow (cost 1 a byte that leaves its shard, 0 a byte that stays)
says how many bytes go where; the blocks of an old shard are then laid along its flows. Only the flow problem, whose size
is shards times shards, is solved on the driver; documents meet the plan by a broadcast of the block table, which never
exceeds MAX_BLOCKS rows. ``rewrite_affected`` then writes every shard that loses or gains a block anew, in files of about
FILE_BYTES, by one shuffle of the rows to the files they go to; shards without a move aren't touched.

Defined cases: null text has size 1 and crc32 0; a null id belongs to old shard 0; repeated rows keep a slot each, and
neither they nor rows without an id share a block for that; an empty table gives an empty result; clashing column names are replaced.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialmill.llm.text import numbered
from dialmill.runtime import stash, without

MAX_BLOCKS, FILE_BYTES = 32_768, 32 << 20
OWN = ["size", "text_crc32", "old_shard", "block", "shard", "slot"]


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one, moving the fewest; successive shortest paths with potentials."""
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the corpus")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, residual, cost; edge e and e ^ 1 are each other's reverse
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, most: int, cost: int) -> int:
        for u, v, r, c in ((a, b, most, cost), (b, a, 0, -cost)):
            at[u].append(len(edges))
            edges.append([v, r, c])
        return len(edges) - 2

    for i, s in enumerate(supply):
        link(source, i, s, 0)
    for j, c in enumerate(capacity):
        link(n + j, sink, c, 0)
    pipes = [[link(i, n + j, supply[i], int(i != j)) for j in range(m)] for i in range(n)]
    height = [0] * len(at)
    left = sum(supply)
    while left:
        far, came, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heappop(heap)
            if d > far[u]:
                continue
            for e in at[u]:
                v, r, c = edges[e]
                if r and (nd := d + c + height[u] - height[v]) < far.get(v, nd + 1):
                    far[v], came[v] = nd, e
                    heappush(heap, (nd, v))
        for v, d in far.items():
            height[v] += d
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = edges[came[v] ^ 1][0]
        step = min(left, *(edges[e][1] for e in path))
        for e in path:
            edges[e][1] -= step
            edges[e ^ 1][1] += step
        left -= step
    return [[edges[e ^ 1][1] for e in row] for row in pipes]


def facts(docs: DataFrame, old_shards: int, id_col: str, text_col: str) -> DataFrame:
    """docs with size, text_crc32 and old_shard."""
    key, text = F.col(id_col), F.col(text_col)
    place = F.when(key.isNull(), 0).otherwise(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(old_shards))).cast("int")
    return without(docs, OWN).withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "text_crc32": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)), "old_shard": place})


def blocked(rows: DataFrame, blocks: int, id_col: str) -> DataFrame:
    """rows of ``facts`` with their block, of ``blocks`` in each old shard; equal rows are numbered, so they spread over blocks."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string")]
    out = numbered(rows, F.concat_ws("|", *parts))
    return out.withColumn("block", F.pmod(F.xxhash64("__row_key", "__k"), F.lit(blocks)).cast("int")).drop("__row_key", "__k")


def layout(rows: DataFrame, new_shards: int, old_shards: int, blocks: int) -> DataFrame:
    """(old_shard, block, shard, first, file): where each block goes, its first slot, and its file; MAX_BLOCKS rows at most."""
    sizes = stash(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-blocks")
    supply = [0] * old_shards
    for r in sizes.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect():  # a row per old shard
        supply[r.old_shard] = r.b
    total = sum(supply)
    flow = min_cost_flow(supply, [total // new_shards + (j < total % new_shards) for j in range(new_shards)])
    cuts = []  # (old shard, first byte, end byte, new shard): what stays comes first
    for i, out in enumerate(flow):
        a = 0
        for j in sorted(range(new_shards), key=lambda j: (j != i, j)):
            if out[j]:
                cuts.append((i, a, a + out[j], j))
                a += out[j]
    plan = rows.sparkSession.createDataFrame(cuts, "old_shard int, a long, b long, shard int")
    by_old = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    middle = 2 * F.coalesce(F.sum("bytes").over(by_old), F.lit(0)) + F.col("bytes")
    laid = sizes.withColumn("mid", middle).join(F.broadcast(plan), "old_shard").filter((F.col("mid") >= 2 * F.col("a")) & (F.col("mid") < 2 * F.col("b")))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return stash(laid.select("old_shard", "block", "shard", so_far("n").alias("first"), F.floor(so_far("bytes") / FILE_BYTES).alias("file"), "bytes", "n"), "shard-layout")


def blocks_for(n: int, old_shards: int) -> int:
    return max(1, min(n, MAX_BLOCKS) // old_shards)


def slot(id_col: str) -> Column:
    """A row's place in its shard: after the blocks before its own, by id, crc and size."""
    inside = Window.partitionBy("shard", "file", "old_shard", "block").orderBy(id_col, "text_crc32", "size")
    return (F.col("first") + F.row_number().over(inside) - 1).cast("long")


def reshard(docs: DataFrame, new_shards: int = 8, old_shards: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The plan per document: id, size, text_crc32, old_shard, block, shard and slot (gapless from 0 in each shard). No text moves."""
    rows = stash(facts(docs, old_shards, id_col, text_col).select(id_col, "size", "text_crc32", "old_shard"), "shard-facts")
    blocks = blocks_for(rows.count(), old_shards)
    rows = stash(blocked(rows, blocks, id_col), "shard-rows")
    out = rows.join(F.broadcast(layout(rows, new_shards, old_shards, blocks)), ["old_shard", "block"])
    return out.withColumn("slot", slot(id_col)).select(id_col, *OWN)


def rewrite_affected(docs: DataFrame, path: str, new_shards: int = 8, old_shards: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every shard that loses or gains documents, whole, under path/shard=j: the columns of docs with old_shard and slot.

    Returns the moves (old_shard, shard, blocks, documents, bytes), stays included. A shard without a move in or out is
    not written: its old files stand, and its rows keep the slots of ``reshard``.
    """
    narrow = stash(facts(docs, old_shards, id_col, text_col).select(id_col, "size", "text_crc32", "old_shard"), "shard-facts")
    blocks = blocks_for(narrow.count(), old_shards)
    laid = layout(blocked(narrow, blocks, id_col), new_shards, old_shards, blocks)
    moves = stash(laid.groupBy("old_shard", "shard").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("documents"), F.sum("bytes").alias("bytes")), "shard-moves")
    moved = moves.filter("old_shard <> shard")
    affected = moved.select("shard").union(moved.select("old_shard")).distinct()  # as many rows as shards
    rows = blocked(facts(docs, old_shards, id_col, text_col), blocks, id_col).join(F.broadcast(laid.drop("bytes", "n")), ["old_shard", "block"]).join(F.broadcast(affected), "shard", "left_semi")
    kept = [c for c in without(docs, OWN).columns]
    rows.repartition("shard", "file").withColumn("slot", slot(id_col)).select(*kept, "old_shard", "shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return moves


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``rewrite_affected`` wrote under path for docs: their columns, old_shard, slot and shard."""
    schema = without(docs, OWN).schema.add("old_shard", T.IntegerType()).add("slot", T.LongType()).add("shard", T.IntegerType())
    return docs.sparkSession.read.schema(schema).option("basePath", path).parquet(path)
