"""N-gram Jaccard join through a MinHash LSH forest, with exact verification.

Words are maximal runs without ASCII white space; a text's set holds its five-word shingles (a text of one to four words
has one shingle, all its words). Two texts are linked when the Jaccard similarity of their sets is 0.8 or more.

1. One pass over the texts gives each its set's digest, size, the MinHash labels of TREES prefix tries and a sketch of
   bits. Texts of equal sets become one class of copies; later steps see one representative of each, so copies make no pairs.
2. Each trie is cut at its shallowest nodes of LEAF members or fewer, at depth DEPTH at the latest: a text's matched prefix
   is shortened as far as its node stays that small, so seldom texts need short prefixes and crowded ones get long ones.
   The tries are read in two lots. A text's recall is 1 - prod(1 - 0.8 ** depth) over the depths at which its prefixes
   ended; a text that reaches RECALL in the first lot takes no part in the second, and with all TREES even a text whose
   prefixes all end at DEPTH reaches it. Members of a leaf are paired. A text takes no part where no partner is possible:
   sets of fewer than LEAST_SET shingles can't resemble another set to 0.8.
3. Nodes of more than LEAF members at DEPTH hold clusters of near copies and texts with much in common. Their texts are
   joined to clusters by deeper prefixes (DEEP values, minimum label, two rounds), and texts that meet a larger
   cluster higher up and resemble a member by sketch are taken in. Pairs inside a cluster never become rows:
   the cluster is cut into cells of bounded size, and a task counts the links of a cell by exact set intersections.
4. Candidate pairs across clusters, which are few, are rows: filtered by set sizes and sketches
   in the join itself (heavy nodes are cut into blocks), then verified exactly.
5. Connected components of the verified links are found by minimum labels with pointer jumping.

Shingles are 64-bit hashes. Missed pairs: at most (1 - RECALL) of those at 0.8 exactly, fewer above.

Defined cases: a null or empty text, and one without a word, has no set, no link, and is its own class; a row without an
id takes no part and has a null class; repeated rows are copies of each other; an empty table gives an empty result;
extra columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.runtime import bound_batches, fits_broadcast, stash, tidy

WORDS, RECALL, LEAST_SET = 5, 0.9995, 4
#: Tries, their depth and the levels at which they may be cut; the trees of the first lot; a leaf's most members.
TREES, DEPTH, LEVELS, FIRST_LOT, LEAF = 28, 6, (2, 4, 6), 10, 8
#: A node with more than one in HOT of a lot's rows is hot: there are fewer than HOT such nodes, so a filter can name them.
HOT = 1000
DEEP_TREES, DEEP = 8, 10
#: One mixed bit of each of SKETCH_BITS MinHash values; two sets of similarity s agree in (1 + s) / 2 of them.
SKETCH_BITS, SKETCH_DIFFER = 256, 51
CELL_ROWS, CELL_SHINGLES, NODE_ROWS, CHUNK = 128, 2_000_000, 512, 1 << 20
M64 = (1 << 64) - 1


def miss(depth: int, s: float = 0.8) -> float:
    """Logarithm of the probability that a pair of similarity s doesn't share a prefix of this depth in one tree."""
    return math.log(1 - s**depth)


_rng = np.random.default_rng(20240607)
A, B = (_rng.integers(0, 1 << 32, max(SKETCH_BITS, TREES * DEPTH + DEEP_TREES * (DEEP - DEPTH)), dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse mod 2 ** 64, for i < n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 1 << 14)
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word's UTF-8 bytes, chunk by chunk of a long text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        if to < len(data):  # a chunk ends after white space
            cut = np.flatnonzero(SPACES[data[at:to]])
            while not len(cut) and to < len(data):
                cut, to = np.flatnonzero(SPACES[data[to : to + CHUNK]]) + to - at, min(len(data), to + CHUNK)
            to = at + int(cut[-1]) + 1 if len(cut) else len(data)
        part = data[at:to]
        blank = np.concatenate([[True], SPACES[part], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edge[::2], edge[1::2]
        up, down = powers(len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
        out.append(mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mixed(h * np.uint64(BASE) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, one for each (A, B)."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(A), np.uint32(0xFFFFFFFF))
    for i in range(0, len(shingles), 4096):
        best = np.minimum(best, (A[:, None] * low[i : i + 4096] + B[:, None] * high[i : i + 4096]).min(1))
    return best


def labels(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In every tree the hash of the first two values, and 16 bits of each further one; in DEEP_TREES the hash of DEEP values."""
    values = sig[: TREES * DEPTH].reshape(TREES, DEPTH).astype(np.uint64)
    head = mixed(mixed(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(BASE) + values[:, 0]) * np.uint64(BASE) + values[:, 1])
    tail = np.zeros(TREES, np.uint64)
    for level in range(2, DEPTH):
        tail = (tail << np.uint64(16)) | (mixed(values[:, level] + np.uint64(level)) >> np.uint64(48))
    deep = mixed(head[:DEEP_TREES] ^ mixed(tail[:DEEP_TREES]))
    tails = sig[TREES * DEPTH :][: DEEP_TREES * (DEEP - DEPTH)].reshape(DEEP_TREES, DEEP - DEPTH).astype(np.uint64)
    for level in range(DEEP - DEPTH):
        deep = mixed(deep * np.uint64(BASE) + tails[:, level])
    return head.view(np.int64), tail.view(np.int64), deep.view(np.int64)


def node(level: int) -> Column:
    """The trie node of a row's prefix of this length."""
    return F.col("head") if level == 2 else F.xxhash64("head", F.shiftrightunsigned("tail", 16 * (DEPTH - level)), F.lit(level))


def sketch(sig: np.ndarray) -> np.ndarray:
    """A bit of each of SKETCH_BITS values mixed with its place, as longs.

    A and B are odd, so the lowest bits of the values themselves would be one bit of the shingle, the same in all places.
    """
    own = mixed(sig[:SKETCH_BITS].astype(np.uint64) + np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * np.uint64(BASE))
    return np.packbits((own >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart, none for a null text: with the id they name a row, as an id may repeat with other texts."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, digest, size, heads, tails, deep, sketch of every text that has a word; rows without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for i, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    s = shingle_set(text.as_py())
                    if len(s):
                        sig = signature(s)
                        rows.append((i, key, digest(s), len(s), *labels(sig), sketch(sig)))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "key", "digest", "size", "heads", "tails", "deep", "sketch"])

    src = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, key binary, digest binary, size int, heads array<long>, tails array<long>, deep array<long>, sketch array<long>")


def cut(rows: DataFrame, most: int) -> DataFrame:
    """rows (rid, node, and more) of nodes with two members or more, with n, their number.

    Rows of hot nodes, with more than ``most`` members and HOT at most by its choice, get a number above ``most`` by a
    filter; the rest meet their counts by the node.
    """
    counts = stash(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "forest-counts")
    hot = [r.node for r in counts.filter(F.col("n") > most).select("node").collect()]  # HOT rows at most
    shared = rows.filter(~F.col("node").isin(*hot)).join(counts.filter(F.col("n") <= most), "node")
    return rows.filter(F.col("node").isin(*hot)).withColumn("n", F.lit(most + 1).cast("long")).unionByName(shared) if hot else shared


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, node) of the leaves with two members or more, and of the nodes that are still heavy at DEPTH."""
    active = reps.filter(F.col("size") >= LEAST_SET).select("rid", "heads", "tails")
    leaves, heavy = [], []
    for first, trees in ((0, FIRST_LOT), (FIRST_LOT, TREES - FIRST_LOT)):
        rows = active.select("rid", F.inline(F.arrays_zip(F.slice("heads", first + 1, trees), F.slice("tails", first + 1, trees))).alias("head", "tail"))
        most = max(LEAF, active.count() * trees // HOT)
        longer = []  # (rid, what its recall loses) of prefixes that couldn't end at a level
        for level, after in zip(LEVELS, (*LEVELS[1:], None), strict=True):
            here = stash(cut(rows.withColumn("node", node(level)), most), "forest-level")
            leaves.append(here.filter(F.col("n") <= LEAF).select("rid", "node"))
            rows = here.filter(F.col("n") > LEAF)
            if after is None:
                heavy.append(rows.select("rid", "node"))
            else:
                longer.append(rows.select("rid", F.lit(miss(after) - miss(level)).alias("loss")))
                rows = rows.select("rid", "head", "tail")
            if not rows.limit(1).count():
                break
        if first == 0:
            short = math.log(1 - RECALL) - trees * miss(LEVELS[0])
            crowded = reduce(DataFrame.union, longer).groupBy("rid").agg(F.sum("loss").alias("loss")).filter(F.col("loss") > short)
            crowded = stash(crowded.select("rid"), "forest-crowded")
            active = active.join(F.broadcast(crowded) if fits_broadcast(crowded) else crowded, "rid", "left_semi")
    none = reps.limit(0).select("rid", F.lit(0).cast("long").alias("node"))
    return reduce(DataFrame.union, leaves), reduce(DataFrame.union, heavy, none)


def leaf_pairs(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the leaves: their members come together, LEAF at most, and are filtered as in ``cross_pairs``."""
    words = [f"w{i}" for i in range(SKETCH_BITS // 64)]
    met = leaves.join(reps.select("rid", "size", *bits()), "rid").groupBy("node").agg(F.collect_list(F.struct("rid", "size", *words)).alias("m"))
    apart = lambda x, y: sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in words), F.lit(0))
    near = lambda x, y: (10 * F.least(x["size"], y["size"]) >= 8 * F.greatest(x["size"], y["size"])) & (apart(x, y) <= SKETCH_DIFFER)
    others = lambda x, i: F.filter(F.slice(F.col("m"), i + 2, F.lit(LEAF)), lambda y: near(x, y))
    pair = lambda x, y: F.struct(F.least(x["rid"], y["rid"]).alias("a"), F.greatest(x["rid"], y["rid"]).alias("b"))
    return met.select(F.inline(F.flatten(F.transform("m", lambda x, i: F.transform(others(x, i), lambda y: pair(x, y)))))).distinct()


def shared_deep(reps: DataFrame) -> DataFrame:
    """(node, rid) of the prefixes of DEEP values that two representatives or more share."""
    each = reps.select("rid", F.explode("deep").alias("node"))
    return cut(each, max(LEAF, reps.count() * DEEP_TREES // HOT)).select("node", "rid")


def clusters(reps: DataFrame) -> DataFrame:
    """(rid, cluster) of representatives that share a node of full depth with another: minimum label, two rounds."""
    met = stash(shared_deep(reps), "forest-deep")
    label = met.select("rid").distinct().withColumn("cluster", F.col("rid"))
    for _ in range(2):
        low = met.join(label, "rid").groupBy("node").agg(F.min("cluster").alias("low"))
        label = stash(met.join(low, "node").groupBy("rid").agg(F.min("low").alias("cluster")), "forest-labels")
    up = label.select(F.col("rid").alias("cluster"), F.col("cluster").alias("root"))
    return stash(label.join(up, "cluster", "left").select("rid", F.coalesce("root", "cluster").alias("cluster")), "forest-clusters")


def with_sets(docs: DataFrame, need: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """need (doc_id, key, digest, and more) with ``shingles``, the bytes of the sorted hashes of that text."""
    need = stash(need, "forest-need")
    side = F.broadcast(need) if fits_broadcast(need) else need.hint("shuffle_hash")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("__text")).join(side, ["doc_id", "key"]).select("__text", *need.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py()) for t in part.column(0)]
                own = pa.array([digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)])
                cols = [*part.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[1:], "shingles"]).filter(own)

    schema = ", ".join(f"{n} {t}" for n, t in need.dtypes) + ", shingles binary"
    return src.mapInArrow(tidy(run), schema)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    df = np.diff(np.append(first, len(flat)))
    counts = np.zeros(n * n, np.int64)
    often = max(8, n // 16)
    for d in np.unique(df[(df > 1) & (df < often)]):  # seldom ones: pairs of owners
        rows = first[df == d]
        ia, ib = np.triu_indices(d, 1)
        step = max(1, 250_000 // len(ia))
        for i in range(0, len(rows), step):
            own = owner[rows[i : i + step, None] + np.arange(d)]
            counts += np.bincount((own[:, ia] * n + own[:, ib]).ravel(), minlength=n * n)
    counts = counts.reshape(n, n)
    counts += counts.T
    many = np.flatnonzero(df >= often)  # frequent ones: matrix products
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        x = np.zeros((n, len(part)), np.float32)
        x[np.concatenate([owner[first[m] : first[m] + df[m]] for m in part]), np.repeat(np.arange(len(part)), df[part])] = 1
        counts += np.rint(x @ x.T).astype(np.int64)
    return counts


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an intersection of sets of sizes a and b means a similarity of 0.8 or more."""
    return 9 * both >= 4 * (a + b)


def count_cell(cell: pa.Table) -> pa.Table:
    """Links inside a cell: per representative, the documents it is linked to, and the least rid it is joined with."""
    rid, first = np.unique(cell["rid"].to_numpy(), return_index=True)
    cell = cell.take(pa.array(first))
    copies, blk = cell["n"].to_numpy(), cell["blk"].to_numpy()
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in cell["shingles"]]
    size = np.array([len(s) for s in sets])
    link = linked(common(sets), size[:, None], size[None, :])
    np.fill_diagonal(link, False)
    if cell["i"][0].as_py() != cell["j"][0].as_py():
        link &= blk[:, None] != blk[None, :]
    label = rid.copy()
    while True:
        low = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            break
        label = low
    return pa.table({"rid": rid, "links": link @ copies, "other": label})


def cells(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rid, links, other) from every cell of every cluster; sizes: (cluster, blocks)."""
    dealt = sets.join(sizes, "cluster").withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("__p", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = dealt.select("rid", "n", "shingles", "cluster", "blk", F.least("blk", "__p").alias("i"), F.greatest("blk", "__p").alias("j"))
    return dealt.groupBy("cluster", "i", "j").applyInArrow(count_cell, "rid long, links long, other long")


def differ(x: str, y: str) -> Column:
    """Bits in which the sketches whose longs are w0.. with these endings differ."""
    return sum((F.bit_count(F.col(f"w{i}{x}").bitwiseXOR(F.col(f"w{i}{y}"))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def bits(end: str = "") -> list[Column]:
    return [F.col("sketch")[i].alias(f"w{i}{end}") for i in range(SKETCH_BITS // 64)]


def mixed_members(nodes: DataFrame, cluster: DataFrame) -> DataFrame:
    """(node, rid, cluster, main, head, blocks) for nodes with members of several clusters; main is the node's largest, head its first member there."""
    met = nodes.join(cluster, "rid", "left").select("node", "rid", F.coalesce("cluster", "rid").alias("cluster"))
    own = met.groupBy("node", "cluster").agg(F.count(F.lit(1)).alias("k"), F.min("rid").alias("head"))
    main = own.groupBy("node").agg(F.max(F.struct("k", "cluster", "head")).alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("all"))
    several = main.filter("kinds > 1").select("node", F.col("m.cluster").alias("main"), F.col("m.head").alias("head"), F.ceil(F.col("all") / NODE_ROWS).alias("blocks"))
    several = stash(several, "forest-several")
    return met.join(F.broadcast(several) if fits_broadcast(several) else several, "node")


def adopted(nodes: DataFrame, cluster: DataFrame, reps: DataFrame) -> DataFrame:
    """cluster, with texts taken into a larger cluster that they meet in a node if their sketch is near its first member's there.

    Clusters only say which pairs are counted in cells and which are rows, so this changes costs, not results.
    """
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    met = mixed_members(nodes, cluster).filter("cluster <> main").select("rid", "cluster", "main", "head").distinct()
    near = met.join(reps.select(F.col("rid").alias("head"), *bits("_m")), "head").join(reps.select("rid", *bits()), "rid").filter(differ("", "_m") <= SKETCH_DIFFER)
    near = near.select("rid", "cluster", "main").distinct().join(sizes.toDF("main", "to_size"), "main", "left").join(sizes.toDF("cluster", "from_size"), "cluster", "left")
    place = lambda n, c: F.struct(F.coalesce(F.col(n), F.lit(1)), -F.col(c))
    near = near.filter(place("to_size", "main") > place("from_size", "cluster"))
    new = near.groupBy("rid").agg(F.max(F.struct(F.coalesce("to_size", F.lit(1)), -F.col("main"), F.col("main").alias("main")))["main"].alias("into"))
    out = cluster.join(new, "rid", "full").select("rid", F.coalesce("into", "cluster").alias("cluster"))
    heads = out.select(F.col("cluster").alias("rid")).distinct().join(out.select("rid"), "rid", "left_anti")
    return stash(out.unionByName(heads.withColumn("cluster", F.col("rid"))), "forest-adopted")


def cross_pairs(nodes: DataFrame, cluster: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of different clusters that meet in a heavy node.

    In each node only the members outside its main cluster are joined with the node, so that a node full of one
    cluster's texts costs as many rows as it has members. A node of many clusters is dealt into cells of NODE_ROWS
    members a side, so no task meets more than a cell at once. The join's condition drops pairs whose sizes rule a link out,
    or whose sketches differ in more than SKETCH_DIFFER bits: over five deviations from what a similarity of 0.8 gives,
    and where texts that share a passage, but no more, come out.
    """
    here = stash(mixed_members(nodes, cluster).join(reps.select("rid", "size", *bits()), "rid"), "forest-mixed")
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("rid", "size", "cluster", *(f"w{i}" for i in range(SKETCH_BITS // 64)))]
    minor = here.filter("cluster <> main").select("node", block.alias("i"), every.alias("j"), *side("a"))
    other = here.select("node", block.alias("j"), every.alias("i"), "main", *side("b"))
    fits = (F.col("cluster_a") != F.col("cluster_b")) & (10 * F.least("size_a", "size_b") >= 8 * F.greatest("size_a", "size_b")) & (differ("_a", "_b") <= SKETCH_DIFFER)
    once = (F.col("cluster_b") == F.col("main")) | (F.col("rid_a") < F.col("rid_b"))
    pairs = minor.join(other, (minor["node"] == other["node"]) & (minor["i"] == other["i"]) & (minor["j"] == other["j"]) & fits & once)
    return pairs.select(F.least("rid_a", "rid_b").alias("a"), F.greatest("rid_a", "rid_b").alias("b")).distinct()


def across_clusters(pairs: DataFrame, cluster: DataFrame) -> DataFrame:
    """The pairs, each once, less those inside a cluster, which cells count."""
    side = lambda x: cluster.select(F.col("rid").alias(x), F.col("cluster").alias(f"c{x}"))
    out = pairs.distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.filter(F.coalesce(F.col("ca") != F.col("cb"), F.lit(True))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are linked."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("shingles").alias(f"s{x}"), F.col("n").alias(f"n{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                ok.append(bool(linked(np.intersect1d(x, y, True).size, len(x), len(y))))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long, na long, nb long")


def components(edges: DataFrame) -> DataFrame:
    """(rid, comp) for the ends of edges (a, b): minimum label over neighbours, then over the label's label, until stable."""
    both = stash(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "forest-edges")
    label = stash(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "forest-comp")
    while True:
        near = both.join(label.withColumnRenamed("rid", "b"), "b").groupBy("a").agg(F.min("comp").alias("low")).withColumnRenamed("a", "rid")
        step = label.join(near, "rid").select("rid", F.least("comp", "low").alias("new"), "comp")
        up = label.select(F.col("rid").alias("new"), F.col("comp").alias("root"))
        step = stash(step.join(up, "new", "left").select("rid", F.least("new", F.coalesce("root", "new")).alias("new"), "comp"), "forest-comp")
        label = step.select("rid", F.col("new").alias("comp"))
        if not step.filter("new <> comp").limit(1).count():
            return label


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, class_id and class_key (the least id of the component, and its text's key), copy_id, n_links per row with an id and a word."""
    bound_batches(docs.sparkSession)
    prints = stash(fingerprints(docs, id_col, text_col), "forest-prints")
    labels = ["size", "heads", "tails", "deep", "sketch"]  # equal for equal digests
    reps = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in labels])
    reps = stash(reps.select("digest", "least.doc_id", "least.key", "n", *labels).withColumn("rid", F.monotonically_increasing_id()), "forest-reps")
    leaves, heavy = forest(reps)
    found = stash(leaf_pairs(leaves, reps), "forest-found")
    nodes = stash(heavy, "forest-nodes")
    dense = stash(reps.join(nodes.select("rid").distinct(), "rid", "left_semi").select("rid", "deep", "size", "sketch"), "forest-dense")
    cluster = clusters(dense)
    for _ in range(2):
        cluster = adopted(nodes, cluster, dense)
    info = reps.select("rid", "doc_id", "key", "digest", "n", "size")
    members = cluster.join(info, "rid")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s")).filter("k > 1")
    sizes = stash(sizes.select("cluster", F.greatest(F.ceil(F.col("k") / CELL_ROWS), F.ceil(F.col("s") / CELL_SHINGLES)).alias("blocks")), "forest-cells")
    inside = with_sets(docs, members.join(sizes.select("cluster"), "cluster").select("doc_id", "key", "digest", "rid", "n", "cluster"), id_col, text_col)
    counted = stash(cells(inside, sizes), "forest-counted")
    pairs = stash(across_clusters(found.union(cross_pairs(nodes, cluster, dense)), cluster), "forest-pairs")
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    across = stash(verified(pairs, with_sets(docs, ends.join(info, "rid").select("doc_id", "key", "digest", "rid", "n"), id_col, text_col)).distinct(), "forest-across")
    links = counted.select("rid", "links").union(across.select("a", "nb")).union(across.select("b", "na")).groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(counted.filter("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")).union(across.select("a", "b")))
    named = info.join(comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = named.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("comp", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("class_key"))
    classes = stash(named.join(least, "comp").join(links, "rid", "left").select("digest", "class_id", "class_key", F.col("doc_id").alias("copy_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "forest-classes")
    return prints.select("doc_id", "key", "digest").join(classes, "digest").drop("digest")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, class_id (the least id of its component), copy_id (the least id with an equal set), n_links."""
    own = classified(docs, id_col, text_col).select("doc_id", "class_id", "copy_id", "n_links")
    rest = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).filter(F.col("doc_id").isNull() | F.col("t").isNull() | ~F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    rest = rest.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return own.unionByName(rest).withColumnRenamed("doc_id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id and, for that id, the least key of its text.

    Rows are told apart by id and text, so a repeated id loses only the texts that are near copies. Rows without an id
    stay; of rows that repeat both id and text one stays, the least by its other columns.
    """
    rows = stash(classified(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "class_id", "class_key"), "forest-keep")
    gone = stash(rows.filter("__id <> class_id OR __key <> class_key").select("__id", "__key").distinct(), "forest-gone")
    marked = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": text_key(F.col(text_col))})
    names = ["__id", "__key"]
    kept = marked.join(F.broadcast(gone) if fits_broadcast(gone) else gone, names, "left_anti")
    every = marked.filter("__id IS NOT NULL").groupBy(*names).count().filter("count > 1").select(*names)
    twice = stash(every.join(gone, names, "left_anti"), "forest-twice")
    if twice.limit(1).count():
        side = F.broadcast(twice) if fits_broadcast(twice) else twice
        row = F.struct(*docs.columns)
        one = kept.join(side, names, "left_semi").groupBy(*names).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
        return kept.join(side, names, "left_anti").select(*docs.columns).unionByName(one)
    return kept.select(*docs.columns)
