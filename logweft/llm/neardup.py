"""Near-duplicate documents: an LSH forest over MinHash signatures, links confirmed on whole sets.

1.  Each text becomes its set of five-word shingles (64-bit hashes), a hash of
    that set, and a signature of ``SIZE`` one-byte minima.  Equal sets form a
    class, and its smallest id stands for it from here on.
2.  The forest is ``SIZE / DEPTH`` sorted orders of the signatures: order k
    starts at position ``k * DEPTH`` and wraps around.  Of the first ``DEPTH``
    minima a whole byte is kept, of all others half of one.  All orders are sorted
    at once, by ranges that end where a prefix of ``DEPTH`` does; only a prefix
    with very many members is cut further, so that no task depends on how many
    documents are alike, and the members beside the cuts are compared once more.
3.  A row's candidates are its neighbours with the longest common prefixes.
    The depth adapts to the region: it is lowered from the deepest until about
    ``REGION`` rows share a prefix, but never under ``DEPTH``, and all rows of
    such a part are compared, by signature.  Where a part is cut off, its
    edges stay tied to the next row of the order.  Rows that agree in
    ``AGREE`` positions are candidates; of a part's candidate graph only a
    spanning forest leaves the task, so output is linear in its input.
4.  Components of the candidates are clusters.  Texts meet once more by
    cluster, and links are decided exactly, on whole sets.  A cluster over
    ``LEAST`` shingles is dealt in blocks (see ``blocks_of``): its most typical
    text goes to every block, what is linked to it needs nothing more among
    itself, and only the texts that are left are queries against all blocks.
    Within a block the sets are indexed by their rarest shingles only, as many
    as any similar set must share one of, so common passages cost nothing.
5.  Components of the confirmed links are the groups of near copies.

A pair at similarity 0.75 shares a prefix of four in at least one of 24 orders
with probability 0.9999, and agrees in 56 of 96 half bytes with 0.99998.  In
regions over ``REGION`` rows only pairs in one part are compared, so there the
figure is a measured one; the tests keep it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HASHES, saved
from .components import components

WIDTH, PERCENT = 5, 75
SIZE, DEPTH, AGREE, REGION = 96, 4, 56, 2048
#: Bytes of a sort key: the order, its prefix, and all minima in half bytes.
KEY = 1 + DEPTH + SIZE // 2
#: Shingles of a cluster that one task holds, at least and at most, and into how many blocks it is dealt between the two (plans only, no results).
LEAST, BLOCK, SPREAD = 8_000, 2_000_000, 64
#: Odd multipliers and masks of the minima, drawn once from a fixed seed.
_RNG = np.random.default_rng(20240229)
MULTIPLIERS = _RNG.integers(0, 2**63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RNG.integers(0, 2**63, SIZE, np.uint64)
STEP, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles.

    Words are what stands between blanks, A-Z lower-cased; a text with fewer
    words is one shingle, one without words has none.
    """
    # bytes.lower and bytes.split know ASCII letters and blanks only.
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    k = min(width, n)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h = h * STEP + w[i : n - k + 1 + i]
    h += np.uint64(k)
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return np.unique(h ^ (h >> np.uint64(31)))


def signature(hashes: np.ndarray) -> bytes:
    """The low bytes of SIZE minima; which hash is least depends on the high bits."""
    best = None
    for at in range(0, len(hashes), 4096):
        low = ((hashes[None, at : at + 4096] ^ MASKS[:, None]) * MULTIPLIERS[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return (best & np.uint64(255)).astype(np.uint8).tobytes()


def halves(sig: bytes) -> bytes:
    """The low half of each byte, two to a byte."""
    s = np.frombuffer(sig, np.uint8) & 15
    return ((s[0::2] << 4) | s[1::2]).astype(np.uint8).tobytes()


def unpacked(packed: np.ndarray) -> np.ndarray:
    out = np.empty((packed.shape[0], 2 * packed.shape[1]), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, class, sig, half); the last three are null for texts without words."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("half", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sets, sigs = [], [], []
            for text in b.column(1):
                s = shingles(text.as_py())
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array([x and halves(x) for x in sigs], pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class Forest:
    """A union-find over the ids of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, r = self.up, x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def links(self) -> tuple[list[int], list[int]]:
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


def compare(sig: np.ndarray, ids: np.ndarray, forest: Forest, depth: int = 0) -> None:
    """Join the candidates of one region; rows (half bytes) are in sorted order and agree in the first ``depth`` ones."""
    n = len(ids)
    if n == 2:
        if ids[0] != ids[1] and np.count_nonzero(sig[0] == sig[1]) >= AGREE:
            forest.join(int(ids[0]), int(ids[1]))
        return
    if n > REGION:
        if depth < SIZE:
            deeper = min(depth + 2, SIZE)
            cut = np.flatnonzero((sig[1:, depth:deeper] != sig[:-1, depth:deeper]).any(axis=1)) + 1
            for a, b in zip([0, *cut], [*cut, n], strict=True):
                if b - a > 1:
                    compare(sig[a:b], ids[a:b], forest, deeper)
        near = np.flatnonzero((sig[1:] == sig[:-1]).sum(axis=1) >= AGREE)
        for i in near.tolist():
            forest.join(int(ids[i]), int(ids[i + 1]))
        return
    # The row nearest to the commonest bytes first: pairs among those it reaches bring nothing new.
    common = np.array([np.bincount(c).argmax() for c in sig.T], np.uint8) if n > 8 else sig[0]
    core = int((sig == common).sum(axis=1).argmax())
    reached = (sig == sig[core]).sum(axis=1) >= AGREE
    reached[core] = True
    for i in [core, *np.flatnonzero(~reached).tolist()]:
        like = reached if i == core else (sig == sig[i]).sum(axis=1) >= AGREE
        for j in np.flatnonzero(like).tolist():
            if j != i:
                forest.join(int(ids[i]), int(ids[j]))


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, id, long), sorted by key, to the spanning links of their regions.

    The first and the last row come out as well, with their keys, if they are of a long region.
    """
    forest, held, held_ids = Forest(), np.empty((0, KEY), np.uint8), np.empty(0, np.int64)
    first = last_row = None

    def regions(keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        start = 0
        for end in ends.tolist():
            if end - start > 1:
                compare(unpacked(keys[start:end, DEPTH + 1 :]), ids[start:end], forest)
            start = end

    for b in batches:
        if not b.num_rows:
            continue
        first = first or tuple(c[0].as_py() for c in b.columns)
        last_row = tuple(c[-1].as_py() for c in b.columns)
        keys = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, KEY)
        keys, ids = np.concatenate([held, keys]), np.concatenate([held_ids, b.column(1).to_numpy(zero_copy_only=False)])
        cut = np.flatnonzero((keys[1:, : DEPTH + 1] != keys[:-1, : DEPTH + 1]).any(axis=1)) + 1
        regions(keys, ids, cut)
        last = int(cut[-1]) if len(cut) else 0
        if len(ids) - last > 4 * REGION:  # a very long run goes in pieces, tied by a row in common
            compare(unpacked(keys[last:, DEPTH + 1 :]), ids[last:], forest)
            last = len(ids) - 1
        held, held_ids = keys[last:], ids[last:]
    regions(held, held_ids, np.array([len(held_ids)]))
    a, r = forest.links()
    edges = [x for x in (first, last_row) if x and x[2]]
    a, r, e = a + [x[1] for x in edges], r + [x[1] for x in edges], [None] * len(a) + [x[0] for x in edges]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(e, pa.binary())], names=["a", "b", "edge"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def needed(n: int) -> int:
    """How many of ``n`` shingles, the first by any common order, hold one that a similar set must have among its own first ones."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


class Index:
    """The sets of some documents by their rarest shingles; ``similar`` decides on whole sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.flat, self.end = np.concatenate(sets), np.cumsum(self.size)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.terms, term, self.often = np.unique(self.flat, return_inverse=True, return_counts=True)
        #: How much each set shares with all of them, by its own size.
        self.weight = np.bincount(self.owner, self.often[term]) / np.maximum(self.size, 1)
        # Each set's shingles from the rarest on, ties by hash: terms are sorted, so by their place.
        order = np.lexsort((term, self.often[term], self.owner))
        place = np.arange(len(order)) - np.repeat(self.end - self.size, self.size)
        first = order[place < np.repeat([needed(n) for n in self.size.tolist()], self.size)]
        first = first[np.argsort(term[first], kind="stable")]
        self.by_term = self.owner[first]
        self.start = np.searchsorted(term[first], np.arange(len(self.terms) + 1))

    def shared(self, x: np.ndarray, those: np.ndarray) -> np.ndarray:
        """How many shingles each of some sets shares with ``x``."""
        size = self.size[those]
        at = np.repeat(self.end[those] - size - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(np.repeat(np.arange(len(those)), size), np.isin(self.flat[at], x), len(those)).astype(np.int64)

    def similar(self, x: np.ndarray, every: bool = False) -> np.ndarray:
        """Positions of the sets that are similar enough to ``x``; ``every`` set is looked at, or those that its rarest shingles lead to."""
        if every:
            those = np.arange(len(self.size))
        else:
            at = np.minimum(np.searchsorted(self.terms, x), len(self.terms) - 1)
            known = self.terms[at] == x
            often = np.where(known, self.often[at], 0)  # a shingle that no set has is the rarest
            first = np.lexsort((x, often))[: needed(len(x))]
            lead = at[first][known[first]]
            those = np.unique(np.concatenate([self.by_term[self.start[t] : self.start[t + 1]] for t in lead.tolist()])) if len(lead) else np.empty(0, np.int64)
        those = those[(100 * self.size[those] >= PERCENT * len(x)) & (PERCENT * self.size[those] <= 100 * len(x))]
        if not len(those):
            return those
        both = self.shared(x, those)
        return those[100 * both >= PERCENT * (self.size[those] + len(x) - both)]


def confirm(ids: list[int], sets: list[np.ndarray], forest: Forest) -> None:
    """Join all pairs of one cluster that are similar enough, exactly.

    The set that shares most with the rest comes first.  Those it is linked
    to are joined through it, so pairs among them can bring nothing new; every
    other set is looked up in the index.
    """
    if len(ids) < 2:
        return
    if len(ids) == 2:
        if alike(sets[0], sets[1]):
            forest.join(ids[0], ids[1])
        return
    index = Index(sets)
    core = int(np.argmax(index.weight))
    done = index.similar(sets[core], every=True)
    for i in [core, *np.setdiff1d(np.arange(len(ids)), done).tolist()]:
        for j in (done if i == core else index.similar(sets[i])).tolist():
            forest.join(ids[i], ids[j])


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cluster, x, y, asks, id, text), sorted by the first three, to spanning links of each task.

    Where no row asks, all pairs are compared, and else the asking rows with all others.
    """
    now, ids, sets, asks = None, [], [], []

    def links() -> pa.RecordBatch:
        forest = Forest()
        if not any(asks):
            confirm(ids, sets, forest)
        elif others := [k for k, q in enumerate(asks) if not q]:
            index = Index([sets[k] for k in others])
            for k in (k for k, q in enumerate(asks) if q):
                for j in index.similar(sets[k]).tolist():
                    forest.join(ids[k], ids[others[j]])
        a, r = forest.links()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64())], names=["a", "b"])

    for b in batches:
        for key, q, i, text in zip(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
            if key != now:
                yield links()
                now, ids, sets, asks = key, [], [], []
            ids.append(i)
            sets.append(shingles(text.as_py()))
            asks.append(q)
    yield links()


LINK = "a long, b long"


def decided(tasks: DataFrame) -> DataFrame:
    return tasks.select("cluster", "x", "y", "asks", "id", "text").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(confirmed, LINK)


def typical(big: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, leader): the document nearest to the commonest byte in each position of its cluster's signatures.

    Members meet the commonest bytes by cluster and block, so that a cluster
    is never whole in one task; only each task's best goes on.
    """
    sig = big.join(classes.groupBy(F.col("rep").alias("_id")).agg(F.max("sig").alias("sig")), "_id")
    bytes_ = F.transform(F.sequence(F.lit(1), F.lit(SIZE)), lambda i: F.hex(F.substring(F.col("sig"), i, F.lit(1))))
    rows = sig.select("cluster", "block", "blocks", "_id", bytes_.alias("bytes"))
    common = rows.select("cluster", "blocks", F.posexplode("bytes").alias("at", "byte")).groupBy("cluster", "blocks", "at", "byte").count().groupBy("cluster", "blocks", "at").agg(F.max_by("byte", F.struct("count", "byte")).alias("byte"))
    mode = common.groupBy("cluster", "blocks").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "byte"))), lambda x: x["byte"]).alias("mode"))
    dealt = mode.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "mode")
    same = F.size(F.filter(F.zip_with("bytes", "mode", lambda x, y: x == y), lambda x: x))
    return rows.join(dealt, ["cluster", "block"]).groupBy("cluster").agg(F.max_by("_id", F.struct(same, -F.col("_id"))).alias("leader"))


def confirmed_links(docs: DataFrame, placed: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spanning links of all clusters (placed: _id, cluster, block, blocks), decided on whole sets."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # One text of a class is enough: the representative's.
    texts = source.join(placed, F.col("id") == F.col("_id"))
    alone = {"x": F.lit(0), "y": F.lit(0), "asks": F.lit(False)}
    sure = saved(decided(texts.where("blocks = 1").withColumns(alone)), "links")
    big = placed.where("blocks > 1")
    if not big.limit(1).count():
        return sure
    big_texts = saved(texts.where("blocks > 1").select("cluster", "block", "blocks", "id", "text"), "big-clusters")
    leaders = typical(big, classes).withColumnRenamed("cluster", "_of")
    lead = big_texts.join(leaders, (F.col("cluster") == F.col("_of")) & (F.col("id") == F.col("leader")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = big_texts.select("cluster", F.col("block").alias("x"), F.lit(0).alias("y"), F.lit(False).alias("asks"), "id", "text").unionByName(lead.select("cluster", every.alias("x"), F.lit(0).alias("y"), F.lit(True).alias("asks"), "id", "text"))
    core = saved(decided(first), "core-links")
    rest = big_texts.join(core.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
    # The rest in blocks of queries, as many as its own shingles fill.
    # Rows meet their cluster's figures by block too, so that no cluster is whole in one task.
    asking = rest.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n")), "id").groupBy("cluster", "blocks").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("asking"))
    share = saved(asking.select("cluster", every.alias("block"), "asking"), "asking")
    queries = rest.join(share, ["cluster", "block"]).withColumn("y", F.pmod(F.xxhash64("id", F.lit("q")), F.col("asking")).cast("int"))
    second = big_texts.join(share, ["cluster", "block"]).select("cluster", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("y"), F.lit(False).alias("asks"), "id", "text")
    second = second.unionByName(queries.select("cluster", every.alias("x"), "y", F.lit(True).alias("asks"), "id", "text"))
    return sure.unionByName(core).unionByName(saved(decided(second), "rest-links"))


def candidate_links(classes: DataFrame, parts: int) -> DataFrame:
    """Spanning links of the regions of all orders.

    A region is whole in one of ``parts`` ranges.  One with more than
    ``4 * REGION`` members and a 2000th of all rows (there are under 2000 such,
    whatever the data) can be cut; its rows beside a cut meet once more.
    """
    turn = DEPTH // 2  # bytes of half bytes that an order's prefix takes
    orders = F.array(*(F.concat(F.lit(bytes([k])), F.expr(f"substring(sig, {k * DEPTH + 1}, {DEPTH})"), F.expr(f"substring(half, {(k + 1) * turn + 1})"), F.expr(f"substring(half, 1, {(k + 1) * turn})")) for k in range(SIZE // DEPTH)))
    keys = classes.select(F.explode(orders).alias("key"), F.col("rep").alias("id"))
    keys = keys.withColumn("prefix", F.expr(f"substring(key, 1, {DEPTH + 1})"))
    most = max(4 * REGION, classes.count() * (SIZE // DEPTH) // 2000)
    long = saved(keys.groupBy("prefix").count().where(F.col("count") > most).select("prefix", F.lit(True).alias("long")), "long-regions")
    dealt = keys.join(F.broadcast(long), "prefix", "left").repartitionByRange(parts, "prefix", F.when(F.col("long"), F.col("key"))).sortWithinPartitions("key")
    found = saved(dealt.select("key", "id", F.coalesce("long", F.lit(False)).alias("long")).mapInArrow(candidates, f"{LINK}, edge binary"), "candidates")
    edges = found.where("edge is not null").select(F.col("edge").alias("key"), F.col("a").alias("id"), F.lit(False).alias("long"))  # two rows of a range at most
    ties = saved(edges.repartition(1).sortWithinPartitions("key").mapInArrow(candidates, f"{LINK}, edge binary"), "ties")
    return found.where("edge is null").unionByName(ties).select("a", "b")


def blocks_of(shingles: F.Column) -> F.Column:
    """Into how many blocks a cluster goes: none smaller than ``LEAST`` but for its last one, none larger than ``BLOCK``, and ``SPREAD`` in between."""
    size = F.least(F.greatest(shingles / SPREAD, F.lit(LEAST)), F.lit(BLOCK))
    return F.greatest(F.ceil(shingles / size), F.lit(1)).cast("int")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, root) for every row: shingles in its set and the smallest id it is linked to, directly or not.

    Texts without words are linked with nothing and are their own roots.
    Rows that share an id count as one document.  A null id is never linked
    and has a null root.  Ids are whole numbers (anything that casts to one).
    """
    spark = docs.sparkSession
    rows = saved(sketches(docs, id_col, text_col), "sketches")
    classes = saved(rows.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.max("sig").alias("sig"), F.max("half").alias("half"), F.max("n").alias("n")), "classes")
    near = candidate_links(classes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cluster = components(near).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    sized = cluster.join(classes.select(F.col("rep").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n")), "id")
    blocks = sized.groupBy("cluster").agg(blocks_of(F.sum("n")).alias("blocks"))
    placed = saved(sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(F.col("id").alias("_id"), "cluster", "block", "blocks"), "clusters")
    sure = confirmed_links(docs, placed, classes, id_col, text_col)
    # Rows of one id are one document: where their sets differ, the id ties their classes.
    member = saved(rows.select("id", "n", "class").join(classes.select("class", "rep"), "class", "left").select("id", "n", "rep"), "members")
    torn = member.where("id is not null").groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("id")
    ties = member.join(torn, "id", "left_semi").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    root = components(sure.unionByName(ties)).select(F.col("node").alias("rep"), "root")
    return member.join(root, "rep", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id, kept: one row per row of ``docs``.

    ``kept`` holds for the smallest id of each component, and for null ids.
    Other columns are not read, so they cannot clash.  See ``groups``.
    """
    out = groups(docs, id_col=id_col, text_col=text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, columns as they were, with the smallest id of each group of near copies only."""
    gone = groups(docs, id_col=id_col, text_col=text_col).where("id <> root").select(F.col("id").alias("_lw_id")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_lw_id"), "left_anti").select(*docs.columns)
