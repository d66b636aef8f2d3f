"""SimHash fingerprints and their close pairs by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.components import connected
from dockledger.llm.ranges import fresh, saved, slices
from dockledger.operators.skew import attach

SEED = 42
# Fingerprints of a leaf of the shared tree, and the most leaves; the tree is made from a few
# fingerprints for each leaf, so it never holds more than LEAVES * SAMPLE numbers.
LEAF = 2_000
LEAVES = 65_536
SAMPLE = 16
_BLOCK = 65_536
# Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; a shorter text is one run."""
    words = text.encode("utf-8", "replace").lower().split()  # splits and lowers ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes; zero without any."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        some = np.ascontiguousarray(hashes[i : i + _BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, out: str = "fp") -> DataFrame:
    """doc_id and the fingerprint of the whole text as a signed 64-bit number; null texts count as empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(shingle_hashes(t or "", shingle)) for t in batch.column(1).to_pylist()]
            values = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", out])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField(out, T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(made, schema)


@dataclass
class Node:
    """Points at most ``cut`` bits from ``vantage`` lie left, the others right."""

    vantage: np.uint64 = np.uint64(0)
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


def build_tree(sample: np.ndarray, leaves: int, rng: np.random.Generator | None = None) -> Node:
    """A vantage-point tree with about ``leaves`` leaves, halving the sample at every node."""
    rng = rng or np.random.default_rng(7)
    count = 0

    def grow(points: np.ndarray, want: int) -> Node:
        nonlocal count
        if want > 1 and len(points) > 1:
            tries = points[rng.integers(0, len(points), 4)]
            apart = [np.bitwise_count(points ^ v) for v in tries]
            best = int(np.argmax([d.astype(float).std() for d in apart]))
            cut = int(np.median(apart[best]))
            inner = apart[best] <= cut
            if inner.all():
                cut -= 1
                inner = apart[best] <= cut
            if inner.any() and not inner.all():
                share = max(1, min(want - 1, round(want * inner.mean())))
                return Node(
                    tries[best], cut, grow(points[inner], share), grow(points[~inner], want - share)
                )
        count += 1
        return Node(leaf=count - 1)

    return grow(sample, leaves)


def route(tree: Node, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """The leaves of each point: (leaf, indices, at home).

    A point has one home. It visits further leaves whose region its ball may touch, by the
    triangle inequality. Two points part at one node only, and there just the left one
    visits the other side, so a close pair meets once, in the home of one of them.
    """
    stack = [(tree, np.arange(len(points)), np.empty(0, dtype=np.int64))]
    while stack:
        node, home, visit = stack.pop()
        if node.leaf >= 0:
            if len(home):
                yield node.leaf, home, True
            if len(visit):
                yield node.leaf, visit, False
            continue
        near = np.bitwise_count(points[home] ^ node.vantage).astype(np.int16)
        far = np.bitwise_count(points[visit] ^ node.vantage).astype(np.int16)
        crossing = home[(near <= node.cut) & (near + radius > node.cut)]
        sides = (
            (node.left, home[near <= node.cut], visit[far - radius <= node.cut]),
            (node.right, home[near > node.cut], np.concatenate((visit[far + radius > node.cut], crossing))),
        )
        stack.extend(side for side in sides if len(side[1]) or len(side[2]))


def close_links(homes: np.ndarray, visits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among homes, and between homes and visitors, that join all close pairs of a leaf.

    Two vantage points sort the leaf once more: only points whose distances to both differ by
    ``radius`` at most are compared. Of the pairs found, a spanning forest is
    returned, so a dense leaf gives no more links than it has points.
    """
    points = np.concatenate((homes, visits))
    if len(points) < 2 or not len(homes):
        return []
    first = points[0]
    d1 = np.bitwise_count(points ^ first).astype(np.int16)
    second = points[int(np.argmin(np.abs(d1 - 32)))]
    d2 = np.bitwise_count(points ^ second).astype(np.int16)
    order = np.argsort(d1, kind="stable")
    s1 = d1[order]
    parent = np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    own = np.arange(len(homes))
    for a in np.unique(d1[: len(homes)]):
        near = order[np.searchsorted(s1, a - radius) : np.searchsorted(s1, a + radius, side="right")]
        ring = own[d1[: len(homes)] == a]
        for b in np.unique(d2[ring]):
            mine = ring[d2[ring] == b]
            others = near[np.abs(d2[near] - b) <= radius]
            for i in range(0, len(mine), 256):
                some = mine[i : i + 256]
                x, y = np.nonzero(np.bitwise_count(points[some, None] ^ points[None, others]) <= radius)
                for p, q in zip(some[x].tolist(), others[y].tolist()):
                    if p < q and (rp := root(p)) != (rq := root(q)):
                        parent[rq] = rp
                        links.append((p, q))
    return links


# Bands of the similarity stage and smallest hashes in each. Two documents share a band with a
# chance of J ** ROWS: at a similarity of 0.8 all bands miss three pairs in a million.
BANDS = 32
ROWS = 5
# Shingles of a bucket's members that a task holds, with as many of those that it compares them with.
BLOCK_SHINGLES = 1 << 20
_KEY = ["n", "k1", "k2"]
_SIGNS = np.random.default_rng(11).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_FLIPS, _TIMES = _SIGNS[0], _SIGNS[1] | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band: of the smallest of the hashes in each of ROWS random orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[i : i + 1024] ^ _FLIPS[:, None]) * _TIMES[:, None]).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for some in least.reshape(BANDS, ROWS).T:
        out = (out ^ some) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (distinct shingles), k1 and k2 (128 bits of their set), its fingerprint and the bands, none without shingles."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, fps, found = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(text or "", shingle))
                key = xxhash.xxh3_128_digest(hashes.tobytes(), SEED)
                keys.append((len(hashes), *np.frombuffer(key, dtype=np.int64).tolist()))
                fps.append(fingerprint(hashes))
                found.append(bands(hashes).view(np.int64) if len(hashes) else [])
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
            columns += [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_KEY, "fp", "bands"])

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(made, "doc_id long, n long, k1 long, k2 long, fp long, bands array<long>")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and the distinct shingles of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            sets = [np.unique(shingle_hashes(t or "", shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"]
            )

    return docs.mapInArrow(made, "doc_id long, shingles array<long>")


def alike(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose distinct shingles have a Jaccard similarity of ``threshold`` at least.

    ``pairs`` is a saved table. Only the texts it names are read into sets, and every pair is checked on them.
    """
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = saved(_shingle_sets(texts, shingle), "shingles")
    for side in ("a", "b"):
        pairs = attach(pairs, sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"of_{side}")), [side], "inner")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.where(shared / (F.size("of_a") + F.size("of_b") - shared) >= threshold).select("a", "b")


def _links_between(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Pairs of a left and a right document of different components that are similar, by their shingle sets."""
    sides = [left, right]
    sets = [t.column("shingles").combine_chunks() for t in sides]
    node, root = ([t.column(c).to_numpy() for t in sides] for c in ("node", "root"))
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in sets]
    names, place = np.unique(np.concatenate([x.flatten().to_numpy() for x in sets]), return_inverse=True)
    mine, theirs = np.split(place, [int(sizes[0].sum())])
    starts, held = np.cumsum(sizes[0]) - sizes[0], np.zeros(len(names), np.int64)
    bounds = np.append(0, np.cumsum(sizes[1]))
    found = []
    for i, (start, size) in enumerate(zip(starts.tolist(), sizes[0].tolist())):
        held[mine[start : start + size]] = 1
        sums = np.append(0, np.cumsum(held[theirs]))
        shared = sums[bounds[1:]] - sums[bounds[:-1]]
        held[mine[start : start + size]] = 0
        similar = (shared / (sizes[1] + size - shared) >= threshold) & (root[1] != root[0][i])
        found += [(int(node[0][i]), int(node[1][j])) for j in np.flatnonzero(similar).tolist()]
    pairs = [(min(p), max(p)) for p in found]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _crowded_links(
    docs: DataFrame, members: DataFrame, buckets: DataFrame, roots: DataFrame, shingle: int, threshold: float
) -> DataFrame:
    """Similar pairs (a, b) of a bucket of three and more that no link joins yet and that were not compared with its first.

    All members outside the bucket's largest component meet all others on their shingle sets, in blocks
    of about BLOCK_SHINGLES by BLOCK_SHINGLES; a block gives out similar pairs only.
    """
    crowded = attach(members, buckets.where("m > 2").select("h", "first"), ["h"], "inner")
    crowded = crowded.where("node <> first")
    crowded = saved(
        attach(crowded, roots, ["node"]).select("h", "node", "n", F.coalesce("root", "node").alias("root")), "crowded"
    )
    counts = crowded.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    mixed = counts.groupBy("h").agg(
        F.max(F.struct("m", "root"))["root"].alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")
    ).where("roots > 1")
    parts = F.ceil(F.col("n") / BLOCK_SHINGLES)
    mixed = attach(crowded.drop("n"), mixed.select("h", "main", parts.alias("parts")), ["h"], "inner")
    mixed = saved(mixed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "mixed")
    wanted = saved(mixed.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = saved(_shingle_sets(texts.dropDuplicates(), shingle).withColumnRenamed("doc_id", "node"), "sets")
    full = attach(mixed, sets, ["node"], "inner")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = full.where("root <> main").select("h", F.col("part").alias("i"), every.alias("j"), "node", "root", "shingles")
    same = {c: F.col(c).alias(c) for c in ("h", "node", "root", "shingles")}
    right = full.select(same["h"], every.alias("i"), F.col("part").alias("j"), same["node"], same["root"], same["shingles"])
    met = left.groupBy("h", "i", "j").cogroup(right.groupBy("h", "i", "j"))
    return met.applyInArrow(lambda a, b: _links_between(a, b, threshold), "a long, b long").distinct()


def fingerprint_pairs(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes that link fingerprints at most ``radius`` bits apart, found by the tree.

    ``nodes`` is a saved table with node and fp. Each fingerprint stands by its smallest node: the others
    are paired with it, and it with those of close fingerprints, as :func:`close_edges` links them. So the pairs
    are no more than the nodes and the links of the leaves, however many copies there are.
    """
    first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = attach(nodes.select("fp", "node"), first, ["fp"], "inner").where("node <> first").select("first", "node")
    apart = close_edges(first, radius)
    for side in ("a", "b"):
        apart = apart.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"of_{side}")), side)
    return same.toDF("a", "b").union(apart.select(F.least("of_a", "of_b"), F.greatest("of_a", "of_b"))).distinct()


def _not_joined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}"))
        pairs = attach(pairs, own, [side])
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def later_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 2) -> DataFrame:
    """doc_id of every document that a group of similar documents does not keep.

    Two documents are similar if the sets of their shingles have a Jaccard similarity of ``threshold``
    at least. Groups are connected by such pairs and keep their smallest doc_id. Documents with equal sets
    are compared once.

    SimHash fingerprints at most ``radius`` bits apart, found by the vantage-point tree, propose the first pairs.
    Similar documents may be further apart than a tree can tell (about ten of 64 bits at 0.8), so min-hashing
    proposes the rest: documents that share a band and that the tree's links do not join. Every pair is checked
    on its shingles, so no other document is linked. Of a bucket of min-hashes, all members are compared with
    its smallest id first, then those with each other that no link joins yet.
    """
    rows = saved(_sketches(docs, shingle), "sketches")
    nodes = rows.groupBy(*_KEY).agg(
        F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
    )
    nodes = saved(nodes, "nodes")
    near = saved(fingerprint_pairs(nodes.where("n > 0"), radius), "near")
    near = saved(alike(docs, near, shingle, threshold), "close")
    members = nodes.select(F.explode("bands").alias("h"), "node", "n")
    buckets = members.groupBy("h").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = saved(buckets, "buckets")
    members = saved(attach(members, buckets.select("h"), ["h"], "left_semi"), "members")
    stars = attach(members, buckets.select("h", "first"), ["h"], "inner").where("node <> first")
    stars = stars.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = saved(_not_joined(stars, connected(near)), "stars")
    links = saved(near.union(alike(docs, stars, shingle, threshold)), "links")
    roots = connected(links)
    crowd = saved(_crowded_links(docs, members, buckets, roots, shingle, threshold), "crowd")
    if not crowd.isEmpty():
        roots = connected(links.union(crowd))
    rooted = nodes.join(roots, "node", "left").select(*_KEY, F.coalesce("root", "node").alias("root"))
    return attach(rows.select("doc_id", *_KEY), rooted, _KEY).where("doc_id <> root").select("doc_id").distinct()


def without_near_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents, less those whose group of similar documents has a smaller doc_id.

    Empty and null texts are alike, so one of them stays. Documents without a doc_id stay; rows that repeat
    an id go or stay together.
    """
    gone = saved(later_copies(docs, shingle, threshold), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    (name,) = fresh(docs.columns, "__gone")
    gone = gone.select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def close_edges(fps: DataFrame, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) between different fingerprints at most ``radius`` bits apart.

    ``fps`` has one row per fingerprint, column fp. The edges connect exactly what all close pairs
    connect. The tree's leaves number rows / ``leaf``, LEAVES at most; it is made on the
    driver from a sample of bounded size, ordered by a hash, and sent to the tasks that
    route fingerprints. It decides where points meet, never which pairs are found.
    """
    spark = fps.sparkSession
    leaves = max(1, min(LEAVES, fps.count() // leaf))
    chosen = fps.select("fp").orderBy(F.xxhash64("fp", F.lit("vantage")), "fp").limit(leaves * SAMPLE)
    sample = np.array([r[0] for r in chosen.collect()], dtype=np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, leaves))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for number, index, home in route(tree.value, points, radius):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(index), number, np.int32)), pa.array(points[index].view(np.int64)),
                        pa.array(np.full(len(index), home)),
                    ],
                    names=["leaf", "fp", "home"],
                )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        # Sorted, so that a task that runs again makes the same links.
        group = group.sort_values(["home", "fp"], ascending=[False, True])
        points = group["fp"].to_numpy().view(np.uint64)
        n = int(group["home"].sum())
        links = np.array(close_links(points[:n], points[n:], radius), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": points[links[:, 0]].view(np.int64), "b": points[links[:, 1]].view(np.int64)})

    placed = fps.select("fp").mapInArrow(routed, "leaf int, fp long, home boolean")
    return placed.groupBy("leaf").applyInPandas(joined, "a long, b long")


def near_groups(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Add component_id, the smallest doc_id that links of at most ``radius`` bits reach.

    ``fps`` has doc_id and fp, and is read several times. Equal fingerprints are one node, however
    many rows share them. Rows without a doc_id take part; a component with no
    other rows has a null component_id. An empty table gives no rows.
    """
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = connected(close_edges(nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = saved(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return attach(fps, attach(rooted.select("fp", "root"), least, ["root"]).drop("root"), ["fp"])


def near_documents(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    fps = saved(fingerprints(docs, shingle), "documents")
    return near_groups(fps, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
