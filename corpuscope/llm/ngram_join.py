"""Similarity join of word n-gram sets with a prefix tree.

Texts with equal sets are one node.  Two sets with Jaccard J >= t share one of the first
n - ceil(t n) + 1 n-grams of each, in any order that is the same for all sets; here rare n-grams
come first, so that passages many texts share lie behind that prefix.  N-grams of prefixes that at
least two nodes have bring nodes together.

Nodes are put into blocks by the n-gram most others share with them, so a group of near copies is a
few blocks, not all its pairs.  Blocks with a common n-gram, whose lengths and positions can still
reach the threshold, meet in a cell.  A cell stores one block's sets in a prefix tree (in order,
each taking over what it shares with the one before) and walks it with all sets of the other block
at once: overlaps along a shared path are counted once, and a subtree is left when the lengths that
remain cannot bring any set to the threshold.  Before sets are moved there, their signatures (a bit
for each of the first bits of their n-grams) have shown which nodes of the cell may link at all.  A cell returns links that join its nodes, no more
than it has nodes; connected components of all links are the groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.batches import in_row, out_of_row
from corpuscope.llm import sketch
from corpuscope.llm.components import components
from corpuscope.llm.shingles import WORDS, nodes_of, over_sets, shingles_of
from corpuscope.sources.shared import stored

THRESHOLD = 80  # per cent
BUCKET_BITS = 22  # n-grams are counted in 2^22 buckets; one byte for each, 4 MB, is broadcast
PARTS = 64
HOT = 50_000
BLOCK = 128
MOST_BITS = 15
AT_ONCE = 1 << 25  # bytes of the table of one side's n-grams while the other's tree is walked


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of all tasks' counts, summed batch by batch, as eighths of a doubling."""
    part, total = None, 0
    for batch in batches:
        part = batch.column(0)[0].as_py()
        for x in batch.column(1):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), np.uint16).astype(np.int64)
    level = np.minimum(np.rint(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "counts"])


def bucket_levels(docs: DataFrame, words: int) -> np.ndarray:
    """How often the n-grams of each bucket occur in sets, over all texts; the result has a fixed size.

    Only the order of n-grams follows from it, so it need not be exact: a task's count of a bucket
    stops at 65535, and counts are kept as eighths of a doubling.
    """
    def count(sets) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int32)
        for _, _, some in sets:
            bucket, n = np.unique(_bucket(np.concatenate(some)), return_counts=True)
            total[bucket] += n.astype(np.int32)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=["part", "counts"])

    rows = over_sets(docs, count, "part int, counts binary", words).groupBy("part").applyInArrow(
        _sum, "part int, counts binary").collect()  # PARTS rows of fixed size
    if not rows:
        return np.zeros(1 << BUCKET_BITS, np.uint8)
    return np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in sorted(rows)])


def prefixes(docs: DataFrame, levels: np.ndarray, words: int) -> DataFrame:
    """token, salt, node, n, pos: the prefix of each set, rare n-grams first.

    A bucket's level bounds how many sets have an n-gram, so one that many may have is salted, and
    a (token, salt) has about HOT rows at most, or eight times what a bucket holds on average.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    counts = 2 ** (np.arange(256) / 8) - 1
    hot = max(HOT, 8 * float(counts[levels].mean()))
    salts = (counts // hot).astype(np.int64) + 1

    def cut(sets) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for _, nodes, some in sets:
            held = [(node, s, levels[_bucket(s)]) for node, s in zip(nodes, some) if len(s)]
            if not held:
                continue
            firsts = [np.argsort(level, kind="stable")[: len(s) - (THRESHOLD * len(s) + 99) // 100 + 1] for _, s, level in held]
            size = [len(x) for x in firsts]
            node = np.repeat(np.array([h[0] for h in held]), size)
            salt = salts[np.concatenate([h[2][x] for h, x in zip(held, firsts)])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([h[1][x] for h, x in zip(held, firsts)]).view(np.int64)),
                pa.array(np.where(salt > 1, 1 + node % salt, 0).astype(np.int32)), pa.array(node),
                pa.array(np.repeat(np.array([len(h[1]) for h in held], np.int32), size)),
                pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size]))],
                names=["token", "salt", "node", "n", "pos"])

    return over_sets(docs, cut, "token long, salt int, node long, n int, pos int", words)


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """token, node, n, pos, others, hub: prefix rows of n-grams that at least two nodes may have.

    ``others`` is how many rows have the n-gram, ``hub`` the smallest of its nodes of like size.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / THRESHOLD)))).cast("int")
    like, group = Window.partitionBy("token", "salt", "band"), Window.partitionBy("token", "salt")
    rest, t = F.col("n") - F.col("pos"), THRESHOLD / 100
    # with the group's longest rest and a partner of the least length that may link
    able = (F.least(rest, F.col("rest")) >= (F.col("n") + F.greatest(F.col("least"), t * F.col("n"))) * t / (1 + t) - 1e-6)
    return (rows.withColumn("band", band)
            .withColumn("hub", F.min("node").over(like)).withColumn("others", F.count("*").over(group))
            .withColumn("low", F.min("node").over(group)).withColumn("high", F.max("node").over(group))
            .withColumn("rest", F.max(rest).over(group)).withColumn("least", F.min("n").over(group))
            .where((F.col("salt") > 0) | (F.col("low") < F.col("high")) & able).select("token", "node", "n", "pos", "others", "hub"))


def blocks_of(shared: DataFrame) -> DataFrame:
    """node, block: nodes under the hub of the n-gram that most share with them, BLOCK or so to a block."""
    hubs = shared.groupBy("node").agg(F.max(F.struct("others", "hub"))["hub"].alias("hub"))
    sizes = hubs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return hubs.join(sizes, "hub").select("node", F.xxhash64("hub", F.pmod(F.xxhash64("node"), "blocks")).alias("block"))


def cells_of(shared: DataFrame, blocks: DataFrame) -> DataFrame:
    """x, y: blocks (x <= y) that a common n-gram brings together and that may have a link.

    The sum of what two blocks' sets can still share must reach what their shortest sets ask for.
    """
    rows = shared.join(blocks, "node")
    sides = stored(rows.groupBy("token", "block").agg(
        F.count("*").alias("nodes"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.col("n") - F.col("pos")).alias("rest")), "sides")
    t = THRESHOLD / 100
    a, b = sides.alias("a"), sides.alias("b")
    n_a, n_b = F.greatest(F.col("a.least"), t * F.col("b.least")), F.greatest(F.col("b.least"), t * F.col("a.least"))
    may = ((F.col("a.most") >= t * F.col("b.least")) & (F.col("b.most") >= t * F.col("a.least"))
           & (F.least("a.rest", "b.rest") >= THRESHOLD * (n_a + n_b) / (100 + THRESHOLD) - 1e-6))
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.block") < F.col("b.block")) & may).select(
        F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    inside = sides.where("nodes > 1").select(F.col("block").alias("x"), F.col("block").alias("y"))
    return across.unionByName(inside).distinct()


def _of_nodes(docs: DataFrame, nodes: DataFrame, words: int, columns: str, make) -> DataFrame:
    """What ``make`` makes of the sets of the given nodes, once each; a fixed-size filter keeps the others from moving."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch.key_filter(nodes, "node"))

    def sift(sets) -> Iterator[pa.RecordBatch]:
        for _, named, some in sets:
            keep = np.flatnonzero(sketch.may_have(sent.value, named) & (named != 0))
            yield pa.RecordBatch.from_arrays([pa.array(named[keep]), *make([some[i] for i in keep])],
                                             names=["node", *[c.split()[0] for c in columns.split(", ")]])

    few = over_sets(docs, sift, f"node long, {columns}", words)
    return few.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, tokens."""
    return _of_nodes(docs, nodes, words, "tokens binary", lambda sets: [pa.array([s.tobytes() for s in sets], pa.binary())])


def signature(s: np.ndarray) -> bytes:
    """A bit for each value of the n-grams' first bits that occurs: about as many bits as n-grams.

    Signatures of very long texts stay short and just tell less.
    """
    width = min(max(8, (len(s) - 1).bit_length()), MOST_BITS)
    bits = np.zeros(1 << width, bool)
    bits[(s >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signatures_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, mark: a set's size and signature, 64 times smaller than the set."""
    return _of_nodes(docs, nodes, words, "n int, mark binary", lambda sets: [
        pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary())])


def near(ours: list[tuple[int, bytes]], theirs: list[tuple[int, bytes]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ours`` and of ``theirs`` (size, signature) may link with one of the other.

    A bit that only one side has stands for an n-gram that only it has, so signatures bound the
    overlap from above.  Sizes that may link differ by less than two, so signatures by one doubling;
    a longer one is folded.
    """
    found = np.zeros(len(ours), bool), np.zeros(len(theirs), bool)
    widths = sorted({len(m) for _, m in ours} | {len(m) for _, m in theirs})
    pick = lambda rows, w: np.array([i for i, (_, m) in enumerate(rows) if len(m) == w], np.int64)

    def bits(rows, at, width):
        out = np.unpackbits(np.stack([np.frombuffer(rows[i][1], np.uint8) for i in at]), axis=1, bitorder="little")
        while out.shape[1] > 8 * width:
            out = out[:, ::2] | out[:, 1::2]
        return out.astype(np.float32)

    for w in widths:
        for v in (w // 2, w, 2 * w):
            a, b = pick(ours, w), pick(theirs, v)
            if not len(a) or not len(b):
                continue
            x, y = bits(ours, a, min(v, w)), bits(theirs, b, min(v, w))
            n_x, n_y = (np.array([rows[i][0] for i in at])[:, None] for rows, at in ((ours, a), (theirs, b)))
            both = x @ y.T
            most = np.minimum(n_x - x.sum(1)[:, None], (n_y - y.sum(1)[:, None]).T) + both
            able = (100 + THRESHOLD) * most >= THRESHOLD * (n_x + n_y.T)
            if same:
                able &= a[:, None] != b[None, :]
            found[0][a[able.any(1)]] = True
            found[1][b[able.any(0)]] = True
    return found


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], tuple[list, list]]]:
    """(x, y) and the rows of either side, from rows (x, y, side, ...) in that order."""
    key, sides = None, ([], [])
    for batch in batches:
        for x, y, side, *rest in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
            if (x, y) != key:
                if key:
                    yield key, sides
                key, sides = (x, y), ([], [])
            sides[side].append(rest)
    if key:
        yield key, sides


def _meet(cells: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of both blocks of each cell, cell by cell."""
    first = cells.join(held, F.col("x") == F.col("block")).select("x", "y", F.lit(0).alias("side"), *columns)
    second = cells.where("x < y").join(held, F.col("y") == F.col("block")).select("x", "y", F.lit(1).alias("side"), *columns)
    return first.unionByName(second).repartition("x", "y").sortWithinPartitions("x", "y", "side")


def near_nodes(cells: DataFrame, blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """x, y, side, node: the nodes of each cell that may have a link there, by their signatures."""
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (x, y), (ours, theirs) in _cells(batches):
            same = x == y
            sides = near([r[1:] for r in ours], [r[1:] for r in (ours if same else theirs)], same)
            for side, (rows, able) in enumerate(zip((ours, theirs), sides)):
                out += [(x, y, side, r[0]) for r, fit in zip(rows, able) if fit]
            if len(out) > 10_000:
                yield record(out)
                out = []
        yield record(out)

    def record(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                                          names=["x", "y", "side", "node"])

    return _meet(cells, blocks.join(marks, "node"), ["node", "n", "mark"]).mapInArrow(sift, "x long, y long, side int, node long")


def tree_links(ours: list[np.ndarray], theirs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(i, j) with ours[i] and theirs[j] at the threshold or above.

    ``theirs`` is walked as a prefix tree: in order, a set goes on from the depth it has in common
    with the one before, with the overlaps counted up to there.  At some depths the overlaps and the
    remaining length are compared with what each of ``ours`` asks for; if none can get there, the
    subtree is left, also for later sets that come through that depth and are no longer.
    """
    sizes = np.array([len(s) for s in ours])
    known = np.intersect1d(np.concatenate(ours), np.concatenate(theirs))
    if not len(known):
        return
    has = np.zeros((len(known) + 1, len(ours)), np.uint8)  # the last row is for n-grams that only one side has
    for i, s in enumerate(ours):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        has[at[known[at] == s], i] = 1
    order = sorted(range(len(theirs)), key=lambda j: theirs[j].astype(">u8").tobytes())
    before, path, dead = np.empty(0, np.uint64), [(0, np.zeros(len(ours), np.int64))], None
    for j in order:
        s = theirs[j]
        least = -(-THRESHOLD * (sizes + len(s)) // (100 + THRESHOLD))
        m = min(len(before), len(s))
        differ = np.flatnonzero(before[:m] != s[:m])
        shared = int(differ[0]) if differ.size else m
        before = s
        while path[-1][0] > shared:
            path.pop()
        if dead and dead[0] <= shared and len(s) <= dead[1] and len(s) >= dead[2]:
            continue
        dead = None
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        row = np.where(known[at] == s, at, len(known))
        depth, overlap = path[-1]
        step = max(8, len(s) // 8)
        while depth < len(s):
            until = min(depth + step, len(s))
            overlap = overlap + has[row[depth:until]].sum(0, dtype=np.int32)
            depth = until
            path.append((depth, overlap))
            if not (overlap + (len(s) - depth) >= least).any():
                # a shorter set has less to come but asks for less; equal lengths are safe
                dead = (depth, len(s), len(s))
                break
        else:
            for i in np.flatnonzero(overlap >= least):
                yield int(i), j


def _joined(links: Iterator[tuple[int, int]], root: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links that join two nodes not joined yet."""
    def top(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield a, b


def links_of(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that connect what the cells' nodes connect; no more per cell than it has nodes.

    ``rows`` are (x, y, side, node).
    """
    dealt = rows.join(sets, "node").select("x", "y", "side", "node", "tokens").repartition("x", "y").sortWithinPartitions("x", "y", "side")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x, y), sides in _cells(batches):
            (names, ours), (others, theirs) = (([r[0] for r in s], [np.frombuffer(r[1], np.uint64) for r in s]) for s in sides)
            if x == y:
                others, theirs = names, ours
            found, root = [], {}
            step = max(1, min(BLOCK, AT_ONCE // max(map(len, ours), default=1)))
            for at in range(0, len(ours) if theirs else 0, step):
                pairs = ((names[at + i], others[j]) for i, j in tree_links(ours[at:at + step], theirs) if names[at + i] != others[j])
                found += _joined(pairs, root)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return dealt.mapInArrow(walk, "a long, b long")


def _named(sets):
    for ids, nodes, some in sets:
        yield pa.RecordBatch.from_arrays([ids, pa.array(nodes), pa.array([len(s) for s in some], pa.int64())],
                                         names=["doc_id", "node", "n_shingles"])


def similar_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node, n_shingles, root; one row for each row of ``docs``.

    Sets are distinct runs of ``words`` words (all words of a shorter text).  Rows link when
    100 * intersection >= 80 * union; root names the group that links connect.
    NULL and empty texts have no shingles, node 0 and a NULL root: each is alone.  Repeated rows
    share a group; other columns are left aside; an empty table gives no rows.  Two different sets
    share a node, or two n-grams a hash, with the odds of 64 bits.
    """
    shared = stored(shared_prefixes(prefixes(docs, bucket_levels(docs, words), words)), "shared")
    blocks = stored(blocks_of(shared), "blocks")
    cells = stored(cells_of(shared, blocks), "cells")
    meeting = cells.select(F.col("x").alias("block")).unionByName(cells.select(F.col("y").alias("block"))).distinct()
    blocks = stored(blocks.join(meeting, "block"), "blocks")
    marks = stored(signatures_of(docs, blocks.select("node"), words), "marks")
    rows = stored(near_nodes(cells, blocks, marks), "near")
    sets = stored(sets_of(docs, rows.select("node").distinct(), words), "sets")
    roots = components(stored(links_of(rows, sets), "links"))
    rows = stored(over_sets(docs, _named, "doc_id long, node long, n_shingles long", words), "nodes")
    return rows.join(roots, "node", "left").withColumn(
        "root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))


def component_ids(groups: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id of each row's group, its own if it is alone.

    A NULL doc_id counts only where the group has no other.
    """
    least = groups.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return groups.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id (NULL is the smallest).

    Texts without words stay, once for each doc_id.  Rows that repeat in doc_id and text are one.
    """
    groups = similar_groups(docs, words)
    own = F.struct("doc_id", "node")
    stay = groups.where("root IS NOT NULL").groupBy("root").agg(F.min(own).alias("first")).select("first.doc_id", "first.node").unionByName(
        groups.where("root IS NULL").select("doc_id", "node").distinct())
    stay = stay.select(F.col("doc_id").alias("first_id"), F.col("node").alias("first_node"))
    rows = with_nodes(docs, words)
    same = F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_node") == F.col("first_node"))
    return rows.join(stay, same, "left_semi").dropDuplicates(["own_id", "own_node"]).select(*out_of_row(docs, text=False))


def with_nodes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row, own_id, own_node: the columns of ``docs`` as a struct, its id and the node of its text."""
    @F.pandas_udf("long")
    def node(texts):
        sets = [s for _, some in shingles_of(pa.array(texts, pa.string()), words) for s in some]
        return pd.Series(nodes_of(sets))

    return docs.select(in_row(docs), F.col("doc_id").cast("long").alias("own_id"), node("text").alias("own_node"))
