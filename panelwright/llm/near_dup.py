"""Near-duplicate documents by a chosen-path set similarity join.

Every document is a set of word shingles. Documents with equal sets form a class at once. Class
representatives then walk several independent trees: a tree's root sends a document along the
smallest shingle under the tree's own hash order (its minwise shingle), so similar documents share
a node with the probability of their similarity. A node that is still large is first cut by size of
set, without loss: similar sets have sizes of one class or two neighbouring ones. If that is not
enough it branches again, each document along further minwise shingles, until nodes are small. Every
tree and level has minwise shingles of its own, so trees miss a pair independently. In a small node all pairs
are compared on their minwise signatures, which leaves the groups that may hold a link (most nodes
have none: they share a common line), and those groups are compared exhaustively on full sets. The
number of trees and the signature agreement asked for follow from the recall asked for. Documents of
nodes that stay large at the last level (they resemble each other all over) are joined exactly, on
their rarest shingles (``alike``), so nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.llm.alike import meetings_of_alike
from panelwright.llm.components import connected_components
from panelwright.scratch import pin

#: Branches of a node that is too large, and how often a path may branch.
BRANCHES, LEVELS = 2, 3
#: Nodes up to this size are compared exhaustively.
NODE_LIMIT = 3072
#: Minwise shingles in a signature.
SIGNATURE = 64


def _sketch(batches: Iterator[pa.RecordBatch], width: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.chunks(batch):
            values, ptr = tokens.shingles(tokens.words_of(part.column("text")), width)
            signature = np.empty((part.num_rows, coordinates), np.uint64)
            for k in range(coordinates):
                order = tokens.mix(values, k + 1)
                signature[:, k] = tokens.per_doc(np.minimum, order, ptr)
            flat = pa.array((signature >> np.uint64(8)).astype(np.uint32).view(np.int32).reshape(-1))
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * coordinates)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(ptr)),
                    pa.array(tokens.signed(tokens.per_doc(np.add, tokens.mix(values, 101), ptr))),
                    pa.array(tokens.signed(tokens.per_doc(np.bitwise_xor, tokens.mix(values, 102), ptr))),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "minwise"],
            )


def _linked(values: np.ndarray, ptr: np.ndarray, numerator: int, denominator: int) -> list[list[int]]:
    """Connected groups of sets whose similarity reaches the threshold; each pair is decided exactly.

    A set is compared with all sets that no group has taken yet, which suffices for connectivity.
    """
    _, ids = np.unique(values, return_inverse=True)
    sizes = np.diff(ptr)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    rest = np.arange(len(sizes))
    groups = []
    flat, starts = ids, ptr[:-1]
    while len(rest):
        queue = [int(rest[0])]
        group = []
        drop = np.zeros(len(rest), bool)
        drop[0] = True
        while queue:
            if drop.any():
                keep = ~drop
                flat = flat[np.repeat(keep, sizes[rest])]
                rest = rest[keep]
                starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]).astype(np.int64)
            p = queue.pop()
            group.append(p)
            if not len(rest):
                drop = np.zeros(0, bool)
                continue
            own = ids[ptr[p] : ptr[p + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            drop = denominator * common >= numerator * (sizes[rest] + sizes[p] - common)
            queue += rest[drop].tolist()
        if len(group) > 1:
            groups.append(group)
    return groups


def _whole_nodes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows come sorted by node; tables of about so many rows that hold every node whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            nodes = part.column("node").to_numpy()
            last = int(np.flatnonzero(nodes != nodes[-1])[-1]) + 1 if nodes[0] != nodes[-1] else 0
            if held and last == 0 and held[-1].column("node")[-1].as_py() == nodes[-1]:
                held.append(part)  # the node that was open goes through this part
                continue
            ready = [*held, part.slice(0, last)]
            if sum(x.num_rows for x in ready):
                yield pa.Table.from_batches(ready)
            held = [part.slice(last)]
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _runs(nodes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]])


def _groups(linked: np.ndarray) -> np.ndarray:
    """Smallest member that links reach, of a square matrix of links."""
    root = np.arange(len(linked))
    open_ = linked.sum(1) > 1
    for first in np.flatnonzero(open_).tolist():
        if not open_[first]:
            continue
        edge = np.array([first])
        open_[first] = False
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(0) & open_)
            open_[edge] = False
            root[edge] = first
    return root


def _likely(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Groups of each node's documents whose signatures agree often enough for a link."""
    for table in _whole_nodes(batches, 20_000):
        nodes = table.column("node").to_numpy()
        ids = table.column("doc_id").to_numpy()
        lists = table.column("minwise").combine_chunks()
        minwise = lists.flatten().to_numpy().reshape(len(nodes), -1)
        runs = _runs(nodes)
        sizes = np.diff(runs)
        group = np.full(len(nodes), -1, np.int64)
        two = runs[:-1][sizes == 2]
        near = two[(minwise[two] == minwise[two + 1]).sum(1) >= least]
        group[near] = group[near + 1] = near
        for first, size in zip(runs[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = minwise[first : first + size]
            same = np.zeros((size, size), np.uint8)
            for k in range(own.shape[1]):
                same += own[:, k, None] == own[None, :, k]
            linked = same >= least
            some = linked.sum(1) > 1
            if some.any():
                root = _groups(linked)
                group[first : first + size][some] = first + root[some]
        keep = np.flatnonzero(group >= 0)
        # a group goes by its node and its first member
        name = tokens.mix(nodes[keep].view(np.uint64) ^ tokens.mix(ids[group[keep]].view(np.uint64), 3), 4)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(name)), pa.array(ids[keep])], ["node", "doc_id"])


def _compare(
    batches: Iterator[pa.RecordBatch], width: int, numerator: int, denominator: int
) -> Iterator[pa.RecordBatch]:
    """Links that hold every connected group of a node's documents together."""
    for table in _whole_nodes(batches, 2_000):
        a, b = [], []
        ids = table.column("doc_id").to_numpy()
        runs = _runs(table.column("node").to_numpy())
        values, ptrs = [], [np.zeros(1, np.int64)]
        for batch in table.select(["text"]).to_batches():
            for part in tokens.chunks(batch):
                v, p = tokens.shingles(tokens.words_of(part.column("text")), width)
                values.append(v)
                ptrs.append(p[1:] + ptrs[-1][-1])
        values, ptr = np.concatenate(values), np.concatenate(ptrs)
        for first, last in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            own = ptr[first : last + 1]
            for group in _linked(values[own[0] : own[-1]], own - own[0], numerator, denominator):
                members = ids[first:last][group]
                least = members.min()
                a += members[members != least].tolist()
                b += [int(least)] * int((members != least).sum())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sized(paths: DataFrame) -> DataFrame:
    """Paths with the number of documents at their node; lone documents have nothing to meet.

    Nor have guests alone: they meet in their own class.
    """
    sizes = paths.groupBy("node").agg(F.count("*").alias("members"), F.max("host").alias("hosts"))
    return paths.drop("host").join(sizes.where("members > 1 AND hosts").drop("hosts"), "node")


def _by_size(paths: DataFrame, similarity: float) -> DataFrame:
    """Cut nodes by size of set; sets that are similar enough share a class or have neighbouring ones.

    A document is host in its own class and guest in the next larger one.
    """
    own = F.floor(F.log("n_shingles") / (math.log(1 / similarity) + 1e-6))
    both = F.array(F.struct(own.alias("class"), F.lit(True).alias("host")), F.struct((own + 1).alias("class"), F.lit(False).alias("host")))
    return (
        paths.select("*", F.inline(both))
        .withColumn("node", F.xxhash64("node", "class", F.lit("size")))
        .drop("class")
    )


def _roots(sets: DataFrame, trees: int) -> DataFrame:
    """One row for every tree of every document: its signature, and the minwise shingles that only this tree branches along."""
    turns = BRANCHES * LEVELS
    tree = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return tree.select(
        "doc_id",
        "n_shingles",
        F.slice("minwise", 1, SIGNATURE).alias("minwise"),
        F.slice("minwise", F.lit(trees + 1) + F.col("tree") * turns, F.lit(turns)).alias("turns"),
        F.xxhash64("tree", F.get("minwise", F.col("tree"))).alias("node"),
        F.lit(True).alias("host"),
    )


def _branch(paths: DataFrame, level: int) -> DataFrame:
    """One row for every minwise shingle that a path's own tree has for this level."""
    first = BRANCHES * (level - 1)
    way = paths.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + BRANCHES - 1))).alias("way"))
    node = F.xxhash64("node", "way", F.get("turns", F.col("way")))
    return way.withColumn("node", node).withColumn("host", F.lit(True)).drop("way")


def trees_for(numerator: int, denominator: int, miss: float) -> int:
    """Independent trees so that a pair at the threshold meets in none with at most this probability."""
    t = numerator / denominator
    together = t * (1 - (1 - t) ** BRANCHES) ** LEVELS
    return max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def agreement_for(numerator: int, denominator: int, coordinates: int, miss: float) -> int:
    """Signature positions on which a pair at the threshold agrees but for this probability."""
    t, below = numerator / denominator, 0.0
    for agree in range(coordinates + 1):
        below += math.comb(coordinates, agree) * t**agree * (1 - t) ** (coordinates - agree)
        if below > miss:
            return agree
    return coordinates


def near_duplicates(
    documents: DataFrame,
    *,
    shingle_words: int = 5,
    numerator: int = 80,
    denominator: int = 100,
    miss: float = 1e-6,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for every row of ``documents``.

    Two documents are linked if ``denominator * |A and B| >= numerator * |A or B|`` for their sets of
    shingles of ``shingle_words`` lower-cased words; ``component_id`` is the smallest doc_id that
    links reach, and ``kept`` marks the document that bears it. Null and empty texts, and texts
    without words, are linked with nothing. Rows with a null doc_id are linked with nothing, have a
    null component and are kept. Rows that repeat a doc_id share its component. Other columns of
    ``documents``, whatever their names, are not read. An empty table gives an empty result.
    """
    trees = trees_for(numerator, denominator, miss)
    coordinates = max(SIGNATURE, trees * (1 + BRANCHES * LEVELS))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows may repeat an id, with and without words
    named = texts.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sketches = pin(
        texts.mapInArrow(
            partial(_sketch, width=shingle_words, coordinates=coordinates),
            "doc_id long, n_shingles long, set_a long, set_b long, minwise array<int>",
        ),
        "sketches",
    )
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("representative"))
    alone = usable.join(classes, F.col("doc_id") == F.col("representative"), "left_semi")

    roots = _roots(alone.select("doc_id", "n_shingles", "minwise"), trees)
    open_paths = pin(_sized(roots), "paths")
    closed, links = [], None
    for level in range(LEVELS + 2):
        closed.append(open_paths.where(F.col("members") <= node_limit).select("node", "doc_id", "minwise"))
        large = open_paths.where(F.col("members") > node_limit)
        if large.isEmpty():
            break
        if level > LEVELS:
            alike = pin(large.select("doc_id").distinct(), "alike")
            meet, links = meetings_of_alike(
                alike, named, width=shingle_words, numerator=numerator, denominator=denominator, limit=node_limit
            )
            signatures = alone.select("doc_id", F.slice("minwise", 1, SIGNATURE).alias("minwise"))
            closed.append(meet.join(signatures, "doc_id").select("node", "doc_id", "minwise"))
            break
        if level == 0:
            narrower = _by_size(large.drop("members"), numerator / denominator)
        else:
            narrower = _branch(large.drop("members"), level)
        open_paths = pin(_sized(narrower), "paths")
    nodes = closed[0]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)

    agree = agreement_for(numerator, denominator, SIGNATURE, miss)
    likely = (
        nodes.repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(partial(_likely, least=agree), "node long, doc_id long")
    )
    meetings = pin(likely.distinct(), "groups")
    marks = meetings.groupBy("node").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    )
    once = marks.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")
    meetings = meetings.join(once, "node", "left_semi")
    edges = (
        meetings.join(named, "doc_id")
        .repartition("node")
        .sortWithinPartitions("node")
        .select("node", "doc_id", "text")
        .mapInArrow(
            partial(_compare, width=shingle_words, numerator=numerator, denominator=denominator),
            "a long, b long",
        )
    )
    components = connected_components(edges.unionByName(links) if links is not None else edges)

    member = sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(
        classes.withColumnsRenamed({"set_a": "own_a", "set_b": "own_b"}),
        (F.col("set_a") == F.col("own_a")) & (F.col("set_b") == F.col("own_b")) & (F.col("n_shingles") > 0)
        & F.col("doc_id").isNotNull(),
        "left",
    )
    return member.join(components, F.col("representative") == F.col("id"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "representative", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "representative", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """One row of each group of equal or linked documents, that of the smallest doc_id, with its own columns.

    Every row counts by its own text: rows that repeat a doc_id are one document only if their texts
    are equal or linked. Rows with a null doc_id all stay, and so does one row of each id among texts
    without words. Columns of any name stay as they are. An empty table gives an empty result.
    """
    rows = documents.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("doc_id", "text"))
    groups = near_duplicates(named.select(F.col("key").alias("doc_id"), "text"), **settings)
    groups = groups.select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = groups.join(named.select("key", "doc_id"), "key").groupBy("component_id")
    first = first.agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    kept = named.join(first, "key", "left_semi").dropDuplicates(["key"])
    return kept.unionByName(rows.where("doc_id IS NULL").withColumn("key", F.lit(None).cast("long"))).select("document.*")
