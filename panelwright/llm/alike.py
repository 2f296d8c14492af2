"""Links among documents that resemble each other all over, such as pages of one template.

Branching along minwise shingles cannot part such documents. They are joined exactly instead, on the
rarest shingles of each: if two sets must have ``o`` shingles in common, they share one of their
rarest ``size - o + 1``, under any one order of all shingles. How many they must have in common
follows from both sizes, so a document has one such prefix for each class of sizes that it may be
linked with. Pages that share a template but differ by more than the threshold part at once, as what
they share is frequent and comes last in the order.

What still meets in a large group are copies that differ in less than that. There a pivot, the
document of the fewest rare shingles, is compared with all others: those linked with it are one
component already and need not meet each other. The rest goes by shells of distance from the pivot.
As the distance of two sets obeys the triangle inequality, linked sets lie in one shell or in
neighbouring ones. A document is host in its own shell and guest in the next, and guests need not meet
guests. A group that no pivot thins out (copies with scattered edits, just below the threshold of
each other) is compared in pairs of blocks in the end, so nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens
from panelwright.scratch import pin

#: Most shingles whose frequency decides their place in the order; the others count as rare.
ORDERED = 1 << 18
#: Classes of set sizes between a size and the largest one it may be linked with.
SIZES = 3
#: How often a group may be cut by a pivot.
TURNS = 4


def _repeated(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.chunks(batch):
            values, _ = tokens.shingles(tokens.words_of(part.column("text")), width)
            values, times = np.unique(values, return_counts=True)
            some = times > 1
            columns = [pa.array(tokens.signed(values[some])), pa.array(times[some])]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "n"])


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``ORDERED`` frequent shingles, ascending, and their numbers.

    Counted are the documents within a chunk that share a shingle, as only the order matters: whatever
    it is, the same links follow.
    """
    counted = texts.mapInArrow(partial(_repeated, width=width), "shingle long, n long")
    counted = pin(counted.groupBy("shingle").agg(F.sum("n").alias("n")), "frequent")
    steps = counted.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("k")).collect()
    least, room = 64, ORDERED
    for step, k in sorted(steps, reverse=True):
        room -= k
        if room < 0:
            break
        least = step
    rows = counted.where(F.col("n") >= 2**least).collect() if least < 63 else []
    values = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r.n for r in rows], np.int64)[order]


PATH = "node long, doc_id long, host boolean, cross boolean, rare float"


def _rarest(
    batches: Iterator[pa.RecordBatch], width: int, numerator: int, denominator: int, known: np.ndarray, times: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of every document, as many as linked sets of each class of sizes need to share one.

    A node is a shingle and two classes; across classes the larger sets are hosts.
    """
    names = [c.split()[0] for c in PATH.split(", ")]
    step = np.log(denominator / numerator) / SIZES + 1e-9
    for batch in batches:
        for part in tokens.chunks(batch):
            values, ptr = tokens.shingles(tokens.words_of(part.column("text")), width)
            sizes = np.diff(ptr)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            n = np.zeros(len(values), np.int64)
            if len(known):
                slot = np.minimum(np.searchsorted(known, values), len(known) - 1)
                n = np.where(known[slot] == values, times[slot], 0)
            order = np.lexsort((tokens.mix(values, 7), n, doc))
            place = np.arange(len(values)) - ptr[doc]
            rare = (tokens.per_doc(np.add, (n == 0).astype(np.int64), ptr) / np.maximum(sizes, 1)).astype(np.float32)
            own = np.floor(np.log(np.maximum(sizes, 1)) / step).astype(np.int64)
            for away in range(-SIZES, SIZES + 1):
                least = np.ceil(np.exp((own + away) * step) * (1 - 1e-9)).astype(np.int64)
                common = np.maximum(
                    -(-numerator * (sizes + least) // (numerator + denominator)), -(-numerator * sizes // denominator)
                )
                need = np.where(sizes > 0, sizes - common + 1, 0)
                take = order[place < need[doc]]
                d = doc[take]
                classes = tokens.mix((np.minimum(own, own + away) * (SIZES + 1) + abs(away)).astype(np.uint64), 11)
                columns = [
                    pa.array(tokens.signed(tokens.mix(values[take] ^ classes[d], 12))),
                    part.column("doc_id").take(pa.array(d)),
                    pa.array(np.full(len(d), away <= 0)),
                    pa.array(np.full(len(d), away != 0)),
                    pa.array(rare[d]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)


def _counted(paths: DataFrame) -> DataFrame:
    """Paths with the documents and the hosts of their node.

    Of nodes that hold the same documents in the same parts one is left. Lone documents, nodes without a
    host, and nodes across classes without a guest have nothing to compare.
    """
    marks = paths.groupBy("node").agg(
        F.count("*").alias("members"),
        F.count_if("host").alias("hosts"),
        F.bool_or("cross").alias("cross"),
        F.bit_xor(F.xxhash64("doc_id", "host")).alias("x"),
        F.bit_xor(F.xxhash64("doc_id", "host", F.lit(1))).alias("y"),
    )
    some = marks.where("members > 1 AND hosts > 0 AND (NOT cross OR hosts < members)")
    once = some.groupBy("members", "hosts", "x", "y").agg(F.min("node").alias("node"))
    return paths.drop("cross").join(once.select("node", "members", "hosts"), "node")


def _block_pairs(large: DataFrame, limit: int) -> DataFrame:
    """Cut a node into blocks and let every two blocks, and each block with itself, meet."""
    blocks = F.ceil(F.col("members") * 2 / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit("block")), blocks.cast("long")).cast("int")
    return (
        large.withColumns({"blocks": blocks, "own": own})
        .select("node", "doc_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "doc_id")
    )


def _guest_blocks(few_hosts: DataFrame, limit: int) -> DataFrame:
    """Cut a node's guests into blocks and let each meet all hosts, which are at most half of ``limit``."""
    blocks = F.ceil(F.col("members") * 2 / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit("guest")), blocks.cast("long")).cast("int")
    to = F.when(F.col("host"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return few_hosts.select("node", "doc_id", F.explode(to).alias("block")).select(
        F.xxhash64("node", "block", F.lit("guests")).alias("node"), "doc_id"
    )


def _shells(batches: Iterator[pa.RecordBatch], width: int, numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """Each row's shell around its pivot, whose own row comes before; shell 0 is linked with the pivot."""
    pivot = np.empty(0, np.uint64)
    thick = 1 - numerator / denominator + 1e-9
    for batch in batches:
        for part in tokens.chunks(batch):
            values, ptr = tokens.shingles(tokens.words_of(part.column("text")), width)
            sizes = np.diff(ptr)
            leads = part.column("leads").to_numpy(zero_copy_only=False)
            common, whole = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
            cuts = np.unique([0, *np.flatnonzero(leads), len(sizes)]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if leads[a]:
                    pivot = values[ptr[a] : ptr[a + 1]].copy()
                own = values[ptr[a] : ptr[b]]
                hit = pivot[np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)] == own
                common[a:b] = tokens.per_doc(np.add, hit.astype(np.int64), ptr[a : b + 1] - ptr[a])
                whole[a:b] = sizes[a:b] + len(pivot) - common[a:b]
            shell = np.maximum(1, np.floor((1 - common / whole) / thick).astype(np.int64))
            shell[denominator * common >= numerator * whole] = 0
            out = pa.RecordBatch.from_arrays(
                [part.column("pivot"), part.column("doc_id"), pa.array(shell)], ["pivot", "doc_id", "shell"]
            )
            yield out.filter(pa.array(~leads & (sizes > 0)))


def _around_pivots(open_nodes: DataFrame, texts: DataFrame, limit: int, settings: dict) -> tuple[DataFrame, DataFrame]:
    """Paths of the shells around one host of each node, and the pivots' links."""
    pivots = pin(
        open_nodes.where("host").groupBy("node").agg(
            F.min_by("doc_id", F.struct("rare", F.xxhash64("doc_id"), "doc_id")).alias("pivot"),
            F.max("members").alias("members"),
        ),
        "pivots",
    )
    placed = open_nodes.select("node", "doc_id", "host", "rare").join(pivots.select("node", "pivot"), "node")
    parts = pivots.groupBy("pivot").agg(F.ceil(F.max("members") / F.lit(limit)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts").cast("long")).cast("int")
    followers = placed.select("pivot", "doc_id").distinct().join(parts, "pivot")
    followers = followers.select("pivot", part.alias("part"), "doc_id").join(texts, "doc_id").withColumn("leads", F.lit(False))
    # rows may repeat an id; one of its texts leads
    lead = texts.join(parts, F.col("doc_id") == F.col("pivot")).groupBy("pivot", "parts").agg(F.min("text").alias("text"))
    leaders = lead.select(
        F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text", F.lit(True).alias("leads")
    )
    shells = pin(
        followers.unionByName(leaders)
        .repartition("pivot", "part")
        .sortWithinPartitions("pivot", "part", F.desc("leads"))
        .mapInArrow(partial(_shells, **settings), "pivot long, doc_id long, shell long"),
        "shells",
    )
    host, shell = F.col("host"), F.col("shell")

    def at(step: int, as_host: bool):
        return F.struct((shell + step).alias("shell"), F.lit(as_host).alias("host"))

    # the innermost shell is settled by its pivot; its hosts are there for guests of the next one only
    to = (
        F.when(host & (shell > 0), F.array(at(0, True), at(1, False)))
        .when(host, F.array(at(0, False), at(1, False)))
        .when(shell > 1, F.array(at(-1, False), at(0, False), at(1, False)))
        .when(shell == 1, F.array(at(-1, True), at(0, False), at(1, False)))
        .otherwise(F.array(at(1, False)))
    )
    paths = (
        placed.join(shells, ["pivot", "doc_id"])
        .select("node", "doc_id", "rare", F.explode(to).alias("to"))
        .select(
            F.xxhash64("node", "to.shell", F.lit("shell")).alias("node"), "doc_id", "to.host", F.lit(False).alias("cross"), "rare"
        )
    )
    links = shells.where("shell = 0 AND doc_id != pivot")
    return paths, links.select(F.greatest("doc_id", "pivot").alias("a"), F.least("doc_id", "pivot").alias("b"))


def meetings_of_alike(
    alike: DataFrame, texts: DataFrame, *, width: int, numerator: int, denominator: int, limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc_id) of nodes inside which the documents ``alike`` are to be compared, and (a, b) links found.

    ``texts`` (doc_id, text) has no null ids and no texts without words. Every link among the documents is one of a node, or
    connects two documents that the given links connect. Nodes hold about ``limit`` documents.
    """
    settings = {"width": width, "numerator": numerator, "denominator": denominator}
    own = texts.join(alike, "doc_id", "left_semi")
    known, times = _frequent(own, width)
    prefixes = own.mapInArrow(partial(_rarest, **settings, known=known, times=times), PATH)
    open_nodes = pin(_counted(pin(prefixes, "rarest")), "alike-paths")
    closed, links = [], []
    for turn in range(TURNS + 1):
        closed.append(open_nodes.where(F.col("members") <= limit).select("node", "doc_id"))
        large = open_nodes.where(F.col("members") > limit)
        closed.append(_guest_blocks(large.where(F.col("hosts") <= limit // 2), limit))
        large = large.where(F.col("hosts") > limit // 2)
        if large.isEmpty():
            break
        if turn == TURNS:
            closed.append(_block_pairs(large, limit))
            break
        paths, found = _around_pivots(large, own, limit, settings)
        links.append(found)
        open_nodes = pin(_counted(pin(paths, "shell-paths")), "alike-paths")
    nodes = closed[0]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)
    found = links[0] if links else None
    for more in links[1:]:
        found = found.unionByName(more)
    return nodes, found
