"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

Leaves are numbered in Spark: rows are dealt by ranges of (source, doc_id), and a range's place in its
source is the sum of the ranges before it.  Trees then grow as in a combineByKey by events: in each
task partial parents gather the digests of their children by place; one that has as many as the size
of its tree gives it becomes an event for its own parent.  What a task can't complete, its frontier, is
reshuffled by the ancestor three levels up at most, until nothing is open.  Links from children to
parents, followed down from the roots, carry to each run of leaves the digests of all runs above it.

Nulls are `-` in a leaf and come first in the order, also as a source; rows with one id are ordered by
digest; equal rows are leaves of their own.  A row without doc_id is never one whose text was edited.
An empty table has no leaves and no root; further columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.llm.common import ascii_lower, map_batches, pick, stage
from crewspark.shipping import map_in_arrow

#: Children of a node: 2 ** BITS.
BITS = 4
ARITY = 1 << BITS
#: Levels that a frontier can climb in one round; a task gets (16 ** 3 - 1) / 15 partial parents of a subtree at most.
CLIMB = 3
#: Ranges of sources up to which their offsets are broadcast (about 60 bytes each).
BROADCAST_RUNS = 500_000

EVENT = "tree long, n long, level int, idx long, digest binary, children binary"
_EVENT = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("children", pa.binary())])


def digest_of(hexes: str) -> bytes:
    return hashlib.sha256(hexes.encode()).digest()


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return (n + (1 << BITS * level) - 1) >> BITS * level


def arity(n: int, level: int, idx: int) -> int:
    """Children of a node; follows from the size of its tree."""
    return min(ARITY, width(n, level - 1) - ARITY * idx)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


class Combiners:
    """The partial parents of a task, by (tree, level, index)."""

    def __init__(self):
        self.open: dict[tuple, tuple[int, dict[int, bytes]]] = {}
        self.done: list[tuple] = []

    def merge(self, tree: int, n: int, level: int, idx: int, slot: int, digest: bytes) -> None:
        """A child's digest reaches its parent; a parent that has all its children is the next event."""
        while True:
            own = self.open.setdefault((tree, level, idx), (n, {}))[1]
            own[slot] = digest
            size = arity(n, level, idx)
            if len(own) < size:
                return
            del self.open[tree, level, idx]
            children = b"".join(own[s] for s in range(size))
            digest = digest_of(children.hex())
            self.done.append((tree, n, level, idx, digest, children))
            if width(n, level) == 1:
                return
            level, idx, slot = level + 1, idx >> BITS, idx & (ARITY - 1)

    def finished(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def frontier(self) -> list[tuple]:
        """Partial parents: each child's place, a byte, before its digest."""
        return [(t, n, level, idx, None, b"".join(bytes([s]) + d for s, d in own.items())) for (t, level, idx), (n, own) in self.open.items()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _EVENT, strict=True)], schema=_EVENT)


def _grow_leaves(batches):
    tasks = Combiners()
    for batch in batches:
        for tree, n, idx, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            tasks.merge(tree, n, 1, idx >> BITS, idx & (ARITY - 1), digest)
        if tasks.done:
            yield _rows(tasks.finished())
    if tasks.open:
        yield _rows(tasks.frontier())


def _grow_parents(batches):
    tasks = Combiners()
    for batch in batches:
        for tree, n, level, idx, _, children in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for at in range(0, len(children), 33):
                tasks.merge(tree, n, level, idx, children[at], children[at + 1 : at + 33])
        if tasks.done:
            yield _rows(tasks.finished())
    if tasks.open:
        yield _rows(tasks.frontier())


def grow(leaves: DataFrame) -> DataFrame:
    """All inner nodes of the trees over leaves (tree, n, idx, digest): tree, n, level, idx, digest and
    children (their digests, one after the other).  Needs a round for every three levels."""
    rounds = [stage(map_in_arrow(leaves.where("n > 1").select("tree", "n", "idx", "digest"), _grow_leaves, EVENT))]
    band = F.ceil(F.col("level") / CLIMB) * CLIMB
    while True:
        frontier = rounds[-1].where("digest IS NULL")
        if frontier.isEmpty():
            break
        dealt = frontier.repartition("tree", band, F.expr(f"shiftright(idx, CAST({BITS} * (ceil(level / {CLIMB}) * {CLIMB} - level) AS INT))"))
        rounds.append(stage(map_in_arrow(dealt, _grow_parents, EVENT)))
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    return nodes.where("digest IS NOT NULL")


def numbered(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """df with idx, its row's place in its tree by order (nulls first), and n, the rows of the tree.
    Ranges split a hot tree; only counts of ranges are brought together."""
    dealt = stage(df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    runs = dealt.groupBy(part.alias("part"), F.col(tree).alias("own")).agg(F.count("*").alias("size"), F.min("place").alias("first"))
    whole = Window.partitionBy("own")
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stage(runs.select("part", "own", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n")))
    side = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    joined = dealt.join(side, (part == side["part"]) & dealt[tree].eqNullSafe(side["own"]))
    return joined.select(*df.columns, (F.col("place") - F.col("first") + F.col("before")).alias("idx"), "n")


def _part(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document, with another text if one is given."""
    fields = [*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.col("text") if text is None else text]
    return F.unhex(F.sha2(F.concat(*map(_part, fields)), 256))


@dataclass
class Manifest:
    leaves: DataFrame  #: doc_id, tree, n, idx, digest, received (digest of the text to check; null: unchanged)
    sources: DataFrame  #: tree (the source's place), source, n
    nodes: DataFrame  #: inner nodes of the sources' trees
    top: DataFrame  #: inner nodes of the tree over the sources' roots (tree 0)
    links: DataFrame  #: tree, run, path: digests of a run of leaves and of all runs above, upwards
    n_sources: int


def _wide(level: int) -> Column:
    return F.expr(f"shiftright(n + {(1 << BITS * level) - 1}, {BITS * level})")


def paths(nodes: DataFrame, trees: DataFrame, tallest: int) -> DataFrame:
    """tree, run, path of all runs of leaves, down from the trees (tree, n, above: what is over the root)."""
    out = None
    for level in range(tallest, 0, -1):
        own = nodes.where(F.col("level") == level).select("tree", "n", F.col("idx").alias("run"), "children")
        tops = own.where(_wide(level) == 1).join(trees.select("tree", "above"), "tree")
        found = tops.select("tree", "run", F.concat("children", "above").alias("path"))
        if out is not None:
            up = out.select("tree", F.col("run").alias("up"), "path")
            below = own.where(_wide(level) > 1).withColumn("up", F.shiftright("run", BITS)).join(up, ["tree", "up"])
            found = found.unionByName(below.select("tree", "run", F.concat("children", "path").alias("path")))
        out = found
    alone = trees.where("n = 1").select("tree", F.lit(0).cast("long").alias("run"), F.col("above").alias("path"))
    return alone if out is None else out.unionByName(alone)


def manifest(docs: DataFrame, received: Column | None = None) -> Manifest:
    """Numbers, trees and links of documents.  received: what came in as the text of a row, to be
    checked against the manifest (null: the text as it is)."""
    own = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    other = F.lit(None).cast("binary") if received is None else F.when(received.isNotNull(), leaf(received))
    rows = stage(own.select("doc_id", "source", leaf().alias("digest"), other.alias("received"), F.monotonically_increasing_id().alias("row")))
    places = numbered(rows, "source", "doc_id", "digest", "row")
    sizes = rows.groupBy("source").agg(F.count("*").alias("size")).withColumn("all", F.lit(0))
    sources = stage(numbered(sizes, "all", "source").select(F.col("idx").alias("tree"), "source", F.col("size").alias("n"), F.col("n").alias("n_sources")))
    most = sources.agg(F.max("n"), F.max("n_sources")).first()
    ids = F.broadcast(sources) if (most[1] or 0) <= BROADCAST_RUNS else sources
    leaves = stage(places.join(ids.select("tree", F.col("source").alias("of")), places["source"].eqNullSafe(F.col("of"))).select("doc_id", "tree", "n", "idx", "digest", "received"))
    nodes = grow(leaves)
    roots = nodes.where("idx = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    roots = roots.unionByName(leaves.where("n = 1").select("tree", "digest"))
    subroots = stage(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(most[1]).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"))
    top = grow(subroots)
    whole = sources.limit(1).select(F.lit(0).cast("long").alias("tree"), F.col("n_sources").alias("n"), F.lit(b"").alias("above"))
    above = paths(top, whole, height(most[1] or 1)).select(F.col("run"), F.col("path").alias("above"))
    trees = stage(sources.withColumn("run", F.shiftright("tree", BITS)).join(above, "run").select("tree", "n", "above"))
    return Manifest(leaves, sources, nodes, top, paths(nodes, trees, height(most[0] or 1)), most[1] or 0)


def prove(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, n_siblings, proof_sha256 (digest of the siblings, upwards),
    folded_root (from what was received, and the siblings) and verified, for each leaf."""
    total = m.n_sources

    def rows(batch):
        out = [[] for _ in range(8)]
        ends: dict[bytes, str] = {}  # digests of the roots' children

        def end(block: bytes) -> str:
            if block not in ends:
                if len(ends) > 1000:
                    ends.clear()
                ends[block] = digest_of(block.hex()).hex()
            return ends[block]

        for doc, tree, n, idx, digest, got, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = subroot = root = digest.hex()
            now, at, siblings = (got or digest).hex(), 0, []
            for size, place, is_top in ((n, idx, False), (total, tree, True)):
                level, block = 0, None
                while width(size, level) > 1:
                    level += 1
                    slot, place = place & (ARITY - 1), place >> BITS
                    to = at + 32 * arity(size, level, place)
                    block, at = path[at:to], to
                    text = block.hex()
                    left, right = text[: 64 * slot], text[64 * slot + 64 :]
                    siblings += [left, right]
                    now = digest_of(f"{left}{now}{right}").hex()
                root = end(block) if block else root
                subroot = subroot if is_top else root
            proof = "".join(siblings)
            for column, value in zip(out, (doc, own, subroot, root, len(proof) // 64, digest_of(proof).hex(), now, now == root), strict=True):
                column.append(value)
        return [pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)]

    kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.bool_()]
    joined = m.leaves.withColumn("run", F.shiftright("idx", BITS)).join(m.links, ["tree", "run"])
    return map_batches(
        joined.select("doc_id", "tree", "n", "idx", "digest", "received", "path"),
        "doc_id long, leaf string, subroot string, root string, n_siblings long, proof_sha256 string, folded_root string, verified boolean",
        rows,
        text=6,
    )


def lowered_copy() -> Column:
    """A tampered text: A-Z in lower case, in rows whose crc32 of the id is a multiple of 5."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text")))
