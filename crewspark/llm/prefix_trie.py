"""Prefix tries of conversations that share their first turns.

Turns are known by digests.  Conversations are hash-partitioned by the digest of their first turn into
buckets of bounded size, in which tries with dictionaries of child pointers are built and folded in
iterative postorder.  A first turn with too many turns below it is divided by the next turn, the parts
that are still too large by the one after it, and so on; as a node is known by the digests on its way,
one aggregation gives the sizes below all of them, so that this needs no rounds.  The nodes above the
cuts, the spine, are few but have many members: they are aggregated, and what lies below them reaches
them through their parts' smallest members.

Nulls of role and text are empty; a null turn comes first, turns of one number are ordered by digest,
equal ones follow each other.  Rows without conv_id are in no conversation.  An empty table has no
nodes; further columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewspark.llm.common import pick, stage
from crewspark.shipping import map_in_arrow, ship

#: Turns below a node up to which its subtrie is built in one piece.
SUBTRIE_TURNS = 2_000
#: Turns of a bucket, on average.
BUCKET_TURNS = 4_000
#: Nodes of the spine up to which they are broadcast (about 50 bytes each).
BROADCAST_NODES = 500_000
#: conv_ids of one block of a list of ends: 2 ** BLOCK.
BLOCK = 12
ROOT = bytes(16)

TURN = "conv_id long, depth long, length long, first binary, node binary, up binary, bytes long"
_TURN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("length", pa.int64()), ("first", pa.binary()), ("node", pa.binary()), ("up", pa.binary()), ("bytes", pa.int64())])
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up binary"


def _paths(batches):
    """Conversations as ways through the trie: rows sorted by family, its base first, and turn.  A family
    shares what its base begins with; of that no more than the most turns taken over are kept."""
    family = conv = None
    base: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for own_family, c, taken, own, most, digest, size in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if c != conv:
                if own_family != family:
                    family, base = own_family, []
                conv, k, depth, node, first = c, 0, 0, ROOT, None
                shared = [] if c == family else base[:taken]
                length = own if c == family else len(shared) + max(0, own - taken)
                out.append((c, 0, length, None, ROOT, None, 0))
                turns = shared
            else:
                turns = []
            if c == family:
                if k < most:
                    base.append((digest, size))
                turns = [(digest, size)]
            elif k >= taken:
                turns = [*turns, (digest, size)]
            k += 1
            for d, s in turns:
                up, depth = node, depth + 1
                node = hashlib.blake2b(up + d, digest_size=16).digest()
                first = first or node
                out.append((c, depth, length, first, node, up, s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _TURN, strict=True)], schema=_TURN)


def paths(conversations: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """A row for each turn of each conversation, and one (depth 0) for its start.  Conversation c begins
    with the first crc32(c) % (most + 1) turns of c - c % every, and goes on with its own after those."""
    own = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    own = own.select(
        (F.col("conv_id") - F.col("conv_id") % every).cast("long").alias("family"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).repartition("family")
    own = own.withColumn("own", F.count("*").over(Window.partitionBy("family", "conv_id")))
    dealt = own.sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "digest")
    taken = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("long")
    rows = dealt.select("family", "conv_id", taken.alias("taken"), "own", F.lit(most).cast("long").alias("most"), "digest", "bytes")
    return map_in_arrow(rows, _paths, TURN)


def _tries(part: pd.DataFrame) -> pd.DataFrame:
    """The tries of a bucket: children are dictionaries from a turn's digest to a pointer."""
    part = part.sort_values(["key", "conv_id", "depth"])
    kids: list[dict] = []
    conv, depth, size, n, ends, parent, above = [], [], [], [], [], [], []
    roots: dict[bytes, int] = {}
    at, now = -1, None
    for key, c, d, length, node, up, b in zip(*[part[x].tolist() for x in ("key", "conv_id", "depth", "length", "node", "up", "bytes")], strict=True):
        if (key, c) != now:
            at, now = -1, (key, c)
        below = roots if at < 0 else kids[at]
        to = below.get(node)
        if to is None:
            to = below[node] = len(kids)
            kids.append({})
            conv.append(c)  # ids come in ascending order
            depth.append(d)
            size.append(b)
            n.append(0)
            ends.append([])
            parent.append(at)
            above.append(up if at < 0 else None)
        n[to] += 1
        if d == length:
            ends[to].append(c)
        at = to
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for root in roots.values():
        order, todo = [], [root]
        while todo:
            v = todo.pop()
            order.append(v)
            todo.extend(kids[v].values())
        for v in reversed(order):  # children before their parents
            leaves[v] += not kids[v]
            saved[v] += (n[v] - 1) * size[v]
            if parent[v] >= 0:
                leaves[parent[v]] += leaves[v]
                saved[parent[v]] += saved[v]
    digests = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in ends]
    columns = (conv, depth, [conv[p] if p >= 0 else None for p in parent], n, [len(k) for k in kids], leaves, saved, digests, above)
    out = pd.DataFrame(dict(zip([f.split(" ")[0] for f in NODE.split(", ")], columns, strict=True)))
    return out.astype({"parent_conv_id": "Int64"})


def _ends(batches):
    """Digest of each node's conv_ids: rows (node, block of them as text) sorted by node and block."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        out = []
        for own, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def prefix_trie(conversations: DataFrame, subtrie: int = SUBTRIE_TURNS, bucket: int = BUCKET_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (of the subtree) and ends_sha256."""
    rows = stage(paths(conversations))
    turns = rows.where("depth > 0")
    firsts = turns.groupBy("first").agg(F.count("*").alias("below"))
    large = stage(firsts.where(F.col("below") > subtrie).select("first"))
    starts = rows.where("depth = 0").drop("first")
    if large.isEmpty():
        cut, spine = turns.withColumn("key", F.col("first")), starts
    else:
        side = _small(large)
        inside = turns.join(side, "first", "left_semi")
        sizes = inside.groupBy("node").agg(F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
        over = _small(stage(sizes.where(F.col("below") > subtrie).select("node", F.lit(True).alias("over"))))
        first_under = F.min(F.when(F.col("over").isNull(), F.struct("depth", "node"))).over(Window.partitionBy("conv_id"))
        marked = stage(inside.join(over, "node", "left").withColumn("key", first_under["node"]))
        rest = turns.join(side, "first", "left_anti").withColumn("key", F.col("first"))
        columns = ["key", "conv_id", "depth", "length", "node", "up", "bytes"]
        cut = rest.select(columns).unionByName(marked.where("over IS NULL").select(columns))
        spine = starts.unionByName(marked.where("over").select(starts.columns))
    ship(rows.sparkSession)
    n_buckets = max(1, -(-turns.count() // bucket))
    dealt = cut.select(F.pmod(F.xxhash64("key"), F.lit(n_buckets)).alias("bucket"), "key", "conv_id", "depth", "length", "node", "up", "bytes")
    tries = stage(dealt.groupBy("bucket").applyInPandas(_tries, NODE))
    return _with_spine(tries, stage(spine))


def _with_spine(tries: DataFrame, members: DataFrame) -> DataFrame:
    """All nodes, from the subtries and from the ways (conv_id, depth, node ...) over the spine."""
    spine = stage(
        members.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.max("up").alias("up"))
    )
    tops = tries.where("up IS NOT NULL")
    children = spine.where("up IS NOT NULL").select(F.col("up").alias("node")).unionByName(tops.select(F.col("up").alias("node")))
    full = stage(spine.join(children.groupBy("node").agg(F.count("*").alias("n_children")), "node", "left").fillna(0, ["n_children"]))
    # what a node adds is told to its smallest member, which is also a member of all nodes above it
    own = full.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    added = own.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    zero, nowhere = F.lit(0).cast("long"), F.lit(None).cast("binary")
    told = members.select("conv_id", "depth", "node", zero.alias("leaves"), zero.alias("saved")).unionByName(added.select("conv_id", "depth", nowhere.alias("node"), "leaves", "saved"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    told = told.select("node", F.sum("leaves").over(down).alias("leaves"), F.sum("saved").over(down).alias("saved")).where("node IS NOT NULL")
    sums = told.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    blocks = members.where("depth = length").groupBy("node", F.shiftright("conv_id", BLOCK).alias("block"))
    texts = blocks.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = map_in_arrow(texts.repartition("node").sortWithinPartitions("node", "block").select("node", "ids"), _ends, "node binary, ends_sha256 string")
    up = _small(spine.select(F.col("node").alias("up"), F.col("conv_id").alias("above")))
    none = hashlib.sha256(b"").hexdigest()
    out = full.join(sums, "node").join(ends, "node", "left").fillna(none, ["ends_sha256"]).join(up, "up", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = tries.join(up, "up", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return out.withColumn("parent_conv_id", F.col("above")).select(columns).unionByName(below.select(columns))
