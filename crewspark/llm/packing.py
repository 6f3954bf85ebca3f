"""Mixture-controlled packing of token streams into windows.

Each source is a queue of tokens.  Deficit round-robin serves the queues: in each window a queue
earns its quantum (window size x target share), sends whole tokens, and carries the rest.  What a
queue has sent after w windows is then known in closed form (the floor of what it has earned), so
that every task can cut its own documents without hearing of the others: deficits carry over
windows and partitions alike.  Where a queue runs dry, a new phase begins with the others' shares.
What remains at a phase's end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewspark.llm.common import ARROW, pick, slices, stage
from crewspark.shipping import map_in_arrow

WINDOW = 1024
#: Texts with one of these go to the tokenizer itself: blanks for one library only, a special token.
OWN = ("<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f")
#: Rows of (partition, source) up to which their offsets are broadcast (32 bytes each).
BROADCAST_ROWS = 200_000


class Encoder:
    """ids of a text as bytes, two a token: by the rank file of the same vocabulary, which is faster."""

    def __init__(self, path: str, ranks_path: str):
        from tokenizers import Tokenizer

        from crewspark.llm.secret_scan import encoder

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids over 65535 don't fit two bytes")
        self.fast = encoder(ranks_path).encode_ordinary

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(map(text.__contains__, OWN)):
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("H", self.fast(text)).tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def tokenized(docs: DataFrame, path: str, ranks_path: str) -> DataFrame:
    """part, source, local_start (tokens of this source before it in its part), doc_id, ids."""
    out = pa.schema([(n, ARROW[t]) for n, t in (("part", "long"), ("source", "string"), ("local_start", "long"), ("doc_id", "long"), ("n", "long"), ("ids", "binary"))])

    def run(batches):
        if (path, ranks_path) not in _encoders:  # once in a worker process
            _encoders[path, ranks_path] = Encoder(path, ranks_path)
        enc = _encoders[path, ranks_path]
        part, sent = TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in slices(whole, 2):
                ids, sources, texts = (c.to_pylist() for c in batch.columns)
                tokens = [enc.ids(t) + b"\0\0" for t in texts]
                starts = []
                for s, t in zip(sources, tokens, strict=True):
                    starts.append(sent.get(s, 0))
                    sent[s] = starts[-1] + len(t) // 2
                columns = [[part] * len(ids), sources, starts, ids, [len(t) // 2 for t in tokens], tokens]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    rows = pick(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return map_in_arrow(rows, run, "part long, source string, local_start long, doc_id long, n long, ids binary")


@dataclass
class Phase:
    """Tokens [start, end) of each queue, in order of the queues, and the first sequence's number."""

    start: list[int]
    end: list[int]
    first: int

    def __post_init__(self):
        sizes = [b - a for a, b in zip(self.start, self.end, strict=True)]
        self.below = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        self.total = self.below[-1]
        self.full = self.total // WINDOW
        rest, at, self.cuts = self.total % WINDOW, 0, [0]
        for bit in reversed(range(WINDOW.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                self.cuts.append(at)
        self.sequences = self.full + len(self.cuts) - 1

    def earned(self, i: int, w: int) -> int:
        """Tokens that the first i queues send in w windows."""
        return WINDOW * w * self.below[i] // self.total

    def pieces(self, q: int, a: int, b: int):
        """(start, end, sequence, offset) for the tokens [a, b) of queue q in this phase."""
        a, b, zero = max(a, self.start[q]), min(b, self.end[q]), self.start[q]
        if a >= b:
            return
        k, end = a - zero, b - zero
        own = self.below[q + 1] - self.below[q]
        w = min(k * self.total // (own * WINDOW), self.full)
        sent = lambda w: self.earned(q + 1, w) - self.earned(q, w)
        while w and sent(w) > k:
            w -= 1
        while w < self.full and sent(w + 1) <= k:
            w += 1
        have = sent(w)
        while k < end and w < self.full:
            after = sent(w + 1)
            to = min(end, after)
            if to > k:
                yield zero + k, zero + to, self.first + w, self.earned(q, w + 1) - self.earned(q, w) + k - have
            k, w, have = to, w + (to == after), after if to == after else have
            if own * WINDOW < self.total and q + 2 == len(self.below):  # windows that get none of the last queue
                w = max(w, min(k * self.total // (own * WINDOW), self.full))
                have = sent(w)
        if k < end:
            shift = self.below[q] - self.earned(q, self.full) - sent(self.full)
            while k < end:
                c = bisect_right(self.cuts, shift + k) - 1
                to = min(end, self.cuts[c + 1] - shift)
                yield zero + k, zero + to, self.first + self.full + c, shift + k - self.cuts[c]
                k = to


def phases(sizes: list[int], weights: list[Fraction] | None) -> list[Phase]:
    """Phases of the queues; without weights one, as all queues end together at their own shares."""
    left, at, out = list(sizes), [0] * len(sizes), []
    while any(left):
        if weights is None:
            take = list(left)
        else:
            live = [i for i, n in enumerate(left) if n]
            t = min(Fraction(left[i]) / weights[i] for i in live)
            take = [min(n, int(weights[i] * t)) if n else 0 for i, n in enumerate(left)]
        to = [a + b for a, b in zip(at, take, strict=True)]
        out.append(Phase(at, to, out[-1].first + out[-1].sequences if out else 0))
        at, left = to, [a - b for a, b in zip(left, take, strict=True)]
    return out


def by_virtual_time(rows: DataFrame) -> DataFrame:
    """doc_id, source, queue, at (tokens before it), ids of the common queue's documents (with at and all: its
    place in its source, and that source's tokens).

    A document's time is the share of its source's tokens before it, moved by a part of its own length
    that hangs on the source, so that sources don't begin together.  Ranges of time are sorted and
    summed in tasks; only the ranges' sums are added up.
    """
    own = pa.schema([(n, ARROW[t]) for n, t in (("range", "long"), ("doc_id", "long"), ("source", "string"), ("queue", "long"), ("sent", "long"), ("n", "long"), ("ids", "binary"))])
    moved = (F.pmod(F.xxhash64("source"), F.lit(1024)) + 0.5) / 1024
    timed = rows.select("doc_id", "source", "queue", "at", "n", "ids", ((F.col("at") + F.col("n") * moved) / F.col("all")).alias("time"))
    order = ["time", "source", "at", "doc_id"]

    def run(batches):
        part, sent = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            starts = sent + np.cumsum(sizes) - sizes
            sent += int(sizes.sum())
            columns = [np.full(batch.num_rows, part), *[batch.column(i) for i in range(3)], starts, sizes, batch.column(4)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, own, strict=True)], schema=own)

    dealt = timed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "queue", "n", "ids")
    summed = stage(map_in_arrow(dealt, run, "range long, doc_id long, source string, queue long, sent long, n long, ids binary"))
    ranges = summed.groupBy("range").agg(F.sum("n").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stage(ranges.select("range", base.alias("base")))
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return summed.join(bases, "range").select("doc_id", "source", "queue", (F.col("base") + F.col("sent")).alias("at"), "ids")


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    targets: share of each source in every window; without it, the corpus's own shares.  Sources
    that aren't named there, or whose share is below one token a window, share the last queue, in which
    documents stand by virtual time: each source's are spread over all of it, so that at any moment what
    a source has sent is within a document of its share.  At most 1024 queues can have a share of 1/1024
    or more, so that what the driver learns about queues is bounded.  Null sources are "", null texts
    are empty (one token, the end mark); repeated rows are documents of their own; an empty table gives
    no pieces.
    """
    import public_tokenizers

    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = stage(tokenized(docs, path, ranks))
    by_part = stage(rows.groupBy("part", "source").agg(F.sum("n").alias("n")))
    total = by_part.agg(F.sum("n")).first()[0] or 0
    by_source = by_part.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        large = {r[0]: r[1] for r in by_source.where(F.col("n") * WINDOW >= total).collect()}
    else:
        named = {s for s, x in targets.items() if x * WINDOW >= sum(targets.values())}
        large = {r[0]: r[1] for r in by_source.where(F.col("source").isin(list(named))).collect()}
    names = sorted(large, key=lambda s: (-large[s], s))
    sizes = [large[s] for s in names]
    rest = total - sum(sizes)
    if rest:  # last, so that its share may be below a token a window: what it has sent is rounded up
        names.append(None)
        sizes.append(rest)
    weights = None
    if targets is not None:
        whole = Fraction(sum(Fraction(x) for x in targets.values()))
        own = [Fraction(targets[s]) / whole if s is not None else Fraction(0) for s in names]
        weights = [x or max(Fraction(1, WINDOW), 1 - sum(own)) for x in own]
    common = len(names) - 1
    queue_of = {s: i for i, s in enumerate(names) if s is not None}
    plan = phases(sizes, weights)

    pairs = [x for s, i in queue_of.items() for x in (F.lit(s), F.lit(i))]
    queue = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(common)) if pairs else F.lit(common)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("source")
    bases = stage(by_part.select("part", "source", queue.cast("long").alias("queue"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(all_).alias("all")))
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    found = rows.join(bases, ["part", "source"]).withColumn("at", F.col("base") + F.col("local_start"))
    placed = found.where(F.col("queue") != common) if rest else found
    placed = placed.select("doc_id", "source", "queue", "at", "ids")
    if rest:
        placed = placed.unionByName(by_virtual_time(found.where(F.col("queue") == common)))
    out = pa.schema([(n, ARROW[t]) for n, t in PIECES])

    def cut(batches):
        for batch in batches:
            rows = []
            ids, sources, queues, starts, tokens = (c.to_pylist() for c in batch.columns)
            for doc, source, q, at, raw in zip(ids, sources, queues, starts, tokens, strict=True):
                wide = memoryview(np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes())
                n = len(wide) // 4
                for phase in plan:
                    for a, b, sequence, offset in phase.pieces(q, at, at + n):
                        rows.append((doc, a - at, b - a, zlib.crc32(wide[4 * (a - at) : 4 * (b - at)]), n, sequence, offset, source))
                if len(rows) > 100_000:
                    yield _batch(rows, out)
                    rows = []
            if rows:
                yield _batch(rows, out)

    return map_in_arrow(placed, cut, ", ".join(f"{n} {t}" for n, t in PIECES))


#: Columns of pack().
PIECES = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("source", "string")]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
