"""Substring dedup with an FM-index per shard.

A window is 35 consecutive words.  Its anchor is its least run of 8 words by hash, which depends on
the window's words only; so equal windows have equal anchors, and the windows around one anchor are
routed to one shard.  Consecutive windows with one anchor are one segment, an open part of its
document; equal segments are counted before anything is sent.  Each shard builds a compressed
FM-index over its different segments: the Burrows-Wheeler transform in a wavelet matrix of packed
bits with block ranks, and two bit vectors; the suffix array is dropped once these are made.  The
segments' words are then streamed through it by backward search, all segments in step, which keeps
the length and the interval of each match.  A match that grows beyond the window is shortened on its
right (to the rows that share its first 35 words: rank and select on a bit vector of borders), so
that every window's interval is known; it is repeated if the interval stands for more than one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewspark.llm.common import ARROW, map_batches, pick, slices, stage
from crewspark.llm.textscan import NOT_BLANK, U, mix, scan, windows
from crewspark.shipping import map_in_arrow, ship

WINDOW, ANCHOR = 35, 8
#: Bases of the two content hashes of a segment, and the limit of 64 bits.
STEPS, MASK = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25), (1 << 64) - 1
#: Characters of all texts for each shard.
SHARD_CHARS = 4_000_000
#: An anchor with more different segments is routed window by window.
HOT = 2_000
#: A place is begin x PLACE + number of windows (which share an anchor: fewer than PLACE).
PLACE = 64
#: Bytes of words handed on at once.
SENT_BYTES = 4_000_000


class Bits:
    """A bit vector with rank and select, 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        packed[:n] = bits
        self.words = np.packbits(packed, bitorder="little").view("<u8")
        self.counts = np.r_[0, np.cumsum(np.bitwise_count(self.words))][:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        below = (U(1) << (at & 63).astype(U)) - U(1)
        return self.counts[at >> 6] + np.bitwise_count(self.words[at >> 6] & below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the one with k ones before it."""
        block = np.searchsorted(self.counts, k, side="right") - 1
        word, left, at = self.words[block], k - self.counts[block], np.zeros(len(k), dtype=np.int64)
        for size in (32, 16, 8, 4, 2, 1):
            own = np.bitwise_count((word >> at.astype(U)) & U((1 << size) - 1))
            up = own <= left
            left, at = np.where(up, left - own, left), np.where(up, at + size, at)
        return (block << 6) + at


class FMIndex:
    """FM-index of segments of numbers (above 0), each ended by 0, with what shortening needs.

    many: whether a segment stands for several places.  It holds bits only: per symbol 1.5 for each
    level of the wavelet matrix, and 1.5 each for borders (rows that differ from the row before in
    their first ``depth`` symbols) and for rows of segments with several places.
    """

    def __init__(self, text: np.ndarray, many: np.ndarray, depth: int):
        n = len(text)
        self.n, self.depth = n, depth
        rank, h = text.astype(np.int32), 1
        while h < 2 * (depth + 1):
            if h <= depth < 2 * h:
                half, at_half = h, rank
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - h, 0)] = rank[h:] + 1
            key = rank * np.int64(n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, dtype=np.int32)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.cumsum(new) - 1
            h *= 2
        # rows that agree in their first ``depth`` symbols: two overlapping powers of two
        a, b = at_half[order], at_half[np.minimum(order + depth - half, n - 1)]
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.borders, self.many = Bits(new), Bits(many[order])
        self.top = int(text.max())
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=self.top + 1))]
        self._wavelet(text[order - 1])

    def _wavelet(self, bwt: np.ndarray) -> None:
        self.levels = []
        for bit in reversed(range(max(1, self.top.bit_length()))):
            ones = (bwt >> bit) & 1
            self.levels.append((bit, Bits(ones), self.n - int(ones.sum())))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        symbols = np.arange(self.top + 1)
        self.base = self._walk(symbols, np.zeros(len(symbols), dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self._walk(np.r_[symbol, symbol], np.r_[low, high])
        shift = self.below[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``depth`` symbols of the patterns whose intervals start at low."""
        k = self.borders.rank(low + 1)
        return self.borders.select(k - 1), self.borders.select(k)

    def repeated(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the intervals stand for more than one place."""
        return (high - low > 1) | (self.many.rank(high) > self.many.rank(low))


def repeated_windows(segments: list[np.ndarray], counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, whether the window that starts at each of its places stands for more than
    one place of the corpus.  counts: places that each segment stands for."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    own = np.ones(int(ends[-1]), dtype=bool)
    own[ends - 1] = False  # 0 ends a segment
    text = np.zeros(len(own), dtype=np.int64)
    text[own] = np.unique(np.concatenate(segments), return_inverse=True)[1] + 1
    index = FMIndex(text, np.repeat(np.asarray(counts) > 1, sizes + 1), window)
    flags = np.zeros(len(text), dtype=bool)
    order = np.argsort(-sizes, kind="stable")
    long = sizes[order]
    low, high = np.zeros(len(order), dtype=np.int64), np.full(len(order), index.n)
    for length in range(1, int(long[0]) + 1):
        live = int(np.searchsorted(-long, -length, side="right"))
        at = starts[order[:live]] + long[:live] - length
        low, high = index.extend(text[at], low[:live], high[:live])
        if length > window:
            low, high = index.shorten(low)
        if length >= window:
            flags[at] = index.repeated(low, high)
    return [flags[a : a + n - window + 1] for a, n in zip(starts, sizes, strict=True)]


def segments_of(column: pa.Array, window: int = WINDOW, anchor: int = ANCHOR):
    """doc, first window, number of windows, anchor hash, two content hashes of all segments."""
    s = scan(column, NOT_BLANK, lower=False)
    h = s.hashes()
    n = np.maximum(s.n_words - window + 1, 0)
    if not n.sum():
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 3
    grams = windows(h, anchor)
    span, place = window - anchor + 1, np.arange(len(grams), dtype=U)
    bits = U(max(24, len(grams).bit_length()))
    key = ((grams >> bits) << bits) | place  # the leftmost of equals
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    least = np.minimum(key[: len(key) - (span - size)], key[span - size :]) if span > size else key
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s.first[:-1][doc]
    chosen = (least[at] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    begin, end = at[first], at[first] + count + window - 1
    salt = count.astype(U) * U(0x632BE59BD9B4E019) + (chosen[first] - begin).astype(U)
    contents = []
    for step in STEPS:  # of prefix sums, as a segment is any run of words
        up, down = np.full(len(h), step, dtype=U), np.full(len(h), pow(step, -1, 1 << 64), dtype=U)
        up[:1] = down[:1] = 1
        sums = np.r_[U(0), np.cumsum(mix(h ^ U(step)) * np.multiply.accumulate(up))]
        contents.append(mix((sums[end] - sums[begin]) * np.multiply.accumulate(down)[begin] + salt))
    return [doc[first], begin - s.first[:-1][doc[first]], count, grams[chosen[first]], *contents]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words, one blank between) per document.

    Words are runs without blanks, unchanged; null and empty texts have none.  A repeated row makes
    its windows repeated, like any copy; rows with one id and different texts are judged each; texts
    of fewer words than a window keep all; an empty table gives an empty one.

    Only segments whose anchor occurs twice go on after the first count; texts travel compressed.
    """
    import zstandard

    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), "txt": F.xxhash64("text")})

    def cut(batch):
        doc, begin, count, anchor, *contents = segments_of(batch.column(2), window)
        ids, txt = (batch.column(i).to_numpy()[doc] for i in (0, 1))
        return [anchor.view(np.int64), *(c.view(np.int64) for c in contents), ids, txt, begin * PLACE + count]

    # cut twice, so that only anchors go to the disk for those that occur once
    anchors = map_batches(rows.select("text"), "anchor long", lambda batch: [segments_of(batch.column(0), window)[3].view(np.int64)], text=0)
    # staged, so that the join's sides are plain exchanges and a hot anchor's partition can be split
    twice = stage(anchors.groupBy("anchor").agg(F.count("*").alias("all")).where("all > 1").select("anchor"))
    placed = map_batches(rows.select("id", "txt", "text"), "anchor long, seg long, seg2 long, id long, txt long, place long", cut, text=2)
    repeated = stage(placed.join(twice, "anchor").withColumn("n", (F.col("place") % PLACE).cast("int")))
    different = repeated.groupBy("anchor", "seg", "seg2", "n").agg(F.count("*").alias("places"), F.min(F.struct("id", "txt", "place")).alias("x"))
    hot = different.groupBy("anchor").agg(F.count("*").alias("segments")).where(F.col("segments") > HOT).select("anchor", F.lit(True).alias("hot"))
    wanted = different.join(hot, "anchor", "left").select("x.id", "x.txt", F.struct("anchor", "seg", "seg2", "n", "places", "x.place", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    zipped = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("txt", pa.int64()), ("z", pa.binary())])

    def shrink(batches):
        z = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole, 3):
                packed = pa.array([z.compress(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], schema=zipped)

    dealt = map_in_arrow(rows.select("doc_id", "id", "txt", "text"), shrink, "doc_id long, id long, txt long, z binary").repartition("id", "txt")
    ordered = dealt.select("id", "txt", "z").dropDuplicates(["id", "txt"]).join(wanted.groupBy("id", "txt").agg(F.collect_list("s").alias("segs")), ["id", "txt"])
    sent = "shard long, anchor long, seg long, seg2 long, n int, skip long, places long, words binary"

    def payload(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out, held = [], 0
            for packed, segs in zip(batch.column(0), batch.column(1), strict=True):
                h = scan(pa.array([z.decompress(packed.as_py()).decode()]), NOT_BLANK, lower=False).hashes()
                raw = h.tobytes()
                for x in segs.as_py():
                    a, count = divmod(x["place"], PLACE)
                    parts = [(k, 1) for k in range(count)] if x["hot"] else [(0, count)]
                    for skip, some in parts:
                        words = raw[8 * (a + skip) : 8 * (a + skip + some + window - 1)]
                        by = int.from_bytes(hashlib.blake2b(words, digest_size=6).digest()) if x["hot"] else x["anchor"]
                        out.append((by % shards, x["anchor"], x["seg"], x["seg2"], count, skip, x["places"], words))
                        held += len(words)
                if held > SENT_BYTES:
                    yield _batch(out, sent)
                    out, held = [], 0
            if out:
                yield _batch(out, sent)

    def search(table: pa.Table) -> pa.Table:
        anchor, seg, seg2, n, skip, places = (table.column(c).to_numpy() for c in ("anchor", "seg", "seg2", "n", "skip", "places"))
        segments = [np.frombuffer(raw, dtype="<u8") for raw in table.column("words").to_pylist()]
        flags = repeated_windows(segments, places, window)
        sizes = np.array([len(f) for f in flags])
        joined = np.concatenate([np.r_[f, False] for f in flags]).astype(np.int8)
        change = np.diff(np.r_[0, joined])
        lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        base = np.cumsum(sizes + 1) - sizes - 1
        which = np.searchsorted(base, lo, side="right") - 1
        shift = skip[which] - base[which]
        return pa.table({"anchor": anchor[which], "seg": seg[which], "seg2": seg2[which], "n": n[which], "lo": lo + shift, "hi": hi + shift})

    words = map_in_arrow(ordered.select("z", "segs"), payload, sent)
    ranges = words.groupBy("shard").applyInArrow(search, "anchor long, seg long, seg2 long, n int, lo long, hi long")
    begin = F.floor(F.col("place") / PLACE)
    covered = repeated.join(ranges, ["anchor", "seg", "seg2", "n"]).select("id", "txt", (begin + F.col("lo")).alias("a"), (begin + F.col("hi") + window - 1).alias("b")).distinct()
    lists = covered.groupBy("id", "txt").agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    final = dealt.join(lists, ["id", "txt"], "left").select("doc_id", "z", "cover")
    kinds = "doc_id long, n_words long, n_removed long, kept string"

    def keep(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out, held = [], 0
            for doc, packed, cover in zip(*batch.columns, strict=True):
                own = z.decompress(packed.as_py()).split()  # at the blanks that part words here, and at no others
                left, at = [], 0
                for x in sorted((x["a"], x["b"]) for x in cover.as_py() or ()):
                    left += own[at : x[0]]
                    at = max(at, x[1])
                left += own[at:]
                out.append((doc.as_py(), len(own), len(own) - len(left), b" ".join(left).decode()))
                held += len(out[-1][3])
                if held > SENT_BYTES:
                    yield _batch(out, kinds)
                    out, held = [], 0
            if out:
                yield _batch(out, kinds)

    return map_in_arrow(final, keep, kinds)


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=ARROW[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
