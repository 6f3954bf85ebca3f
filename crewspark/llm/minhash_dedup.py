"""MinHash near-dedup with tensored banding, every link confirmed on the full shingle sets.

Two small collections of bands are made from the minhashes; a table's key is a pair of one band of
either collection, so that b bands a side give b x b tables for 2 x b bands' worth of hashing.
Documents with one shingle set are one class.  In a bucket, members are held against the bucket's
leader, its most central class, not against each other: near copies of one text link to it.

What leaders leave open is settled by differences.  Each member of a leader's buckets becomes the set
of shingles in which it differs from the leader; two members' common shingles follow from their sizes
and from the number of differences they share.  Members that don't link with the leader need at
least one shared difference to link with anyone, and mostly many, so that their rarest differences
(a prefix, as in prefix-filtered set joins) lead to all possible partners.  Work follows rare shared
differences, not the size of a bucket; no link between candidates is lost, no copies are paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.llm.common import ARROW, map_batches, pick, stage
from crewspark.llm.textscan import NOT_BLANK, U, mix, scan, window_owner, windows
from crewspark.shipping import ship

BANDS = 12
#: Bound of the probability that a pair at the threshold shares no table.
MISSED = 0.001
#: Rows of candidate ids up to which they are broadcast to pick texts (32 bytes each).
BROADCAST_IDS = 1_000_000
#: Shingles of the texts of one block of pairs that are compared together.
BLOCK_SHINGLES = 200_000
#: Texts that are scanned at once.
GROUP = 256
#: Rounds of leaders before the differences, and leaders that a class is held against in each: those
#: with which it shares the most tables.  The differences make up for all others.
ROUNDS, NEAREST = 1, 4


def shingle_sets(column: pa.Array, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and their number a text."""
    s = scan(column, NOT_BLANK, lower=True)
    h = s.hashes()
    at, doc = window_owner(s, w)
    values = windows(h, w)[at] if len(at) else np.zeros(0, U)
    for k in range(1, w):
        short = np.flatnonzero(s.n_words == k)
        if len(short):
            doc = np.r_[doc, short]
            values = np.r_[values, mix(windows(h, k)[s.first[short]] + U(k))]
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(doc[new], minlength=len(column))


def _per_text(values: np.ndarray, sizes: np.ndarray, ufunc) -> np.ndarray:
    """ufunc over each text's values (texts without any: 0)."""
    out = np.zeros(len(sizes), dtype=values.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = ufunc.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def set_ids(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    a, b = (_per_text(mix(values ^ U(x)), sizes, np.add) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return [x.tobytes() for x in np.stack([a, b], axis=1)]


def minhashes(values: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (32 bits) a text."""
    seeds = np.frombuffer(hashlib.shake_256(b"minhash").digest(16 * n), dtype="<u8").reshape(n, 2) | U(1)
    return np.stack([_per_text(((values * a + b) >> U(32)).astype(np.uint32), sizes, np.minimum) for a, b in seeds], axis=1)


def band_rows(percent: int) -> int:
    """The most minhashes a band with which a pair at the threshold meets in no table with a
    probability of MISSED at most."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    fits = [r for r in range(1, 9) if 2 * (1 - (percent / 100) ** r) ** BANDS <= MISSED]
    if not fits:
        raise ValueError(f"{BANDS} bands a side are too few for {percent} percent")
    return max(fits)


def sketches(docs: DataFrame, w: int, rows: int) -> DataFrame:
    """doc_id, txt, n_shingles, cls (the set's id), bands (2 x BANDS hashes)."""

    def sketch(batch):
        values, sizes = shingle_sets(batch.column(1), w)
        mh = minhashes(values, sizes, 2 * BANDS * rows)
        bands = np.zeros((len(sizes), 2 * BANDS), dtype=U)
        for i in range(rows):
            bands = mix(bands + mh[:, i::rows].astype(U) + U(i))
        bands += np.arange(2 * BANDS, dtype=U)  # bands of different places differ
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, 2 * BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
        return [batch.column(0), batch.column(2), sizes, set_ids(values, sizes), lists]

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("txt"))
    return map_batches(keyed, "doc_id long, txt long, n_shingles long, cls binary, bands array<long>", sketch)


def buckets(classes: DataFrame) -> DataFrame:
    """key, cls, n: classes that share a table's key with another one, and how many do."""
    each = classes.select("cls", F.explode(F.transform("bands", lambda b, i: F.struct(b.alias("band"), (i < BANDS).alias("first")))).alias("x")).select("cls", "x.*")
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    kept = each.join(shared, "band").groupBy("cls").agg(F.collect_list(F.when(F.col("first"), F.col("band"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("band"))).alias("b"))
    pairs = kept.select("cls", F.explode("a").alias("a"), "b").select("cls", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "cls")
    pairs = stage(pairs)
    common = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return stage(pairs.join(common, "key"))


def _sized(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def with_sizes(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes n_a and n_b of their sets."""
    one = lambda x: info.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b")


def compared(pairs: DataFrame, texts: DataFrame, w: int, schema: str, judge) -> DataFrame:
    """judge(ids of a, their values, their sizes, id of b, its values) for all pairs (a, b, n_a, n_b);
    b is the leader of many a.

    Members of a leader are dealt into parts, parts into blocks of about BLOCK_SHINGLES; a block has
    the texts of its members and, once each, of its leaders.
    """
    ship(pairs.sparkSession)
    pairs = stage(pairs.select("a", "b", "n_a", (F.col("n_a") + F.col("n_b")).alias("weight")))
    blocks = max(1, -(-(pairs.agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES))
    parts = pairs.groupBy("b").agg(F.ceil(F.sum("n_a") / BLOCK_SHINGLES).alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))), F.lit(blocks)).alias("block"))
    members = dealt.join(texts.select(F.col("cls").alias("a"), "text"), "a").select("block", "a", "b", "text")
    leaders = dealt.select("block", "b").distinct().join(texts.select(F.col("cls").alias("b"), "text"), "b").select(F.col("block").alias("at"), F.col("b").alias("leader"), F.col("text").alias("lead"))
    fields = [f.split(" ") for f in schema.split(", ")]
    out = pa.schema([(n, ARROW[t]) for n, t in fields])

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, found = {}, []
        for batch in right.to_batches(max_chunksize=GROUP):
            values, sizes = shingle_sets(batch.column(batch.schema.get_field_index("lead")), w)
            sets |= zip(batch.column(batch.schema.get_field_index("leader")).to_pylist(), np.split(values, np.cumsum(sizes)[:-1]), strict=True)
        for batch in left.sort_by("b").to_batches(max_chunksize=GROUP):
            a, b, text = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text"))
            values, sizes = shingle_sets(text, w)
            ends, named = np.cumsum(sizes), b.to_pylist()
            cuts = [0, *[i for i in range(1, len(named)) if named[i] != named[i - 1]], len(named)]
            for i, j in zip(cuts, cuts[1:]):
                found += judge(a.slice(i, j - i).to_pylist(), values[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j], named[i], sets[named[i]])
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out) if found else out.empty_table()

    return members.groupBy("block").cogroup(leaders.groupBy("at")).applyInArrow(check, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, w: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def judge(ids, values, sizes, b, lead):
        at = np.minimum(np.searchsorted(lead, values), len(lead) - 1)
        both = _per_text((lead[at] == values).astype(np.int64), sizes, np.add)
        ok = 100 * both >= percent * (sizes + len(lead) - both)
        return [(ids[k], b) for k in np.flatnonzero(ok)]

    fits = pairs.where(_sized(F.col("n_a"), F.col("n_b"), percent))
    return compared(fits, texts, w, "a binary, b binary", judge)


def differences(pairs: DataFrame, texts: DataFrame, w: int) -> DataFrame:
    """a, b, n_a, n_b and diff, the shingles that one of both sets has and the other hasn't."""

    def judge(ids, values, sizes, b, lead):
        own = np.split(values, np.cumsum(sizes)[:-1])
        return [(i, b, len(v), len(lead), np.setxor1d(v, lead, assume_unique=True).view(np.int64)) for i, v in zip(ids, own, strict=True)]

    return compared(pairs, texts, w, "a binary, b binary, n_a long, n_b long, diff array<long>", judge)


def components(edges: DataFrame) -> DataFrame:
    """cls, comp: the least label reachable, one for each component, for all classes with an edge.

    First every a joins its least b.  Its other edges then say which b belong together, and that much
    smaller graph is labelled: each turn takes the least label of the neighbours (and one's own, by an
    edge to oneself); after a few turns labels also jump to their label's label.
    """
    each = edges.select("a", "b").where("a <> b").distinct()
    led = stage(each.withColumn("m", F.min("b").over(Window.partitionBy("a"))))
    heads = stage(led.select(F.col("b").alias("x")).distinct())
    members = stage(led.select("a", "m").distinct())
    own = members.join(heads, members["a"] == heads["x"], "left_semi")
    links = led.where("m <> b").select(F.col("m").alias("x"), F.col("b").alias("y")).union(own.select("a", "m"))
    ways = links.union(links.select("y", "x")).union(heads.select("x", F.col("x").alias("y")))
    both = stage(ways.distinct())
    labels, turn = stage(both.groupBy(F.col("x").alias("cls")).agg(F.min("y").alias("comp"))), 0
    while True:
        met = both.join(labels.select(F.col("cls").alias("y"), "comp"), "y")
        moved = met.groupBy(F.col("x").alias("cls")).agg(F.min("comp").alias("comp"), F.max(F.when(F.col("x") == F.col("y"), F.col("comp"))).alias("old"))
        if turn > 1:
            ahead = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("next"))
            moved = moved.join(ahead, "comp", "left").select("cls", F.least("comp", "next").alias("comp"), "old")
        moved, turn = stage(moved), turn + 1
        labels = moved.select("cls", "comp")
        if not moved.where("comp <> old").limit(1).count():
            break
    rest = members.join(heads, members["a"] == heads["x"], "left_anti")
    return stage(rest.join(labels.withColumnRenamed("cls", "m"), "m").select(F.col("a").alias("cls"), "comp").union(labels))


def can_link(open_: DataFrame, info: DataFrame, texts: DataFrame, w: int, percent: int) -> DataFrame:
    """cls of the open classes less those that can't link: shingles that no other open class has are
    in no intersection, so that a class with too many of them has no partner."""

    def sets(batch):
        values, sizes = shingle_sets(batch.column(1), w)
        return [batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values.view(np.int64)))]

    each = map_batches(texts.join(open_, "cls", "left_semi").select("cls", "text"), "cls binary, h array<long>", sets).select("cls", F.explode("h").alias("h"))
    own = each.groupBy("h").agg(F.min("cls").alias("cls"), F.count("*").alias("n")).where("n = 1").groupBy("cls").agg(F.count("*").alias("own"))
    most = F.col("n_shingles") - F.coalesce("own", F.lit(0))
    return info.join(open_, "cls", "left_semi").join(own, "cls", "left").where(100 * most >= percent * F.col("n_shingles")).select("cls")


def by_differences(pairs: DataFrame, texts: DataFrame, w: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For members a of leaders b (with sizes and a's component): the links of both, and the pairs of
    members of one leader that can link, less those of one component and those that both link to
    the leader.

    With d differences from the leader and a set of n, let h = (100 + p) d - (100 - p) n.  Sets with c
    differences in common link if and only if 2 (100 + p) c >= h + h'; the leader itself has
    h = -(100 - p) n, and c = 0 with everyone.  So c has a lower bound for each member, against
    members that link to the leader (near) and against those that don't (far); a pair's first common
    difference, the rarest first, lies in both members' prefixes that the bounds leave.
    """
    plus, less = 100 + percent, 100 - percent
    found = stage(differences(pairs, texts, w))
    comps = pairs.select("a", "b", "comp").withColumnsRenamed({"a": "x", "b": "y"})
    h = plus * F.size("diff") - less * F.col("n_a")
    sized = found.withColumns({"h": h.cast("long"), "near": h <= less * F.col("n_b")})
    links = sized.where("near").select("a", "b")
    open_ = sized.where("NOT near").select("b").distinct()
    each = sized.join(open_, "b").select("a", "b", F.explode("diff").alias("t"))
    # differences of one member alone are in no common ones
    rare = each.groupBy("b", "t").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(rare, ["b", "t"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
    known = shared.join(sized.select("a", "b", "n_a", "n_b", "h", "near"), ["a", "b"]).join(comps, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
    far_c = F.ceil((F.col("h") + less * F.col("n_b") + 1) / (2 * plus))
    near_c = F.ceil((F.col("h") - less * F.floor(100 * F.col("n_a") / percent)) / plus)
    size = F.size("s").cast("long")
    # a prefix for far partners; one for near partners, which only far members have
    known = known.withColumns({"to_far": size - F.greatest(F.lit(1), far_c) + 1, "to_near": F.when(F.col("near"), F.lit(0)).otherwise(size - F.greatest(F.lit(1), near_c) + 1), "size": size})
    posted = known.select("a", "b", "comp", "h", "near", "size", "to_far", "to_near", F.posexplode(F.expr("slice(s, 1, greatest(to_far, to_near, 0L))")).alias("pos", "x"))
    posted = stage(posted.select("a", "b", "comp", "h", "near", F.col("x.t").alias("t"), (F.col("size") - F.col("pos")).alias("left"), (F.col("pos") < F.col("to_far")).alias("for_far"), (F.col("pos") < F.col("to_near")).alias("for_near")))
    far = posted.where("NOT near").select(*[F.col(c).alias(f"{c}_1") for c in posted.columns])
    other = posted.where("for_far").select(*[F.col(c).alias(f"{c}_2") for c in posted.columns])
    same = (F.col("b_1") == F.col("b_2")) & (F.col("t_1") == F.col("t_2")) & (F.col("comp_1") != F.col("comp_2"))
    prefixes = (F.col("near_2") & F.col("for_near_1")) | (~F.col("near_2") & F.col("for_far_1") & (F.col("a_1") < F.col("a_2")))
    enough = 2 * plus * F.least("left_1", "left_2") >= F.col("h_1") + F.col("h_2")
    met = far.join(other, same & prefixes & enough).select(F.greatest("a_1", "a_2").alias("a"), F.least("a_1", "a_2").alias("b")).distinct()
    return links, met


def link(classes: DataFrame, texts_of, w: int, percent: int) -> DataFrame:
    """cls, comp for all classes that have a link.  classes: cls, doc_id, txt, n_shingles, bands."""
    members = buckets(classes)
    named = members.groupBy("cls").agg(F.sum("n").alias("reach"))
    info = stage(classes.join(named, "cls").select("cls", "doc_id", "txt", "n_shingles", "reach"))
    texts = stage(texts_of(info.select("cls", "doc_id", "txt")))
    labels = None
    for turn in range(ROUNDS + 1):
        if labels is None:
            placed = members.select("key", "cls", F.col("cls").alias("comp"))
        else:
            placed = members.join(labels, "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        placed = stage(placed.join(mixed, "key"))
        if not placed.limit(1).count():
            break
        last = turn == ROUNDS
        if last:
            placed = stage(placed.join(can_link(placed.select("cls").distinct(), info, texts, w, percent), "cls"))
        # the class that meets most others is nearest to all of them
        central = F.struct("reach", F.xxhash64("cls"), F.col("cls").alias("b"), F.col("comp").alias("comp_b"))
        leaders = placed.join(info.select("cls", "reach"), "cls").groupBy("key").agg(F.max(central).alias("x")).select("key", "x.b", "x.comp_b")
        met = placed.join(leaders, "key").where("cls <> b").groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("n"), F.first("comp").alias("comp"), F.first("comp_b").alias("comp_b"))
        if last:
            links, pairs = by_differences(stage(with_sizes(met.select("a", "b", "comp"), info)), texts, w, percent)
            found = stage(links.union(confirmed(with_sizes(pairs, info), texts, w, percent)))
        else:
            nearest = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
            pairs = met.where("comp <> comp_b").withColumn("rank", nearest).where(F.col("rank") <= NEAREST).select("a", "b")
            found = stage(confirmed(with_sizes(pairs, info), texts, w, percent))
        known = found if labels is None else found.union(labels.select(F.col("cls").alias("a"), F.col("comp").alias("b")))
        labels = components(known)
    return classes.select("cls", F.col("cls").alias("comp")).limit(0) if labels is None else labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, txt (xxhash64 of the text), n_shingles, component_id (least doc_id reachable over links),
    component (the component's label; rows with one id may lie in several) and kept, per document.

    A link: two sets of word shingles (texts in lower case, A-Z only; words are runs without blanks;
    a text of fewer words is one shingle) with 100 x common >= percent x all.  Texts without words
    are linked with nothing.  Rows with equal sets are linked; repeated rows stay (a repeated id is
    kept in each row if it is its component's least); null ids take part, and sort after all others;
    an empty table gives an empty one.
    """
    rows = band_rows(percent)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = stage(sketches(texts, shingle, rows))
    some = drawn.where("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt")
    classes = stage(some.groupBy("cls").agg(F.min_by(F.struct("doc_id", "txt", "n_shingles", "bands"), first).alias("x")).select("cls", "x.*"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """cls, text of the wanted classes (cls, doc_id, txt); an id may have several texts, of which
        some may (but hardly will) share a hash."""
        own = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        found = texts.join(own, texts["doc_id"].eqNullSafe(own["doc_id"]) & (F.xxhash64("text") == own["txt"])).select("cls", "text")

        def same(batch):
            ids = set_ids(*shingle_sets(batch.column(1), shingle))
            ok = pa.array([a == b for a, b in zip(batch.column(0).to_pylist(), ids, strict=True)])
            return [batch.column(0).filter(ok), batch.column(1).filter(ok)]

        return map_batches(found, "cls binary, text string", same).dropDuplicates(["cls"])

    labels = link(classes, texts_of, shingle, percent)
    placed = classes.select("cls", "doc_id").join(labels, "cls", "left").select("cls", "doc_id", F.coalesce("comp", "cls").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "comp").select("cls", "comp", "component_id")
    out = drawn.select("doc_id", "txt", "n_shingles", "cls").join(named, "cls", "left")
    out = out.select("doc_id", "txt", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("comp")).alias("component"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
