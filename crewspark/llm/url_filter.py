"""URL filters: rules first, then the ratio of two character language models.

Each model is a smoothed variable-order Markov model over URL characters: counts of all contexts of
0 to 5 characters, interpolated by Witten-Bell from the shortest context up.  One model is counted on
URLs that the rules accept, one on those that they reject.  A URL's score is log P(rejected) -
log P(accepted) a character; the threshold is set on held-out URLs of both classes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.llm.common import ascii_lower, map_batches, pick, stage
from crewspark.shipping import ship

#: Characters (bytes) of the longest context; with the next one they pack into 64 bits.
ORDER = 5
#: URLs of one block, on average.
BLOCK_URLS = 65_536
#: Base of the interpolation: a uniform distribution over the bytes.
ALPHABET = 256
#: The rules of the query (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Contexts of up to so many characters have tables of at most 256^2 rows, which are broadcast.
SMALL_ORDER = 1


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], part: int) -> Column:
    """The rule ("hostpath", part 0) or verdict (part 1) of the longest rule that fits; else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(verdict if part else h + p)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def grams_of(urls: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each URL, and its end, packed with the ``order`` bytes before it; and the number
    of them in each URL."""
    raw = [b"\x02" * order + u.encode() + b"\x03" for u in urls]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(r) - order for r in raw], dtype=np.int64)
    if not len(data):
        return data, sizes
    g = data[order:].copy()
    for back in range(1, order + 1):
        g |= data[order - back : len(data) - back] << (8 * back)
    own = np.ones(len(data), dtype=bool)
    starts = np.cumsum(sizes + order) - sizes - order
    for k in range(order):
        own[starts + k] = False
    return g[own[order:]], sizes


def gram_counts(training: DataFrame) -> DataFrame:
    """gram, c0, c1: counts of the longest grams in accepted and rejected URLs (url, label)."""

    def count(batch):
        labels = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
        grams, sizes = grams_of(batch.column(0).to_pylist())
        keys, at = np.unique(grams, return_inverse=True)
        rejected = np.repeat(labels == 1, sizes)
        return [keys, *[np.bincount(at, weights=x, minlength=len(keys)).astype(np.int64) for x in (~rejected, rejected)]]

    each = map_batches(training.select("url", "label"), "gram long, c0 long, c1 long", count, text=0)
    return each.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def markov_ratios(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio (log P(rejected) - log P(accepted)) of the wanted grams.

    From the shortest context up: p = (count + kinds x shorter p) / (total + kinds) where the context
    was seen, and the shorter p elsewhere.
    """
    probability = None
    for k in range(order + 1):
        part = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        level = stage(counts.groupBy(part.alias("gram")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
        context = F.shiftright("gram", 8)
        seen = [x for i in (0, 1) for x in (F.sum(f"c{i}").alias(f"n{i}"), F.count(F.when(F.col(f"c{i}") > 0, 1)).alias(f"kinds{i}"))]
        contexts = level.groupBy(context.alias("context")).agg(*seen)
        if k <= SMALL_ORDER:
            level, contexts = F.broadcast(level), F.broadcast(contexts)
        own = wanted.select(part.alias("gram")).distinct() if k < order else wanted.select("gram")
        joined = own.withColumn("context", context).join(contexts, "context", "left").join(level, "gram", "left")
        if k:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
            lower = probability.withColumnsRenamed({"gram": "short", "p0": "q0", "p1": "q1"})
            joined = joined.withColumn("short", shorter).join(F.broadcast(lower) if k - 1 <= SMALL_ORDER else lower, "short")
        else:
            joined = joined.withColumns({"q0": F.lit(1.0 / ALPHABET), "q1": F.lit(1.0 / ALPHABET)})
        p = [F.when(F.col(f"n{i}") > 0, (F.coalesce(f"c{i}", F.lit(0)) + F.col(f"kinds{i}") * F.col(f"q{i}")) / (F.col(f"n{i}") + F.col(f"kinds{i}"))).otherwise(F.col(f"q{i}")).alias(f"p{i}") for i in (0, 1)]
        probability = joined.select("gram", *p)
    return probability.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def url_scores(urls: DataFrame, counts: DataFrame, blocks: int) -> DataFrame:
    """u0, u1, score of the URLs (url, u0, u1): dealt into blocks, whose distinct grams meet the
    counts in joins."""
    ship(urls.sparkSession)

    def distinct(table: pa.Table) -> pa.Table:
        keys = np.unique(grams_of(table.column("url").to_pylist())[0])
        return pa.table({"part": pa.array(np.full(len(keys), table.column("block")[0].as_py(), dtype=np.int64)), "gram": pa.array(keys)})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, sizes = grams_of(left.column("url").to_pylist())
        keys, ratios = right.column("gram").to_numpy(), right.column("ratio").to_numpy()
        order = np.argsort(keys)
        at = np.searchsorted(keys[order], grams)
        sums = np.add.reduceat(ratios[order][at], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
        return pa.table({"u0": left.column("u0"), "u1": left.column("u1"), "score": pa.array(sums / sizes)})

    dealt = urls.select(F.pmod("u0", F.lit(blocks)).alias("block"), "url", "u0", "u1").repartition(blocks, "block")
    grams = dealt.groupBy("block").applyInArrow(distinct, "part long, gram long")
    ratios = markov_ratios(counts, grams.select("gram").distinct())
    return dealt.groupBy("block").cogroup(grams.join(ratios, "gram").groupBy("part")).applyInArrow(score, "u0 long, u1 int, score double")


def threshold_of(held: DataFrame) -> float:
    """The score above which URLs are blocked: that of the least sum of both classes' error rates on
    held-out URLs (score, label), in steps of half a percent of either, in the middle between the
    scores that it lies between; infinite without both classes."""
    steps = [i / 200 for i in range(201)]
    got = {r[0]: r[1] for r in held.groupBy("label").agg(F.percentile_approx("score", steps, 10_000)).collect()}
    if not got.get(0) or not got.get(1):
        return float("inf")
    accepted, rejected = np.array(got[0]), np.array(got[1])
    each = np.unique(np.r_[accepted, rejected])
    errors = (accepted[None] > each[:, None]).mean(axis=1) + (rejected[None] <= each[:, None]).mean(axis=1)
    best = np.flatnonzero(errors == errors.min())[-1]  # of equals that which blocks least
    return float(each[best : best + 2].mean())


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every page.

    The models learn from the URLs that a rule allows or blocks, each different URL once; the others
    get the verdict that follows from what those look like.  Four fifths train, one fifth (by the CRC
    of the URL) sets the threshold.  Without URLs of both kinds all others are allowed.

    A null URL has an empty host and path, no rule, and is scored as an empty text; repeated rows
    give repeated rows; URLs of any length are scored whole; other columns are not read; an empty
    table gives an empty one.
    """
    rows = pick(pages, "page_id", "url").withColumn("url", F.coalesce("url", F.lit("")))
    rows = rows.select(F.col("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    verdict = rule_of(F.col("host"), F.col("path"), rules, 1)
    label = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    urls = stage(rows.select("url", "host", "path").distinct().select(ascii_lower(F.col("url")).alias("url"), F.xxhash64("url").alias("u0"), F.hash("url").alias("u1"), label.alias("label"), (F.crc32("url") % 5 == 0).alias("held_out")))
    training = urls.where(F.col("label").isNotNull() & ~F.col("held_out")).select("url", "label")
    blocks = max(1, -(-urls.count() // BLOCK_URLS))
    scored = stage(url_scores(urls, stage(gram_counts(training)), blocks))
    threshold = threshold_of(scored.join(urls.where(F.col("label").isNotNull() & F.col("held_out")).select("u0", "u1", "label"), ["u0", "u1"]))
    keyed = rows.withColumns({"u0": F.xxhash64("url"), "u1": F.hash("url")}).join(scored, ["u0", "u1"], "left")
    return keyed.select(
        "page_id",
        "host",
        "path",
        rule_of(F.col("host"), F.col("path"), rules, 0).alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
        F.lit(threshold).alias("threshold"),
    )
