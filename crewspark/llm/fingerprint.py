"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct shingle hashes.  Sketches of parts merge
into the sketch of the whole; two sketches estimate resemblance and containment; one estimates the
number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.llm.common import pick

K = 128
SHINGLE = 5
BLANKS = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column.  Words are runs without blanks, unchanged; a shingle is
    five words, or all of a shorter text.  Null and empty texts have an empty sketch.
    """
    w, h, n = f"__{out}_words", f"__{out}_hashes", F.size(F.col(f"__{out}_hashes"))
    own = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    df = df.withColumn(w, F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, f"[{BLANKS}]+")))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    runs = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(shingle)]))
    shingles = F.when(n >= shingle, runs).when(n > 0, F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.array_distinct(F.sort_array(shingles)), 1, k)).drop(h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """Sketch of each group of parts.  Hashes are made distinct per group before they are ranked,
    in as many tasks as there are hash ranges, so that a group with very many parts is no task's load.
    """
    each = df.select(*keys, F.explode(sketch).alias("__h")).distinct()
    salted = each.withColumn("__salt", F.pmod(F.xxhash64("__h"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("__h"))
    least = salted.withColumn("__r", rank).where(F.col("__r") <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("__h")), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all; 1 for two empty sketches."""
    u = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) / the k-th hash's place in (0, 1)."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    j = resemblance(a, b, k)
    common = j * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(df: DataFrame, key: str, carried: list[str], tie: str) -> DataFrame:
    """df with next_<c> of the row that follows in descending order of key (after the last: the
    first).  Rows are dealt by ranges of the key, so that no task holds them all; a range's last row
    gets the first of the range below.
    """
    spark = df.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(key, shares, 100 * ranges), F.max(key)).first()
    bounds = sorted({b for b in found[0] or [] if b != found[1]})  # each is a key: no range is empty
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[step - 1 :: step]]) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    below = F.size(F.filter(coarse, lambda b: b < F.col(key))) * step
    more = F.size(F.filter(F.slice(fine, F.col("__below") + 1, F.lit(step)), lambda b: b < F.col(key)))
    dealt = df.withColumn("__below", below).withColumn("__range", F.col("__below") + more).drop("__below")
    order = Window.partitionBy("__range").orderBy(F.col(key).desc(), F.col(tie).desc())
    placed = dealt.withColumn("__row", F.row_number().over(order))
    ahead = placed.select("*", *[F.lead(c).over(order).alias(f"__lead_{c}") for c in carried], F.lead(F.lit(True)).over(order).alias("__inner"))
    heads = placed.where(F.col("__row") == 1).select(
        F.pmod(F.col("__range") + 1, F.lit(len(bounds) + 1)).alias("__range"), *[F.col(c).alias(f"__head_{c}") for c in carried]
    )
    out = ahead.join(heads, "__range", "left")
    return out.select(*df.columns, *[F.when(F.col("__inner"), F.col(f"__lead_{c}")).otherwise(F.col(f"__head_{c}")).alias(f"next_{c}") for c in carried])


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited form, and likeness to that and to the next text.

    Null texts are empty; null ids come last in the order; rows with one id are ordered by text;
    repeated rows give repeated rows; an empty table gives an empty one.
    """
    lowest = F.lit(-(2**63)).cast("long")
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_sketch(own.withColumn("key", F.coalesce("doc_id", lowest)), "text", "sketch", k)
    paired = with_next(own, "key", ["text", "sketch"], "text").withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), (F.col("n_chars") - third).cast("int")), F.left(F.col("next_text"), third))
    both = with_sketch(paired.withColumn("edited", edited), "edited", "edited_sketch", k)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
