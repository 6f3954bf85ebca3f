"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The unit is the character (UTF-16 unit), the order 4: a gram packs into 64 bits, is counted exactly,
and its suffix and context are shifts.  Each language has a model.  Counts are joined by gram in
shards (shuffle partitions): documents are dealt into blocks of bounded size, each block's distinct grams meet the
counts of every order in joins, and the resulting probabilities go back to the block, where they are
summed over its texts.  Neither counts nor probabilities pass the driver or are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.llm.common import pick, slices, stage
from crewspark.shipping import map_in_arrow, ship

ORDER = 4
PAD = "\x02" * (ORDER - 1)
#: Characters of the texts of one block, on average (a longer text is a block's part by itself).
BLOCK_CHARS = 40_000_000
#: Trusted documents with 0 as this remainder set the thresholds; the others train.
HELD_OUT = 5
#: Characters of average text that every document is taken to have besides its own.
PRIOR_CHARS = 60
#: Rows of trusted ids up to which they are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Languages up to which what is known of each is broadcast (some 50 bytes each).
BROADCAST_LANGUAGES = 100_000


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed grams that end at each unit of each text, and the texts' starts and lengths."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    pad = PAD.encode("utf-16-le")
    units = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), dtype="<u2").astype(np.uint64)
    sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), sizes
    g = units[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        g |= units[ORDER - 1 - back : len(units) - back] << np.uint64(16 * back)
    ends = np.cumsum(sizes + ORDER - 1)
    own = np.ones(len(units), dtype=bool)
    for back in range(ORDER - 1):
        own[ends - sizes - 1 - back] = False
    return g[own[ORDER - 1 :]].view(np.int64), np.cumsum(sizes) - sizes, sizes


def _merge(held: dict[str, list], lang: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Adds counts; held has sorted keys and their counts for each language, and what waits."""
    parts = held.setdefault(lang, [])
    parts.append((keys, counts))
    if len(parts) > 8:
        held[lang] = [_summed(parts)]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def _by_lang(ids, langs, texts):
    out: dict[str, tuple[list, list]] = {}
    for i, lang, t in zip(ids, langs, texts, strict=True):
        own = out.setdefault(lang, ([], []))
        own[0].append(i)
        own[1].append(t)
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, c: counts over all texts of docs (doc_id, lang, text)."""
    out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])

    def count(batches):
        held: dict[str, list] = {}
        for whole in batches:
            for batch in slices(whole, 2):
                for lang, (_, texts) in _by_lang(*(c.to_pylist() for c in batch.columns)).items():
                    keys, n = np.unique(grams_of(texts)[0], return_counts=True)
                    _merge(held, lang, keys, n)
        for lang, parts in held.items():
            keys, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], schema=out)

    return map_in_arrow(docs, count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def suffix(k: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < 4 else F.col("gram")


def by_language(df: DataFrame) -> DataFrame:
    """A table with a row for each language, broadcast if it is as small as it should be: a join by
    shuffle would send all rows of one language to one task."""
    df = stage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_LANGUAGES else df


def kneser_ney(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, gram, logp for the wanted grams (lang, gram), from counts of the highest order.

    Lower orders count the different grams that a gram ends (continuations); each order has three
    discounts from its counts of counts; the shortest order rests on a uniform distribution.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", suffix(k).alias("gram")).agg(F.count("*").alias("c"))
    probability = None
    for k in range(1, ORDER + 1):
        level = levels[k] if k == ORDER else stage(levels[k])
        n = [F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]
        discounts = level.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)], F.count("*").alias("kinds"))
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        d = [F.greatest(F.lit(0.05), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.75 * i)))) for i in (1, 2, 3)]
        discounts = by_language(discounts.select("lang", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)], "kinds"))
        context = F.shiftrightunsigned("gram", 16)
        contexts = level.groupBy("lang", context.alias("context")).agg(
            F.sum("c").alias("total"), *[F.count(F.when(F.least(F.col("c"), F.lit(3)) == i, 1)).alias(f"t{i}") for i in (1, 2, 3)]
        )
        own = wanted.select("lang", suffix(k).alias("gram"))
        own = own if k == ORDER else own.distinct()
        own = own.withColumn("context", context).withColumn("gram_", suffix(k - 1) if k > 1 else F.lit(0))
        joined = own.join(level, ["lang", "gram"], "left").join(contexts, ["lang", "context"], "left").join(discounts, "lang", "left")
        if probability is not None:
            joined = joined.join(probability.withColumnsRenamed({"gram": "gram_", "p": "lower"}), ["lang", "gram_"], "left")
        lower = F.col("lower") if k > 1 else 1.0 / (F.coalesce("kinds", F.lit(0)) + 1)
        c = F.coalesce("c", F.lit(0))
        off = F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        left = (F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")) / F.col("total")
        p = F.when(F.col("total").isNull(), lower).otherwise((c - off) / F.col("total") + left * lower)
        probability = joined.select("lang", "gram", p.alias("p"))
    return probability.select("lang", "gram", F.log("p").alias("logp"))


def document_scores(docs: DataFrame, counts: DataFrame, blocks: int) -> DataFrame:
    """doc_id, lang, units, nll (summed) of every document."""
    import zstandard

    zipped = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("z", pa.binary())])

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in slices(whole, 3):
                block, ids, langs, texts = batch.columns
                yield pa.RecordBatch.from_arrays([block, ids, langs, pa.array([z.compress(t.encode()) for t in texts.to_pylist()], pa.binary())], schema=zipped)

    def texts_of(table: pa.Table):
        z = zstandard.ZstdDecompressor()
        for batch in table.to_batches(max_chunksize=500):
            ids, langs, raw = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "z"))
            yield from _by_lang(ids, langs, (z.decompress(r).decode() for r in raw)).items()

    def distinct(table: pa.Table) -> pa.Table:
        block, held = table.column("block")[0].as_py(), {}
        for lang, (_, texts) in texts_of(table):
            keys = np.unique(grams_of(texts)[0])
            _merge(held, lang, keys, np.ones(len(keys), np.int64))
        each = [(lang, _summed(parts)[0]) for lang, parts in held.items()]
        return pa.table(
            {
                "block": pa.array(np.full(sum(len(k) for _, k in each), block)),
                "lang": pa.array([x for lang, k in each for x in [lang] * len(k)], pa.string()),
                "gram": pa.array(np.concatenate([k for _, k in each])),
            }
        )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        model, rows = {}, []
        names, grams, logs = right.column("lang").combine_chunks(), right.column("gram").to_numpy(), right.column("logp").to_numpy()
        coded = names.dictionary_encode() if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            own = codes == i
            order = np.argsort(grams[own])
            model[lang] = grams[own][order], logs[own][order]
        for lang, (ids, texts) in texts_of(left):
            g, starts, sizes = grams_of(texts)
            if len(g):
                keys, values = model[lang]
                at = np.searchsorted(keys, g)
                if at.max() >= len(keys) or (keys[at] != g).any():
                    raise ValueError("a block lacks grams of its texts")
                sums = np.r_[0.0, np.cumsum(-values[at])]
                nll = sums[starts + sizes] - sums[starts]
            else:
                nll = np.zeros(len(texts))
            rows += [(i, lang, n, x) for i, n, x in zip(ids, sizes.tolist(), nll.tolist(), strict=True)]
        ids, langs, sizes, nll = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "units": pa.array(sizes, pa.int64()), "nll": pa.array(nll, pa.float64())})

    ship(docs.sparkSession)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    packed = map_in_arrow(docs.select(block.alias("block"), "doc_id", "lang", "text"), pack, "block long, doc_id long, lang string, z binary").repartition(blocks, "block")
    grams = packed.groupBy("block").applyInArrow(distinct, "block long, lang string, gram long")
    logs = kneser_ney(counts, grams.select("lang", "gram").distinct())
    own = grams.join(logs, ["lang", "gram"]).select("block", "lang", "gram", "logp")
    return packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, "doc_id long, lang string, units long, nll double")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995) -> DataFrame:
    """doc_id, lang, units, perplexity (per unit), threshold and keep of every document.

    trusted: doc_id of trusted documents (every row is used).  Four fifths of them train; the rest
    give, for each language, the quantile of perplexity up to which a document is kept.  A text's
    perplexity is drawn towards its language's mean by PRIOR_CHARS units, so that short texts are
    judged with caution.  Texts without characters (null or empty) are rejected; a language without
    trusted text has no thresholds and its documents are kept.  A null language is "".  Rows with one
    doc_id are judged each; an empty table gives an empty one.
    """
    rows = pick(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    good = pick(trusted, "doc_id").select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    good = good.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0)
    small = good.count() <= BROADCAST_IDS
    training = good.where(~F.col("held_out")).select("doc_id")
    counts = stage(gram_counts(rows.join(F.broadcast(training) if small else training, "doc_id", "left_semi")))
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    scores = stage(document_scores(rows, counts, blocks))
    held = scores.where("units > 0").join(good.where("held_out").select("doc_id"), "doc_id", "left_semi")
    means = by_language(held.groupBy("lang").agg((F.sum("nll") / F.sum("units")).alias("mean")))
    drawn = F.exp((F.col("nll") + PRIOR_CHARS * F.col("mean")) / (F.col("units") + PRIOR_CHARS))
    quantiles = by_language(held.join(means, "lang").groupBy("lang").agg(F.percentile_approx(drawn, quantile, 10_000).alias("threshold"), F.first("mean").alias("mean")))
    judged = scores.join(quantiles, "lang", "left").withColumn("perplexity", F.coalesce(drawn, F.exp(F.col("nll") / F.greatest("units", F.lit(1)))))
    return judged.select(
        "doc_id",
        "lang",
        "units",
        "perplexity",
        "threshold",
        ((F.col("units") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("keep"),
    )
