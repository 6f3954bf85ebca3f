"""Product names: what identifies them, which of them are one product, and groups of those.

Two names are one product by a shared code, by one key within the other, or by words that align.  Pairs
are found by what they must have in common, never by holding all names against each other:

* a work code, a variant code or a product code of both;
* a key (12 letters or more) that the other's key begins with: a name looks up the beginnings of its key
  whose lengths occur;
* words: the words of one name all align with words of the other, so that its two rarest words (by the first
  five letters, on which words align) are also in the other name.

Keys and words only tell where one of the names has no code; names that both have some need a common one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.operators.clusters import connected
from crewspark.storage import rewritten

#: Words that tell no product apart, words that a key leaves out, and names of types.
STOP = (
    "vinyl", "pvc", "banen", "natural", "coating", "linoleum", "tapijt", "tapijttegels", "lvt", "ral", "met", "vlok", "cm", "mm",
    "the", "and", "voor", "van", "op",
)
NOT_IN_KEY = r"\b(banen|vinyl|pvc|tapijttegels?|coating|lvt)\b"
GENERIC_TYPE = r"^(tapijttegels?|tapijt|coating|linoleum|vinyl|pvc|lvt|plinten?|gietvloer|entreemat)(\s|\(|$)"
#: Least letters of a word, of a word that may be cut, and of a key that may be cut; words that prove a product.
WORD, CUT_WORD, CUT_KEY, STRONG, FULL = 4, 5, 12, 3, 5


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def name_key(name: Column) -> Column:
    """A name's letters and digits in lower case, less words that don't tell products apart."""
    flat = F.lower(F.trim(name))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, NOT_IN_KEY, " "), r"[^a-z0-9]+", " "))


def facts(name: Column) -> Column:
    """struct<name, work, codes, variants, kind, method, ral, series, key, tokens> of a product's name.

    work: codes of works, 43.20.02a; codes: those, article numbers and codes like f2.10.60; variants: v.05;
    kind: of cast floors and coatings; method, ral, series: how it is carried out; key: the name's letters
    and digits; tokens: its codes and the words that tell it apart.
    """
    flat = F.lower(F.trim(name))
    no_ral = F.regexp_replace(flat, r"\bral\s*\d{3,5}\b", " ")
    codes = F.array_distinct(F.concat(
        _all(flat, r"\b(?:rf\s*)?(\d{6,})\b"), _all(flat, r"\b([a-z]\d\.\d{2}\.\d{2})\b"), _all(flat, r"\b(\d{2,}\.\d{2}\.\d{2}[a-z]?)\b"), _all(no_ral, r"\b(\d{4,5})\b")
    ))
    words = F.filter(F.split(F.regexp_replace(flat, r"[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= WORD) & ~w.isin(*STOP))
    found = lambda pattern, i=1: F.nullif(F.regexp_extract(flat, pattern, i), F.lit(""))
    series = r"\bs\s*(\d{3,5})\s*-?\s*([a-z])?\b"
    return F.struct(
        name.alias("name"),
        F.array_distinct(_all(flat, r"\b(\d{2}\.\d{2}\.\d{2}[a-z]?)\b")).alias("work"),
        codes.alias("codes"),
        F.array_distinct(_all(flat, r"\bv\.(\d{2})\b")).alias("variants"),
        F.when(flat.contains("gietvloer") & flat.contains("vloercoating"), "mixed").when(flat.contains("gietvloer"), "gietvloer").when(flat.contains("coating"), "coating").alias("kind"),
        found(r"\((sp|hp)\)").alias("method"),
        found(r"\bral\s*(\d{3,5})\b").alias("ral"),
        F.when(flat.rlike(series), F.concat(F.lit("s"), F.regexp_extract(flat, series, 1), F.regexp_extract(flat, series, 2))).alias("series"),
        name_key(name).alias("key"),
        F.array_distinct(F.concat(codes, words)).alias("tokens"),
    )


def aligned(a: Column, b: Column) -> Column:
    """Whether two words are one, or one of five letters or more begins the other."""
    return (a == b) | ((F.length(a) >= CUT_WORD) & b.startswith(a)) | ((F.length(b) >= CUT_WORD) & a.startswith(b))


def _within(needles: Column, words: Column) -> Column:
    return F.forall(needles, lambda x: F.exists(words, lambda y: aligned(x, y)))


def _adds_nothing(a: Column, b: Column) -> Column:
    """The name with more words has none that doesn't align."""
    fewer = F.size(a["tokens"]) <= F.size(b["tokens"])
    return F.when(fewer, _within(b["tokens"], a["tokens"])).otherwise(_within(a["tokens"], b["tokens"]))


def _share(a: Column, b: Column, field: str) -> Column:
    return F.arrays_overlap(a[field], b[field])


def same_kind(a: Column, b: Column) -> Column:
    return a["kind"].isNull() | b["kind"].isNull() | (a["kind"] == b["kind"])


def same_execution(a: Column, b: Column) -> Column:
    """Whether two names (facts) don't differ in how a product is carried out."""
    fits = lambda f: F.coalesce(a[f] == b[f], F.lit(True))
    marks = fits("method") & fits("ral") & fits("series") & (a["ral"].isNull() == b["ral"].isNull())
    full = (F.size(a["tokens"]) >= FULL) & (F.size(b["tokens"]) >= FULL)
    return same_kind(a, b) & F.when(_share(a, b, "work"), marks).when(_share(a, b, "variants"), True).when(full, _adds_nothing(a, b)).otherwise(True)


def strong_words(a: Column, b: Column) -> Column:
    """Whether words prove one product: three that align and none left on both sides, or all of the
    shorter name's, two at least, if the longer adds none."""
    shared = F.size(F.filter(a["tokens"], lambda x: F.exists(b["tokens"], lambda y: aligned(x, y))))
    left_over = ~_within(a["tokens"], b["tokens"]) & ~_within(b["tokens"], a["tokens"])
    fewer = F.size(a["tokens"]) <= F.size(b["tokens"])
    shorter_in = F.when(fewer, _within(a["tokens"], b["tokens"])).otherwise(_within(b["tokens"], a["tokens"]))
    two = F.least(F.size(a["tokens"]), F.size(b["tokens"])) >= 2
    return F.when(shared >= STRONG, ~left_over & same_execution(a, b)).otherwise(two & shorter_in & _adds_nothing(a, b))


def same_key(a: Column, b: Column) -> Column:
    """Equal keys, or a long one that begins the other and says enough."""
    fewer = F.length(a["key"]) <= F.length(b["key"])
    begins = F.when(fewer, b["key"].startswith(a["key"])).otherwise(a["key"].startswith(b["key"]))
    words = F.when(fewer, F.size(a["tokens"])).otherwise(F.size(b["tokens"]))
    cut = (F.least(F.length(a["key"]), F.length(b["key"])) >= CUT_KEY) & begins & ((words >= STRONG) | _adds_nothing(a, b))
    return (a["key"] != "") & (b["key"] != "") & ((a["key"] == b["key"]) | cut)


def same_product(a: Column, b: Column) -> Column:
    """Whether two names (facts) are one product: works by code, execution and article; others by variant
    code, by article code, by key or by words.  A code that both have but don't share tells them apart."""
    own = lambda x: F.array_except(x["codes"], x["work"])
    has = lambda c: F.size(c) > 0
    keys = (a["key"] != "") & (b["key"] != "")
    by_name = keys & (same_key(a, b) | strong_words(a, b))
    article = F.when(has(own(a)) & has(own(b)), F.arrays_overlap(own(a), own(b))).otherwise(by_name)
    rest = F.when(_share(a, b, "variants"), True).when(_share(a, b, "codes"), same_execution(a, b)).when(has(a["codes"]) & has(b["codes"]), False).otherwise(by_name)
    works = has(a["work"]) & has(b["work"])
    named = (F.trim(a["name"]) != "") & (F.trim(b["name"]) != "")
    return F.coalesce(named & same_kind(a, b) & F.when(works, _share(a, b, "work") & same_execution(a, b) & article).otherwise(rest), F.lit(False))


def candidates(names: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids that can be one product.  names: id, f (facts)."""
    codes = names.select("id", F.explode(F.array_distinct(F.concat(
        F.transform("f.codes", lambda c: F.concat(F.lit("c"), c)), F.transform("f.variants", lambda c: F.concat(F.lit("v"), c))
    ))).alias("k"))
    by_code = codes.join(codes.withColumnRenamed("id", "other"), "k").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    # a code that both have but don't share tells them apart, so that keys and words only count where a name has no code
    coded = F.size("f.codes") > 0
    keys = names.select("id", F.col("f.key").alias("key"), coded.alias("coded")).where("key <> ''")
    lengths = F.broadcast(keys.where(F.length("key") >= CUT_KEY).groupBy().agg(F.array_distinct(F.collect_set(F.length("key"))).alias("lengths")))
    cut = keys.join(lengths).select("id", F.explode(F.transform(F.filter("lengths", lambda n: n < F.length("key")), lambda n: F.left("key", n))).alias("key"), "coded")
    whole = keys.select(F.col("id").alias("other"), "key", F.col("coded").alias("other_coded"))
    by_key = keys.unionByName(cut).join(whole, "key").where("id <> other AND NOT (coded AND other_coded)").select("id", "other")
    stem = F.array_sort(F.array_distinct(F.transform("f.tokens", lambda t: F.left(t, F.lit(CUT_WORD)))))
    worded = names.select("id", stem.alias("stems"), F.when(coded, F.array(F.lit("*"))).otherwise(F.array(F.lit("*"), F.lit("bare"))).alias("among"), F.when(coded, "bare").otherwise("*").alias("with"))
    stems = worded.select("id", "with", F.explode("stems").alias("stem"))
    counted = stems.join(stems.groupBy("stem").agg(F.count("*").alias("n")), "stem")
    rare = counted.groupBy("id", "with").agg(F.array_sort(F.collect_list(F.struct("n", "stem"))).alias("x"))
    rare = rare.select("id", F.col("with").alias("among"), F.array_join(F.array_sort(F.slice("x.stem", 1, 2)), " ").alias("k"))
    pairs = F.flatten(F.transform("stems", lambda s, i: F.transform(F.slice("stems", i + 1, F.size("stems")), lambda t: F.when(s == t, s).otherwise(F.concat(s, F.lit(" "), t)))))
    keyed = worded.select(F.col("id").alias("other"), "among", F.explode(pairs).alias("k")).select("other", F.explode("among").alias("among"), "k")
    by_word = rare.join(keyed, ["among", "k"]).where("id <> other").select("id", "other")
    ordered = by_key.union(by_word).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return by_code.union(ordered).distinct()


def identical(names: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids whose names are one product.  names: id, name; ids are unique."""
    known = rewritten(names.select("id", facts(F.col("name")).alias("f")))
    side = lambda x: known.select(F.col("id").alias(x), F.col("f").alias(f"f_{x}"))
    pairs = candidates(known).join(side("a"), "a").join(side("b"), "b")
    return pairs.where(same_product(F.col("f_a"), F.col("f_b"))).select("a", "b")


def more_canonical(f: Column) -> Column:
    """Names in this order (greatest first): more marks of execution, with codes, longer."""
    marks = sum((F.col("f")[m].isNotNull().cast("int") for m in ("method", "ral", "series")), (F.size(F.col("f")["work"]) > 0).cast("int"))
    return F.struct(marks.alias("marks"), (F.size(f["codes"]) > 0).alias("coded"), F.length(F.trim(f["name"])).alias("length"))


def declared_groups(works: DataFrame) -> DataFrame:
    """One work for all names that are one product, also over others: group (least id), name (the most
    canonical), total (the first above nothing, in order of id), names and rows.

    works: id, name, total.  Names are told apart once, so that rows of one name cost one row of it.
    """
    named = works.where(F.coalesce(F.trim("name"), F.lit("")) != "")
    distinct = rewritten(named.groupBy("name").agg(F.min("id").alias("id")))
    labels = connected(identical(distinct))
    placed = distinct.join(labels.withColumnRenamed("vertex", "id"), "id", "left").select("name", F.coalesce("component", "id").alias("group"))
    best = placed.withColumn("f", facts(F.col("name"))).groupBy("group").agg(F.max(F.struct(more_canonical(F.col("f")).alias("rank"), "name")).alias("x"), F.count("*").alias("names"))
    given = F.when(F.col("total") > 0, F.col("id"))
    sums = named.join(placed, "name").groupBy("group").agg(F.min_by("total", given).alias("total"), F.count("*").alias("rows"))
    return best.join(sums, "group").select("group", F.col("x.name").alias("name"), "total", "names", "rows")
