"""Identity of product names against stated cases and all pairs; components; groups."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from crewspark.operators import clusters, products

SAME = [
    ("43.20.02a Tarkett iQ Granit 0508", "43.20.02a Tarkett iQ Granit, vinyl 0508 grijs"),  # work and article
    ("43.20.02 Forbo Coral Brush", "43.20.02 Forbo Coral Brush 5721"),  # work; the longer key goes on
    ("v.05 Linoleum blauw", "Marmoleum v.05"),  # variant code
    ("Desso Essence 9021", "Tapijttegels Desso Essence 9021"),  # article, four digits
    ("rf 7133080 Ege Highline", "Ege 7133080"),
    ("Sikkens F2.10.60", "f2.10.60 gietvloer Sikkens"),
    ("Tarkett Granit Sahara", "TARKETT granit  sahara"),  # keys
    ("Forbo Marmoleum Walton", "Forbo Marmoleum Walton uni"),  # a key of three words begins the other
    ("Interface Heuga Zwart", "Heuga Interface Zwart"),  # three words align
    ("Interf Heugatile", "Heugatile Interface"),  # two words, cut after five letters
]
OTHER = [
    ("43.20.02a Coral", "43.20.02b Coral"),
    ("43.20.03a coating ral 9010 (sp)", "43.20.03a coating ral 9010 (hp)"),
    ("43.20.03a coating ral 9010", "43.20.03a coating"),
    ("43.20.02 Coral Brush 5721", "43.20.02 Tarkett iQ 0508"),  # one work, two articles
    ("gietvloer PU Sikkens", "coating PU Sikkens"),  # kinds
    ("Desso Essence 9021", "Desso Essence 9022"),  # codes that differ
    ("Interface Heuga", "Interface Heuga Zwart"),  # the longer one adds a word, and two are too few
    ("Interface", "Interface tegel"),
    ("tapijt", "vinyl"),
    ("", "Coral Brush"),
    ("Forbo Marmoleum Walton rood", "Forbo Marmoleum Walton blauw"),  # words left on both sides
]


@pytest.mark.parametrize("turned", [False, True])
def test_same_product(spark, turned):
    rows = [(*(reversed(p) if turned else p), want) for pairs, want in ((SAME, True), (OTHER, False)) for p in pairs]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("a", "b", "want", products.same_product(products.facts(F.col("a")), products.facts(F.col("b"))).alias("got"))
    assert [r for r in got.collect() if r.got != r.want] == []


def test_null_names_are_no_product(spark):
    df = spark.createDataFrame([(None, "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(products.same_product(products.facts(F.col("a")), products.facts(F.col("b")))).collect()] == [False, False]


def test_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    words = ["tarkett", "granit", "iq", "sahara", "forbo", "coral", "brush", "walton", "marmoleum", "marmo", "zwart", "blauw", "heuga", "heugatile", "desso", "uni", "vinyl", "gietvloer", "coating"]
    tails = ["", "", "", " 0508", " 5721", " v.05", " v.06", " rf 7133080", " ral 9010", " ral 9010 (sp)"]
    heads = ["", "", "", "43.20.02 ", "43.20.02a "]
    made = {rng.choice(heads) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(tails) for _ in range(220)}
    names = spark.createDataFrame(list(enumerate(sorted(made | {x for p in SAME + OTHER for x in p}))), "id long, name string").cache()
    f = names.select("id", products.facts(F.col("name")).alias("f"))
    every = f.crossJoin(f.toDF("other", "g")).where("id < other").where(products.same_product(F.col("f"), F.col("g"))).select("id", "other")
    got = {tuple(r) for r in products.identical(names).collect()}
    assert got == {tuple(r) for r in every.collect()} and len(got) > 300
    assert products.candidates(f).count() < names.count() * (names.count() - 1) / 4


def test_components(spark):
    rng = random.Random(2)
    chain = list(range(1, 200))
    rng.shuffle(chain)
    pairs = list(itertools.pairwise(chain)) + [(1000 + i, 1000) for i in range(1, 60)] + [(5, 5), (7, 6), (2001, 2002), (2003, 2002), (2002, 2003)]
    got = {r.vertex: r.component for r in clusters.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 200)}, **{1000 + i: 1000 for i in range(60)}, 2001: 2001, 2002: 2001, 2003: 2001}
    assert clusters.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_names_is_one_group(spark):
    rows = [(1, "Coral Brush 5721", 0.0), (2, "43.20.02 Coral Brush 5721", 12.5), (3, "Forbo Coral 5721, breed", 30.0), (4, "Coral Brush 5721", None), (5, "  ", 4.0), (6, None, 4.0), (7, "Desso 9021", None)]
    got = {r.group: r for r in products.declared_groups(spark.createDataFrame(rows, "id long, name string, total double")).collect()}
    assert set(got) == {1, 7}
    assert (got[1].name, got[1].total, got[1].names, got[1].rows) == ("43.20.02 Coral Brush 5721", 12.5, 3, 4)
    assert got[7].total is None


def test_names_with_other_codes_are_no_candidates(spark):
    rows = [(i, f"large ring economy, 43.{i // 100:02d}.{i % 100:02d}") for i in range(300)] + [(300, "large ring economy"), (301, "large bolt economy")]
    names = spark.createDataFrame(rows, "id long, name string").select("id", products.facts(F.col("name")).alias("f"))
    assert {tuple(r) for r in products.candidates(names).collect()} == {(i, 300) for i in range(300)}
