"""Rooms of several sources, storeys by section, and names that are alike."""

import itertools
import random
from pathlib import Path

from pyspark.sql import functions as F

from crewspark.catalogue import QUERIES
from crewspark.operators import room_sources, rooms

ROWS = "id string, floor string, number string, name string, area double, product string"
NAMES = ("takeoff", "drawing", "materials", "cutlist")


def merged(spark, **rows):
    sources = [(n, spark.createDataFrame(rows.get(n, []), ROWS)) for n in NAMES]
    pool = room_sources.merged_sources(sources, [["floor", "number", "name"], ["floor", "name"]], ["area", "product"])
    return {r.room: r for r in room_sources.judged(pool, NAMES, ["drawing", "takeoff"], ["takeoff", "materials"]).collect()}


def test_all_patterns_of_presence(spark):
    rows = {n: [] for n in NAMES}
    patterns = [p for k in range(1, 5) for p in itertools.combinations(NAMES, k)]
    for i, p in enumerate(patterns):
        for n in p:
            rows[n].append((f"{n}{i}", "0", f"0.{i}", "kantoor", 10.0, "a"))
    got = merged(spark, **rows)
    assert sorted(tuple(r.sources) for r in got.values()) == sorted(patterns) and len(got) == 15
    assert all(r.confidence == "hoog" for k, r in got.items() if "takeoff" in r.sources)


def test_claims_and_reasons(spark):
    got = merged(
        spark,
        takeoff=[("t1", "0", "0.1", "hal", 10.0, "Coral"), ("t2", "0", None, "berging", 5.0, None), ("t3", "0", "0.3", "kantoor", None, "x"), ("t4", "0", "0.4", "kantoor", 8.0, "x")],
        drawing=[("d1", "0", "0.1", "hal", 12.5, "Forbo"), ("d2", "0", "0.2", "berging", 5.2, None), ("d3", "0", None, "kantoor", 8.0, None), ("d4", "1", "1.1", "hal", None, None)],
        materials=[("m1", "0", "0.2", "berging", None, "Y"), ("m2", "0", "0.2", "berging", None, "Z")],
    )
    assert set(got) == {"t1", "t2", "t3", "t4", "d3", "d4", "m1", "m2"}
    assert (got["t1"].confidence, got["t1"].area, got["t1"].product, got["t1"].reasons) == ("controleren", 12.5, "Coral", ["materials differ", "areas differ"])
    assert (got["t2"].number, got["t2"].how_drawing, got["t2"].reasons) == ("0.2", 2, ["matched by name"])  # two rows of one key claim nothing
    assert got["d3"].sources == ["drawing"] and got["d4"].confidence == "midden" and got["d4"].reasons == ["no area", "one source"]
    assert got["t3"].confidence == "midden"
    assert merged(spark) == {}


def test_rows_of_all_sources_come_together_once(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("*"))
    done = QUERIES["assembled_rooms"](spark, "/root/testdata/sf0.001")
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(project") == 1
    assert done.count() > 0 and set(folder.glob("*")) == before  # no source's claims are written
    some = [(f"t{i}", "0", None, None, 1.0, "a") for i in range(3)] + [("t9", "0", "0.1", "", 1.0, "a")]
    assert set(merged(spark, takeoff=some, drawing=[(f"d{i[0]}", *i[1:]) for i in some])) == {i[0] for i in some} | {f"d{i[0]}" for i in some}


def test_names_alike_share_a_key(spark):
    rng = random.Random(5)
    base = ["kantoor", "kantooor", "kantor", "kantoorruimte", "berging", "bergingen 2", "hal", "hall", "werkplaats", "werkplaatsen", "de werkplaats", "overleg", "overlegg"]
    names = sorted({*base, *("".join(rng.choice("abco") for _ in range(rng.randint(1, 8))) for _ in range(120))})
    df = spark.createDataFrame([(n,) for n in names], "a string")
    pairs = df.crossJoin(df.toDF("b")).where(rooms.names_alike(F.col("a"), F.col("b")))
    key = lambda c, w: rooms.alike_keys(F.col(c), w)
    share = F.arrays_overlap(key("a", True), key("b", False)) | F.arrays_overlap(key("a", False), key("b", True))
    assert pairs.count() > len(names) and pairs.where(~share).count() == 0


def test_storeys_by_section(spark):
    schema = "project long, id string, floor string, number string, name string, area double, page int"
    known = [(1, "k1", "Verdieping 1", "1.01", "kantoor", 20.0, None), (1, "k2", "Fase 2 verdieping 1", "1.01", "berging", 9.0, None), (1, "k3", "fase 2 verdieping 1", "1.02", "werkplaats", 30.0, None), (1, "k4", "Fase 2 verdieping 1", "1.03", "overleg", 12.0, None)]
    drawn = [
        (1, "a", "verdieping 1", "1.01", "kantoor", 20.0, 1),  # is where it is
        (1, "b", "verdieping 1", "1.01", "berging", 9.0, 2),  # all three agree with the other section
        (1, "c", "verdieping 1", "1.09", "werkplaats", 30.02, 2),  # by the page's section, number put right
        (1, "d", "verdieping 1", "1.03", "overleg", 15.0, 3),  # no section page, areas differ
        (1, "e", "verdieping 1", None, "toilet", 9.0, 2),
        (2, "f", "verdieping 1", "1.01", "berging", 9.0, 2),
        (1, "g", None, "1.01", "berging", 9.0, 2),
    ]
    got = {r.id: r for r in room_sources.storeys_by_section(spark.createDataFrame(drawn, schema), spark.createDataFrame(known, schema)).collect()}
    assert {k: (r.floor, r.moved_from is not None, r.number, r.by_page) for k, r in got.items()} == {
        "a": ("verdieping 1", False, "1.01", False),
        "b": ("fase 2 verdieping 1", True, "1.01", True),
        "c": ("fase 2 verdieping 1", True, "1.02", True),
        "d": ("verdieping 1", False, "1.03", False),
        "e": ("verdieping 1", False, None, False),
        "f": ("verdieping 1", False, "1.01", False),
        "g": ("", False, "1.01", False),
    }


def test_rooms_of_small_projects_need_no_keys(spark, monkeypatch):
    rng = random.Random(8)
    schema = "project long, id string, floor string, number string, name string, area double, page int"
    names = ["kantoor", "kantooor", "kantoorruimte", "berging", "bergingen", "hal", "werkplaats", "ruimte", "", None]
    make = lambda kind, floors: [(rng.randint(1, 6), f"{kind}{i}", rng.choice(floors), rng.choice(["1.01", "1.02", "", None]), rng.choice(names), rng.choice([9.0, 9.02, 12.0, None]), rng.choice([1, 2])) for i in range(90)]
    drawn = spark.createDataFrame(make("d", ["verdieping 1", "kelder"]), schema)
    known = spark.createDataFrame(make("k", ["Verdieping 1", "Fase 2 verdieping 1", "kelder"]), schema)
    result = lambda: sorted(map(repr, room_sources.storeys_by_section(drawn, known).collect()))
    monkeypatch.setattr(room_sources, "FEW_ROOMS", 15)  # some projects have more
    mixed = result()
    monkeypatch.setattr(room_sources, "FEW_ROOMS", 0)
    keyed = result()
    monkeypatch.setattr(room_sources, "FEW_ROOMS", 64)
    monkeypatch.setattr(room_sources, "_alike_pairs", None)
    assert result() == keyed == mixed and len(keyed) == 90


def test_rooms_of_a_project_meet_once(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("*"))
    done = QUERIES["section_storeys"](spark, "/root/testdata/sf0.001")
    plan = done._jdf.queryExecution().executedPlan().toString()
    # lines are dealt by project once: pairs, ranks and votes are found where they lie, and only the list of large projects is written
    assert plan.count("Exchange hashpartitioning(project") == plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
    assert done.count() > 0 and len(set(folder.glob("*")) - before) == 1


def test_rooms_without_a_storey_add_no_rows(spark, monkeypatch):
    schema = "project long, id string, floor string, number string, name string, area double, page int"
    rows = [(1, f"d{i}", f, "1.01", "berging", 9.0, 1) for i, f in enumerate(["verdieping 1", "verdieping 1", "", None])]
    drawn = spark.createDataFrame([*rows, rows[0]], schema)  # equal rows are one room
    known = spark.createDataFrame([(1, f"k{i}", f, "1.01", "berging", 9.0, None) for i, f in enumerate([None, "", " ", "Fase 2 verdieping 1", None])], schema)
    for few in (64, 0):
        monkeypatch.setattr(room_sources, "FEW_ROOMS", few)
        got = sorted((r.id, r.floor, r.moved_from, r.by_page) for r in room_sources.storeys_by_section(drawn, known).collect())
        assert got == [*[(d, "fase 2 verdieping 1", "verdieping 1", True) for d in ("d0", "d1")], *[(d, "", None, False) for d in ("d2", "d3")]]


def test_storeys_from_page(spark):
    rows = [(1, 1, "kelder"), (1, 1, None), (1, 1, "Onbekend"), (1, 2, "a"), (1, 2, "b"), (1, 2, ""), (1, None, None)]
    got = room_sources.storeys_from_page(spark.createDataFrame(rows, "project long, page int, floor string")).collect()
    assert sorted((r.page or 0, r.floor or "-") for r in got) == [(0, "-"), (1, "kelder"), (1, "kelder"), (1, "kelder"), (2, "-"), (2, "a"), (2, "b")]
