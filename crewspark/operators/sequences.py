"""Operators that depend on the order of rows: budget splits, runs, lanes, pools, carried headers."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from crewspark.operators.matching import first_rows, greedy_edges
from crewspark.shipping import map_in_arrow, ship
from crewspark.storage import rewritten


def budget_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], hours: str, budget: Column) -> DataFrame:
    """within and over: hours of each row inside and beyond the budget, used up in the given order;
    without a budget all hours are within."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(hours).over(w), F.lit(0))
    within = F.when(budget.isNull(), F.col(hours)).otherwise(F.least(F.col(hours), F.greatest(F.lit(0), budget - used)))
    return df.withColumn("within", within).withColumn("over", F.col(hours) - F.col("within"))


def date_runs(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Runs of consecutive days: first day, last day, days."""
    days = df.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return days.withColumn("__run", island).groupBy(*keys, "__run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("__run")


def without_day(df: DataFrame, keys: Sequence[str], start: str, end: str, removed: Column, gaps: Column | None = None) -> DataFrame:
    """Ranges without one day: gone, shorter, or in two.  gaps: days of a range that it doesn't cover anyway,
    which part it too."""
    days = F.filter(F.sequence(F.col(start), F.col(end)), lambda d: d != removed)
    days = days if gaps is None else F.array_except(days, F.coalesce(gaps, F.array().cast("array<date>")))
    return date_runs(df.select(*keys, F.explode(days).alias("day")), keys, "day")


def lanes(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """First-fit lanes of bars (closed ranges of integers): the lowest lane whose last bar has ended.

    Greedy and hence sequential within a key, but only until a moment without any bar, at which all
    lanes are free: what lies between two such moments is a group of its own.
    """
    ship(df.sparkSession)
    order = Window.partitionBy(*keys).orderBy(start, end, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (reach < F.col(start)), F.col(start))
    stretches = df.withColumn("__begin", begins).withColumn("__begin", F.max("__begin").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="__begin").sort_values([start, end, tie], kind="stable")
        busy: list[tuple[int, int]] = []  # last bar's end and lane
        free: list[int] = []
        chosen = []
        for a, b in zip(group[start].tolist(), group[end].tolist(), strict=True):
            while busy and busy[0][0] < a:
                heapq.heappush(free, heapq.heappop(busy)[1])
            lane = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (b, lane))
            chosen.append(lane)
        return group.assign(lane=pd.Series(chosen, index=group.index, dtype="int64"))

    schema = ", ".join([*(f"{n} {t}" for n, t in df.dtypes), "lane bigint"])
    return stretches.groupBy(*keys, "__begin").applyInPandas(place, schema)


def pool_shares(df: DataFrame, keys: Sequence[str], order: Sequence[str], pool: int, share: int = 8) -> DataFrame:
    """A pool dealt out in order, at most one share a row; keys and order name a row.  Only rows that
    get a share are ranked, so that each task sends few; all others get nothing."""
    top = first_rows(df.select(*keys, *order), keys, order, -(-pool // share))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    dealt = top.withColumn("dealt", F.least(F.lit(share), pool - share * (rank - 1)))
    return df.join(dealt, [*keys, *order], "left").withColumn("dealt", F.coalesce("dealt", F.lit(0)))


def carry_down(df: DataFrame, keys: Sequence[str], order: str, header: Column, out: str) -> DataFrame:
    """The latest header at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(header, ignorenulls=True).over(w))


def remembered(df: DataFrame, keys: Sequence[str], order: Sequence[str], role: str) -> DataFrame:
    """A memory of roles: the same role strengthens it; another one replaces it only while its
    strength is 1 or less, and weakens nothing.

    So the first role that comes twice running stays for good, and each later row of it counts; without
    one the last role stays.  Running windows find it; no list of a key's rows is made.  Rows of one
    order are taken by role.
    """
    w = Window.partitionBy(*keys).orderBy(*order, role)
    one = F.struct(F.col(role).alias("role"))  # a null role is one too
    own = df.withColumns({"__r": one, "__again": one == F.lag(one).over(w)})
    kept = F.first(F.when(F.col("__again"), F.col("__r")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = own.withColumn("__kept", kept).groupBy(*keys)
    total = each.agg(F.max("__kept").alias("__k"), F.count_if(F.col("__r") == F.col("__kept")).alias("__n"), F.max_by("__r", F.struct(*order, role)).alias("__last"))
    return total.select(*keys, F.coalesce("__k", "__last")["role"].alias("role"), F.when(F.col("__k").isNull(), 1).otherwise(F.col("__n") + 1).cast("int").alias("strength"))


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, step) -> DataFrame:
    """keys, value, parts: step(state, value) over each key's rows in order, from None; parts counts rows.

    For folds that depend on the order and have no shorter form.  Each task reads its sorted rows once and
    keeps one state, however many rows a key has; a key's fold itself is sequential.
    """
    own = df.select(*keys, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], value)
    dealt = own.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))], value).select(*keys, value)
    schema = StructType([*dealt.schema.fields[:-1], dealt.schema.fields[-1], StructField("parts", LongType())])
    types = to_arrow_schema(schema)

    def run(batches):
        now, state, n = None, None, 0
        for batch in batches:
            out = []
            for *key, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    if now is not None:
                        out.append((*now, state, n))
                    now, state, n = key, None, 0
                state, n = step(state, v), n + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip((*now, state, n), types, strict=True)], schema=types)

    return map_in_arrow(dealt, run, schema)


def greedy_pairs(df: DataFrame, keys: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs by falling score (ties: least left, then right), within each key, in rounds over all keys at
    once (see ``greedy_edges``)."""
    ends = df.withColumns({"__left": F.struct(*keys, left), "__right": F.struct(*keys, right)})
    return greedy_edges(ends, "__left", "__right", [-F.col(score)]).select(df.columns)


#: Rounds of nearest_pairs() by windows; what is left then is matched group by group.
ROUNDS = 6


def nearest_pairs(df: DataFrame, keys: Sequence[str], left: str, id_: str, value: str, rounds: int = ROUNDS) -> DataFrame:
    """keys, left_id, right_id, distance: one-to-one pairs of rows with ``left`` true and false, nearest
    in value first (ties: least left id, then right), within each key, until one side is used up.

    Value and id are whole numbers; an id occurs once in a key.  Rows of one value are a level; once
    equal values are paired, it is of one side.  In each round, levels that are each other's nearest
    are paired; nothing could come before those pairs, so that the result is the greedy one.
    """
    own = [f"key{n}" for n in range(len(keys))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(left).alias("l"), F.col(id_).alias("i"), F.col(value).alias("v"))
    return _nearest_pairs(rows, own, rounds).toDF(*keys, "left_id", "right_id", "distance")


def _nearest_pairs(rows: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    by_id = Window.partitionBy(*keys, "v", "l").orderBy("i")
    same = rows.withColumn("r", F.row_number().over(by_id)).withColumn("both", F.least(*[F.count(F.when(F.col("l") == x, 1)).over(Window.partitionBy(*keys, "v")) for x in (True, False)]))
    same = rewritten(same.withColumns({"edge": F.when(F.col("r") <= F.col("both"), F.col("v")), "d": F.lit(0).cast("long")}))
    edge = lambda: [F.max(F.when(F.col("l"), F.col("i"))).alias("left_id"), F.max(F.when(~F.col("l"), F.col("i"))).alias("right_id"), F.max("d").alias("distance")]
    out = same.where("edge IS NOT NULL").groupBy(*keys, "edge", "r").agg(*edge()).drop("edge", "r")
    rows = same.where("edge IS NULL").select(*keys, "l", "i", "v")
    own = Window.partitionBy(*keys)
    for turn in range(rounds + 1):
        sided = rows.withColumns({"a": F.max("l").over(own), "b": F.min("l").over(own)})
        rows = rewritten(sided.where("a AND NOT b").select(*keys, "l", "i", "v"))
        if not rows.limit(1).count():
            return out
        if turn == rounds:
            break
        levels = rows.groupBy(*keys, "v", "l").agg(F.min("i").alias("i"), F.count("*").alias("n"))
        best = []
        for order in (F.col("v"), F.desc("v")):
            before = own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            of = [F.last(F.when(F.col("l") == x, F.struct("v", "i")), ignorenulls=True).over(before) for x in (True, False)]
            other = F.when(F.col("l"), of[1]).otherwise(of[0])
            pair = F.struct(F.abs(F.col("v") - other["v"]).alias("d"), F.when(F.col("l"), F.col("i")).otherwise(other["i"]).alias("x"), F.when(F.col("l"), other["i"]).otherwise(F.col("i")).alias("y"))
            best.append(F.when(other.isNotNull(), pair))
        near = levels.withColumns({"p": best[0], "q": best[1]}).withColumns({"e": F.least("p", "q"), "tie": F.coalesce(F.col("p.d") == F.col("q.d"), F.lit(False))})
        of_edge = Window.partitionBy(*keys, "e")
        mutual = near.withColumns({"ends": F.count("*").over(of_edge), "k": F.when(F.max("tie").over(of_edge), 1).otherwise(F.min("n").over(of_edge))}).where("ends = 2")
        ranked = rows.withColumn("r", F.row_number().over(by_id)).join(mutual.select(*keys, "v", "e", "k"), [*keys, "v"], "left")
        ranked = rewritten(ranked.withColumn("taken", F.coalesce(F.col("r") <= F.col("k"), F.lit(False))).withColumn("d", F.col("e.d")))
        out = out.union(ranked.where("taken").groupBy(*keys, "e", "r").agg(*edge()).drop("e", "r"))
        rows = ranked.where("NOT taken").select(*keys, "l", "i", "v")
    ship(rows.sparkSession)

    def rest(group: pd.DataFrame) -> pd.DataFrame:
        ids, side = {}, {}
        for v, i, own_side in sorted(zip(group["v"].tolist(), group["i"].tolist(), group["l"].tolist(), strict=True), reverse=True):
            ids.setdefault(v, []).append(i)  # the least id last
            side[v] = own_side
        order = sorted(ids)
        up, down = dict(zip(order, order[1:], strict=False)), dict(zip(order[1:], order, strict=False))

        def joint(a, b):
            if ids.get(a) and ids.get(b) and side[a] != side[b]:
                x, y = (a, b) if side[a] else (b, a)
                heapq.heappush(heap, (b - a, ids[x][-1], ids[y][-1], x, y))

        heap, found = [], []
        for a in order:
            joint(a, up.get(a))
        while heap:
            d, i, j, x, y = heapq.heappop(heap)
            if not ids[x] or not ids[y] or ids[x][-1] != i or ids[y][-1] != j:
                continue  # a newer entry has the levels' present ids
            found.append((i, j, d))
            ids[x].pop()
            ids[y].pop()
            for v in (x, y):
                a, b = down.get(v), up.get(v)
                if ids[v]:
                    joint(a, v)
                    joint(v, b)
                else:  # its neighbours are next to each other now
                    up[a], down[b] = b, a
                    joint(a, b)
        head = group[list(keys)].iloc[[0] * len(found)].reset_index(drop=True)
        return head.assign(**{n: [f[k] for f in found] for k, n in enumerate(("left_id", "right_id", "distance"))})

    return out.union(rows.groupBy(*keys).applyInPandas(rest, out.schema))
