"""First matches, waterfalls, scored matches with margins, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewspark.functions import geometry
from crewspark.operators.ranking import with_place
from crewspark.shipping import map_in_arrow
from crewspark.storage import rewritten

#: The least score of a match, its lead, and the shorter lead of an exact match.
LEAST, LEAD, EXACT, EXACT_LEAD = 70, 25, 100, 10


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first rows of each key in a stated order, at most so many; each task sends no more than those."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return first_rows(df, keys, order)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the last row of each key; one aggregate, so that each task reduces its own rows."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def waterfall(*levels: tuple[str, Column]) -> tuple[Column, Column]:
    """The first level that has a value, and that level's name."""
    value = F.coalesce(*[c for _, c in levels])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in levels])
    return value, source


def best_two(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The best row of each key with the score of the next, runner_up; two rows of each key are sorted."""
    order = [F.col(score).desc(), *tie]
    two = first_rows(df, keys, order, 2)
    w = Window.partitionBy(*keys).orderBy(*order)
    return two.withColumns({"__rank": F.row_number().over(w), "runner_up": F.lead(score).over(w)}).where("__rank = 1").drop("__rank")


def best_with_margin(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], least: float, margin: float) -> DataFrame:
    """The best row of each key if it reaches the least score and leads the next by the margin."""
    clear = F.col("runner_up").isNull() | (F.col(score) - F.col("runner_up") >= margin)
    return best_two(df, keys, score, tie).where((F.col(score) >= least) & clear)


def uniquely_best(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The best candidate of each key where no other comes near it: an exact match needs a shorter
    lead, or none over a candidate that wouldn't be accepted."""
    lead = F.col(score) - F.col("runner_up")
    exact = (F.col(score) >= EXACT) & ((lead >= EXACT_LEAD) | (F.col("runner_up") < LEAST))
    clear = F.col("runner_up").isNull() | (lead >= LEAD) | exact
    return best_two(df, keys, score, tie).where((F.col(score) >= LEAST) & clear)


def only_candidate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no other row; an aggregate, so that each task reduces its own rows."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct(*rest)).alias("__row")).where("__n = 1")
    return one.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def greedy_edges(edges: DataFrame, left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """One-to-one choice of edges in a total order, as if they were taken one by one and each end once.

    An edge that is the best one of both its ends is certain to be taken, wherever it stands: nothing
    before it in the order touches its ends.  Such edges are taken together, those that touch them go,
    and so on; each round reduces the edges by two aggregates, and no key is one task.  order: the best
    first (ties: the least ends); an edge occurs once.
    """
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    rest = rewritten(edges.withColumn("__rank", rank))
    out = []
    while not rest.isEmpty():
        best = [rest.groupBy(end).agg(F.min("__rank").alias("__rank")).select("__rank.l", "__rank.r") for end in (left, right)]
        taken = rewritten(best[0].join(best[1], ["l", "r"]))
        out.append(taken)
        rest = rest.join(taken.select(F.col("l").alias(left)), left, "left_anti").join(taken.select(F.col("r").alias(right)), right, "left_anti")
        rest = rewritten(rest)
    if not out:
        return edges.limit(0)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    found = found.toDF("__l", "__r")
    return edges.join(found, (F.col(left) == F.col("__l")) & (F.col(right) == F.col("__r"))).drop("__l", "__r")


def fallback_join(left: DataFrame, right: DataFrame, keys: Sequence[str], second: Sequence[str], order: str) -> DataFrame:
    """id, other, by ("key", "name" or null): each left row (id, keys, second keys) gets the right row of its
    keys, and where there is none that of its second keys; right rows are used once, the first by
    order of both sides, those taken by keys before all others.

    Rows of a key meet by their places in it, as many as the shorter side has.
    """
    out, a, b = None, left, right
    for by, own in (("key", list(keys)), ("name", list(second))):
        known = F.lit(True)
        for k in own:
            known = known & F.col(k).isNotNull()
        place = F.row_number().over(Window.partitionBy(*own).orderBy(order, "id"))
        x = a.where(known).select("id", *own, place.alias("__k"))
        y = b.where(known).select(F.col("id").alias("other"), *own, place.alias("__k"))
        met = rewritten(x.join(y, [*own, "__k"]).select("id", "other", F.lit(by).alias("by")))
        out = met if out is None else out.union(met)
        a, b = a.join(met.select("id"), "id", "left_anti"), b.join(met.select(F.col("other").alias("id")), "id", "left_anti")
    return left.select("id").join(out, "id", "left")


#: Pairs of all rows up to which they meet square by square, whatever lies in one.
FEW_PAIRS = 4_000_000
#: Points of a block, and how many blocks one of the next tier holds.
BLOCK, FAN = 16, 16
AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """For each left row (keys, id, x, y) the nearest right row (keys, id, x, y) closer than the
    radius; the lesser id wins among equals.

    Points are dealt into squares of the radius; a left point meets the nine squares around it.  Unless
    they are few, blocks of neighbouring left points first find the right blocks that can hold the
    nearest of one of them (``near_blocks``), so that the work doesn't grow with the points of a square.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    d = lambda x, y: (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    if left.count() * right.count() <= FEW_PAIRS:
        around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND])
        a = left.select(*keys, "id", "x", "y", F.explode(around).alias("n")).withColumns({"cx": cell("x") + F.col("n.dx"), "cy": cell("y") + F.col("n.dy")})
        b = right.select(*keys, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
        near = a.join(b, [*keys, "cx", "cy"]).select(*keys, "id", F.struct(d(F.col("ox"), F.col("oy")).alias("d2"), "other").alias("m"))
    else:
        a = point_blocks(left, keys, radius)
        b = point_blocks(right.groupBy(*keys, "x", "y").agg(F.min("id").alias("id")), keys, radius)
        met = near_blocks(a, b, keys, radius).join(b.select(*keys, "cx", "cy", "block", F.col("points").alias("others")), [*keys, "cx", "cy", "block"])
        met = met.select("left", "others").repartition("left").sortWithinPartitions("left")
        own = met.join(a.select("left", *keys, "points"), "left").select(*keys, "left", "points", "others")
        types = {f.name: f.dataType for f in (*a.select(*keys, F.col("points")[0]["id"].alias("id")).schema, *b.select(F.col("points")[0]["id"].alias("other")).schema)}
        each = map_in_arrow(own, _nearest_of_blocks, T.StructType([T.StructField(n, types.get(n, T.DoubleType())) for n in (*keys, "id", "d2", "other")]))
        near = each.select(*keys, "id", F.struct("d2", "other").alias("m"))
    near = near.where(F.col("m.d2") < radius * radius)
    return near.groupBy(*keys, "id").agg(F.min("m").alias("m")).select(*keys, "id", F.col("m.other").alias("other"), F.col("m.d2").alias("d2"))


def _nearest_of_blocks(batches):
    """For each point (id, x, y) of points the nearest of others, in the order of their ids: id, d2, other, with the
    row's first columns; one row for consecutive ones of the same left.  No list has more than BLOCK entries."""
    for whole in batches:
        for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
            rows, places, real = [], [], []
            for c in ("points", "others"):
                n = batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(int)
                real.append(np.arange(BLOCK) < n[:, None])
                places.append(np.where(real[-1], (np.cumsum(n) - n)[:, None] + np.arange(BLOCK), 0))
                rows.append(batch.column(c).flatten())
            (x, u), (y, v) = [[r.field(c).to_numpy(zero_copy_only=False)[p] for r, p in zip(rows, places)] for c in "xy"]
            dx, dy = x[:, :, None] - u[:, None, :], y[:, :, None] - v[:, None, :]
            d2 = np.where(real[1][:, None, :], dx * dx + dy * dy, np.inf)
            rank = pc.rank(rows[1].field("id"), tiebreaker="dense", null_placement="at_start").to_numpy() - 1
            least = np.take_along_axis(rank[places[1]], d2.argmin(axis=2), 1)
            d2 = d2.min(axis=2)
            left = batch.column("left").to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            of_left = np.minimum.reduceat(d2, runs)
            again = np.repeat(of_left, np.diff(np.append(runs, len(left))), axis=0)
            least = np.minimum.reduceat(np.where(d2 == again, least, len(rank)), runs)
            ids = np.empty(len(rank), int)
            ids[rank] = np.arange(len(rank))
            own = real[0][runs]
            of = pa.array(runs[np.nonzero(own)[0]])
            keys = [batch.column(i).take(of) for i in range(batch.num_columns - 3)]
            point = rows[0].field("id").take(pa.array(places[0][runs][own]))
            names = [*batch.schema.names[:-3], "id", "d2", "other"]
            yield pa.RecordBatch.from_arrays([*keys, point, pa.array(of_left[own]), rows[1].field("id").take(pa.array(ids[least[own]]))], names)


def _spread(c: Column) -> Column:
    """The low 31 bits of a whole number, each followed by a 0."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
    return c


def point_blocks(points: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """keys, cx, cy (square), block, x0, x1, y0, y1, points, left: each square's points (id, x, y) in blocks
    of BLOCK, in the order of their place on a Z-curve through it; left is a number of the block's own."""
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    at = lambda c: F.col(c) / radius
    inner = lambda c: _spread(F.floor((at(c) - F.floor(at(c))) * 2**31).cast("bigint").bitwiseAND(F.lit(2**31 - 1)))
    own = points.where(finite("x") & finite("y")).select(*keys, "id", "x", "y", F.floor(at("x")).alias("cx"), F.floor(at("y")).alias("cy"), F.shiftleft(inner("x"), 1).bitwiseOR(inner("y")).alias("z"))
    placed = with_place(own.dropna(subset=list(keys)), [*keys, "cx", "cy"], ["z", "x", "y"], "place").withColumn("block", F.expr(f"(place - 1) div {BLOCK}"))
    box = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
    blocks = placed.groupBy(*keys, "cx", "cy", "block").agg(*box, F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("points"))
    return rewritten(blocks.withColumn("left", F.monotonically_increasing_id()))


def near_blocks(a: DataFrame, b: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """left, keys, cx, cy, block: the blocks of b that can hold the nearest point, within the radius, of one of
    the points of a's block left.

    Blocks are found from the top of a tree down: FAN blocks that follow one another are one of the next
    tier.  A box is left out if its least distance is more than the largest one of another box.
    """
    square, box = [*keys, "cx", "cy"], ["x0", "x1", "y0", "y1"]
    most, top = b.agg(F.max("block")).first()[0] or 0, 0
    while most >= FAN ** (top + 1):
        top += 1

    def tier(t: int) -> DataFrame:
        grown = b.select(*square, F.expr(f"block div {FAN**t}").alias("block"), *box)
        if t:
            grown = grown.groupBy(*square, "block").agg(*[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in box])
        return grown.select(*square, "block", *[F.col(c).alias(f"o{c}") for c in box])

    squared = lambda x, y: x * x + y * y
    c = {n: F.col(n) for n in [*box, *[f"o{n}" for n in box]]}
    gap = lambda v: F.greatest(F.lit(0.0), c[f"o{v}0"] - c[f"{v}1"], c[f"{v}0"] - c[f"o{v}1"])
    reach = lambda v: F.greatest(c[f"o{v}1"] - c[f"{v}0"], c[f"{v}1"] - c[f"o{v}0"])
    around = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in AROUND])
    own = a.select(*keys, "left", *box, F.inline(around))
    for t in range(top, -1, -1):
        nodes = tier(t)
        if t < top:
            own = own.withColumnRenamed("block", "__up")
            nodes = nodes.withColumn("__up", F.expr(f"block div {FAN}"))
        pairs = own.join(nodes, [*square, *(["__up"] if t < top else [])])
        pairs = pairs.withColumn("__least", squared(gap("x"), gap("y"))).where(F.col("__least") < radius * radius)
        known = pairs.withColumn("__known", F.min(squared(reach("x"), reach("y"))).over(Window.partitionBy("left")))
        own = known.where(F.col("__least") <= F.col("__known")).select(*square, "left", *box, "block")
    return own.drop(*box)


#: The smallest polygons of a key that points meet first; each round ends at twice as many.
FIRST_POLYGONS = 256
#: Widths of squares, each a fourth of the next; what is narrower lies in the narrowest.
WIDTHS = 12


def smallest_enclosing(points: DataFrame, polygons: DataFrame, keys: Sequence[str], id: str, cell: float) -> DataFrame:
    """For each point (keys, id, x, y) the polygon (keys, polygon, points) of least area around it; the
    lesser polygon wins among equals.

    A polygon is dealt to the squares that its bounds touch, a point to its own, so that the join is
    on equality.  Unless they are few, polygons are taken from the smallest on, in rounds, each dealt to
    cells about as wide and high as its bounds, and a point that has its polygon meets no larger ones.
    """
    b = polygons.withColumn("__b", geometry.bounds(F.col("points"))).withColumn("__area", geometry.polygon_area(F.col("points")))
    inside = geometry.inside(F.col("points"), F.col("x"), F.col("y"))
    if points.count() * polygons.count() <= FEW_PAIRS:
        at = lambda c: F.floor(c / cell)
        columns = b.withColumn("cx", F.explode(F.sequence(at(F.col("__b.x0")), at(F.col("__b.x1")))))
        dealt = columns.withColumn("cy", F.explode(F.sequence(at(F.col("__b.y0")), at(F.col("__b.y1"))))).drop("__b")
        own = points.withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
        hit = own.join(dealt, [*keys, "cx", "cy"]).where(inside)
        return hit.groupBy(*keys, id).agg(F.min(F.struct("__area", "polygon")).alias("m")).select(*keys, id, F.col("m.polygon").alias("polygon"), F.col("m.__area").alias("area"))
    placed = by_area(b.dropna(subset=list(keys)), keys, cell)
    rounds: dict[int, list] = {}
    for r in placed.select("round", "kx", "ky").distinct().collect():
        rounds.setdefault(r["round"], []).append(F.struct(F.lit(r["kx"]).alias("kx"), F.lit(r["ky"]).alias("ky")))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rest, found = points.where(known).select(*keys, id, "x", "y"), None
    for n in sorted(rounds):
        met = rewritten(enclosing_candidates(rest, placed.where(F.col("round") == n), keys, rounds[n], cell).where(F.col("points").isNull() | inside).groupBy(*keys, id).agg(F.min("place").alias("place")))
        found = met if found is None else found.union(met)
        rest = rewritten(rest.join(met.select(*keys, id), [*keys, id], "left_anti"))
        if rest.isEmpty():
            break
    if found is None:
        return points.join(b, keys).limit(0).select(*keys, id, "polygon", F.col("__area").alias("area"))
    return found.join(placed.select(*keys, "place", "polygon", F.col("__area").alias("area")), [*keys, "place"]).select(*keys, id, "polygon", "area")


def _cell(c: Column, k: Column, cell: float) -> Column:
    return F.floor(c / (F.pow(F.lit(4.0), k) * cell))


def by_area(polygons: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Different polygons (keys, polygon, points, __b, __area) with place, from the least area on, round, and
    kx and ky: the powers of four, times cell, that their bounds' width and height don't exceed.  Points are
    null for a rectangle along the axes, which is its bounds."""
    power = lambda lo, hi: F.ceil(F.log(4.0, (F.col(f"__b.{hi}") - F.col(f"__b.{lo}")) / cell)).cast("int")
    one = polygons.groupBy(*keys, "points", "__b", "__area").agg(F.min("polygon").alias("polygon"))
    sized = one.withColumns({"kx": power("x0", "x1"), "ky": power("y0", "y1")}).where("kx IS NOT NULL AND ky IS NOT NULL")
    p = [F.get("points", F.lit(i)) for i in range(4)]
    turned = lambda c, d: (p[0][c] == p[1][c]) & (p[2][c] == p[3][c]) & (p[1][d] == p[2][d]) & (p[3][d] == p[0][d])
    sized = sized.withColumn("points", F.when((F.size("points") != 4) | ~(turned("y", "x") | turned("x", "y")), F.col("points")))
    placed = rewritten(with_place(sized, keys, ["__area", "polygon"], "place"))
    widest = placed.agg(F.max("kx").alias("kx"), F.max("ky").alias("ky")).first()
    turn = F.when(F.col("place") <= FIRST_POLYGONS, 0).otherwise(F.ceil(F.log(2.0, F.col("place") / FIRST_POLYGONS)).cast("int"))
    return placed.withColumns({"round": turn, **{k: F.greatest(F.col(k), F.lit((widest[k] or 0) - WIDTHS)) for k in ("kx", "ky")}})


def enclosing_candidates(points: DataFrame, polygons: DataFrame, keys: Sequence[str], sizes: Sequence[Column], cell: float) -> DataFrame:
    """Points (keys, x, y) with the polygons (of ``by_area``) whose bounds hold them, upper ends left out for
    rectangles; sizes are all pairs of
    kx and ky that these have."""
    at = lambda c, k: _cell(F.col(c), F.col(k), cell)
    columns = polygons.select(*keys, "place", "points", "__b", "kx", "ky", F.explode(F.sequence(at("__b.x0", "kx"), at("__b.x1", "kx"))).alias("cx"))
    dealt = columns.withColumn("cy", F.explode(F.sequence(at("__b.y0", "ky"), at("__b.y1", "ky"))))
    own = points.select("*", F.inline(F.array(*sizes))).withColumns({"cx": at("x", "kx"), "cy": at("y", "ky")})
    return own.join(dealt, [*keys, "kx", "ky", "cx", "cy"]).where("x >= __b.x0 AND y >= __b.y0 AND IF(points IS NULL, x < __b.x1 AND y < __b.y1, x <= __b.x1 AND y <= __b.y1)")
