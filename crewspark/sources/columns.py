"""What the columns of sheets are, from their headers, their contents and what was learned before.

Each of the first rows, and none, is tried as a header.  A column has points for a role from the header's
words, from the share of its values that look like the role, and from a memory of headers; roles choose
their columns in a fixed order.  The header under which the roles have the most points is the sheet's.
Sheets with several columns of room numbers are cut into ranges before each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crewspark.functions.numbers import is_machine_number
from crewspark.shipping import map_in_arrow

#: Words of headers and their points, by role, in the order in which roles choose; the first word that fits counts.
HEADERS = {
    "room_number": {"ruimte nr": 6, "ruimtenr": 6, "ruimtenummer": 6, "ruimte nummer": 6, "room number": 6, "room no": 6, "vertreknr": 5, "ruimtecode": 5, "room code": 5, "nr": 3, "nummer": 3},
    "room_name": {"ruimtenaam": 6, "ruimte naam": 6, "room name": 6, "vertrek": 5, "functie": 4, "ruimte": 3, "naam": 3},
    "building": {"gebouw": 6, "building": 6, "vleugel": 5, "blok": 4},
    "floor_level": {"verdieping": 6, "etage": 5, "niveau": 4, "floor level": 6},
    "floor_finish": {"vloerafwerking": 6, "vloer afwerking": 6, "floor finish": 6, "vloercode": 5, "vloerproduct": 5, "vloer": 4},
    "plinth_finish": {"plintafwerking": 6, "plint afwerking": 6, "plinth": 5, "holplint": 5, "plint": 4},
    "product": {"productomschrijving": 6, "artikelomschrijving": 6, "product": 5, "materiaal": 4, "artikel": 4, "afwerking": 3, "omschrijving": 3},
    "quantity": {"hoeveelheid": 6, "oppervlakte": 5, "aantal": 4, "quantity": 5, "qty": 4, "m2": 4, "totaal": 3},
    "unit": {"eenheid": 6, "unit": 5, "eenh": 4, "eh": 4},
}
ROLES = tuple(HEADERS)
#: Forms of values.
ROOM = r"(?i)^(?:[A-Z]-\d{1,2}-\d{2}(?:[/-]\d{2})*|\d{2}-\d{2}|0\d[.\-]\d{2})$"
UNIT = r"(?i)^(m2|m²|m1|m¹|lm|stuks|st|uren|u)$"
CODE = r"(?i)(?<![a-z0-9])((?:v|pl)\d{2}(?:\.[a-z0-9]+)?)"
FLOORING, COVERING = "gietvloer|marmoleum|pvc|tapijt|linoleum|coating", "plint|saus|behang"
DIMENSION = r"(?i)^(lengte|breedte|hoogte|length|width|height)\b"
#: Rows that can be a header, values that are looked at, and points: at least, by memory, of a sure header.
HEAD_ROWS, SAMPLE, LEAST, MEMORY = 25, 40, 3, 6
#: Bits of a count up to SAMPLE; a row's place in numbers that hold a column or sheet and a row; rows that a task takes at once.
COUNT, FAR, ROWS_AT_ONCE = 7, 40, 100_000


def _looks(cells: DataFrame) -> DataFrame:
    """cells with total, code, and as booleans whether a value looks like each role (is_...).

    What several roles ask for is a column of its own, so that it is found once; a value of digits and signs alone
    isn't searched for words, one without digits isn't read as a number.  low: the value in lower case.
    """
    value, room, unit, number, wordy, digit = (F.col(c) for c in ("value", "is_room_number", "is_unit", "is_quantity", "wordy", "digit"))
    own = cells.withColumns({"is_room_number": value.rlike(ROOM), "wordy": value.rlike(r"[^\s\d.,:_/\-]"), "digit": value.rlike("[0-9]"), "low": F.lower(value)})
    words = lambda pattern: wordy & value.rlike(pattern)
    own = own.withColumns({"is_unit": words(UNIT), "laid": wordy & F.col("low").rlike(f"{FLOORING}|{COVERING}"), "total": words(r"(?i)^totaal\b"), "code": F.when(wordy & digit, F.regexp_extract(value, CODE, 1))})
    own = own.withColumn("code", F.when(F.col("code") != "", F.lower("code"))).withColumn("is_quantity", digit & ~room & ~unit & ~words("(?i)totaal|som|subtotal") & is_machine_number(value))
    bare, low = F.translate(value, ",.", ""), F.translate("low", ",.", "")
    double = (digit | low.contains("nan") | low.contains("inf")) & bare.try_cast("double").isNotNull()
    return own.withColumns({
        "is_room_name": ~room & ~number & ~unit & F.col("code").isNull() & ~F.col("laid") & (F.length(value) <= 80) & ~double,
        "is_building": words(r"(?i)^(gebouw|blok|vleugel|[a-z])\b"),
        "is_floor_level": words(r"(?i)^(bg|kelder|zolder|vliering|\d{1,2}e|verdieping(?:\s+\d+)?)$"),
        "is_floor_finish": (F.col("laid") & F.col("low").rlike(FLOORING)) | (digit & words(r"(?i)(?<![a-z0-9])v\d{2}(?:\.[a-z0-9]+)?(?![a-z0-9])")),
        "is_plinth_finish": (F.col("laid") & F.col("low").contains("plint")) | (digit & words(r"(?i)(?<![a-z0-9])pl\d{2}(?:\.[a-z0-9]+)?(?![a-z0-9])")),
        "is_product": (F.length(value) > 2) & ~room & ~number & ~unit,
    })


def normalized_header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s._:\-]+", " "))


def _header_points(header: Column, role: str) -> Column:
    points = None
    for word, n in HEADERS[role].items():
        hit = header.contains(word)
        points = F.when(hit, n) if points is None else points.when(hit, n)
    if role == "quantity":
        points = F.when(~header.rlike(DIMENSION), points)
    return F.coalesce(points, F.lit(0))


def _content_points(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = hits / np.maximum(n, 1)
    return np.where((n >= 2) & (share >= 0.6), 4, np.where(share >= 0.3, 2, np.where(hits > 0, 1, 0)))


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before in a column; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        x, y = c.slice(1), c.slice(0, len(c) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.not_equal(pc.is_null(x), pc.is_null(y)))
        out[1:] |= differs.to_numpy(zero_copy_only=False)
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _tried(t: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """All headers that are tried, by column: the index of the column's first row, the head, the part of the sheet
    (0: none), whether sheet and part differ from the column before, points and sure of each role.

    A column's values are in order, so that those below a header are a run of them, and what is counted in it
    is the difference of two sums; counts of all roles are in one number (COUNT bits each).
    """
    file, sheet = t.column("file"), t.column("sheet")
    col, row, seen, bits, points, learned = (t.column(c).to_numpy(zero_copy_only=False) for c in ("col_no", "row_no", "seen", "bits", "points", "learned"))
    new_sheet = _changes(file, sheet)
    new_column = new_sheet | np.concatenate([[True], col[1:] != col[:-1]])
    s, c = np.cumsum(new_sheet) - 1, np.cumsum(new_column) - 1
    at = np.flatnonzero(new_column)
    v = np.flatnonzero(seen)
    place, ends = (c[v] << FAR) + row[v], np.searchsorted(c[v], np.arange(len(at)), "right")
    heads = np.clip(np.maximum.reduceat(row, at), 0, HEAD_ROWS) + 1
    first = np.cumsum(heads) - heads
    of = np.repeat(np.arange(len(at)), heads)
    head = np.arange(len(of)) - first[of]
    a = np.searchsorted(place, (of << FAR) + head, "right")
    z = np.minimum(a + SAMPLE, ends[of])
    n, total = z - a, _sums(bits[v])
    hits = total[z] - total[a]
    # a sheet's columns of room numbers, from two on, begin its parts
    count = lambda i, x=hits: (x >> (COUNT * i)) & ((1 << COUNT) - 1)
    starts = (_content_points(count(0)[first], n[first]) >= 2).astype(np.int64)
    of_sheet, before = s[at], _sums(starts)
    sheets = np.searchsorted(of_sheet, np.arange(of_sheet[-1] + 2))
    many = (before[sheets[1:]] - before[sheets[:-1]])[of_sheet] >= 2
    part = np.where(many, before[1:] - before[sheets[:-1]][of_sheet], 1)
    # finishes need a code on a row with a room, and more than one code in five values
    coded = t.column("code").is_valid().to_numpy(zero_copy_only=False)[v]
    on_row, is_room = (s[v] << FAR) + row[v], count(0, bits[v]) > 0
    on = _sums(coded & np.isin(on_row, np.unique(on_row[is_room])))
    near = np.minimum(z, np.searchsorted(place, (of << FAR) + head + SAMPLE, "right"))
    codes, others = _sums(coded), np.zeros(1, np.int64)
    if coded.any():
        others = _sums(_changes(t.column("code").take(pa.array(v[coded]))))
    one = (codes[z] > codes[a]) & (others[codes[z]] == others[np.minimum(codes[a] + 1, len(others) - 1)])
    finish = (on[near] > on[a]) & ~((n >= 5) & one)
    named = np.flatnonzero((row >= 0) & (row <= HEAD_ROWS) & ((points != 0) | (learned != 0)))
    words, memory = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    words[first[c[named]] + row[named]], memory[first[c[named]] + row[named]] = points[named], learned[named]
    given, sure = np.empty((len(ROLES), len(of)), np.int64), np.empty((len(ROLES), len(of)), bool)
    for i, role in enumerate(ROLES):
        by_word, content = (words >> (4 * i)) & 15, _content_points(count(i), n)
        recalled = (content >= 2) & ((memory >> i) & 1 == 1)
        given[i] = by_word + content + MEMORY * recalled
        sure[i] = ((by_word >= 4) & (content >= 2)) | recalled
        if role == "quantity":
            given[i][by_word < 2] = 0
        else:
            sure[i] |= content >= 4
        if role.endswith("_finish"):
            given[i][~finish] = 0
    new_part = np.concatenate([[True], (of_sheet[1:] != of_sheet[:-1]) | (part[1:] != part[:-1])])
    return at[of], head, part[of], (np.cumsum(new_part) - 1)[of], given, sure


def _choices(t: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The roles' columns under the best header of each part of whole sheets, whose rows are in order."""
    at, head, part, group, given, sure = _tried(t)
    kept = np.flatnonzero((given >= LEAST).any(0) & (part > 0))
    kept = kept[np.argsort(group[kept] * (HEAD_ROWS + 1) + head[kept], kind="stable")]
    at, head, part, group, given, sure = at[kept], head[kept], part[kept], group[kept], given[:, kept], sure[:, kept]
    trial = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (head[1:] != head[:-1])])) if len(kept) else kept
    rows, roles = [], []
    if len(kept):
        size = np.diff(np.append(trial, len(kept)))
        left = size.max() - (np.arange(len(kept)) - np.repeat(trial, size))  # 1 at least; the leftmost column has most
        free, score, picks = np.ones(len(kept), bool), np.zeros(len(trial), np.int64), []
        for points in given:
            best = np.maximum.reduceat(np.where(free & (points >= LEAST), points * (size.max() + 1) + left, 0), trial)
            pick = np.where(best > 0, trial + size.max() - best % (size.max() + 1), -1)
            free[pick[pick >= 0]] = False
            score += best // (size.max() + 1)
            picks.append(pick)
        # the header with the most points, the first of equals
        worth, parts = score * (HEAD_ROWS + 1) + HEAD_ROWS - head[trial], np.flatnonzero(np.concatenate([[True], np.diff(group[trial]) != 0]))
        won = worth == np.repeat(np.maximum.reduceat(worth, parts), np.diff(np.append(parts, len(trial))))
        for i, pick in enumerate(picks):
            chosen = pick[won & (pick >= 0)]
            rows.append(chosen)
            roles.append(np.full(len(chosen), i))
    r, i = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, roles))
    own = pa.array(at[r])
    columns = [t.column("file").take(own), t.column("sheet").take(own), pa.array(part[r]), pa.array(head[r], mask=head[r] == 0), pa.array(ROLES).take(pa.array(i)), t.column("col_no").take(own), pa.array(given[i, r]), pa.array(sure[i, r])]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _sheet_by_sheet(schema: pa.Schema):
    """_choices of batches, in which a sheet's rows follow each other: the last sheet waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, ROWS_AT_ONCE
        whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                t = whole()
                cut = int(np.flatnonzero(_changes(t.column("file"), t.column("sheet")))[-1])
                if cut:
                    yield _choices(t.slice(0, cut), schema)
                held, n = [t.slice(cut)], t.num_rows - cut
                most = max(ROWS_AT_ONCE, 2 * n)
        if n:
            yield _choices(whole(), schema)

    return run


def guessed_columns(cells: DataFrame, memory: DataFrame | None = None, together: bool = False) -> DataFrame:
    """file, sheet, part, header_row (null: none), role, col_no, points, sure of all sheets of cells (file,
    sheet, row_no, col_no, value; blank ones left out).  memory: header (normalized) and role.  together: the
    cells of a sheet are known to lie in one partition.

    Only the first values below each header are looked at, so that a sheet's length doesn't matter: a column
    is its first values (their row, what they look like, and code) and the points of its headers; a task
    tries the headers of its sheets, one after the other, and lets the roles choose.
    """
    own = cells.select("file", "sheet", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), F.trim("value").alias("value")).where("value <> ''")
    looks = _looks(own)
    # without a memory only what holds a header's word, to its first blank, is brought into a header's form
    begun = {w.split(" ")[0] for words in HEADERS.values() for w in words}
    as_header = F.col("row_no") <= HEAD_ROWS
    if memory is None:
        as_header = as_header & F.col("wordy") & F.col("low").rlike("|".join(sorted(w for w in begun if not any(x != w and x in w for x in begun))))
    looks = looks.withColumn("header", F.when(as_header, normalized_header(F.col("value"))))
    bits = sum((F.when(F.col(f"is_{r}"), F.lit(1 << (COUNT * i)).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(ROLES)), F.lit(0).cast("long"))
    # few cells are headers: their points are found apart from the code that all cells run through
    points = F.element_at(F.transform(F.array("header"), lambda h: sum((F.shiftleft(_header_points(h, r).cast("long"), 4 * i) for i, r in enumerate(ROLES)), F.lit(0).cast("long"))), 1)
    short = looks.select("file", "sheet", "col_no", "row_no", "total", bits.alias("bits"), "code", F.when(F.col("header").isNotNull(), points).otherwise(F.lit(0).cast("long")).alias("points"), "header")
    if memory is None:
        short = short.withColumn("learned", F.lit(0))
    else:
        role = sum((F.when(F.col("role") == r, 1 << i).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0))
        recalled = memory.where("header <> ''").groupBy("header").agg(F.bit_or(role).alias("learned"))
        short = short.join(recalled, "header", "left").withColumn("learned", F.coalesce("learned", F.lit(0)))
    k = F.row_number().over(Window.partitionBy("file", "sheet", "col_no").orderBy("total", "row_no"))
    first = short.withColumn("seen", ~F.col("total") & (k <= HEAD_ROWS + SAMPLE)).where("seen OR points <> 0 OR learned <> 0").select("file", "sheet", "col_no", "total", "row_no", "seen", "bits", "code", "points", "learned")
    dealt = first if together and memory is None else first.repartition("file", "sheet")
    sheets = dealt.sortWithinPartitions("file", "sheet", "col_no", "total", "row_no").drop("total")
    types = {f.name: f.dataType for f in cells.schema}
    schema = T.StructType([T.StructField(n, types.get(n, t)) for n, t in (("file", None), ("sheet", None), ("part", T.IntegerType()), ("header_row", T.LongType()), ("role", T.StringType()), ("col_no", None), ("points", T.IntegerType()), ("sure", T.BooleanType()))])
    return map_in_arrow(sheets, _sheet_by_sheet(to_arrow_schema(schema)), schema)
