"""European number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Units that are left out wherever they stand, and what counts as a plain number.
UNITS = r"(?i)m²|m2|m¹|m1|lm"
PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
GROUPED = r"^-?[0-9]{1,3}(\.[0-9]{3})+$"
#: Type of a parsed number.
NUMBER = "decimal(18,4)"


def _bare(text: Column) -> Column:
    """Without blanks and units."""
    return F.regexp_replace(F.regexp_replace(text, "[\u00a0 ]", ""), UNITS, "")


def _once(value: Column, function) -> Column:
    """function of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _european(bare: Column) -> Column:
    """The number in what is left of a text: all but digits, commas, points and minus signs is noise.
    The later of comma and point parts the decimals; a lone comma does with up to two digits behind
    it, a lone point unless three follow."""
    own = F.regexp_replace(F.ltrim(bare, F.lit("+-")), "[^0-9,.-]", "")

    def read(x: Column) -> Column:
        after = lambda mark: F.instr(F.reverse(x), mark) - 1
        comma, point = F.instr(x, ",") > 0, F.instr(x, ".") > 0
        both = F.when(after(",") < after("."), F.translate(F.translate(x, ".", ""), ",", ".")).otherwise(F.translate(x, ",", ""))
        lone = F.when(after(",") <= 2, F.translate(x, ",", ".")).otherwise(F.translate(x, ",", ""))
        thousands = (after(".") == 3) & (F.instr(x, ".") == F.length(x) - 3)
        return F.when(comma & point, both).when(comma, lone).when(point & thousands, F.translate(x, ".", "")).otherwise(x)

    value = _once(_once(own, read), lambda x: F.when(x.rlike(PLAIN), x.try_cast(NUMBER)))
    return F.when(F.startswith(bare, F.lit("-")), -value).otherwise(value)


def parse_number(text: Column) -> Column:
    """Number of a text such as "1.234,50 m2" or "€ 1,234": a plain number as it stands, unless points
    part groups of three; else as a European one.  "n.v.t.", "-" and texts without a number are null."""

    def read(own: Column) -> Column:
        nothing = own.isin("", "-") | (F.lower(own) == "n.v.t.")
        return F.when(~nothing, _once(_bare(own), lambda x: F.when(x.rlike(PLAIN) & ~x.rlike(GROUPED), x.try_cast(NUMBER)).otherwise(_european(x))))

    return _once(F.trim(text), read)


def machine_number(text: Column) -> Column:
    """Number of a sheet's cell: a point parts decimals, however many; with a comma, or if it is no plain
    number, as ``parse_number``."""
    bare = _bare(F.trim(text))
    return F.when((F.instr(text, ",") > 0) | ~bare.rlike(PLAIN), parse_number(text)).otherwise(bare.try_cast(NUMBER))


def is_machine_number(text: Column) -> Column:
    """Whether ``machine_number`` of a text that isn't null finds one: a single run of up to twelve digits without signs and
    without an m before it (which may be a unit's), and usual forms, are known as such; only others are read."""
    usual = text.rlike(r"^[^0-9,.+\-mM]*[0-9]{1,12}[^0-9,.+\-]*$") | text.rlike(r"^[0-9]{1,12}(\.[0-9]*|,[0-9]{1,2})$")
    return F.when(~text.rlike("[0-9]"), False).when(usual, True).otherwise(machine_number(text).isNotNull())


def sheet_number(cell: Column) -> Column:
    """``machine_number`` of a column: its usual forms, digits with a point or one comma before up to two
    digits, are cast as they are; only others are read by its rules."""
    usual = cell.rlike(r"^[0-9]{1,12}(\.[0-9]*|,[0-9]{1,2})?$")
    return F.when(usual, F.translate(cell, ",", ".").try_cast(NUMBER)).otherwise(machine_number(cell))


def cell_number(cell: Column) -> Column:
    """``parse_number`` of a column: digits with a point or comma before one or two more are cast as they are,
    and an empty cell is null; only others are read by its rules."""
    usual = cell.rlike(r"^[0-9]{1,12}([.,][0-9]{1,2})?$")
    return F.when(usual, F.translate(cell, ",", ".").try_cast(NUMBER)).when(cell != "", parse_number(cell))


def european(value: Column, decimals: int = 2) -> Column:
    """1234.5 as "1.234,50"."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def euro(value: Column) -> Column:
    return F.concat(F.lit("€ "), european(value, 2))


def hours_label(hours: Column) -> Column:
    """4 as "4u", 4.50 as "4,5u"."""
    return F.concat(F.regexp_replace(european(hours, 2), r",?0+$", ""), F.lit("u"))


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a tolerance; null equals null only."""
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False)) | (a.isNull() & b.isNull())


def guarded(a: Column, b: Column, least: float = 0.0001) -> Column:
    """a / b; null where either is too small to mean a value."""
    return F.when((a > least) & (b > least), a / b)
