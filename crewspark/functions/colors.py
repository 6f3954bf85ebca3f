"""Colours that follow from codes and places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from crewspark.functions.geometry import color_distance, hex_rgb

#: Colours of known floor codes.
CODES = {
    "v01": "#848482", "v01.a": "#be0032", "v01.b": "#f38400", "v01.c": "#dcd300", "v01.d": "#008856", "v01.e": "#c026d3", "v01.f": "#1d4ed8", "v01.g": "#7c3aed",
    "v02": "#e68fac", "v03": "#5eead4", "v04": "#8db600", "v05": "#0067a5", "v06": "#604e97", "v07": "#882d17", "v08": "#2b3d26", "v09": "#222222", "v10": "#b3446c",
}
#: Degrees from one hue to the next, hues a seed, and how near two colours clash.
STEP, SEED_HUES, CLASH, STEPS = 137.508, 0.38196601125, 52, 16


def hsl_hex(hue: Column, saturation: Column, lightness: Column) -> Column:
    """#rrggbb of a hue in degrees and percentages."""
    s, l = saturation / 100, lightness / 100  # noqa: E741
    strength = s * F.least(l, 1 - l)

    def part(shift: int) -> Column:
        k = (F.lit(shift) + F.pmod(hue, F.lit(360.0)) / 30) % 12
        value = l - strength * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.round(value * 255, 0).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), part(0), part(8), part(4))


def code_color(code: Column, known: dict[str, str] = CODES, prefix: str = "material:") -> Column:
    """A known code's colour; any other code's from its digest, turned on until it is clear of all known
    ones.  A blank code has none."""
    own = F.lower(F.trim(code))
    listed = F.coalesce(*[F.when(own == k, v) for k, v in known.items()], F.lit(None).cast("string"))
    seed = F.conv(F.left(F.sha2(F.concat(F.lit(prefix), own), 256), F.lit(8)), 16, 10).cast("bigint")
    taken = F.array(*[F.lit(v) for v in known.values()])

    def derived(n: Column) -> Column:
        turned = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: hsl_hex(n * SEED_HUES + i * STEP, 62 + n % 16, 36 + F.floor(n / 256) % 12))
        free = F.filter(F.slice(turned, 1, STEPS), lambda c: F.forall(taken, lambda t: color_distance(hex_rgb(c), hex_rgb(t)) > CLASH))
        return F.coalesce(F.get(free, F.lit(0)), F.element_at(turned, -1))

    found = F.element_at(F.transform(F.array(seed), derived), 1)
    return F.when(own != "", F.coalesce(listed, found))


def place_color(place: Column, palette: Sequence[str]) -> Column:
    """The colour of the n-th row (from 0) of a list: the palette's, then hues a golden angle apart."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in palette]), place.cast("int")), hsl_hex(place * STEP, F.lit(72.0), F.lit(38.0)))
