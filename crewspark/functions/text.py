"""Codes, tokens, room numbers and labels in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell no product apart.
STOP_WORDS = ("voor", "naar", "with", "from", "type", "kleur", "inclusief", "exclusief", "leveren", "aanbrengen")


def folded(text: Column) -> Column:
    return F.lower(F.trim(text))


def product_codes(text: Column) -> Column:
    """Runs of capitals and digits that hold a digit, such as "PVC12", in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,4}[0-9]{2,6})\b"), F.lit(1)))


def room_numbers(text: Column) -> Column:
    """Numbers like A-00-12 or 1.04; one that is the start of a longer one is left out."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]?-?[0-9]{1,2}[.-][0-9]{2,3}[a-z]?)\b"), F.lit(1)))
    return F.filter(found, lambda n: ~F.exists(found, lambda m: (m != n) & m.startswith(n)))


def distinctive_tokens(text: Column, least: int = 4) -> Column:
    parts = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS)))


def tokens_align(a: Column, b: Column, least: int = 5) -> Column:
    """Every token of a begins, or is begun by, one of b."""
    fits = lambda x, y: ((F.length(x) >= least) & y.startswith(x)) | ((F.length(y) >= least) & x.startswith(y)) | (x == y)
    return F.forall(a, lambda x: F.exists(b, lambda y: fits(x, y)))


def loose_name(text: Column) -> Column:
    """A name for comparison: lower case, letters and digits only, runs of a letter as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]", ""), r"(.)\1+", "$1")


def natural_key(text: Column) -> Column:
    """A text in lower case whose numbers are padded to five digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(\d+)", "0000$1"), r"0+(\d{5})", "$1")


def first_keyword(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The name of the first rule one of whose words the text holds, in any case."""
    t, out = F.lower(text), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def room_sort_key(number: Column) -> Column:
    """Digits padded to five; other texts after all numbers, empty ones last."""
    padded = natural_key(number)
    return F.when(F.coalesce(F.trim(number), F.lit("")) == "", "zzz").when(number.rlike(r"^\d"), padded).otherwise(F.concat(F.lit("yyy."), padded))


def expand_rooms(number: Column, most: int = 30) -> Column:
    """"A-00-12/15" as its rooms; other texts as themselves."""
    parts = F.struct(*[F.regexp_extract(number, r"^(.*?)(\d+)/(\d+)$", i).alias(c) for i, c in enumerate(("head", "a", "b"), 1)])

    def expand(p: Column) -> Column:
        low, high = p["a"].try_cast("int"), p["b"].try_cast("int")
        rooms = F.transform(F.sequence(low, high), lambda n: F.concat(p["head"], F.lpad(n.cast("string"), F.length(p["a"]), F.lit("0"))))
        return F.when((low <= high) & (high - low < most), rooms).otherwise(F.array(number))

    # the text is taken apart once, not for each of its rooms
    return F.element_at(F.transform(F.array(parts), expand), 1)


def _storey(flat: Column) -> Column:
    after, before = F.regexp_extract(flat, r"verdieping\s*(\d+)\b", 1), F.regexp_extract(flat, r"\b(\d+)e?\s*verdieping\b", 1)
    return (
        F.when(flat.rlike(r"\b(tussenlaag|middenlaag)\b"), "tussenlaag")
        .when(flat.rlike(r"begane\s*grond"), "begane grond")
        .when(flat.rlike(r"installatie\s*ruimt"), "installatie ruimten")
        .when(flat.rlike(r"\b(kelder|souterrain)\b"), "kelder")
        .when(after != "", F.concat(F.lit("verdieping "), after))
        .when(before != "", F.concat(F.lit("verdieping "), before))
    )


def floor_label(text: Column) -> Column:
    """The storey that a text names, after its phase if it names one; null without a storey."""
    flat = folded(text)
    phase, storey = F.regexp_extract(flat, r"\bfase\s*(\d+)\b", 1), _storey(flat)
    own = F.when(flat.contains("souterrain"), "souterrain").otherwise(storey)
    may = flat.rlike("verdieping|laag|grond|ruimt|kelder|souterrain")  # most lines name none, and aren't searched for each
    return F.when(may & storey.isNotNull(), F.when(phase != "", F.concat(F.lit("fase "), phase, F.lit(" "), own)).otherwise(storey))


def floor_base(text: Column) -> Column:
    """The storey without phase or section; a text that names none, as it is."""
    flat = F.regexp_replace(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"\bfase\s*\d+\b|\bsporthal\b", ""), r"\s+", " ")
    own = F.trim(F.replace(flat, F.lit("souterrain"), F.lit("kelder")))
    # the text is brought into its form once, not for each pattern that is looked for in it
    return F.element_at(F.transform(F.array(own), lambda t: F.coalesce(floor_label(t), t)), 1)


def same_storey(a: Column, b: Column) -> Column:
    """Whether two texts may mean one storey; unknown ones fit any."""
    x, y = floor_base(a), floor_base(b)
    return x.isin("", "onbekend") | y.isin("", "onbekend") | (x == y)


def row_label(file: Column, row: Column) -> Column:
    """"file#row", in lower case."""
    return F.concat_ws("#", folded(file), row.cast("string"))


def phone(text: Column, country: str = "31") -> Column:
    digits = F.regexp_replace(text, r"[^\d+]", "")
    return F.when(digits.startswith("+"), digits).when(digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, 3, 1000))).when(digits.startswith("0"), F.concat(F.lit(f"+{country}"), F.substring(digits, 2, 1000)))


def identity_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("0")) for p in parts])


def split_glued_number(label: Column) -> Column:
    """"00.12kantoor" as struct<number, name>; a label without a leading number has none."""
    number = F.regexp_extract(label, r"^\s*([A-Za-z]?-?\d[\d.\-]*\d|\d)", 1)
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.trim(F.substr(F.ltrim(label), F.length(number) + 1)).alias("name"))


def repaired_number(text: Column) -> Column:
    """A room number as read by OCR: letters that stand for digits inside it, blanks and commas put right."""
    flat = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"\s+", ""), ",", ".")
    return F.when(flat.rlike(r"[0-9]"), F.concat(F.regexp_extract(flat, r"^([A-Z]-)?", 0), F.translate(F.regexp_replace(flat, r"^([A-Z]-)?", ""), "OILSB", "01158"))).otherwise(flat)


def repaired_room_number(text: Column) -> Column:
    """A room number in lower case without blanks, with points for commas; one that was read with its
    storey and digits twice ("00.0.077") put right ("0.07")."""
    flat, twice = F.translate(F.regexp_replace(F.lower(text), r"\s+", ""), ",", "."), r"^(\d)\d?[.\-](\d{1,2})[.\-]\d{1,2}(\d)([a-z]?)$"
    return F.regexp_replace(flat, twice, "$1.$2$3$4")


def activity_key(item: Column, unit: Column, description: Column) -> Column:
    """item:id:unit, else custom:name:unit, else line:unit; names in lower case."""
    u, name = F.coalesce(folded(unit), F.lit("")), F.coalesce(folded(description), F.lit(""))
    return F.when(item.isNotNull(), F.concat_ws(":", F.lit("item"), item, u)).when(name != "", F.concat_ws(":", F.lit("custom"), name, u)).otherwise(F.concat_ws(":", F.lit("line"), u))


def without_prefix(text: Column, prefix: Column) -> Column:
    """A line's name without the room that it begins with."""
    own = F.trim(text)
    cut = F.trim(F.regexp_replace(F.substr(own, F.length(F.trim(prefix)) + 1), r"^[\s:,–-]+", ""))
    return F.when((F.trim(prefix) != "") & F.startswith(F.lower(own), F.lower(F.trim(prefix))) & (cut != ""), cut).otherwise(own)


def finish_family(code: Column) -> Column:
    return F.split_part(folded(code), F.lit("."), F.lit(1))


def finish_compatible(a: Column, b: Column) -> Column:
    """Whether two codes can be one finish: equal, or of one family and not both of a kind of it."""
    x, y = folded(a), folded(b)
    kin = (finish_family(x) == finish_family(y)) & ~(x.contains(".") & y.contains("."))
    return (x == y) | ((x != "") & (y != "") & kin)


def preferred_finish(current: Column, incoming: Column) -> Column:
    """The code to keep of one that is there and one that comes: of two that fit the more specific, else
    the one that comes; null if both are blank."""
    x, y = F.nullif(folded(current), F.lit("")), F.nullif(folded(incoming), F.lit(""))
    return F.when(y.isNull() | (finish_compatible(x, y) & ~y.contains(".")), x).otherwise(y)


def one_line_address(street: Column, postcode: Column, town: Column) -> Column:
    """"Street 12a, 1234 AB Town" from what is given; null if nothing is."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    place = F.nullif(F.concat_ws(" ", given(postcode), given(town)), F.lit(""))
    return F.nullif(F.concat_ws(", ", given(street), place), F.lit(""))


def address_parts(address: Column) -> Column:
    """"Street 12a, 1234 AB Town" as struct<street, number, postcode, town>; what isn't there is null."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(address, r"^\s*(.*?)\s+(\d+\s*[A-Za-z]?(?:-\d+)?)\s*(?:,\s*(\d{4}\s?[A-Za-z]{2})?\s*(.*?))?\s*$", i)), F.lit(""))
    return F.struct(part(1).alias("street"), part(2).alias("number"), F.upper(F.regexp_replace(part(3), r"\s", "")).alias("postcode"), part(4).alias("town"))


def date_range_label(start: Column, end: Column) -> Column:
    """"3 t/m 7-2-2026", the first date shortened where month or year are the same."""
    whole = lambda d: F.date_format(d, "d-M-yyyy")
    head = F.when(F.year(start) != F.year(end), whole(start)).when(F.month(start) != F.month(end), F.date_format(start, "d-M")).otherwise(F.date_format(start, "d"))
    return F.when(end.isNull() | (start == end), whole(start)).otherwise(F.concat(head, F.lit(" t/m "), whole(end)))


def floor_from_number(number: Column) -> Column:
    """The storey that a room's number begins with ("2.14": verdieping 2; "0.03": begane grond), or null."""
    storey = F.nullif(F.regexp_extract(F.trim(number), r"^(\d{1,2})[.\-]\d+", 1), F.lit("")).cast("int")
    return F.when(storey == 0, "begane grond").when(storey.isNotNull(), F.concat(F.lit("verdieping "), storey.cast("string")))


def undoubled(letters: Column) -> Column:
    """"hhaall" as "hal": every second letter, where most pairs of letters are equal."""
    n = F.length(letters)
    firsts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(2))
    pairs = F.filter(firsts, lambda i: i < n)
    same = F.size(F.filter(pairs, lambda i: F.substr(letters, i, F.lit(1)) == F.substr(letters, i + 1, F.lit(1))))
    even = F.array_join(F.transform(firsts, lambda i: F.substr(letters, i, F.lit(1))), "")
    return F.when((n >= 4) & (same / F.floor(n / 2) >= 0.55), even).otherwise(letters)


def name_in_text(expected: Column, text: Column) -> Column:
    """Whether a text holds a name by its letters: as they are, with runs of a letter as one, with letters that
    were drawn twice, or (four letters and more, in a text that isn't much longer) in their order."""
    a, b = (F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]", "") for x in (expected, text))
    in_order = F.rlike(b, F.concat_ws(".*", F.split(a, "")))
    long = (F.length(a) >= 4) & (F.length(b) <= F.ceil(F.length(a) * 2.6))
    return (a != "") & (b != "") & (b.contains(a) | F.regexp_replace(b, r"(.)\1+", "$1").contains(a) | undoubled(b).contains(a) | (long & in_order))


def mobile_number(value: Column) -> Column:
    """A Dutch mobile number as 06 and eight digits, however it is written (+31, 0031, (0)6), or null."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\D+", ""), "^00", "")
    own = F.regexp_extract(digits, r"^(?:310?|0)(6\d{8})$", 1)
    return F.when(own != "", F.concat(F.lit("0"), own))


def phone_id(value: Column) -> Column:
    """A number with its country and without signs: a Dutch mobile as 316..., another one's digits without 00;
    null with fewer than eight."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\D+", ""), "^00", "")
    mobile = mobile_number(value)
    return F.when(mobile.isNotNull(), F.concat(F.lit("31"), F.substr(mobile, F.lit(2)))).when(F.length(digits) >= 8, digits)


def phone_shown(value: Column) -> Column:
    """A Dutch mobile as 06-12345678, other numbers as they are written."""
    mobile = mobile_number(value)
    return F.when(mobile.isNotNull(), F.concat(F.lit("06-"), F.substr(mobile, F.lit(3)))).otherwise(F.trim(F.coalesce(value, F.lit(""))))
