"""Text and quantity scalars as Column expressions. Missing and empty are the same everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(x: ColumnLike) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def strip(x: ColumnLike) -> Column:
    """Any Unicode white space, unlike trim()."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalize_text(x: ColumnLike) -> Column:
    """Lower case without punctuation; inner white space becomes one space. Edges are stripped first, so a space that punctuation covered stays."""
    bare = F.regexp_replace(F.lower(strip(blank(x))), r"(?U)[^\w\s]", "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def format_g(x: Column) -> Column:
    """A number to six significant digits without trailing zeros, in exponent form from 1e6 and below 1e-4."""
    return let(x, _format_g)


def _format_g(x: Column) -> Column:
    rounded = F.format_string("%.5e", x)
    return let(F.struct(x.alias("x"), rounded.alias("rounded"), F.regexp_extract(rounded, r"e([+-]\d+)$", 1).try_cast("int").alias("power")), _by_power)


def _by_power(given: Column) -> Column:
    x, rounded, power = given["x"], given["rounded"], given["power"]
    digits = F.regexp_replace(F.regexp_extract(rounded, r"^(-?[\d.]+)e", 1), r"\.?0+$", "")
    # An ordinary number is rounded to 5 - power places. Places are fixed in a format, so each power is its own branch.
    cases = F.when(x == 0, F.lit("0"))
    for e in range(-4, 6):
        cases = cases.when(power == e, F.regexp_replace(F.regexp_replace(F.format_string(f"%.{5 - e}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    wide = F.concat(digits, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return cases.otherwise(wide)


def normalize_quantity(x: ColumnLike) -> Column:
    """The amount in grams or millilitres as text, "N x M unit" multiplied out. A multipack has to start the text and name its unit in lower case; other amounts may
    stand anywhere in any case. Anything else is stripped and lower-cased. A number that can't be read gives null."""
    return let(blank(x), _normalize_quantity)


#: What counts as a multipack and as an amount, on which results depend.
PACK, AMOUNT = r"^(\d+)\s*[xX]\s*([\d.]+)\s*(kg|g|l|ml)", r"(?i)([\d.]+)\s*(kg|g|l|ml)"


def _normalize_quantity(text: Column) -> Column:
    found = {"pack": (PACK, 1), "each": (PACK, 2), "pack_unit": (PACK, 3), "amount": (AMOUNT, 1), "unit": (AMOUNT, 2)}
    parts = (F.regexp_extract(text, p, g).alias(n) for n, (p, g) in found.items())
    return let(F.struct(text.alias("text"), *parts), _quantity_of_parts)


def _quantity_of_parts(part: Column) -> Column:
    number = lambda n: part[n].try_cast("double")
    is_pack, is_single = part["pack"] != "", part["amount"] != ""
    amount = F.when(is_pack, number("each") * number("pack")).otherwise(number("amount"))
    unit = F.when(is_pack, part["pack_unit"]).otherwise(F.lower(part["unit"]))
    base = F.when(unit.isin("kg", "g"), F.lit("g")).otherwise(F.lit("ml"))
    shown = F.concat(format_g(amount * F.when(unit.isin("kg", "l"), F.lit(1000.0)).otherwise(F.lit(1.0))), base)
    return F.when(is_pack | is_single, shown).otherwise(F.lower(strip(part["text"])))


def alias_key(brand: ColumnLike, name: ColumnLike) -> Column:
    """Brand and name in lower case with all white space made one space; punctuation stays."""
    return strip(F.regexp_replace(F.lower(F.concat(blank(brand), F.lit(" "), blank(name))), r"(?U)\s+", " "))


def match_key(x: ColumnLike) -> Column:
    """Only a-z and 0-9."""
    return F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]", "")


def spaced_key(x: ColumnLike) -> Column:
    """As match_key, with one space for each run of anything else inside."""
    return F.trim(F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", " "))


def found_in(brand: ColumnLike, text: ColumnLike, shortest: int = 4) -> Column:
    """Whether the brand's key is part of the text's; keys below `shortest` would turn up by chance."""
    key = match_key(brand)
    return (F.length(key) >= shortest) & match_key(text).contains(key)


def same_filled(a: ColumnLike, b: ColumnLike) -> Column:
    """Equal and not empty, after stripping."""
    x, y = strip(blank(a)), strip(blank(b))
    return (x != "") & (x == y)


def truncate_name(x: ColumnLike) -> Column:
    """Without the last word, where there are more than two."""
    words = F.split(strip(x), r"(?U)\s+")
    return F.when(F.size(words) > 2, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(_c(x))


def reformat_quantity(x: ColumnLike) -> Column:
    """Grams as kilograms to three places, millilitres as litres to two; all else stays, "kg" and multipacks too."""
    text = strip(x)
    grams = F.regexp_extract(text, r"^(.*)g$", 1).try_cast("double")
    millis = F.regexp_extract(text, r"^(.*)ml$", 1).try_cast("double")
    return F.when(text.endswith("g") & ~text.contains("x"), F.when(grams.isNotNull(), F.format_string("%.3fkg", grams / 1000)).otherwise(text)).when(text.endswith("ml"), F.when(millis.isNotNull(), F.format_string("%.2fL", millis / 1000)).otherwise(text)).otherwise(text)
