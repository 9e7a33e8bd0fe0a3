"""GS1 barcodes as Column expressions. Codes are text: leading zeros count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import ColumnLike, _c, blank, let, strip

#: Line ends of scanned text.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def digits_only(x: ColumnLike) -> Column:
    return F.regexp_replace(blank(x), r"\D", "")


def _is_digits(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


#: Digits that fit a long.
LONG_DIGITS = 18


def _weighted(code: Column, digits: int) -> Column:
    """The sum of a number's digits with weights 3 and 1 in turn from the right; `digits` is the most it has. Arithmetic on one long, which stays in generated code."""
    n = code.cast("bigint")
    at = lambda k: n if k == 0 else F.call_function("div", n, F.lit(10**k).cast("bigint"))
    return sum((at(k) % 10 * (3 if k % 2 == 0 else 1) for k in range(digits)), F.lit(0))


def ean13_check_digit(body12: ColumnLike) -> Column:
    """Of twelve digits; null for anything else."""
    x = _c(body12)
    return F.when(x.rlike("^[0-9]{12}$"), _check(x, 12))


def _check(body: Column, digits: int) -> Column:
    return ((10 - _weighted(body, digits) % 10) % 10).cast("int")


def is_valid_ean13(x: ColumnLike) -> Column:
    code = blank(x)
    return F.when(code.rlike("^[0-9]{13}$"), F.substr(code, F.lit(13), F.lit(1)).cast("int") == _check(F.substr(code, F.lit(1), F.lit(12)), 12)).otherwise(False)


def mod10_check_digit(body: ColumnLike) -> Column:
    """Weights 3 and 1 from the right, for bodies of any length; null for anything but digits."""
    x = _c(body)
    long = F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda a, i: a + F.substr(F.reverse(x), i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.when(_is_digits(x), F.when(F.length(x) <= LONG_DIGITS, _check(x, LONG_DIGITS)).otherwise((10 - long % 10) % 10))


def is_valid_gtin(x: ColumnLike) -> Column:
    """Eight, twelve, thirteen or fourteen digits with their check digit."""
    return let(strip(blank(x)), valid_digits)


def valid_digits(code: Column) -> Column:
    """is_valid_gtin of a code without white space at its ends."""
    body = let(F.substr(code, F.lit(1), F.length(code) - 1).cast("bigint"), lambda n: _check(n, 13))
    return F.when(code.rlike("^([0-9]{8}|[0-9]{12,14})$"), body == F.substr(code, F.length(code), F.lit(1)).cast("int")).otherwise(False)


def gtin_format(x: ColumnLike) -> Column:
    code = blank(x)
    n = F.length(code)
    return F.when(~_is_digits(code), F.lit("non_numeric")).when(n == 8, F.lit("ean8")).when(n == 12, F.lit("upc12")).when(n == 13, F.lit("ean13")).when(n == 14, F.lit("gtin14")).otherwise(F.concat(F.lit("len"), n.cast("string")))


def gtin14(x: ColumnLike) -> Column:
    """Digits padded with zeros to fourteen; all else, and longer ones, as they are."""
    code = blank(x)
    return F.when(_is_digits(code) & (F.length(code) < 14), F.lpad(code, 14, "0")).otherwise(code)


def make_gtin(prefix: str, number: ColumnLike) -> Column:
    """A valid EAN-13 of a three-digit prefix and a running number."""
    body = F.concat(F.lit(prefix), F.lpad(_c(number).cast("string"), 9, "0"))
    return F.concat(body, ean13_check_digit(body).cast("string"))


def barcode_status(x: ColumnLike) -> Column:
    code = blank(x)
    n = F.length(code)
    return F.when(~_is_digits(code), F.lit("non_numeric")).when(n == 13, F.when(is_valid_ean13(code), F.lit("ean13")).otherwise(F.lit("ean13_bad_check"))).when(n == 12, F.lit("upc12")).when(n == 8, F.lit("ean8")).otherwise(F.lit("other_length"))


def gtin_similarity(query: ColumnLike, candidate: ColumnLike) -> Column:
    """1 for equal codes; 0 where either is missing or the query is a valid EAN-13 of another product; else up to half for a misread that is one or two edits away."""
    q, c = blank(query), blank(candidate)
    near = F.greatest(F.lit(0.0), 0.5 * (1 - F.levenshtein(q, c) / F.lit(3.0)))
    return F.when((q == "") | (c == ""), F.lit(0.0)).when(q == c, F.lit(1.0)).when(is_valid_ean13(q), F.lit(0.0)).otherwise(near)


def scanned_lines(text: ColumnLike) -> Column:
    return F.filter(F.transform(F.split(blank(text), LINE_ENDS), strip), lambda x: x != "")


def pick_barcode(text: ColumnLike) -> Column:
    """The first run of digits with a right check digit, lines taken one by one without their spaces; else the longest run of 12 or 13 digits, the first of equals; else ''."""
    runs = F.flatten(F.transform(F.split(blank(text), LINE_ENDS), lambda line: F.regexp_extract_all(F.replace(line, F.lit(" "), F.lit("")), F.lit(r"(\d{8,14})"), F.lit(1))))
    valid = F.filter(runs, is_valid_ean13)
    full = F.filter(runs, lambda r: F.length(r) == 13)
    short = F.filter(runs, lambda r: F.length(r) == 12)
    return F.coalesce(F.get(valid, F.lit(0)), F.get(full, F.lit(0)), F.get(short, F.lit(0)), F.lit(""))


def extract_fields(text: ColumnLike) -> Column:
    """brand, product_name, quantity and gtin of a scanned label: first line, second line, what is left of the first line with NET WEIGHT, and the picked code."""
    lines = scanned_lines(text)
    weight = F.coalesce(F.get(F.filter(lines, lambda x: F.upper(x).contains("NET WEIGHT")), F.lit(0)), F.lit(""))
    return F.struct(
        F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("brand"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("product_name"),
        strip(F.replace(F.upper(weight), F.lit("NET WEIGHT"), F.lit(""))).alias("quantity"),
        pick_barcode(text).alias("gtin"),
    )


def arbitrate_fields(plain: Column, sharp: Column) -> Column:
    """Two readings of one label: the plain one, the sharpened one where a field is blank, and its code only where the plain code fails and it doesn't."""
    text = lambda f: F.when(strip(blank(plain[f])) != "", plain[f]).otherwise(sharp[f]).alias(f)
    code = F.when(~is_valid_ean13(plain["gtin"]) & is_valid_ean13(sharp["gtin"]), sharp["gtin"]).when(blank(plain["gtin"]) != "", plain["gtin"]).otherwise(sharp["gtin"])
    return F.struct(text("brand"), text("product_name"), text("quantity"), code.alias("gtin"))
