"""Patterns, white space and field rules of ledgers, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("date", "item", "qty", "price", "total")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")

# fixed values
DATE = r"(?U)\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
MONEY = r"(?U)[£$€]?\d+[.,]\d{1,2}"
MONEY_VALUE = r"(?U)\d+\.\d{1,2}"
INT = r"(?U)\d+"
# white space and line ends as the readers of texts know them
BLANKS = r"(?U)[\s\x1c-\x1f]+"
# each character that BLANKS knows
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\R|[\x1c-\x1e]"
ROWS = "array<struct<row_pos:int,date:string,item:string,qty:string,price:string,total:string>>"


def is_whole(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def strip(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(BLANK))


def find_date(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?U)(?=\d){DATE}", 0)  # only a digit is worth a look


def norm_money(token: Column) -> Column:
    return F.replace(F.regexp_extract(token, r"(?U)\d+[.,]\d{1,2}", 0), F.lit(","), F.lit("."))


def norm_date(value: Column) -> Column:
    return F.translate(strip(value), "./", "--")


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip), lambda x: x != "")


def strip_trailing_numeric(item: Column) -> Column:
    plain = F.btrim(F.regexp_replace(item, BLANKS, " "))
    cut = F.regexp_replace(plain, r"(?U)(?:(?:^|\s+)(?:\d+|[£$€]?\d+[.,]\d{1,2}))+$", "")
    return F.when(F.right(plain, F.lit(1)).rlike(r"(?U)\d"), cut).otherwise(plain)


def original_stem(name: Column) -> Column:
    return F.regexp_replace(name, "_clean$", "")


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def processed_name(name: Column) -> Column:
    """The name of the cleaned image of an image file."""
    return F.concat(F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", ""), F.lit("_clean.png"))


@cache
def _plain_forms() -> str:
    """Each character beyond ASCII that is made of ASCII ones and marks, and those, as the text of a map."""
    forms = []
    for point in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if plain:
            forms.append(f"{chr(point)}\x02{plain}")
    return "\x01".join(forms)


def to_ascii(text: Column) -> Column:
    """The text with accents taken off and joined letters parted; what is made of no ASCII character is left out."""
    known = F.str_to_map(F.lit(_plain_forms()), F.lit("\x01"), F.lit("\x02"))
    plain = F.transform(F.split(text, ""), lambda c: F.when(c <= "\x7f", c).otherwise(F.coalesce(F.element_at(known, c), F.lit(""))))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(plain, "")).otherwise(text)


def unique_stem(name: Column, at: Column) -> Column:
    """The time in UTC to a microsecond, and the stem of a file name made safe, or `upload` where nothing of it is left.

    Safe are ASCII letters, digits, dots, dashes and underscores, other letters in their plain
    form; path marks and blanks become underscores.
    """
    plain = F.regexp_replace(F.translate(to_ascii(F.coalesce(name, F.lit(""))), "/\\", "  "), r"\A\s+|\s+\z", "")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s+", "_"), r"[^A-Za-z0-9_.\-]", ""), r"\A[._]+|[._]+\z", "")
    stem = F.regexp_replace(safe, r"(?<=.)\.[^.]*$", "")
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("_"), F.when(stem == "", "upload").otherwise(stem))
