"""Recognised text to ledger rows: a text is cut into row texts by patterns, and each is read by patterns, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import semantics as S


def _token(pattern: str) -> str:
    """A whole token of the kind, with the blank before it."""
    return rf" (?:{pattern})(?=[ \n]|\z)"


DATE_TOKEN, MONEY_TOKEN = _token(S.DATE), _token(S.MONEY)
#: The beginning of a line that has a date, an amount and three tokens or more.
COMPLETE = rf"(?md)^(?= [^ \n]+ [^ \n]+ [^ \n])(?=[^\n]*?(?=(?U:\d))(?:{S.DATE}))(?=[^\n]*{MONEY_TOKEN})"
#: A line with a date.
DATED = rf"(?md)^(?=[^\n]*?(?=(?U:\d))(?:{S.DATE}))[^\n]+"
#: What only a text has that isn't yet of printable ASCII with single blanks and line ends.
ODD = r"[^ -~\n]|[ \n][ \n]"


def plain(text: Column) -> Column:
    """The text's lines that have tokens, parted by \\n, with one blank before each token and no other."""
    text, ends = F.coalesce(text, F.lit("")), F.lit(" \n")
    lines = F.regexp_replace(text, S.LINE_END, "\n")
    blanks = F.regexp_replace(lines, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    odd = F.regexp_replace(F.btrim(blanks, ends), r" ?\n[ \n]*", "\n ")
    return F.concat(F.lit(" "), F.when(text.rlike(ODD), odd).otherwise(F.replace(F.btrim(text, ends), F.lit("\n"), F.lit("\n "))))


def complete_line(line: Column) -> Column:
    """A date, an amount and three words or more."""
    return plain(line).rlike(COMPLETE)


def _flat(lines: Column) -> Column:
    return F.regexp_count(lines, F.lit(COMPLETE)) >= 2


def shape(text: Column) -> Column:
    return F.when(_flat(plain(text)), F.lit("flat")).otherwise(F.lit("tokens"))


def segments(lines: Column) -> Column:
    """The runs of tokens that begin at a token that is a date; what stands before the first is left out."""
    marked = F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit("")), rf"(?={DATE_TOKEN})", "\n")
    return F.slice(F.split(marked, "\n"), 2, 1 << 30)


def row_texts(lines: Column) -> Column:
    """The tokens of each row of a text's plain lines, in order: lines with a date if two at least are complete, else runs of tokens from dates on."""
    return F.when(_flat(lines), F.regexp_extract_all(lines, F.lit(DATED), F.lit(0))).otherwise(segments(lines))


def row_fields(row: Column) -> dict[str, Column]:
    """The fields of one row text: amounts from the end, the first whole number, and the rest as item."""
    rest = F.regexp_replace(row, DATE_TOKEN, "")
    money = F.regexp_extract_all(rest, F.lit(MONEY_TOKEN), F.lit(0))
    from_end = lambda k: F.coalesce(S.norm_money(F.get(money, F.size(money) - k)), F.lit(""))
    words = F.regexp_replace(rest, MONEY_TOKEN, "")
    return {
        "date": S.find_date(row),
        "item": F.substr(F.regexp_replace(words, rf"(?s)\A(.*?){_token(S.INT)}", "$1"), F.lit(2)),
        "qty": F.substr(F.regexp_extract(words, _token(S.INT), 0), F.lit(2)),
        "price": from_end(2),
        "total": from_end(1),
    }


def extract_fields(texts: DataFrame, text: str = "text", name_item: Callable[[Column], Column] | None = None) -> DataFrame:
    """The other columns of texts with row_pos and the five fields, one row for each ledger row; '' where a field is missing.

    `name_item` gives an item, from the row's text as written, where none is left; without it
    such items are ''. A null or empty text has no row.
    """
    others = [F.col(f"`{c}`") for c in texts.columns if c != text]
    made = "_" * max(map(len, texts.columns))  # longer names than any there is
    # the lines are made once, then read by several patterns
    lines = texts.select(*others, plain(F.col(f"`{text}`")).alias(f"{made}lines"))
    rows = lines.select(*others, F.posexplode(row_texts(F.col(f"`{made}lines`"))).alias("row_pos", f"{made}row"))
    row = F.col(f"`{made}row`")
    fields = row_fields(row)
    if name_item is not None:
        named = F.coalesce(name_item(F.substr(row, F.lit(2))), F.lit(""))
        fields["item"] = F.when(fields["item"] == "", named).otherwise(fields["item"])
    return rows.select(*others, "row_pos", *[fields[f].alias(f) for f in S.FIELDS])
