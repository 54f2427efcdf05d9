"""Rows of random texts, held against a token-by-token reading in plain Python."""

import random
import re

from inkledger.functions import semantics as S
from inkledger.operators import extraction

DATE = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
MONEY, INT = r"[£$€]?\d+[.,]\d{1,2}", r"\d+"
WORDS = ["2026-01-03", "3/4/26", "(1.2.2026)", "2026-01-0345", "x2026-01-03", "£1.50", "2,5", "12.345", "$7.", "7", "٣", "40", "tea", "é", "-", "£", "1-2-3", "a.b"]
GAPS = [" ", "  ", "\t", "\n", "\r\n", "\n \n", " ", "\x1c", "\x1f", " ", "\x0b"]


def whole(pattern, token):
    return re.fullmatch(pattern, token) is not None


def first_date(text):
    found = re.search(DATE, text)
    return found.group() if found else ""


def row(tokens):
    rest = [t for t in tokens if not whole(DATE, t)]
    money = [re.search(r"\d+[.,]\d{1,2}", t).group().replace(",", ".") for t in rest if whole(MONEY, t)]
    at = next((k for k, t in enumerate(rest) if whole(INT, t)), None)
    item = " ".join(t for k, t in enumerate(rest) if k != at and not whole(MONEY, t))
    return first_date(" ".join(tokens)), item, "" if at is None else rest[at], money[-2] if len(money) > 1 else "", money[-1] if money else ""


def rows(text):
    lines = [x for x in (line.split() for line in (text or "").splitlines()) if x]
    full = [x for x in lines if first_date(" ".join(x)) and any(whole(MONEY, t) for t in x) and len(x) >= 3]
    if len(full) >= 2:
        return "flat", [row(x) for x in lines if first_date(" ".join(x))]
    made = []
    for token in (t for x in lines for t in x):
        if whole(DATE, token):
            made.append([])
        if made:
            made[-1].append(token)
    return "tokens", [row(x) for x in made]


def texts():
    rng = random.Random(5)
    weights = [30, 3, 1, 12, 2, 1, 1, 1, 1, 3, 1]
    made = [None, "", " \n ", "2026-01-03", " \r\n2026-01-03 1 tea 2.50\r\n"]
    for _ in range(600):
        some = rng.choices(WORDS, k=rng.randrange(1, 30))
        made.append(rng.choice(["", " ", "\n"]) + "".join(w + rng.choices(GAPS, weights)[0] for w in some))
    # one line of many tokens, and many lines: patterns must not recurse
    return made + ["2026-01-03 " + "tea " * 100_000 + "7 1.50", "\n".join(["2026-01-03 tea 7 1.50"] * 20_000), "tea " * 100_000, "7 " * 50_000]


def test_rows_as_token_by_token(spark):
    cases = texts()
    df = spark.createDataFrame(list(enumerate(cases)), "stem int, text string").repartition(4)
    shapes = {r.stem: r.s for r in df.select("stem", extraction.shape(df.text).alias("s")).collect()}
    got = {k: [] for k in range(len(cases))}
    for r in sorted(extraction.extract_fields(df).collect(), key=lambda r: (r.stem, r.row_pos)):
        assert r.row_pos == len(got[r.stem])
        got[r.stem].append(tuple(r[f] for f in S.FIELDS))
    for k, text in enumerate(cases):
        assert (shapes[k], got[k]) == rows(text), repr(text)[:300]
    assert {"flat", "tokens"} == set(shapes.values())


def test_no_texts_and_columns_of_other_names(spark):
    empty = spark.createDataFrame([], "stem int, text string")
    assert extraction.extract_fields(empty).columns == ["stem", "row_pos", *S.FIELDS] and extraction.extract_fields(empty).count() == 0
    odd = spark.createDataFrame([("2026-01-03 tea 7 1.50", "a", "b", "c")], "`the.text` string, _lines string, _row string, `x.y` string")
    r = extraction.extract_fields(odd, "the.text").first()
    assert r.asDict() == {"_lines": "a", "_row": "b", "x.y": "c", "row_pos": 0, "date": "2026-01-03", "item": "tea", "qty": "7", "price": "", "total": "1.50"}
    alone = spark.createDataFrame([("2026-01-03 tea 7 1.50",)], "text string")
    assert extraction.extract_fields(alone).columns == ["row_pos", *S.FIELDS] and extraction.extract_fields(alone).count() == 1
