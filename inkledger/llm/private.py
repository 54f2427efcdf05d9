"""Personal data: numbers and dates are permuted in their format under a key, other finds are named by a keyed hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Rounds of the Feistel network. The key is the caller's; this one is for tests.
ROUNDS, KEY = 10, "public test key"

#: Letters beyond ASCII, without the marks among them.
BEYOND = "À-῿Ⰰ-⿯぀-퟿豈-﷏"
#: What stands before a secret's value, in any case: a name that ends in one of these words and perhaps more, or a bearer's scheme.
NAMED = r"(?i:passwords?|passwd|pwd|passphrase|tokens?|secrets?|credentials?|(?:api|access|auth|private|client|secret)[_\-]?keys?)(?:[_\-][A-Za-z0-9]+)*\d*[\"']?"
HEAD = rf"(?:{NAMED}\s{{0,3}}[=:]\s{{0,3}}|{NAMED}\s(?i:is|was)\s(?=\S*[0-9!@#$%^&*])|(?<![A-Za-z])(?i:bearer)\s{{1,3}}(?=\S*\d))"
#: A value runs to its closing quote, or to the blank behind it without the marks of the sentence.
VALUE = r"(?:\"[^\"\n]+\"|'[^'\n]+'|\S*[^\s\"'.,;:!?)\]}>])"
#: The user of an address of the web, and the password between it and the host.
USER, PASSWORD = r"://[^\s/:@\"']*:", r"(?:[^\s/]+(?=@)|[^\s@]+(?=@))"
BARE = (
    r"AKIA[0-9A-Z]{16,}", r"gh[pousr]_[A-Za-z0-9]{16,}", r"github_pat_[A-Za-z0-9_]{16,}", r"glpat-[A-Za-z0-9_\-]{16,}", r"AIza[A-Za-z0-9_\-]{30,}", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}",
    r"sk-[A-Za-z0-9_\-]{16,}", r"xox[abprs]-[A-Za-z0-9\-]{10,}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+)?",
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^\x00]*?(?:-----END [A-Z ]{0,30}PRIVATE KEY-----|\Z)",
)

#: Behind a blank, what is a number of its own and no part of the one before.
_OWN = r"(?:\d{13,19}|\d{4}[ .\-]\d{4}[ .\-]\d{4}[ .\-]\d{1,7}|\d{4}[ .\-]\d{6}[ .\-]\d{4,5}|\d{3}[.\-]\d{3}[.\-]\d{4}|\d{3}-\d{2}-\d{4}|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}-\d{1,2}-\d{4})(?!\d)"
#: Kinds of finds in order: of those that begin at one place the first is taken. No find of a secret or an address has an upper bound.
KINDS = {
    "secret": rf"(?:{HEAD}{VALUE}|{USER}{PASSWORD}|(?<![A-Za-z0-9])(?:{'|'.join(BARE)}))",
    "email": rf"(?<![A-Za-z0-9._%+\-{BEYOND}])[A-Za-z0-9._%+\-{BEYOND}]++@(?:[A-Za-z0-9\-{BEYOND}]+\.)+(?:xn--[A-Za-z0-9\-]+|[A-Za-z{BEYOND}]{{2,}})",
    "ip": r"(?<!\d)(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "date": r"(?<!\d)(?<!\d[.\-/])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![.\-/]?\d)",
    # under code 1 ten digits follow; elsewhere groups of digits
    "phone": r"(?<!\d)\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\d)(?<!\d[.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![.\-]?\d)",
    "ssn": r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?![\-]?\d)",
    # whole; four and more groups of four; 4-6-5; any other grouping
    "card": rf"(?<!\d)(?:\d{{13,19}}(?!\d)|\d{{4}}([ .\-])\d{{4}}(?:\3\d{{4}})++(?:\3\d{{1,7}})?+(?!\d)|\d{{4}}([ .\-])\d{{6}}\4\d{{4,5}}(?!\d)|\d(?:-?\d| (?!{_OWN})\d){{12,18}}(?!\d))",
}


def _round(key: Column, n: Column, side: Column, tag: Column) -> Column:
    """52 bits that key, round, the side that stays and the format give."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tag, n.cast("string"), side.cast("string")), 256), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, mod_left: Column, mod_right: Column, key: Column, tag: Column, back: bool = False) -> Column:
    """(l, r): a keyed permutation of the pairs with 0 <= left < mod_left, 0 <= right < mod_right; `back` undoes it."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    sign = -1 if back else 1

    def turn(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + sign * F.pmod(_round(key, n, s["r"], tag), mod_left), mod_left)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(_round(key, n, s["l"], tag), mod_right), mod_right)).alias("r"),
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, start, turn)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: Column, tag: Column, back: bool = False) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length; shorter and longer ones as they are."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    form = F.concat_ws("|", tag, n.cast("string"))
    moved = lambda p: F.concat(F.lpad(p["l"].cast("string"), a, "0"), F.lpad(p["r"].cast("string"), n - a, "0"))
    pair = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a), _ten(a), _ten(n - a), key, form, back)
    # through a one-element array, so that the network is run once and read twice
    return F.when(n.between(2, 36), F.transform(F.array(pair), moved)[0]).otherwise(digits)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits, in order, replaced by `digits`."""
    chars = F.split(shape, "")
    done = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("k"),
        ),
    )
    return done["out"]


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum with the last digit taken once."""
    back = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    parts = F.transform(
        back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _one_card(find: Column, key: Column, back: bool) -> Column:
    digits = _only_digits(find)
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"), back)
    check = lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    return _refill(find, F.transform(F.array(body), check)[0])


def card(find: Column, key: Column, back: bool = False) -> Column:
    """All digits of a card number but the check digit are permuted, and that is made right again; what fails the check stays.

    A find may hold other numbers beside the card's. From its first group of digits on, the
    fewest groups that make 13 to 19 digits and pass the check are a card number; the next is
    looked for behind it.
    """

    def read(x: Column) -> Column:
        groups, marks = x["groups"], x["marks"]
        n = F.size(groups)
        joined = lambda i, k: F.array_join(F.slice(groups, i + 1, k), "")
        sound = lambda d: F.length(d).between(13, 19) & (_luhn_sum(d) % 10 == 0)
        least = lambda i: F.coalesce(F.get(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: sound(joined(i, k))), 0), F.lit(0))

        def part(i: Column, k: Column) -> Column:
            return F.array_join(F.transform(F.sequence(i, i + k - 1), lambda g: F.concat(groups[g], F.when(g < i + k - 1, F.get(marks, g)).otherwise(""))), "")

        def step(s: Column, i: Column) -> Column:
            def taken(k: Column) -> Column:
                one = F.when(k > 0, _one_card(part(i, F.greatest(k, F.lit(1))), key, back)).otherwise(groups[i])
                size = F.greatest(k, F.lit(1))
                return F.struct(F.concat(s["out"], one, F.coalesce(F.get(marks, i + size - 1), F.lit(""))).alias("out"), (size - 1).alias("skip"))

            passed = F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip"))
            return F.when(s["skip"] > 0, passed).otherwise(F.transform(F.array(least(i)), taken)[0])

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit("").alias("out"), F.lit(0).alias("skip")), step)["out"]

    cut = F.struct(F.split(find, "[ .-]").alias("groups"), F.regexp_extract_all(find, F.lit("[ .-]"), F.lit(0)).alias("marks"))
    return F.transform(F.array(cut), read)[0]


#: fixed values: country codes of one and of two digits; all others have three
CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def phone(find: Column, key: Column, back: bool = False) -> Column:
    """The country code stays, the other digits are permuted, however they are grouped; without a plus the code is 1.

    Numbers of less than 8 or more than 15 digits stay.
    """
    digits = _only_digits(find)
    code = F.when(find.startswith("+"), F.regexp_extract(digits, CODES, 0)).otherwise("1")
    rest = F.when(find.startswith("+"), F.substring(digits, F.length(code) + 1, F.length(digits))).otherwise(digits)
    new = permute_digits(rest, key, F.concat_ws("|", F.lit("phone"), code), back)
    shown = F.when(find.startswith("+"), F.concat(code, new)).otherwise(new)
    return F.when(F.length(digits).between(8, 15), _refill(find, shown)).otherwise(find)


def ssn(find: Column, key: Column, back: bool = False) -> Column:
    """Numbers that can be given out are permuted among themselves: areas 001 to 899 but 666, no part of zeros; others stay."""
    area, group, serial = (F.regexp_extract(find, r"^(\d{3})-(\d{2})-(\d{4})$", k).cast("int") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - (area > 666).cast("int")
    pair = feistel(left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"), back)

    def text(p: Column) -> Column:
        a = p["l"] + 1
        parts = ((a + (a >= 666).cast("int"), 3), (F.floor(p["r"] / 9999) + 1, 2), (p["r"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, F.transform(F.array(pair), text)[0]).otherwise(find)


def ip(find: Column, key: Column, back: bool = False) -> Column:
    """Four numbers up to 255 are permuted as 32 bits; others stay, as do those written with leading zeros."""
    part = F.transform(F.split(find, r"\."), lambda x: x.cast("int"))
    pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("ip"), back)
    text = lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string"))
    valid = (F.array_max(part) <= 255) & (F.array_join(F.transform(part, lambda x: x.cast("string")), ".") == find)
    return F.when(valid, F.transform(F.array(pair), text)[0]).otherwise(find)


#: Days of 400 years, which are the same days again, as a product for the two sides of the network; the day number of 1600-01-01.
CYCLE, CYCLE_LEFT, CYCLE_RIGHT, CYCLE_START = 146_097, 189, 773, -135_140


def date(find: Column, key: Column, back: bool = False) -> Column:
    """A day of the years 1600 to 1999 or 2000 to 2399 is permuted among those of its 400 years; what is no date stays.

    Year first, or else day before month; if only month before day gives a date, that. Where
    a day or month below ten has one digit, those of the new date have no zero before them.
    """
    mark = F.substring(F.regexp_extract(find, r"[-/.]", 0), 1, 1)
    p = F.split(find, r"[-/.]")
    year_first = F.length(p[0]) == 4
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    bare = find.rlike(r"(?<!\d)\d(?!\d)")
    dmy, mdy = made(p[2], p[1], p[0]), made(p[2], p[0], p[1])
    day = F.when(year_first, made(p[0], p[1], p[2])).otherwise(F.coalesce(dmy, mdy))
    offset = F.unix_date(day) - CYCLE_START
    cycle, within = F.floor(offset / CYCLE), F.pmod(offset, F.lit(CYCLE))
    pair = feistel(F.floor(within / CYCLE_RIGHT), within % CYCLE_RIGHT, F.lit(CYCLE_LEFT), F.lit(CYCLE_RIGHT), key, F.lit("date"), back)

    def text(q: Column) -> Column:
        new = F.date_from_unix_date((cycle * CYCLE + CYCLE_START + q["l"] * CYCLE_RIGHT + q["r"]).cast("int"))
        form = lambda f: F.date_format(new, f) if f == "yyyy" else F.when(bare, F.date_format(new, f[0])).otherwise(F.date_format(new, f))
        return (
            F.when(year_first, F.concat_ws("|", form("yyyy"), form("MM"), form("dd")))
            .when(dmy.isNotNull(), F.concat_ws("|", form("dd"), form("MM"), form("yyyy")))
            .otherwise(F.concat_ws("|", form("MM"), form("dd"), form("yyyy")))
        )

    valid = day.isNotNull() & offset.between(0, 2 * CYCLE - 1)
    return F.when(valid, F.replace(F.transform(F.array(pair), text)[0], F.lit("|"), mark)).otherwise(find)


def email(find: Column, key: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(find)), 256), 1, 20), F.lit("@example.invalid"))


def secret(find: Column, key: Column) -> Column:
    """What stands before the value, such as `password=`, stays, and so do quotes around it."""
    head = F.regexp_extract(find, rf"^(?:{HEAD}[\"']?|{USER})", 0)
    rest = F.substring(find, F.length(head) + 1, F.length(find))
    quote = F.when(head.rlike("[\"']$"), F.regexp_extract(rest, "[\"']$", 0)).otherwise("")
    value = F.substring(rest, F.lit(1), F.length(rest) - F.length(quote))
    return F.concat(head, F.lit("secret-"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("secret"), value), 256), 1, 20), quote)


FORMS = {"secret": secret, "email": email, "ip": ip, "date": date, "phone": phone, "ssn": ssn, "card": card}


def _pattern() -> str:
    """All kinds in one pattern; the date's and the card's groups are the only ones that are numbered.

    The kinds of numbers stand behind one look at the character they begin with.
    """
    some = lambda *kinds: "|".join(f"(?:{KINDS[k]})" for k in kinds)
    return rf"(?=[A-Za-z\-:])(?:{some('secret')})|(?=[A-Za-z0-9._%+\-{BEYOND}])(?:{some('email')})|(?=[0-9+(])(?:{some('ip', 'date', 'phone', 'ssn', 'card')})"


#: What every find has one of: a digit, the mark of an address or of a value, or the beginning of a bare secret.
GATE = r"[0-9@=:]|AKIA|gh[pousr]_|github_pat|glpat-|AIza|_live_|_test_|sk-|xox[abprs]-|eyJ|PRIVATE KEY|(?i:passw|passphrase|pwd|token|secret|credential)"


def kind_of(find: Column) -> Column:
    out = None
    for kind, p in KINDS.items():
        if kind == "secret":
            continue
        own = p.replace(r"\3", r"\1").replace(r"\4", r"\2") if kind == "card" else p  # its groups when it stands alone
        whole = find.rlike(rf"\A(?:{own})\z")
        out = F.when(whole, F.lit(kind)) if out is None else out.when(whole, F.lit(kind))
    return out.otherwise(F.lit("secret"))


def pseudonyms(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with `text` pseudonymised and `finds`, an array of (kind, changed) in the order of the text.

    Card numbers (Luhn's check), dates of the calendar, IPv4 addresses, telephone numbers (8
    to 15 digits) and social security numbers become others of their format, the same value
    always the same other, a telephone number also where it is grouped otherwise; the key
    undoes it. E-mail addresses and secrets become names from a keyed hash. What has the form
    but fails its check stays, and its `changed` is false. Texts without what every find has
    (GATE) are not searched further. Null texts stay null. `finds` is replaced.
    """
    k = F.lit(key)
    docs = docs.drop("finds")
    gaps, hits, made = fresh(docs, "_gaps", "_hits", "_made")
    t = F.col(f"`{text}`")
    out = docs.withColumn(hits, F.when(t.rlike(GATE), F.regexp_extract_all(t, F.lit(_pattern()), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = F.size(hits) > 0

    def change(x: Column) -> Column:
        kind = kind_of(x)

        def new(y: Column) -> Column:
            value = None
            for name, form in FORMS.items():
                hit = y["kind"] == name
                value = F.when(hit, form(y["x"], k)) if value is None else value.when(hit, form(y["x"], k))
            return F.struct(y["kind"].alias("kind"), y["x"].alias("old"), value.alias("new"))

        return F.transform(F.array(F.struct(kind.alias("kind"), x.alias("x"))), new)[0]

    out = out.withColumn(made, F.when(found, F.transform(hits, change)).otherwise(F.array().cast("array<struct<kind:string,old:string,new:string>>")))
    out = out.withColumn(gaps, F.when(found, F.split(t, _pattern(), -1)))
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(made), i)["new"], F.lit("")))), "")
    out = out.withColumn(text, F.when(found, joined).otherwise(t))
    finds = F.transform(made, lambda x: F.struct(x["kind"].alias("kind"), (x["old"] != x["new"]).alias("changed")))
    return out.withColumn("finds", finds).drop(gaps, hits, made)


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("finds", lambda x: (x["kind"] == kind) & x["changed"])).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(kind) for kind in KINDS], F.exists("finds", lambda x: x["changed"]).alias("private"), "text")
