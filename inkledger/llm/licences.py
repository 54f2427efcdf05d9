"""Licence and rights statements by ordered signature rules."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, table

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_V = r"(?: version| v| ver)?"
_LIC = r"(?: public)? licen[cs]e"


def _creative_commons():
    kinds = {
        "cc-by": ("by", "attribution"),
        "cc-by-sa": ("by sa", "attribution share ?alike"),
        "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative)?s"),
        "cc-by-nc": ("by nc", "attribution non ?commercial"),
        "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
        "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
    }
    for label, (short, long) in kinds.items():
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            full = f"{label}-{v.replace(' ', '.')}"
            yield 20, full, "cc", f"cc {short}{_V} {v}"
            yield 20, full, "creativecommons", f"creativecommons org licenses {short} {v}"
            yield 20, full, "creative", f"creative commons {long}(?: international| unported| generic)?{_V} {v}"
        yield 60, label, "cc", f"cc {short}"
        yield 60, label, "creative", f"creative commons {long}"
    yield 20, "cc0-1.0", "cc0", f"cc0(?:{_V} 1 0)?"
    yield 20, "cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0"
    yield 40, "cc-pdm", "publicdomain", "creativecommons org publicdomain mark 1 0"
    yield 90, "cc", "creative", f"creative commons(?:{_LIC})?"


def _gnu():
    for label, name, short, versions in (
        ("gpl", "general", "gpl", ("1", "2", "3")),
        ("lgpl", "(?:lesser|library) general", "lgpl", ("2", "2 1", "3")),
        ("agpl", "affero general", "agpl", ("1", "3")),
        ("gfdl", "free documentation", "gfdl", ("1 1", "1 2", "1 3")),
    ):
        for v in versions:
            spelt = v if " " in v else f"{v}(?: 0)?"
            for later, text in (("-or-later", f"{_V} {spelt} or(?: at your option)? any later version"), ("-or-later", f"{_V} {spelt} or later"), ("-only", f"{_V} {spelt} only"), ("", f"{_V} {spelt}")):
                full = f"{label}-{v.replace(' ', '.')}{later}"
                rank = 10 if later else 30
                yield rank, full, name.split()[-1] if label != "gfdl" else "documentation", f"(?:gnu )?{name}{_LIC}{text}"
                yield rank, full, short, f"(?:gnu )?{short}{text}"
            yield 30, f"{label}-{v.replace(' ', '.')}", f"{short}v{v.split()[0]}", f"{short}v{v}"
        yield 70, label, name.split()[-1] if label != "gfdl" else "documentation", f"(?:gnu )?{name}{_LIC}"
        yield 80, label, "gnu", f"gnu {short}"
    yield 25, "gpl-exception-classpath", "classpath", "gpl with classpath exception|classpath exception"
    yield 25, "gpl-exception-gcc", "gcc", "gcc runtime library exception"


def _permissive():
    for label, keyword, names, versions in (
        ("apache", "apache", "apache(?: software)?", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
        ("cddl", "distribution", "common development and distribution", ("1 0", "1 1")),
        ("eupl", "european", "european union public", ("1 0", "1 1", "1 2")),
        ("artistic", "artistic", "artistic", ("1 0", "2 0")),
        ("afl", "academic", "academic free", ("1 1", "2 0", "2 1", "3 0")),
        ("osl", "open", "open software", ("1 0", "2 0", "2 1", "3 0")),
        ("zpl", "zope", "zope public", ("1 1", "2 0", "2 1")),
        ("cpl", "common", "common public", ("1 0",)),
        ("ofl", "sil", "sil open font", ("1 0", "1 1")),
        ("psf", "python", "python software foundation", ("2",)),
        ("php", "php", "php", ("3 0", "3 01")),
        ("lppl", "latex", "latex project public", ("1 0", "1 1", "1 2", "1 3")),
        ("ecl", "educational", "educational community", ("1 0", "2 0")),
        ("bsl", "boost", "boost software", ("1 0",)),
        ("odbl", "database", "open database", ("1 0",)),
        ("openrail", "openrail", "openrail", ("1 0",)),
    ):
        for v in versions:
            full = f"{label}-{v.replace(' ', '.')}"
            spelt = v if v != "2 0" else "2(?: 0)?"
            yield 20, full, keyword, f"(?:the )?{names}(?: licen[cs]e)?{_V} {spelt}"
        yield 60, label, keyword, f"{names} licen[cs]e"
    for label, keyword, text in (
        ("apache-2.0", "apache", "apache org licenses license 2 0"),
        ("mit", "mit", "mit licen[cs]e|licen[cs]ed under (?:the )?mit"),
        ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("mit-0", "mit", "mit no attribution|mit 0"),
        ("x11", "x11", "x11 licen[cs]e"),
        ("expat", "expat", "expat licen[cs]e"),
        ("isc", "isc", "isc licen[cs]e"),
        ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
        ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?"),
        ("bsd-3-clause", "bsd", "(?:modified|revised|new|3 clause) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?"),
        ("bsd-4-clause", "bsd", "(?:original|4 clause) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?"),
        ("bsd", "redistribution", "redistribution and use in source and binary forms"),
        ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
        ("zlib", "warranty", "this software is provided as is without any express or implied warranty"),
        ("unlicense", "unlicense", "(?:the )?unlicense"),
        ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
        ("wtfpl", "wtfpl", "wtfpl"),
        ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
        ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
        ("ncsa", "illinois", "university of illinois ncsa(?: open source licen[cs]e)?"),
        ("postgresql", "postgresql", "postgresql licen[cs]e"),
        ("openssl", "openssl", "openssl licen[cs]e"),
        ("sspl-1.0", "sspl", "sspl(?: v? ?1(?: 0)?)?"),
        ("sspl-1.0", "server", "server side public licen[cs]e"),
        ("busl-1.1", "business", "business source licen[cs]e(?: 1 1)?"),
        ("elastic-2.0", "elastic", "elastic licen[cs]e(?: 2 0)?"),
        ("commons-clause", "clause", "commons clause"),
        ("blue-oak-1.0.0", "oak", "blue oak model licen[cs]e(?: 1 0 0)?"),
        ("upl-1.0", "universal", "universal permissive licen[cs]e"),
        ("vim", "vim", "vim licen[cs]e"),
        ("ruby", "ruby", "ruby licen[cs]e"),
        ("perl", "perl", "same terms as perl(?: itself)?"),
        ("beerware", "beerware", "beerware"),
    ):
        yield 40, label, keyword, text
    yield 80, "bsd", "bsd", "bsd licen[cs]e"


def _rights():
    for rank, label, keyword, text in (
        (50, "public-domain", "domain", "(?:in|into|to) the public domain"),
        (85, "public-domain", "domain", "public domain"),
        (50, "reserved", "reserved", "all rights reserved"),
        (50, "some-rights-reserved", "reserved", "some rights reserved"),
        (50, "no-rights-reserved", "reserved", "no rights reserved"),
        (50, "reserved", "rechte", "alle rechte vorbehalten"),
        (50, "reserved", "droits", "tous droits réservés"),
        (50, "reserved", "derechos", "todos los derechos reservados"),
        (50, "proprietary", "proprietary", "proprietary and confidential|confidential and proprietary"),
        (50, "no-reproduction", "permission", "without(?: the)?(?: prior)?(?: written)? permission(?: of the (?:author|publisher))?"),
        (50, "fair-use", "fair", "fair (?:use|dealing)"),
        (50, "research-only", "research", "for(?: academic)? research(?: purposes| use)? only"),
        (50, "non-commercial", "commercial", "non ?commercial (?:use|purposes) only|not for commercial use"),
        (50, "non-commercial", "noncommercial", "noncommercial (?:use|purposes) only"),
        (55, "copyright", "copyright", r"copyright(?: c)?(?: \d{4}){1,8}"),
        (95, "copyright", "copyright", "copyright"),
        (50, "terms", "terms", "under the (?:following )?terms"),
        (50, "spdx", "spdx", r"spdx license identifier \S+"),
    ):
        yield rank, label, keyword, text


@cache
def rules() -> tuple[tuple[int, str, str, str], ...]:
    """(priority, label, keyword, pattern) in order: a lower priority comes first, then the earlier rule.

    A pattern is matched on a text's words joined by single spaces, between whole words, and
    only where the text has the keyword as a word.
    """
    found = [*_creative_commons(), *_gnu(), *_permissive(), *_rights()]
    return tuple(x for _, x in sorted(enumerate(found), key=lambda p: (p[1][0], p[0])))


def joined_words(text: Column) -> Column:
    """The text's words, A to Z lower-cased, joined by single spaces; null and wordless texts give ''."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.trim(plain)


def _count(text: Column) -> Column:
    """How many words stand in words joined by spaces, which may begin or end with a space."""
    t = F.trim(text)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1)


def _places(line: str, pattern: str) -> str:
    """SQL: array of (first, last) words of the pattern's matches, in order.

    Marks are put before and behind each match; the marked words' numbers are its ends. That
    takes one pass over the words, however many matches there are.
    """
    bounded = f"concat('(?<![^ ])(?:', {pattern}, ')(?![^ ])')"
    at = lambda test: f"filter(transform(w, (x, i) -> if({test}, i, null)), i -> i IS NOT NULL)"
    ends = f"arrays_zip({at('startswith(x, chr(1))')}, {at('endswith(x, chr(2))')})"
    marked = f"split(regexp_replace({line}, {bounded}, concat(chr(1), '$0', chr(2))), ' ')"
    found = f"transform(transform(array({marked}), w -> {ends})[0], z -> named_struct('first', z.`0`, 'last', z.`1`))"
    return f"if({line} RLIKE {bounded}, {found}, array())"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: n_words, base (places of the BASE phrases) and found (rule matches left standing).

    Row by row and without a shuffle. A text's distinct words are met with the rules'
    keywords first; only texts with a keyword are matched, and only with those keywords'
    rules. A match is dropped if its interval of words lies inside that of a match of an
    earlier priority, or inside a longer match of the same priority; of equal intervals
    the first rule's stays. A rule's matches don't overlap and none is longer than its
    pattern, so in order of their first words a match is held against as many before it as
    rules could have there; the work grows with the text, not its square. Null, empty and wordless texts have no matches. New columns
    replace those of the same name.
    """
    table_of = ", ".join(
        f"named_struct('rank', {rank}, 'n', {n}, 'label', '{label}', 'keyword', '{keyword}', 'pattern', r'{pattern}')"
        for n, (rank, label, keyword, pattern) in enumerate(rules())
    )
    base_of = ", ".join(f"named_struct('label', '{label}', 'keyword', '{phrase.split()[-1]}', 'pattern', '{phrase}')" for phrase, label in BASE.items())
    keywords = sorted({k for _, _, k, _ in rules()} | {p.split()[-1] for p in BASE})
    docs = docs.drop("n_words", "base", "found")
    line, words, keys, all_ = fresh(docs, "_line", "_words", "_keys", "_all")
    out = docs.withColumn(line, joined_words(F.col(f"`{text}`")))
    out = out.withColumn(words, F.split(line, " ")).withColumn("n_words", _count(F.col(line)).cast("long"))
    out = out.withColumn(keys, F.array_intersect(F.array(*map(F.lit, keywords)), words)).drop(words)
    places = lambda rule: _places(line, f"{rule}.pattern")
    hits = "flatten(transform(filter(array({0}), r -> array_contains({keys}, r.keyword)), r -> transform({1}, p -> {2})))"
    base = hits.format(base_of, places("r"), "named_struct('first', p.first, 'last', p.last, 'label', r.label)", keys=keys)
    found = hits.format(table_of, places("r"), "named_struct('first', p.first, 'last', p.last, 'rank', r.rank, 'n', r.n, 'label', r.label)", keys=keys)
    kind = "array<struct<first:int,last:int,label:string>>"
    wide = "array<struct<first:int,last:int,rank:int,n:int,label:string>>"
    gate = F.size(keys) > 0
    out = out.withColumn("base", F.when(gate, F.expr(base)).otherwise(F.expr(f"cast(array() AS {kind})")))
    out = out.withColumn(all_, F.when(gate, F.expr(found)).otherwise(F.expr(f"cast(array() AS {wide})")))
    # in order of first words, then of the longer, the earlier priority and rule: what holds a match stands before it
    in_order = f"array_sort(transform({all_}, x -> named_struct('first', x.first, 'back', -x.last, 'rank', x.rank, 'n', x.n, 'label', x.label)))"
    reach = f"size(array_distinct(transform({all_}, x -> x.n))) * array_max(transform({all_}, x -> x.last - x.first + 1))"
    left = f"""
      transform(transform(array(named_struct('s', {in_order}, 'w', {reach})), q -> filter(q.s, (x, k) ->
        NOT exists(slice(q.s, greatest(1, k + 1 - q.w), least(k, q.w)), y ->
          y.back <= x.back AND (y.rank < x.rank OR y.rank = x.rank AND (y.first < x.first OR y.back < x.back OR y.n < x.n)))))[0],
        x -> named_struct('first', x.first, 'last', -x.back, 'rank', x.rank, 'n', x.n, 'label', x.label))"""
    return out.withColumn("found", F.when(F.size(all_) > 0, F.expr(left)).otherwise(F.col(all_))).drop(line, keys, all_)


def op7_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda x: x["first"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: x["label"]))))
    # words inside a statement, as a part of at most ten words or of all words if those are fewer
    told = F.aggregate("found", F.lit(0), lambda s, x: s + x["last"] - x["first"] + 1)
    score = F.when(F.size(both) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (told + F.lit(1.0)) / (F.least("n_words", F.lit(10)) + F.lit(1.0))))
    return seen.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        score.alias("score"),
        F.size("found").alias("n_found"),
    )
