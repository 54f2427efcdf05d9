"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: How many consecutive sentences make a span, and how many words it has at least; shorter repeats, such as stock lines, stay.
SPANS = {1: 25, 2: 15, 3: 15}
#: A sentence runs to the end of its marks or line breaks and the blanks after them; the sentences of a text, joined, are the text.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r]*|[^.!?\n]+"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _plain(sentence: Column) -> Column:
    """Letters and digits in lower case with single spaces between."""
    return F.trim(F.lower(F.regexp_replace(sentence, r"[^\p{L}\p{N}]+", " ")))


def _spans(text: Column, lengths: dict[int, int]) -> Column:
    """Array of (first, last, h1, h2): sentence numbers and a 128-bit hash of the run's words."""
    numbered = F.filter(
        F.transform(sentences(text), lambda s, i: F.struct(i.alias("i"), _plain(s).alias("p"))), lambda x: x["p"] != ""
    )
    numbered = F.transform(
        numbered, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), (F.length(x["p"]) - F.length(F.replace(x["p"], F.lit(" "))) + 1).alias("n"))
    )

    def runs(all_: Column) -> Column:
        def span(k: int, least: int):
            def of(x: Column, j: Column) -> Column:
                run = [x] + [F.get(all_, j + d) for d in range(1, k)]
                key = [F.lit(k), *[y["p"] for y in run]]
                words = sum((y["n"] for y in run[1:]), run[0]["n"])
                made = F.struct(x["i"].alias("first"), run[-1]["i"].alias("last"), F.xxhash64(F.lit(1), *key).alias("h1"), F.xxhash64(F.lit(2), *key).alias("h2"))
                return F.when(words >= least, made)  # null beyond the last sentence too

            return of

        return F.array_compact(F.concat(*[F.transform(all_, span(k, least)) for k, least in sorted(lengths.items())]))

    # one element, so that the sentences are cut and read once for all lengths
    return F.flatten(F.transform(F.array(numbered), runs))


def row_hash(text: Column) -> Column:
    """64 bits of a text, to tell rows apart that share a key."""
    return F.xxhash64(text.isNull(), text)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: dict[int, int] | None = None) -> DataFrame:
    """Rows (key, row, gone): the numbers of the sentences that a span repeated from elsewhere covers.

    A document is its key and its text, by a hash (row), so that texts under one key, or
    none, are told apart. Of spans with equal words the first stays: that of the least key
    (null before all), under one key of the least hash, and in it the earliest. The counts
    are combined before the shuffle, so a passage that stands in a third of the documents is
    one row a task; joining it back, AQE may split its key.
    """
    found = F.explode(_spans(F.col(f"`{text}`"), lengths or SPANS)).alias("s")
    spans = docs.select(F.col(f"`{key}`").alias("key"), row_hash(F.col(f"`{text}`")).alias("row"), found)
    # first and last sentence as one number: a span is a row of few fields, as all of them are shuffled
    spans = spans.select("key", "row", "s.h1", "s.h2", (F.shiftleft(F.col("s.first").cast("long"), 32) + F.col("s.last")).alias("ends"))
    place = F.struct("key", "row", "ends")
    firsts = spans.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("kept")).where("n > 1").drop("n")
    later = spans.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("kept")))
    covered = F.sequence(F.shiftright("ends", 32).cast("int"), F.col("ends").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return later.select("key", "row", F.explode(covered).alias("i")).groupBy("key", "row").agg(F.collect_set("i").alias("gone"))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: dict[int, int] | None = None) -> DataFrame:
    """docs with `text` freed of repeated passages, and n_sentences and n_removed.

    Rows equal in key and text count as one document read twice: all keep what is first
    there and lose the same sentences. Rows that share only the key, or have none, are
    documents of their own.
    Null and empty texts have no sentences and become ''. Columns of those names are replaced.
    """
    docs = docs.drop("n_sentences", "n_removed")
    gone, all_, kept, id_, row = fresh(docs, "_gone", "_all", "_kept", "_key", "_row")
    found = repeated(docs, key, text, lengths).select(F.col("key").alias(id_), F.col("row").alias(row), F.col("gone").alias(gone))
    out = docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col(id_)) & (row_hash(F.col(f"`{text}`")) == F.col(row)), "left").drop(id_, row)
    out = out.withColumn(all_, sentences(F.col(f"`{text}`")))
    numbers = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(kept, F.array_except(numbers, F.coalesce(gone, F.array().cast("array<int>"))))
    joined = F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "")
    out = out.withColumn(text, joined).withColumn("n_sentences", F.size(all_).cast("long")).withColumn("n_removed", (F.size(all_) - F.size(kept)).cast("long"))
    return out.drop(gone, all_, kept)


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t\r]*|[^.!?\n]+') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM d),
p AS (SELECT doc_id, i, trim(lower(regexp_replace(part, '[^\p{L}\p{N}]+', ' ', 'g'))) AS p FROM u),
s AS (SELECT doc_id, i, p, length(p) - length(replace(p, ' ', '')) + 1 AS n FROM p WHERE p <> ''),
w AS (SELECT *, lead(p, 1) OVER o AS p1, lead(p, 2) OVER o AS p2, lead(n, 1) OVER o AS n1, lead(n, 2) OVER o AS n2,
             lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, i AS last, p AS k FROM w WHERE n >= 25
      UNION ALL SELECT doc_id, i, i1, p || chr(10) || p1 FROM w WHERE n + n1 >= 15
      UNION ALL SELECT doc_id, i, i2, p || chr(10) || p1 || chr(10) || p2 FROM w WHERE n + n1 + n2 >= 15),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i FROM f WHERE nth > 1)
SELECT d.doc_id, CAST(len(d.parts) AS BIGINT) AS n_sentences, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, coalesce(x.text, '') AS text
FROM d LEFT JOIN (
  SELECT u.doc_id, count(g.i) AS n, string_agg(part, '' ORDER BY u.i) FILTER (WHERE g.i IS NULL) AS text
  FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id) x ON x.doc_id = d.doc_id"""
