"""Merkle manifest of a dataset: a root over all rows, and for each row the digests that lead from it to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: The fields of a row that its leaf covers, in this order; how many nodes have one parent; how many levels one deal of the nodes serves.
FIELDS, ARITY, LEVELS = ("doc_id", "source", "lang", "n_chars", "text"), 3, 3
_SPAN = ARITY**LEVELS


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, in lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that fields put together can be told apart: its length in bytes, a colon, itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*[field(fields[f]) for f in FIELDS])


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `i`, a row's place in its group from 0, and `n`, the rows of the group.

    Rows are range-sorted by group and order and written; ranges are numbered apart and
    shifted by the counts of those before them, so a group that holds most rows is numbered
    in many tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    ranged = checkpoint(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # of these rows a group has as many as ranges at most
    counts = ranged.groupBy("_range", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return ranged.join(starts, ["_range", group]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _runs(nodes: DataFrame) -> DataFrame:
    """nodes with `block`, `path` through LEVELS levels, and `above`, the node that many levels up.

    A window over the nodes of one parent, in order, sees the whole run: that is the parent's
    preimage, and what stands before and behind a node are its siblings. A parent takes part
    in the next level once, by the first of its nodes. One deal by blocks of ARITY ** LEVELS
    nodes serves all windows; a group with one node has no level more.
    """
    out = nodes.withColumn("block", F.floor(F.col("i") / _SPAN)).repartition("g", "block").withColumn("above", F.col("node"))
    steps, count = [], F.col("n")
    for level in range(LEVELS):
        below, width = ARITY**level, ARITY ** (level + 1)
        run = Window.partitionBy("g", "block", F.floor(F.col("i") / width)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.col("i") % below == 0
        out = out.withColumn(f"_run{level}", F.collect_list(F.when(first, F.col("above"))).over(run))
        own = F.col(f"_run{level}")
        at = (F.floor(F.col("i") / below) % ARITY).cast("int")
        side = lambda x: F.array_join(x, "")
        step = F.struct(side(F.slice(own, 1, at)).alias("before"), side(F.slice(own, at + 2, ARITY)).alias("behind"))
        steps.append(F.when(count > 1, step))
        out = out.withColumn("above", F.when(count > 1, digest(F.array_join(own, ""))).otherwise(F.col("above")))
        count = F.ceil(count / ARITY)
    out = out.withColumn("path", F.array_compact(F.array(*steps)))
    return out.drop(*[f"_run{level}" for level in range(LEVELS)])


def climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes (g, i, n, node) and, LEVELS levels apart, those above them, up to one node a group; each is written."""
    levels = [checkpoint(nodes)]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        up = _runs(levels[-1]).where(F.col("i") % _SPAN == 0)
        levels.append(checkpoint(up.select("g", "block", F.ceil(F.col("n") / _SPAN).alias("n"), F.col("above").alias("node")).withColumnRenamed("block", "i")))
        most = -(-most // _SPAN)
    return levels


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest nodes with top's columns (g, path, ...), their path put before that of the top."""
    extra = [c for c in top.columns if c not in ("g", "path")]
    down = levels[-1].join(top, "g")
    for nodes in reversed(levels[:-1]):
        above = down.select("g", F.col("i").alias("block"), F.col("path").alias("_more"), *extra)
        down = _runs(nodes).drop("above").join(above, ["g", "block"]).withColumn("path", F.concat("path", "_more")).drop("_more", "block")
    return down


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, start, lambda x, s: digest(s["before"], x, s["behind"]))


def proof(path: Column) -> Column:
    """Digest of the siblings along a path, from the leaf to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["behind"])), ""))


def manifest(leaves: DataFrame, group: str = "source", key: str = "doc_id") -> DataFrame:
    """leaves with `path` (array of before, behind), `subroot` of the group and `root`; `leaf` is among their columns.

    In a group, null being one, leaves stand by key, nulls first, under one key by leaf; rows
    equal in both are interchangeable. Every ARITY consecutive nodes become the digest of
    their digests, a last run of fewer too, until one is left; the groups' last nodes, null
    first, then in the order of bytes, lead to the root likewise. A single leaf is its own
    subroot. An empty table has no rows and no root. Columns called path, subroot or root are
    replaced; others come along.

    A group that holds most rows is cut into ranges and blocks like any other; a path has as
    many steps as the tree levels, and only one node in ARITY ** LEVELS hands its path down.
    """
    names = {c: f"_c{k}" for k, c in enumerate(c for c in leaves.columns if c.lower() not in ("path", "subroot", "root"))}
    rows = leaves.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    rows = rows.withColumn("g", F.coalesce(F.concat(F.lit("1"), F.col(names[group]).cast("string")), F.lit("")))
    levels = climb(placed(checkpoint(rows), "g", [names[key], names["leaf"]]).withColumn("node", F.col(names["leaf"])))
    subroots = levels[-1].select("g", "node")
    sources = climb(placed(subroots.select(F.col("g").alias("source"), F.lit("").alias("g"), F.col("node").alias("subroot")), "g", ["source"]).withColumn("node", F.col("subroot")))
    none = F.array().cast("array<struct<before:string,behind:string>>")
    tops = descend(sources, sources[-1].select("g", none.alias("path"), F.col("node").alias("root")))
    out = descend(levels, checkpoint(tops.select(F.col("source").alias("g"), "path", "subroot", "root")))
    return out.select(*[F.col(x).alias(c) for c, x in names.items()], "path", "subroot", "root")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {f: F.col(f) for f in FIELDS}
    cut = fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    # a row that isn't tampered with, or loses nothing by it, has no second leaf
    again = F.when(hit & F.contains("text", F.lit("\n")), leaf(cut))
    made = manifest(docs.select("doc_id", "source", leaf(fields).alias("leaf"), again.alias("again")))
    made = made.withColumn("folded_root", folded(F.coalesce("again", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda p: [ascii(substr({text}, p, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda s, x: {step}), 4294967295)"


_LEAF = " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in FIELDS)
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || source, '') AS g, sha256({_LEAF}) AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({_LEAF.replace("CAST(text AS VARCHAR)", "replace(text, chr(10), '')")}) END AS again
  FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
up AS (
  SELECT g, 0 AS lvl, i, n, leaf AS node FROM k
  UNION ALL SELECT g, lvl + 1, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(node, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, lvl, n, i // {ARITY}),
s AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, n, subroot AS node FROM s
  UNION ALL SELECT lvl + 1, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(node, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, n, i // {ARITY}),
steps AS (
  SELECT k.g, k.i, lvl, coalesce(string_agg(node, '' ORDER BY u.i) FILTER (WHERE u.i < k.i // CAST({ARITY}**lvl AS BIGINT)), '') AS l, coalesce(string_agg(node, '' ORDER BY u.i) FILTER (WHERE u.i > k.i // CAST({ARITY}**lvl AS BIGINT)), '') AS r
  FROM k JOIN up u ON u.g = k.g AND u.n > 1 AND u.i // {ARITY} = k.i // CAST({ARITY}**lvl AS BIGINT) // {ARITY} GROUP BY k.g, k.i, lvl),
above AS (
  SELECT s.g, lvl, coalesce(string_agg(node, '' ORDER BY u.i) FILTER (WHERE u.i < s.i // CAST({ARITY}**lvl AS BIGINT)), '') AS l, coalesce(string_agg(node, '' ORDER BY u.i) FILTER (WHERE u.i > s.i // CAST({ARITY}**lvl AS BIGINT)), '') AS r
  FROM s JOIN top u ON u.n > 1 AND u.i // {ARITY} = s.i // CAST({ARITY}**lvl AS BIGINT) // {ARITY} GROUP BY s.g, s.i, lvl),
p AS (SELECT g, i, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY g, i),
q AS (SELECT g, list(l || '|' || r ORDER BY lvl) AS path FROM above GROUP BY g),
w AS (
  SELECT k.*, subroot, (SELECT node FROM top WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
  FROM k JOIN s ON s.g = k.g LEFT JOIN p ON p.g = k.g AND p.i = k.i LEFT JOIN q ON q.g = k.g),
f AS (
  SELECT *, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(again, leaf), path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM w)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""
