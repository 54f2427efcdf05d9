"""Conversations brought into legal form by the cheapest edits, found by a fold over their turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table
from .merkle import crc32_sql

#: What edits cost, and what a truncated turn that stays costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A conversation is folded in stretches of so many turns.
STRETCH = 64
#: Where a conversation may stand: nothing yet, behind the system's turn, behind the user's, behind the assistant's.
STATES = ("e", "s", "u", "a")
INK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _least(*options: Column | None) -> Column:
    """Of (cost, audit) structs the cheapest, of those the one first in ASCII; null if all are."""
    known = [x for x in options if x is not None]
    return F.least(*known) if len(known) > 1 else known[0]


def _then(x: Column, cost: Column, letter: str) -> Column:
    return F.when(x.isNotNull(), F.struct((x["cost"] + cost).alias("cost"), F.concat(x["audit"], F.lit(letter)).alias("audit")))


def _with_inserts(at: dict[str, Column]) -> Column:
    """The four structs after the turns that may be inserted here. Two in a row never pay but from nothing, where deleting is cheaper still."""
    put = lambda s: _then(at[s], F.lit(INSERT), "I")
    user = _least(at["u"], put("e"), put("s"), put("a"))
    return F.struct(at["e"].alias("e"), at["s"].alias("s"), user.alias("u"), _least(at["a"], _then(user, F.lit(INSERT), "I")).alias("a"))


def _turn(acc: Column, turn: Column) -> Column:
    """One turn more: delete it, keep it where its role may stand, or give it the role that may."""
    stays = F.when(turn["fault"] == "t", F.lit(TRUNCATED)).otherwise(F.lit(0))
    gone = lambda s: _then(acc[s], F.lit(DELETE), "D")
    keep = lambda s: _then(acc[s], stays, "K")
    rerole = lambda s: _then(acc[s], stays + F.lit(REROLE), "R")
    fit = turn["fault"].isin("", "t")
    of = lambda initial, x: F.when(fit & (turn["initial"] == initial), x)
    before_user = ("e", "s", "a")
    at = {
        "e": gone("e"),
        "s": _least(gone("s"), of("s", keep("e"))),
        "u": _least(gone("u"), *[of("u", keep(s)) for s in before_user], *[F.when(fit, rerole(s)) for s in before_user]),
        "a": _least(gone("a"), of("a", keep("u")), F.when(fit, rerole("u"))),
    }
    # through one-element arrays, so that each struct is made once
    made = F.array(F.struct(*[at[s].alias(s) for s in STATES]))
    return F.transform(made, lambda x: _with_inserts({s: x[s] for s in STATES}))[0]


_PAIR = "struct<cost:bigint,audit:string>"
_FOUR = f"struct<{','.join(f'{s}:{_PAIR}' for s in STATES)}>"


def _pair(cost: int, audit: str) -> Column:
    return F.struct(F.lit(cost).cast("bigint").alias("cost"), F.lit(audit).alias("audit"))


def _entering(state: Column) -> Column:
    """The four structs of a stretch entered in this state; '' is the beginning, where turns may be inserted at once."""
    none = F.lit(None).cast(_PAIR)
    start = F.struct(_pair(0, "").alias("e"), none.alias("s"), _pair(INSERT, "I").alias("u"), _pair(2 * INSERT, "II").alias("a")).cast(_FOUR)
    inner = F.struct(*[F.when(state == s, _pair(0, "")).otherwise(none).alias(s) for s in STATES]).cast(_FOUR)
    return F.when(state == "", start).otherwise(inner)


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) in order: with i from 0, initial, fault (b, d, t or ''), illegal, gap.

    Turns stand by turn, nulls first, then by role and text. `illegal` says that this turn's
    initial may not follow the one before, `new` that its number is another than the one's
    before, null numbers counting as none. The windows are read turn by turn.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    alike = Window.partitionBy("conv", "role", "text").orderBy("i")
    initial = F.substring("role", 1, 1)
    seen = F.row_number().over(alike) > 1
    blank, ended = ~F.col("text").rlike(INK), F.col("text").rlike(ENDED)
    fault = F.when(blank, "b").when(seen, "d").when(~ended, "t").otherwise("")
    last, number = F.lag(initial).over(order), F.lag("turn").over(order)
    legal = F.concat(last, initial).isin("su", "ua", "au")
    numbered = turns.select(
        "conv", "turn", "role", "text", (F.row_number().over(order) - 1).alias("i"), initial.alias("initial"),
        (last.isNotNull() & ~legal).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(number)).alias("new"),
    )
    return numbered.withColumn("fault", fault)


def plan(flagged: DataFrame) -> DataFrame:
    """(conv, stretch, entered, audit, cost, whole) for each stretch of each conversation: the edits of its cheapest repair.

    A stretch is folded from each state it may be entered in, the first from the beginning
    alone; a second fold goes over the stretches, of which each has four structs a state. So
    no fold makes a long audit anew for each turn, and texts take no part. `whole` is the
    audit of the conversation, on its first stretch alone.
    """
    stretches = flagged.groupBy("conv", F.floor(F.col("i") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("i", "initial", "fault"))).alias("turns"))
    entries = F.when(F.col("stretch") == 0, F.array(F.lit(""))).otherwise(F.array(*map(F.lit, STATES)))
    entered = stretches.withColumn("from", F.explode(entries)).withColumn("to", F.aggregate("turns", _entering(F.col("from")), lambda acc, t: _turn(acc, t).cast(_FOUR)))
    exits = F.map_from_entries(F.collect_list(F.struct("from", "to")))
    table_ = entered.groupBy("conv", "stretch").agg(exits.alias("exits"))
    whole = table_.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("stretch", F.map_entries("exits").alias("exits")))).alias("all"))

    # a way through the stretches: cost, audit, and the state behind each of them
    way = "struct<cost:bigint,audit:string,trail:string>"
    ways = f"struct<{','.join(f'{s}:{way}' for s in STATES)}>"

    def longer(acc: Column, x: Column) -> Column:
        exit_of = F.map_from_entries(x["exits"])

        def join(s: str, t: str) -> Column:
            y = F.element_at(exit_of, F.lit(s))[t]
            return F.when(acc[s].isNotNull() & y.isNotNull(), F.struct((acc[s]["cost"] + y["cost"]).alias("cost"), F.concat(acc[s]["audit"], y["audit"]).alias("audit"), F.concat(acc[s]["trail"], F.lit(t)).alias("trail")))

        return F.struct(*[F.least(*[join(s, t) for s in STATES]).alias(t) for t in STATES])

    def first(x: Column) -> Column:
        y = F.element_at(F.map_from_entries(x["exits"]), F.lit(""))
        return F.struct(*[F.when(y[t].isNotNull(), F.struct(y[t]["cost"].alias("cost"), y[t]["audit"].alias("audit"), F.lit(t).alias("trail"))).alias(t) for t in STATES])

    fold = F.aggregate(F.slice("all", 2, F.size("all")), first(F.col("all")[0]).cast(ways), lambda acc, x: longer(acc, x).cast(ways), lambda acc: F.least(acc["e"], acc["a"]))
    best = whole.withColumn("best", fold)
    states = F.concat(F.lit(" "), F.substring("best.trail", 1, 1 << 30))
    parts = best.select("conv", "best", states.alias("states"), F.explode("all").alias("x"))
    k = F.col("x.stretch").cast("int")
    enters = F.when(k == 0, "").otherwise(F.substring(F.col("states"), k + 1, F.lit(1)))
    leaves = F.substring(F.col("states"), k + 2, F.lit(1))
    parts = parts.select("conv", F.col("x.stretch").alias("stretch"), enters.alias("entered"), leaves.alias("left"), F.map_from_entries("x.exits").alias("exits"), "best")
    out = F.element_at("exits", F.col("entered"))
    audit = F.coalesce(*[F.when(F.col("left") == t, out[t]["audit"]) for t in STATES])
    return parts.select("conv", "stretch", "entered", audit.alias("audit"), F.col("best.cost").alias("cost"), F.when(F.col("stretch") == 0, F.col("best.audit")).alias("whole"))


def _lines(turns: Column, audit: Column, entered: Column) -> Column:
    """The turns of a stretch after the edits, as role:text."""

    def edit(acc: Column, op: Column) -> Column:
        turn = F.get(turns, acc["k"])
        now = F.when(op == "D", acc["state"]).when(op == "K", turn["initial"]).otherwise(F.when(acc["state"] == "u", "a").otherwise("u"))
        role = F.when(op == "K", turn["role"]).otherwise(F.when(now == "u", "user").otherwise("assistant"))
        line = F.concat(role, F.lit(":"), F.when(op == "I", "").otherwise(turn["text"]))
        lines = F.when(op == "D", acc["lines"]).otherwise(F.array_append(acc["lines"], line))
        return F.struct(now.alias("state"), (acc["k"] + F.when(op == "I", 0).otherwise(1)).alias("k"), lines.alias("lines")).cast("struct<state:string,k:int,lines:array<string>>")

    zero = F.struct(entered.alias("state"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("lines")).cast("struct<state:string,k:int,lines:array<string>>")
    ops = F.filter(F.split(audit, ""), lambda c: c != "")
    return F.aggregate(ops, zero, edit, lambda acc: acc["lines"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of turns (conv, turn, role, text).

    The first has a row for each conversation: conv, gaps, blank, duplicate, truncated,
    illegal, cost and audit; the second (conv, stretch, lines), the turns kept and made, in
    order, as role:text.

    A null conv is a conversation of its own; null roles and texts are one space; null turn
    numbers stand first and count for no gap. Turns equal in all are duplicates of the first.
    A role whose initial is none of s, u, a, or that is empty, can't be kept. A conversation
    may hold most of all turns: its windows are read turn by turn, texts are gathered by
    stretch, and only four (cost, audit) structs for each stretch come together. Empty tables
    give none. Other columns are left out.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    key = F.struct("conv").alias("conv")  # a struct of null is equal to itself
    flagged = checkpoint(faults(turns.select(key, "turn", space("role"), space("text"))))
    found = checkpoint(plan(flagged))
    count = lambda x: F.sum(x.cast("long"))
    sums = flagged.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == x[0]).alias(x) for x in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
    )
    whole = found.where("stretch = 0").select("conv", "cost", F.col("whole").alias("audit"))
    stretches = flagged.groupBy("conv", F.floor(F.col("i") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("i", "initial", "role", "text"))).alias("turns"))
    lines = stretches.join(found, ["conv", "stretch"]).select("conv.conv", "stretch", _lines(F.col("turns"), F.col("audit"), F.col("entered")).alias("lines"))
    return sums.join(whole, "conv").select("conv.conv", *sums.columns[1:], "cost", "audit"), lines


def text_digests(lines: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's lines, joined by line feeds, read in order and never put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, first, kind = None, None, True, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([made.hexdigest()])], ["conv", "sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, some in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield row()
                    now, made, first = (conv,), hashlib.sha256(), True
                for line in some.values or ():
                    made.update(b"" if first else b"\n")
                    made.update(line.as_buffer())
                    first = False
        if now is not None:
            yield row()

    ordered = lines.repartition("conv").sortWithinPartitions("conv", "stretch")
    return ordered.mapInArrow(run, f"conv {dict(lines.dtypes)['conv']}, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with the faults that a hash of conversation and turn deals out: dropped, emptied, cut marks, repeated, wrong role."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return t.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows, lines = repair(damaged(turns))
    all_ = turns.select("conv_id").distinct()
    named = lambda df, name: df.withColumnRenamed("conv", name)
    out = all_.join(named(rows, "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(named(text_digests(lines), "_named"), F.col("conv_id").eqNullSafe(F.col("_named")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc32_sql("k")} % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER w - 1 AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS last FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM f GROUP BY conv_id),
-- the states behind i turns, an inserted turn counting as a way from one state to another
steps AS (SELECT unnest(['e', 's', 'u', 'a', 's', 'u', 'u', 'u', 'a', 'u', 'u', 'u', 'a']) AS now, unnest(['e', 's', 'u', 'a', 'e', 'e', 's', 'a', 'u', 'e', 's', 'a', 'u']) AS was,
                 unnest(['D', 'D', 'D', 'D', 'K', 'K', 'K', 'K', 'K', 'R', 'R', 'R', 'R']) AS op),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, x.state, x.cost::BIGINT AS cost, x.audit FROM n, (VALUES ('e', 0, ''), ('u', {INSERT}, 'I'), ('a', {2 * INSERT}, 'II')) x(state, cost, audit)
  UNION ALL
  SELECT conv_id, i + 1, state, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT w.conv_id, w.i, unnest(CASE s.now WHEN 'a' THEN ['a', 'u'] WHEN 'u' THEN ['u', 'a'] ELSE [s.now, 'u', 'a'] END) AS state,
           w.cost + CASE op WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} + CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END ELSE CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END END
             + unnest(CASE WHEN s.now IN ('a', 'u') THEN [0, {INSERT}] ELSE [0, {INSERT}, {2 * INSERT}] END) AS cost,
           w.audit || op || unnest(CASE WHEN s.now IN ('a', 'u') THEN ['', 'I'] ELSE ['', 'I', 'II'] END) AS audit
    FROM ways w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i JOIN steps s ON s.was = w.state
    WHERE op = 'D' OR fault IN ('', 't') AND (op = 'R' OR s.now = initial)) x
  GROUP BY conv_id, i, state),
best AS (SELECT w.conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit FROM ways w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = size WHERE state IN ('e', 'a') GROUP BY w.conv_id),
ops AS (SELECT conv_id, unnest(string_split(audit, '')) AS op, unnest(range(1, length(audit) + 1)) AS p FROM best WHERE audit <> ''),
seats AS (SELECT *, sum((op <> 'I')::INT) OVER w - 1 AS i, sum((op <> 'D')::INT) OVER w - 1 AS j FROM ops WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
kept AS (
  SELECT a.conv_id, p, op, j, role, text, max(CASE WHEN j = 0 AND op = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS sys
  FROM seats a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i WHERE op <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (j + sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(l.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM a.conv_id"""
