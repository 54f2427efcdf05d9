"""WARC archives of pages: written by Spark's own writer, read back along verified chains of record boundaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, scratch, table, written

VERSION, END = "1.1", "\r\n\r\n"
#: A record begins with MAGIC, at the head of the file or behind a line feed; files are cut at that, in payloads too.
MAGIC = "WARC/1."
CUT = "\n" + MAGIC
#: Which pages are revisits is broadcast up to so many rows of two numbers and a digest; beyond that pages are joined with it by a shuffle.
BROADCAST_ROWS = 500_000
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: Column) -> Column:
    """The 32 characters of a SHA-1 in hex, five bytes at a time."""
    part = lambda k: F.lpad(F.conv(F.substring(sha1_hex, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), CONV32, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A line of a header; none for null. Characters that would end it are written in per cent."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("\r\n"))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, h, target): the rows (id, body) whose body the page with the largest id holds too.

    Copies are counted by digest before the shuffle; joining the largest id back, rows are two
    numbers and a digest, and AQE may split a digest that most of them share. A null id is the
    least; rows equal in id and body are none of them a revisit of another.
    """
    rows = checkpoint(pages.select("id", F.sha2("body", 256).alias("h"), F.octet_length("body").alias("n"))).where(F.col("n") >= min_bytes)
    copies = rows.groupBy("h").agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.drop("n").join(copies, "h").where("NOT (id <=> target)").select("id", "h", "target").distinct()


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record): the text of a record for each row (id, url, body), without the blank lines behind it."""
    known = checkpoint(revisits(pages, min_bytes))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = pages.withColumn("h", F.sha2("body", 256)).alias("p")
    rows = rows.join(known.alias("r"), F.expr("p.id <=> r.id AND p.h = r.h"), "left").select("p.*", "target", F.expr("r.h IS NOT NULL").alias("again"))
    size = F.octet_length("body")
    name = lambda c: _uuid(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col("h"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit("urn:unknown"))
    optional = lambda name, value: F.coalesce(_header(name, value), F.lit(""))
    again = F.col("again")
    head = F.concat(
        F.lit(f"WARC/{VERSION}\r\n"), _header("WARC-Type", F.when(again, "revisit").otherwise("response")), F.lit("WARC-Record-ID: "), name("id"), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        _header("WARC-Target-URI", url), F.lit("Content-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("body")), F.lit("\r\n"),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("target"), F.lit("\r\n"))).otherwise(""),
        optional("X-Page-Id", F.col("id")), optional("X-Refers-To-Page-Id", F.when(again, F.col("target"))), _header("X-Payload-Bytes", size),
        _header("Content-Length", F.octet_length(http) + F.when(again, 0).otherwise(size)), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(again, "").otherwise(F.col("body"))).alias("record"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write a record for each page into the folder, an archive a task, by Spark's text writer.

    Of pages with equal payloads of min_bytes or more, that with the largest key is a
    response; the others revisit it and carry no payload. Null payloads are empty, a null key
    is the least and isn't written, a null or empty url becomes urn:unknown. Rows equal in key
    and payload are responses both, or both revisits. An empty table writes no record; other
    columns are left out. A payload that the writer of a text of 2 GB can't hold is an error.
    """
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("body"))
    records(rows, min_bytes).write.option("lineSep", END).text(folder)


def _named(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def _parsed(text: Column, skip: Column, keep: Callable[[Column], Column]) -> Column:
    """What stands in a record that begins with its version behind MAGIC; null if it doesn't begin so.

    `size` is the bytes of the record from MAGIC to the next record's, `whole` says that the
    text doesn't end before the record does, and `payload` is what `keep` makes of its
    payload. Bytes are looked at as characters of Latin 1.
    """
    raw = text.cast("binary")
    # behind a piece stands the line feed that it was cut at, which may be the last of its header
    plain = F.decode(F.concat(raw, F.lit(b"\n")), "ISO-8859-1")
    cut = F.locate(END, plain)
    header = F.substring(plain, F.lit(1), cut - 1)
    length = _named(header, "Content-Length").try_cast("bigint")

    def body(x: Column) -> Column:
        whole = x["at"] - 1 + x["length"] <= F.octet_length(text)
        inner = F.position(F.lit(END), plain, x["at"])
        http = x["header"].rlike(r"(?im)^Content-Type:[ \t]*application/http") & (inner > 0) & (inner + 4 <= x["at"] + x["length"])
        at = F.when(http, inner + 4).otherwise(x["at"])
        payload = F.substring(raw, at, (x["at"] + x["length"] - at).cast("int"))
        size = F.lit(len(MAGIC)) - skip + x["at"] - 1 + x["length"] + len(END)
        return F.struct(x["header"].alias("header"), size.cast("bigint").alias("size"), whole.alias("whole"), F.when(whole, keep(payload)).alias("payload"))

    some = F.array(F.struct((cut + len(END)).cast("int").alias("at"), header.alias("header"), length.alias("length")))
    fits = F.substring(plain, skip + 1, F.lit(3)).rlike("[01]\r\n") & (cut > 0) & (length >= 0)
    return F.when(fits, F.transform(some, body)[0])


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, at, value): the files under the folder, cut at every magic by tasks that read them in blocks.

    Read twice, these rows are the same: the blocks come from a session like this one in
    which they don't depend on how many executors there are.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = own.read.text(folder, lineSep=CUT)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def segments(pieces: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """pieces with n, opening and found (what record each may be) and, instead of the value, raw: that of a piece that isn't a whole record by itself."""
    opening = F.startswith("value", F.lit(MAGIC))
    out = pieces.withColumn("n", F.octet_length("value").cast("bigint")).withColumn("opening", opening)
    out = out.withColumn("found", _parsed(F.col("value"), F.when(F.col("opening"), len(MAGIC)).otherwise(0), keep))
    return out.withColumn("raw", F.when(~F.coalesce("found.whole", F.lit(False)), F.col("value"))).drop("value")


def _before(df: DataFrame, order: str, value: Column, name: str, last: bool = False) -> DataFrame:
    """df with the sum of the value over the file's rows before, or with `last` its last value that isn't null up to the row; blocks apart, then over the blocks' ends."""
    block = Window.partitionBy("file", "block")
    if last:
        own = F.last(value, ignorenulls=True).over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        ends = df.groupBy("file", "block").agg(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias("_end"))
        carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        both = lambda c: F.coalesce(own, c)
    else:
        own = F.coalesce(F.sum(value).over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = df.groupBy("file", "block").agg(F.sum(value).alias("_end"))
        carried = F.coalesce(F.sum("_end").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        both = lambda c: own + c
    # a file has as many of these rows as blocks
    return df.join(ends.select("file", "block", carried.alias("_carried")), ["file", "block"]).withColumn(name, both(F.col("_carried"))).drop("_carried")


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, offset, next, run): what looks like a record, and where its successor must begin.

    In a block, consecutive candidates of which each leads to the following one are a run.
    """
    first = F.col("start") == 0
    some = pieces.where(F.col("size").isNotNull() & (F.col("opening") == first))
    offset = F.when(first, 0).otherwise(F.col("start") - len(MAGIC))
    some = some.select("file", "block", offset.alias("offset"), (offset + F.col("size")).alias("next"))
    order = Window.partitionBy("file", "block").orderBy("offset")
    broken = (F.lag("next").over(order) != F.col("offset")).cast("int")
    return some.withColumn("_broken", broken).withColumn("run", F.coalesce(F.sum("_broken").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_broken")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that a chain from the start of their file passes.

    Runs are the nodes: the last member of each leads to a member of another run, from which
    on that one is reached. Pointers jump twice as far in each round, so there are as many
    rounds as the logarithm of a file's runs, and each has a row a run.
    """
    run = F.struct("block", "run")
    last = found.groupBy("file", run.alias("at")).agg(F.max("next").alias("entry"))
    target = found.select("file", F.col("offset").alias("entry"), run.alias("to"))
    jump = checkpoint(last.join(target, ["file", "entry"]).select("file", "at", "to", "entry"))
    new = found.where("offset = 0").select("file", run.alias("at"), F.lit(0).cast("bigint").alias("entry"))
    reached = [checkpoint(new)]
    while True:
        # those already reached, moved on by as many runs as they are
        ahead = reduce(DataFrame.unionByName, reached).drop("entry").join(jump, ["file", "at"]).select("file", F.col("to").alias("at"), "entry")
        new = checkpoint(ahead)
        if new.isEmpty():
            break
        reached.append(new)
        on = jump.select("file", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("entry").alias("_entry"))
        jump = checkpoint(jump.drop("entry").join(on, ["file", "to"]).select("file", "at", F.col("_to").alias("to"), F.col("_entry").alias("entry")))
    whole = reduce(DataFrame.unionByName, reached)
    return found.withColumn("at", run).join(whole, ["file", "at"]).where("offset >= entry").drop("at", "entry")


def read_warc(spark: SparkSession, folder: str, strict: bool = True, keep: Callable[[Column], Column] = lambda payload: payload) -> tuple[DataFrame, DataFrame]:
    """(records, files) of the uncompressed archives in a folder, in any store that Spark reads.

    Records: file, offset, header (all its lines), payload (binary; of an HTTP message what
    follows its header; or what `keep` makes of that, which alone is then written and
    shuffled). Only records that a chain of lengths from the start of their file reaches are
    there: a record's text inside a payload is none, even if it is well formed.
    Files: file, n_records, n_rejected (candidates that are none), read_to, size. Where read_to
    isn't size, what begins there has no whole header or leads to no magic and not to the end
    of the file; that is an error if `strict`, else the file is read up to there. Empty files
    have no row.

    A file is cut into blocks by Spark's settings and a record may cross them; a record is
    one value, of 2 GB at most. Pieces of payloads that hold the magic are shuffled and put
    together; those among them that look like whole records are read from the archives again.
    """
    read = _pieces(spark, folder)
    pieces = written(segments(read, keep))
    narrow = pieces.select("file", "block", "at", "n", "opening", F.col("found.size").alias("size"))
    narrow = checkpoint(_before(narrow, "at", F.col("n") + len(CUT), "start"))
    found = checkpoint(candidates(narrow))
    reached = checkpoint(reachable(found))
    sizes = narrow.groupBy("file").agg((F.sum("n") + (F.count("*") - 1) * len(CUT)).alias("size"))
    made = found.groupBy("file").agg(F.count("*").alias("_all"))
    ends = reached.groupBy("file").agg(F.max("offset").alias("_last"), F.max("next").alias("_end"))
    cuts = narrow.select("file", (F.col("start") - len(MAGIC)).alias("_end"), F.lit(True).alias("_met"))
    ends = checkpoint(sizes.where("size > 0").join(ends, "file", "left").join(cuts, ["file", "_end"], "left"))
    # the last of a chain is no record unless it leads to a magic or to the end of the file
    kept = reached.join(ends, "file").where("next <> _end OR _end = size OR _met").select(*reached.columns)
    counted = kept.groupBy("file").agg(F.count("*").alias("_kept"))
    n = F.coalesce("_kept", F.lit(0))
    read_to = F.when((F.col("_end") == F.col("size")) | F.col("_met"), F.col("_end")).otherwise(F.coalesce("_last", F.lit(0)))
    files = ends.join(made, "file", "left").join(counted, "file", "left").select("file", n.alias("n_records"), (F.coalesce("_all", F.lit(0)) - n).alias("n_rejected"), read_to.alias("read_to"), "size")
    files = checkpoint(files)
    if strict and (bad := files.where("read_to <> size").first()):
        raise ValueError(f"{bad.file}: the chain of records breaks behind byte {bad.read_to} of {bad.size}")

    starts = kept.select("file", "block", F.when(F.col("offset") > 0, F.col("offset") + len(MAGIC)).otherwise(0).alias("start"), "offset", F.col("next"))
    placed = narrow.select("file", "block", "at", "start").join(starts, ["file", "block", "start"], "left")
    of = F.struct("offset", "next")
    owned = _before(placed, "start", F.when(F.col("offset").isNotNull(), of), "owner", last=True).where("start < owner.next")
    keys = ["file", "block", "at"]
    joined = checkpoint(owned.select(*keys, "start", "owner", F.col("offset").isNotNull().alias("first")).join(pieces.select(*keys, "found", "raw"), keys))
    whole = joined.where("first AND raw IS NULL").select("file", "owner.offset", "found.header", "found.payload")
    rest = joined.where("raw IS NOT NULL").select("file", "owner", "start", "raw")
    # a record inside a payload may be whole in its piece, which was not kept then
    inner = checkpoint(joined.where("NOT first AND raw IS NULL").select(*keys, "owner", "start"))
    if n := inner.count():
        again = (F.broadcast(inner) if n <= BROADCAST_ROWS else inner).join(read, keys)
        rest = rest.unionByName(again.select("file", "owner", "start", F.col("value").alias("raw")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "raw"))), lambda x: x["raw"]), CUT)
    skip = F.when(F.col("owner.offset") == 0, len(MAGIC)).otherwise(0)
    parts = rest.groupBy("file", "owner").agg(text.alias("text")).withColumn("found", _parsed(F.col("text"), skip, keep)).select("file", "owner.offset", "found.header", "found.payload")
    return whole.unionByName(parts), files


def op11_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    found, _ = read_warc(spark, folder, keep=lambda p: F.struct(F.octet_length(p).alias("n"), F.sha1(p).alias("hex")))
    header = F.col("header")
    kind, said = _named(header, "WARC-Type"), F.regexp_extract(header, r"(?im)^WARC-Payload-Digest:[ \t]*sha1:(\w+)", 1)
    again = kind == "revisit"
    return found.select(
        _named(header, "X-Page-Id").try_cast("bigint").alias("page_id"),
        F.when(again, _named(header, "X-Payload-Bytes").try_cast("bigint")).otherwise(F.col("payload.n")).cast("bigint").alias("payload_bytes"),
        F.when(again, said).otherwise(base32(F.col("payload.hex"))).alias("payload_digest"),
        kind.alias("record_type"), _named(header, "X-Refers-To-Page-Id").try_cast("bigint").alias("refers_to"),
    )


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS target FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', 1 + ((('0x' || substr(hex, 1 + 10 * (k // 8)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM h"""
