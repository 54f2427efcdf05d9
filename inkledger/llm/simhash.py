"""SimHash near-duplicates by exact comparison of tiles."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import checkpoint, components, fresh, table

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Fingerprints differing in at most RADIUS of so many blocks of bits agree in one block at least.
BLOCKS = RADIUS + 1
#: Most fingerprints on one side of a tile pair, about.
TILE = 2048


def fingerprint(text: str | None) -> int:
    """64 bits: a bit is 1 if over half the XXH64 values of the text's shingles have it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A to Z and ASCII white space only
    if not w:
        return 0
    if len(w) < SHINGLE:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """The fingerprint's bits as a signed number."""
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links between numbers below n: (node, root) of every node linked to a lesser one, root the least in its part."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _near(x: np.ndarray, ones: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i < j, within x, which is sorted by its numbers of ones.

    A strip of rows is compared with the columns whose numbers of ones are no further than
    the radius from its own; the rest of the square is skipped.
    """
    us, vs = [], []
    for i in range(0, len(x), rows):
        a = x[i : i + rows]
        stop = int(np.searchsorted(ones, ones[min(i + rows, len(x)) - 1] + radius, side="right"))
        for j in range(i, stop, 4 * rows):
            b = x[j : min(j + 4 * rows, stop)]
            u, v = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            u, v = u + i, v + j
            ok = u < v
            us.append(u[ok])
            vs.append(v[ok])
            if sum(map(len, us)) > 1 << 20:  # keep no more than a forest of what was found
                us, vs = ([y] for y in _forest(np.concatenate(us), np.concatenate(vs), len(x)))
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(us), np.concatenate(vs), len(x))


def _small(x: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small groups at once: each row with the 1st, 2nd, ... row after it while that is of its group."""
    us, vs, live, d = [], [], np.arange(len(x)), 1
    while True:
        live = live[live + d < len(x)]
        live = live[group[live] == group[live + d]]
        if not len(live):
            break
        ok = np.bitwise_count(x[live] ^ x[live + d]) <= radius
        us.append(live[ok])
        vs.append(live[ok] + d)
        d += 1
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(radius: int):
    """Rows sorted by tile pair in, links (a, b) out; a tile pair is held whole, and is small."""

    def links(x: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        group = np.repeat(np.arange(len(begin)), size)
        few = np.repeat(size <= 64, size)
        pick = np.flatnonzero(few)
        u, v = _small(x[pick], group[pick], radius)
        us, vs = [x[pick][u]], [x[pick][v]]
        for k in np.flatnonzero(size > 64):
            y = np.unique(x[begin[k] : begin[k] + size[k]])
            ones = np.bitwise_count(y).astype(np.int64)
            by = np.argsort(ones, kind="stable")
            u, v = _near(y[by], ones[by], radius)
            us.append(y[by][u])
            vs.append(y[by][v])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (us, vs)], ["a", "b"])

    def run(batches):
        x, key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            x = np.concatenate((x, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            key = np.concatenate((key, batch.column("pair").to_numpy(zero_copy_only=False)))
            if not len(key) or key[0] == key[-1]:
                continue
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last tile pair may go on
            yield links(x[:cut], key[:cut])
            x, key = x[cut:], key[cut:]
        if len(key):
            yield links(x, key)

    return run


def block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """For each choice of blocks - radius blocks, a hash of the choice and the bits in those blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    chosen = [sum(masks[k] for k in c) for c in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed(m)))) for n, m in enumerate(chosen)])


def deal(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows (block, fp, settled, more) as often as there are tile pairs they belong to, with `pair` instead of the block.

    A group is cut into tiles of about `tile` rows that are neighbours in number of ones (where
    one number has more, also by a hash). A row goes to the pairs of its tile with those tiles
    that hold numbers of ones within the radius of its own. Settled rows need no comparison
    with each other; they have tiles of their own, which are paired with the others' only.
    """
    more = [c for c in keyed.columns if c not in ("block", "settled")]
    keyed = keyed.withColumn("ones", F.bit_count("fp"))
    counts = keyed.groupBy("block", "settled", "ones").agg(F.count("*").alias("n"))
    groups = counts.groupBy("block").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("settled", "ones", "n"))).alias("by"))
    groups = groups.where("size > 1")  # a fingerprint alone in its group meets none there
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda s, y: s + y["n"])

    def cut(by: Column) -> Column:
        """(settled, bin, low, high, splits) of the tiles; there are no more bins than numbers of ones."""
        before = lambda x: total(F.filter(by, lambda y: (y["settled"] == x["settled"]) & (y["ones"] < x["ones"])))
        placed = F.transform(by, lambda x: F.struct(x["settled"].alias("settled"), x["ones"].alias("ones"), x["n"].alias("n"), F.floor(before(x) / tile).alias("bin")))

        def tiles(rows: Column) -> Column:
            def one(t: Column) -> Column:
                own = F.filter(rows, lambda x: (x["settled"] == t["settled"]) & (x["bin"] == t["bin"]))
                ones = F.transform(own, lambda x: x["ones"])
                return F.struct(t["settled"].alias("settled"), t["bin"].alias("bin"), F.array_min(ones).alias("low"), F.array_max(ones).alias("high"), F.ceil(total(own) / tile).cast("int").alias("splits"))

            return F.transform(F.array_distinct(F.transform(rows, lambda x: F.struct(x["settled"].alias("settled"), x["bin"].alias("bin")))), one)

        return F.transform(F.array(placed), tiles)[0]

    whole = (F.col("size") <= tile) & ~F.exists("by", lambda x: x["settled"])
    groups = groups.select("block", F.when(~whole, cut(F.col("by"))).alias("tiles"))
    mine = F.filter("tiles", lambda t: (t["settled"] == F.col("settled")) & F.col("ones").between(t["low"], t["high"]))[0]
    placed = keyed.join(groups, "block").withColumn("mine", mine).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("mine.splits")).cast("int"))
    near = F.filter("tiles", lambda t: (t["low"] <= F.col("ones") + radius) & (t["high"] >= F.col("ones") - radius) & ~(t["settled"] & F.col("settled")))
    end = lambda t, s: F.struct(t["settled"].alias("t"), t["bin"].alias("b"), s.alias("s"))

    def pairs(t: Column) -> Column:
        def named(s: Column) -> Column:
            a, b = end(F.col("mine"), F.col("own")), end(t, s)
            return F.xxhash64(F.col("block"), F.least(a, b), F.greatest(a, b))

        return F.transform(F.sequence(F.lit(0), t["splits"] - 1), named)

    return placed.select(*more, F.explode(F.when(F.col("tiles").isNull(), F.array("block")).otherwise(F.flatten(F.transform(near, pairs)))).alias("pair"))


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints `fp` are joined by steps of at most radius bits.

    Fingerprints within the radius agree on blocks - radius of the blocks, so only those
    that share such bits are compared, all with all, in tiles. Each pair of tiles gives a
    forest of its links, never all of them. More blocks give smaller groups and more copies
    of each fingerprint (4 blocks: 4 copies, 16 bits; 6 blocks: 20 copies, 32 bits).
    """
    dealt = deal(prints.select("fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("block"), F.lit(False).alias("settled")), radius, tile)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(_compare(radius), "a bigint, b bigint")


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rows (key, fp), rows (fp, class, component_id)) of the documents.

    Documents with one fingerprint are alike; fingerprints of at most radius differing bits
    are linked, and links go on. `class` is a fingerprint that names the component and
    component_id the least key in it (null if all its keys are null; null keys are passed
    over otherwise). Texts without words, null and empty ones, have fingerprint zero and are
    linked like any other. An empty table has no rows in either.
    """
    prints = checkpoint(docs.select(F.col(f"`{key}`").alias(key), simhash(F.col(f"`{text}`")).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    linked = components(near_links(distinct.select("fp"), radius, blocks, tile))
    classes = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return prints, checkpoint(classes.select("fp", "class").join(least, "class"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class: one with the least key, and of rows alike in key any."""
    fp, cls, least = fresh(docs, "_fp", "_class", "_least")
    prints, classes = near_classes(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t", "k")
    named = classes.select(F.col("fp").alias(fp), F.col("class").alias(cls), F.col("component_id").alias(least))
    marked = docs.withColumn(fp, simhash(F.col(f"`{text}`"))).join(named, fp)
    first = marked.where(F.col(f"`{key}`").eqNullSafe(F.col(least)))
    return first.dropDuplicates([cls]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints, classes = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
