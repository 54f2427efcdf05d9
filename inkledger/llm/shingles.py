"""SimHash near-duplicates of a stated similarity: fingerprints of five-word shingles compared in tiles by exclusive-or and bit counts, each link then held to the exact share of common shingles.

Texts that have 0.8 of their shingles in common differ in 10 of 64 bits on average. So wide a
radius leaves no block of bits on which they must agree; candidates are gathered by bands of
least hashes instead, and the fingerprints are compared within those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from . import bytewords
from .common import checkpoint, components, fresh
from .simhash import _forest, deal

#: Words of a shingle, and the tenths of all shingles of two texts that both must have.
SHINGLE, TENTHS = 5, 8
#: Texts that agree in all ROWS least hashes of one of BANDS bands are compared: at similarity 0.8 that finds 0.9999 of the pairs.
BANDS, ROWS = 24, 5
#: Fingerprints of texts at similarity 0.8 differ in no more bits than this in 0.998 of cases, of more alike texts oftener.
RADIUS = 18
#: Texts on one side of a tile pair, about.
TILE = 512
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray, c: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(c)
    return h ^ (h >> np.uint64(29))


def _sets(texts: pa.Array):
    """(number of texts, shingle hashes sorted within each text, where each text's begin, how many it has) of runs of texts."""
    for _, data, bounds in bytewords.shards(texts):
        w = bytewords.words(data, bounds, _NOT_SPACE)
        n = len(bounds) - 1
        count = np.bincount(w.doc, minlength=n)
        at = np.arange(len(w.doc)) - (np.cumsum(count) - count)[w.doc]
        i = np.flatnonzero((at + SHINGLE <= count[w.doc]) | (at == 0))  # a shorter text is one shingle
        h = np.zeros(len(i), np.uint64)
        for d in range(SHINGLE):
            inside = at[i] + d < count[w.doc[i]]
            h = np.where(inside, _mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[np.minimum(i + d, len(w.hash) - 1)] + np.uint64(1)), h)
        doc = w.doc[i]
        by = np.lexsort((h, doc))
        h, doc = h[by], doc[by]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
        h, doc = h[new], doc[new]
        size = np.bincount(doc, minlength=n)
        yield n, h, np.cumsum(size) - size, size


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def _print(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each set: a bit is 1 if over half of its mixed hashes have it."""
    h = _mix(h, 0xA0761D6478BD642F)
    out = np.zeros(len(begin), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), begin).astype(np.int64)
        out |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return out


def _described(texts: pa.Array) -> pa.Array:
    """Two numbers that name the set of shingles, its fingerprint, and a number for each band; a text without words has no bands."""
    out = []
    for n, h, begin, size in _sets(texts):
        some = np.flatnonzero(size)
        rows = np.zeros((n, 3 + BANDS), np.uint64)
        if len(some):
            for k, c in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
                rows[some, k] = np.add.reduceat(_mix(h + np.uint64(k), c), begin[some])
            rows[some, 2] = _print(h, begin[some], size[some])
            for b in range(BANDS):
                key = np.full(len(some), b, np.uint64)
                for odd in _ODD[b * ROWS : (b + 1) * ROWS]:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * odd, begin[some]))
                rows[some, 3 + b] = key
        sizes = np.where(size > 0, 3 + BANDS, 3)
        keep = np.arange(3 + BANDS) < sizes[:, None]
        out.append(_lists(rows[keep], sizes))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(LongType()))
def sketch(texts: pa.Array) -> pa.Array:
    return _described(texts)


@F.arrow_udf(ArrayType(LongType()))
def shingles(texts: pa.Array) -> pa.Array:
    out = [_lists(h, size) for _, h, _, size in _sets(texts)]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


@F.arrow_udf(BooleanType())
def alike(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether both have TENTHS of ten of the shingles of either."""
    out = []
    for x, y in zip(left, right, strict=True):
        x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(10 * both >= TENTHS * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def _tile_links(ids: list, fp: np.ndarray, part: np.ndarray, sets: list, radius: int) -> pa.RecordBatch:
    """Links that join what is alike in a tile pair and not in one component yet.

    Fingerprints are compared all with all; texts within the radius, and of sizes that allow
    the share, are counted exactly, a text against all of its candidates at once.
    """
    n, size = len(ids), np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    us, vs, mark = [], [], np.zeros(int(word.max(initial=0)) + 1, bool)
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        ok = (np.bitwise_count(fp[js] ^ fp[i]) <= radius) & (part[js] != part[i])
        js = js[ok & (10 * np.minimum(size[js], size[i]) >= TENTHS * np.maximum(size[js], size[i]))]
        if not len(js):
            continue
        mark[word[begin[i] : begin[i] + size[i]]] = True
        for some in np.split(js, np.flatnonzero(np.diff(np.cumsum(size[js]) >> 22)) + 1):  # at most about 4 million words at once
            at = np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
            both = np.add.reduceat(mark[word[at]].astype(np.int64), np.cumsum(size[some]) - size[some])
            hit = some[10 * both >= TENTHS * (size[some] + size[i] - both)]
            us.append(np.full(len(hit), i))
            vs.append(hit)
        mark[word[begin[i] : begin[i] + size[i]]] = False
    a, b = _forest(np.concatenate(us), np.concatenate(vs), n) if us else ([], [])
    return pa.RecordBatch.from_pydict({"a": pa.array([ids[k] for k in a], pa.int64()), "b": pa.array([ids[k] for k in b], pa.int64())})


def _compare(radius: int):
    """Rows sorted by tile pair in, links out; a tile pair is held whole, and is small."""

    def run(batches):
        rows, now = [], None
        flush = lambda: _tile_links([r[0] for r in rows], np.array([r[1] for r in rows], np.int64).view(np.uint64), np.array([r[2] for r in rows]), [r[3] for r in rows], radius)
        for batch in batches:
            for pair, i, fp, part, s in zip(*[batch[c].to_pylist() for c in ("pair", "id", "fp", "part")], batch["set"], strict=True):
                if pair != now and rows:
                    yield flush()
                    rows = []
                now = pair
                rows.append((i, fp, part, s.values.to_numpy(zero_copy_only=False)))
        if rows:
            yield flush()

    return run


def _bare(links: DataFrame) -> DataFrame:
    """The links without what the optimiser knows of them, which it fails on in the rounds of components()."""
    return links.mapInArrow(lambda batches: batches, "a bigint, b bigint")


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rows (key, r1, r2, id) of the documents, rows (id, class) of their sets of shingles).

    `id` names a text's set of shingles, r1 and r2 the row's key and text; a class is a string
    that is no id. Sets are numbered, and the numbers written, before they are dealt by bands,
    as each goes to all of them. In each band's
    groups every text is held to one of the group, drawn anew for each band; in groups that
    this doesn't join to one component, the texts of different components are compared all
    with all, in tiles, but for two texts of the largest. Whatever is held to something passes the radius first and the exact
    share after it. Links go on. Texts without words are alike.
    """
    t = F.col(f"`{text}`")
    r1, r2 = row_hash(F.col(f"`{key}`"), t)
    made = docs.select(F.col(f"`{key}`").alias("key"), r1.alias("r1"), r2.alias("r2"), sketch(t).alias("s"))
    name = F.concat_ws("-", F.hex(F.col("s")[0]), F.hex(F.col("s")[1]))
    rows = checkpoint(made.select("key", "r1", "r2", name.alias("id"), F.col("s")[2].alias("fp"), F.slice("s", 4, BANDS).alias("bands")))
    items = rows.groupBy(F.col("id").alias("name")).agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("r1", "r2")).alias("row"))
    items = checkpoint(items.withColumn("id", F.monotonically_increasing_id()))
    banded = items.select("id", "fp", F.explode("bands").alias("band"))
    drawn = F.min(F.struct(F.xxhash64("id", "band").alias("r"), "id", "fp"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n"), drawn.alias("c")).where("n > 1").select("band", "n", F.col("c.id").alias("centre"), F.col("c.fp").alias("centre_fp"))
    member = checkpoint(banded.join(groups, "band"))
    near = member.where((F.col("id") != F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre_fp"))) <= radius))
    stars = near.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    told = items.join(member.select("id").distinct(), "id").select("id", "row.r1", "row.r2")
    seen = docs.select(r1.alias("r1"), r2.alias("r2"), t.alias("text")).join(told, ["r1", "r2"]).select("id", shingles("text").alias("set"))
    sets = checkpoint(seen.dropDuplicates(["id"]))  # equal rows come once
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    links = checkpoint(stars.join(side("a"), "a").join(side("b"), "b").where(alike("set_a", "set_b")).select("a", "b"))
    linked = components(_bare(links))
    parted = member.where("n > 2").join(linked, F.col("id") == F.col("node"), "left").select("band", "id", "fp", F.xxhash64(F.coalesce("component", "id")).alias("part"))
    # the rows of a band's largest component have been joined, and are compared with the others only
    parts = parted.groupBy("band", "part").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    keyed = parted.join(open_, "band").select(F.col("band").alias("block"), (F.col("part") == F.col("largest")).alias("settled"), "id", "fp", "part")
    # dealing reads them twice, and would hold the joins above twice in one plan
    dealt = deal(checkpoint(keyed), radius, tile).join(sets, "id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("pair", "id", "fp", "part", "set").repartition(n, "pair").sortWithinPartitions("pair")
    more = checkpoint(dealt.mapInArrow(_compare(radius), "a bigint, b bigint"))
    if not more.isEmpty():
        linked = components(_bare(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    named = linked.join(items.select(F.col("id").alias("node"), "name"), "node")
    return rows.select("key", "r1", "r2", "id"), named.select(F.col("name").alias("id"), F.col("component").cast("string").alias("class"))


def row_hash(key, text) -> list:
    """128 bits of a row's key and text, as two numbers."""
    return [F.xxhash64(F.lit(k), key.isNull(), key, text.isNull(), text) for k in (1, 2)]


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each class: one with the least key (null after all), and of rows alike in key and text any.

    What goes is gathered by row_hash and taken out by an anti-join. That shuffles the texts
    once, as finding the sets that are compared did before.
    """
    rows, linked = near_classes(docs, text, key, radius, tile)
    classes = rows.join(linked, "id", "left").select("r1", "r2", F.coalesce("class", "id").alias("class"), F.struct(F.col("key").isNull(), "key", "r1", "r2").alias("place"))
    alike_rows = classes.groupBy("r1", "r2").agg(F.first("class").alias("class"), F.first("place").alias("place"), F.count("*").alias("n"))
    firsts = alike_rows.groupBy("class").agg(F.min("place").alias("first"))
    told = checkpoint(alike_rows.join(firsts, "class").select("r1", "r2", "n", (F.col("place") == F.col("first")).alias("stays")).where("n > 1 OR NOT stays"))
    one, two = fresh(docs, "_r1", "_r2")
    r1, r2 = row_hash(F.col(f"`{key}`"), F.col(f"`{text}`"))
    marked = docs.withColumns({one: r1, two: r2})
    list_ = lambda x: x.select(F.col("r1").alias(one), F.col("r2").alias(two))
    alone = marked.join(list_(told), [one, two], "left_anti")
    several = marked.join(list_(told.where("stays")), [one, two], "left_semi").dropDuplicates([one, two])
    return alone.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])
