"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, table
from .simhash import _forest

COSINE = 0.93
#: In each pass the vectors are sorted by HASH_BITS signs of random projections, and each is compared with the next WINDOW ones.
HASH_BITS, WINDOW, PROJECTION_SEED = 48, 48, 20
#: There are at least so many passes, and as many as find a link of the least cosine with this chance in the largest label.
PASSES, RECALL = 24, 0.999
#: Vectors of a component are compared in tiles of about so many.
TILE = 1024


def passes_for(largest: int, window: int, cosine: float, recall: float = RECALL, least: int = PASSES) -> int:
    """How many passes a label of so many vectors needs.

    Two vectors that agree in the first log2(largest / window) signs stand within a window of
    each other if the signs part the label evenly; each sign agrees with a chance of
    1 - angle / pi.
    """
    signs = max(0.0, np.log2(max(largest, 1) / window))
    once = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** signs
    return max(least, int(np.ceil(np.log(1 - recall) / np.log1p(-min(once, 1 - 1e-12)))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, of one length, as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hasher(passes: int, bits: int, seed: int):
    """For each vector a number a pass: the signs of `bits` random projections, first sign in the highest place."""

    def hashes(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            out = np.zeros((batch.num_rows, passes), np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, passes * bits))
                pick = np.flatnonzero(dims == dim)
                for some in np.array_split(pick, len(pick) // 4096 + 1):
                    signs = (_matrix(batch.column("vector").take(pa.array(some))) @ planes[dim] > 0).reshape(len(some), passes, bits)
                    out[some] = signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * passes), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "hashes"])

    return hashes


def _neighbours(window: int, cosine: float):
    """Rows sorted by (group, hash) in, a forest of verified links (a, b) of each stretch out."""

    def run(batches):
        tail = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                group, cid = (part.column(c).to_numpy(zero_copy_only=False) for c in ("group", "cid"))
                dims = part.column("dim").to_numpy(zero_copy_only=False)
                for some in np.split(np.arange(part.num_rows), np.flatnonzero(dims[1:] != dims[:-1]) + 1):
                    x, g, c = _matrix(part.column("vector").take(pa.array(some))), group[some], cid[some]
                    if tail is not None and tail[0].shape[1] == x.shape[1]:
                        x, g, c = (np.concatenate(z) for z in zip(tail, (x, g, c), strict=True))
                    us, vs = [], []
                    for d in range(1, min(window, len(x) - 1) + 1):
                        ok = np.flatnonzero(g[:-d] == g[d:])
                        ok = ok[np.einsum("ij,ij->i", x[ok], x[ok + d]) >= cosine]
                        us.append(ok)
                        vs.append(ok + d)
                    if us:
                        node, root = _forest(np.concatenate(us), np.concatenate(vs), len(x))
                        yield pa.RecordBatch.from_arrays([pa.array(c[node]), pa.array(c[root])], ["a", "b"])
                    tail = x[-window:], g[-window:], c[-window:]

    return run


def _tiles(cosine: float):
    """Rows of tile pairs in, sorted by pair; per vector the rows of its links in that pair out."""

    def degrees(x, tile, cid, mult, lone):
        for k in range(0, len(x), 1024):
            s = x[k : k + 1024] @ x.T >= cosine
            a = np.arange(k, k + len(s))
            s[np.arange(len(a)), a] = False
            if not lone:  # links within a tile are counted in that tile's pair with itself
                s &= tile[a][:, None] != tile[None, :]
            n = s @ mult
            yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(n.astype(np.int64))], ["cid", "n"])

    def few(x, size, cid, mult):
        """Many small groups at once, each row with the 1st, 2nd, ... after it."""
        n, group = np.zeros(len(x), np.int64), np.repeat(np.arange(len(size)), size)
        for d in range(1, int(size.max(initial=1))):
            ok = np.flatnonzero(group[:-d] == group[d:])
            ok = ok[np.einsum("ij,ij->i", x[ok], x[ok + d]) >= cosine]
            n[ok] += mult[ok + d]
            n[ok + d] += mult[ok]
        return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n)], ["cid", "n"])

    def flush(held):
        pair, tile, cid, mult, dim, lone = (np.concatenate([h[k] for h in held]) for k in range(6))
        vector = pa.concat_arrays([h[6] for h in held])
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        size = np.diff(np.append(begin, len(pair)))
        low = (size <= 32) & lone[begin]
        small = np.repeat(low, size)
        for d in np.unique(dim[small]).tolist():
            pick = np.flatnonzero(small & (dim == d))
            own = np.flatnonzero(low & (dim[begin] == d))
            yield few(_matrix(vector.take(pa.array(pick))), size[own], cid[pick], mult[pick])
        for k in np.flatnonzero(~low):
            at = slice(begin[k], begin[k] + size[k])
            yield from degrees(_matrix(vector[begin[k] : begin[k] + size[k]]), tile[at], cid[at], mult[at], bool(lone[begin[k]]))

    def run(batches):
        held = []
        for batch in batches:
            pair, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "tile", "cid", "mult", "dim", "lone"))
            rest.append(batch.column("vector"))
            held.append((pair, *rest))
            if not len(pair) or held[0][0][0] == pair[-1]:
                held = [h for h in held if len(h[0])]
                continue
            cut = int(np.flatnonzero(pair != pair[-1])[-1]) + 1 if (pair != pair[-1]).any() else 0
            done = [*held[:-1], (pair[:cut], *(x[:cut] for x in rest))]
            yield from flush([h for h in done if len(h[0])])
            held = [(pair[cut:], *(x[cut:] for x in rest))]
        if held:
            yield from flush(held)

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, passes: int | None = None, bits: int = HASH_BITS, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of vectors.

    Equal vectors of one label and length make one class, found before any comparison. There
    are as many passes as the largest label needs (passes_for), unless stated. In each pass the classes are range-sorted by label and the hash of the pass, and each is
    compared with the next `window` ones; verified pairs of all passes are united. Every two
    classes of a component so found are then compared in tiles, so that n_links counts all
    links inside it, also those that no window held.

    Vectors that are null or empty, have a null, NaN or infinite part, are zero, or have no
    label link with nothing. Rows alike in everything are rows all the same, and link.
    component_id is the least key in the component; null keys are passed over, and a row is
    kept if its key is that (a null key never is).
    """
    sound = (
        F.col("label").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    h = [F.xxhash64(F.lit(k), "label", F.size("vector"), "vector").alias(f"h{k}") for k in (1, 2)]
    if passes is None:
        largest = rows.where("sound").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        passes = passes_for(largest or 0, window, cosine)
    good = rows.where("sound").select("key", "vector", "label", *h)
    classes = good.groupBy("h1", "h2").agg(
        F.first("vector").alias("vector"), F.first("label").alias("label"), F.min("key").alias("least"), F.count("*").alias("mult")
    )
    classes = classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    kind = dict(classes.dtypes)
    hashed = classes.mapInArrow(_hasher(passes, bits, PROJECTION_SEED), ", ".join(f"{c} {kind[c]}" for c in classes.columns) + ", hashes array<bigint>")
    classes = checkpoint(hashed)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = classes.select("cid", "dim", "vector", "label", F.posexplode("hashes").alias("pass", "hash"))
    order = ["dim", "pass", "label", "hash", "cid"]
    sorted_ = sorted_.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sorted_ = sorted_.select(F.xxhash64("dim", "pass", "label").alias("group"), "cid", "dim", "vector")
    links = sorted_.mapInArrow(_neighbours(window, cosine), "a bigint, b bigint")
    joined = components(links)
    members = classes.join(joined, classes["cid"] == joined["node"]).select("cid", "dim", "vector", "mult", "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    tiles = F.ceil(F.col("size") / tile).cast("int")
    members = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("cid"), tiles).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda t: F.struct(F.xxhash64(F.col("component"), F.least("tile", t), F.greatest("tile", t)).alias("pair"), (t == F.col("tile")).alias("lone")),
    )
    dealt = members.select(F.explode(pairs).alias("p"), "tile", "cid", "mult", "dim", "vector")
    dealt = dealt.select("p.pair", "p.lone", "tile", "cid", "mult", "dim", "vector")
    dealt = dealt.repartition(n, "pair").sortWithinPartitions("pair")
    degree = dealt.mapInArrow(_tiles(cosine), "cid bigint, n bigint").groupBy("cid").agg(F.sum("n").alias("n"))
    least = classes.join(joined, classes["cid"] == joined["node"], "left").withColumn("part", F.coalesce("component", "cid"))
    lowest = least.groupBy("part").agg(F.min("least").alias("component_id"))
    of_class = least.select("h1", "h2", "cid", "mult", "part").join(lowest, "part").join(degree, "cid", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = good.select("key", "h1", "h2").join(of_class, ["h1", "h2"]).select("key", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lows AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN lows USING (r) LEFT JOIN degree USING (r)"""
