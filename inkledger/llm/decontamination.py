"""Benchmark decontamination by suffix arrays over shards of the training texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import shards, words
from .common import fresh, table

#: Words of a benchmark item that make a leak where they stand together.
WINDOW = 10
#: Benchmark texts are broadcast in blocks of at most about so many bytes, read one after another.
BLOCK_BYTES = 4 << 20
#: Texts are searched in shards of about so many bytes; each shard looks at every window of a block once.
SHARD_BYTES = 4 << 20

FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("longest", pa.int64()),
        ("longest_item", pa.string()),
        ("longest_at", pa.int64()),
    ]
)
FOUND_SQL = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:bigint,last:bigint>>,"
    "longest:bigint,longest_item:string,longest_at:bigint>"
)


def block_of(items: list[tuple[str, str]], window: int) -> dict:
    """The items' suffixes that begin with a window, in order of all their words.

    `seq` holds the words' numbers in the block's vocabulary, a 0 behind each item. Suffixes
    that begin with one window stand together; `first` is where each window's begin in `suffix`.
    """
    items = sorted(items)
    _, data, bounds = next(shards(pa.array([t for _, t in items], pa.string()), 1 << 62))
    w = words(data, bounds)
    vocab, ids = np.unique(w.hash, return_inverse=True)
    n = np.bincount(w.doc, minlength=len(items))
    seq = np.zeros(len(ids) + len(items), np.int64)
    seq[np.arange(len(ids)) + w.doc] = ids + 1
    begin = np.cumsum(n + 1) - n - 1
    starts = [np.arange(s, s + max(k - window, 0) + 1) for s, k in zip(begin.tolist(), n.tolist(), strict=True) if k]
    if not starts:
        return {"names": []}
    suffix = np.concatenate(starts)
    order = suffix_array(seq, int(n.max()), 1)
    rank = np.zeros(len(seq), np.int64)
    rank[order] = np.arange(len(order))
    suffix = suffix[np.argsort(rank[suffix])]
    rows = _rows(seq, suffix, window)
    new = np.append(True, (rows[1:] != rows[:-1]).any(1))
    owner = np.searchsorted(begin, suffix, side="right") - 1
    # the windows, each once, their lengths, and the pairs of neighbouring words that stand in each (0: no pair)
    wins = rows[new]
    joint = _pairs(wins[:, :-1], wins[:, 1:], len(vocab))
    pairs, pair_of = np.unique(joint, return_inverse=True)
    return {
        "names": [i for i, _ in items], "vocab": vocab, "seq": seq.astype(np.int32), "suffix": suffix, "owner": owner, "first": np.append(np.flatnonzero(new), len(suffix)), "window": window,
        "wins": wins.astype(np.int32), "sizes": (wins > 0).sum(1), "pairs": pairs, "pair_of": pair_of.reshape(joint.shape).astype(np.int32),
    }


def _pairs(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A number for each pair of neighbouring words, 0 where either is none."""
    return np.where((a > 0) & (b > 0), a.astype(np.int64) * (n + 1) + b, 0)


def possible(seq: np.ndarray, b: dict) -> np.ndarray:
    """Numbers of the windows all of whose words, and pairs of neighbouring words, stand in the shard: no other can be found in it."""
    there = np.zeros(len(b["vocab"]) + 1, bool)
    there[seq] = there[0] = True
    own = np.unique(_pairs(seq[:-1], seq[1:], len(b["vocab"])))
    place = np.minimum(np.searchsorted(own, b["pairs"]), len(own) - 1)
    met = (own[place] == b["pairs"] if len(own) else False) | (b["pairs"] == 0)
    return np.flatnonzero(there[b["wins"]].all(1) & met[b["pair_of"]].all(1))


def _rows(seq: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The next `width` words from each place, 0 from the end of the text on."""
    cols = at[:, None] + np.arange(width)
    got = np.where(cols < len(seq), seq[np.minimum(cols, len(seq) - 1)], 0)
    return np.where(np.cumsum(got == 0, axis=1) > 0, 0, got)


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> list:
    """The benchmark in broadcast blocks; the driver holds one block at a time."""
    sc, out, part, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator(prefetchPartitions=False):
        part.append((row.i, row.t))
        size += len(row.t)
        if size >= most:
            out.append(sc.broadcast(block_of(part, window)))
            part, size = [], 0
    if part:
        out.append(sc.broadcast(block_of(part, window)))
    return out


def _read(blocks: list):
    """The blocks one after another; of several, each is read anew from the executor's copy and let go again."""
    for b in blocks:
        yield b.value if len(blocks) == 1 else b.load_from_path(b._path)


def suffix_array(seq: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Starts of suffixes in order of their first `depth` words.

    0 stands for a text's end and for words of no item. A suffix with fewer than `least`
    words before the next 0 holds no window and is left out.
    """
    there = np.flatnonzero(seq)
    if not len(there):
        return there
    rank, k = seq.copy(), 1
    _, inverse = np.unique(rank[there], return_inverse=True)
    rank[there] = inverse + 1
    while k < depth:
        ahead = np.zeros(len(there), np.int64)
        ok = there + k < len(seq)
        ahead[ok] = rank[there[ok] + k]
        _, inverse = np.unique(rank[there] * (len(there) + 1) + ahead, return_inverse=True)
        rank[there] = inverse + 1
        k *= 2
    gaps = np.append(np.flatnonzero(seq == 0), len(seq))
    run = gaps[np.searchsorted(gaps, there)] - there
    there = there[run >= least]
    return there[np.argsort(rank[there], kind="stable")]


def _bound(seq: np.ndarray, sa: np.ndarray, wins: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all windows at once: the first suffix not before, or after, those that begin with the window."""
    lo, hi = np.zeros(len(wins), np.int64), np.full(len(wins), len(sa))
    cols = np.arange(wins.shape[1])
    live = cols < sizes[:, None]
    while (open_ := lo < hi).any():
        k = np.flatnonzero(open_)
        mid = (lo[k] + hi[k]) // 2
        at = sa[mid][:, None] + cols
        got = np.where(at < len(seq), seq[np.minimum(at, len(seq) - 1)], 0)
        diff = (got != wins[k]) & live[k]
        first = diff.argmax(1)
        some = diff[np.arange(len(k)), first]
        less = some & (got[np.arange(len(k)), first] < wins[k, first])
        right = less | (~some if upper else False)
        lo[k] = np.where(right, mid + 1, lo[k])
        hi[k] = np.where(right, hi[k], mid)
    return lo


def extend(seq: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """From places that begin with the window of the item suffixes lo to hi: the words they share with the suffix that goes on longest, and such a suffix.

    Word by word the suffixes that go on like the text are found by bisection, as they are in order.
    """
    lo, hi, depth = lo.copy(), hi.copy(), depth.copy()
    live = np.arange(len(place))
    items, suffix = b["seq"], b["suffix"]
    while len(live):
        at = place[live] + depth[live]
        word = np.where(at < len(seq), seq[np.minimum(at, len(seq) - 1)], 0)
        live, word = live[word > 0], word[word > 0]
        ends = []
        for upper in (False, True):
            left, right = lo[live].copy(), hi[live].copy()
            while len(k := np.flatnonzero(left < right)):
                mid = (left[k] + right[k]) // 2
                got = items[suffix[mid] + depth[live[k]]]
                less = got <= word[k] if upper else got < word[k]
                left[k], right[k] = np.where(less, mid + 1, left[k]), np.where(less, right[k], mid)
            ends.append(left)
        on = ends[0] < ends[1]
        live = live[on]
        lo[live], hi[live] = ends[0][on], ends[1][on]
        depth[live] += 1
    return depth, lo


def search(data: np.ndarray, bounds: np.ndarray, blocks) -> list[dict]:
    """FOUND for each text of a shard. Of equally long matches the first in the text is told, and of its items the least."""
    w = words(data, bounds)
    n = len(bounds) - 1
    at = np.arange(len(w.doc)) + w.doc  # one free place after each text
    total = len(w.doc) + n
    first = np.searchsorted(w.doc, np.arange(n)) + np.arange(n)  # where each text begins among the places
    n_words = np.bincount(w.doc, minlength=n)
    cover = np.zeros(total + 1, np.int64)
    items: list[set] = [set() for _ in range(n)]
    best: list[tuple] = [(0, None, None)] * n
    for b in blocks:
        if not b["names"]:
            continue
        seq = np.zeros(total, np.int64)
        pos = np.minimum(np.searchsorted(b["vocab"], w.hash), len(b["vocab"]) - 1)
        seq[at] = np.where(b["vocab"][pos] == w.hash, pos + 1, 0)
        sizes, some = b["sizes"], possible(seq, b)
        if not len(some):
            continue
        # a match is made of such windows, so that other words end it like words of no item
        live = np.zeros(len(b["vocab"]) + 1, bool)
        live[b["wins"][some]] = True
        seq[~live[seq]] = 0
        sa = suffix_array(seq, b["window"], int(sizes[some].min()))
        lo = _bound(seq, sa, b["wins"][some], sizes[some], False)
        n_found = _bound(seq, sa, b["wins"][some], sizes[some], True) - lo
        hit = np.flatnonzero(n_found)
        if not len(hit):
            continue
        count = n_found[hit]
        win = np.repeat(some[hit], count)
        place = sa[np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + sizes[win], -1)
        doc = np.searchsorted(first, place, side="right") - 1
        for d, k in np.unique(np.column_stack((doc, win)), axis=0).tolist():
            items[d].update(b["names"][o] for o in np.unique(b["owner"][b["first"][k] : b["first"][k + 1]]).tolist())
        length, suffix = extend(seq, place, b["first"][win], b["first"][win + 1], sizes[win], b)
        by = np.lexsort((place, -length, doc))
        by = by[np.append(True, doc[by][1:] != doc[by][:-1])]
        for k in by.tolist():
            d, m, p = int(doc[k]), int(length[k]), int(place[k] - first[doc[k]])
            held = best[d]
            alike = b["suffix"][b["first"][win[k]] : b["first"][win[k] + 1]]
            reach = _rows(b["seq"], alike, m) == _rows(b["seq"], b["suffix"][suffix[k] : suffix[k] + 1], m)
            name = min(b["names"][o] for o in b["owner"][b["first"][win[k]] : b["first"][win[k] + 1]][reach.all(1)].tolist())
            if (-m, p, name) < (-held[0], held[2] or 0, held[1] or ""):
                best[d] = (m, name, p)
    covered = np.cumsum(cover)[:total] > 0
    edges = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = np.searchsorted(first, begins, side="right") - 1
    spans: list[list] = [[] for _ in range(n)]
    for k, s, e in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
        spans[k].append({"first": int(s - first[k]), "last": int(e - 1 - first[k])})
    return [
        {
            "n_words": int(n_words[k]),
            "n_hit": sum(x["last"] - x["first"] + 1 for x in spans[k]),
            "items": sorted(items[k]),
            "spans": spans[k],
            "longest": best[k][0],
            "longest_item": best[k][1],
            "longest_at": best[k][2],
        }
        for k in range(n)
    ]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Give each row `leaks`: words hit, spans of them, items met and the longest verbatim match.

    The texts of a batch form shards; over each a suffix array of words is built, and every
    window that begins a benchmark suffix is searched in it by bisection, so that all its
    places are found. From each place the match is followed on through the items' sorted
    suffixes, all that begin with the window, which gives the longest match. Nothing is
    shuffled. The benchmark goes out in blocks of bounded size, and a task holds one at a time.

    Null and wordless texts have no words and no hits. Items without words match nothing;
    items under one id count once; a null id reads ''. An empty benchmark leaves all clean.
    """
    blocks = blocks_of(benchmark, item, item_text, window, block_bytes)

    @F.arrow_udf(FOUND_SQL)
    def leaks(texts: pa.Array) -> pa.Array:
        return pa.array([x for _, data, bounds in shards(texts, SHARD_BYTES) for x in search(data, bounds, _read(blocks))], FOUND)

    return docs.drop("leaks").withColumn("leaks", leaks(F.col(f"`{text}`")))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those rows that hold a window of a benchmark item."""
    (name,) = fresh(docs, "_leaks")
    named = {c: name if c.lower() == "leaks" else c for c in docs.columns}
    found = find_leaks(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), benchmark)
    return found.where("leaks.n_hit = 0").select(*[F.col(f"`{n}`").alias(c) for c, n in named.items()])


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "leaks.n_words",
        "leaks.n_hit",
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"),
        (F.col("leaks.n_hit") > 0).alias("contaminated"),
        F.col("leaks.longest").alias("longest"),
    )


OP2_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents
  UNION ALL
  SELECT 'b', coalesce(CAST(item_id AS VARCHAR), ''), row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark),
items AS (SELECT id AS item, rid AS item_row, w, least(10, len(w)) AS size FROM words WHERE kind = 'b' AND len(w) > 0),
wins AS (
  SELECT DISTINCT item, item_row, size, pos, win
  FROM (SELECT item, item_row, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS win FROM (SELECT *, unnest(range(len(w) - size + 1)) AS pos FROM items))),
places AS (
  SELECT rid, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS pos FROM words CROSS JOIN (SELECT DISTINCT size FROM items) WHERE kind = 'd')),
met AS (SELECT rid, item, item_row, places.pos, places.size, places.pos - wins.pos AS diagonal FROM places JOIN wins ON places.win = wins.win AND places.size = wins.size),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid),
runs AS (SELECT rid, max(n) AS longest FROM (
  SELECT rid, count(*) - 1 + size AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid, item_row, diagonal ORDER BY pos) AS run FROM met) GROUP BY rid, item_row, diagonal, run, size) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM words LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid) LEFT JOIN runs USING (rid) WHERE kind = 'd'"""
