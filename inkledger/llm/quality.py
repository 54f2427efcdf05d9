"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import hashes, shards, words
from .common import table

#: Buckets of hashed words; factors of each feature.
BUCKETS, FACTORS = 1 << 13, 8
#: The model is fitted on at most so many labelled texts (the least hashes of doc_id) and, of each, its first counts over the whole text.
SAMPLE = 8000
#: What the words of a text weigh together against its statistics: with few labels words are learnt by heart.
WORDS_WEIGH = 0.5
#: Each statistic falls into one of so many bins, cut at quantiles of the sample.
BINS = 10
THRESHOLD = 0.3

STATS = (
    "bytes", "words", "word_bytes", "upper", "digits", "marks", "spaces", "beyond_ascii", "distinct_words", "top_word",
    "repeated_next", "distinct_pairs", "marked_words", "short_words", "upper_words", "lines", "distinct_lines", "words_a_line", "top_byte",
)
#: Columns of numbers that are read beside the text; null reads 0.
METADATA = ("n_chars",)
FEATURES = len(STATS) + len(METADATA)


class Model(NamedTuple):
    edges: np.ndarray  # STATS x (BINS - 1)
    bias: float
    weight: np.ndarray
    factor: np.ndarray


class Rows(NamedTuple):
    """Texts in sparse form: row k has word buckets `bucket[ptr[k]:ptr[k+1]]`."""

    ptr: np.ndarray
    bucket: np.ndarray
    stats: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many keys it has, and how often the commonest comes. Of a key 40 bits are read."""
    both = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    d, most = (both[at] >> np.uint64(40)).astype(np.int64), np.zeros(n)
    np.maximum.at(most, d, np.diff(np.append(at, len(both))))
    return np.bincount(d, minlength=n), most


def _top_byte(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often the commonest byte of each text comes."""
    return np.array([np.bincount(data[s:e]).max() if e > s else 0 for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], float)


def describe(data: np.ndarray, bounds: np.ndarray, metadata: np.ndarray) -> Rows:
    """Word buckets, statistics and metadata of each text of a shard; empty texts have no buckets and zero statistics."""
    n = len(bounds) - 1
    w = words(data, bounds)
    size = np.diff(bounds).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(mask, dtype=np.int64))
        return (upto[bounds[1:]] - upto[bounds[:-1]]).astype(float)

    upper, digit, space = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), (data == 32) | ((data >= 9) & (data <= 13))
    letter, beyond = upper | ((data >= 97) & (data <= 122)), data >= 128
    mark = ~(letter | digit | space | beyond)
    n_words = np.bincount(w.doc, minlength=n).astype(float)
    of_words = lambda mask: np.bincount(w.doc[mask], minlength=n).astype(float)
    distinct, top = _distinct(w.doc, w.hash, n)
    near = w.doc[1:] == w.doc[:-1]
    pair = (w.hash[:-1] * np.uint64(31) + w.hash[1:])[near]
    pairs, _ = _distinct(w.doc[:-1][near], pair, n)
    n_pairs = np.bincount(w.doc[:-1][near], minlength=n)
    again = np.append(near & (w.hash[1:] == w.hash[:-1]), np.zeros(min(1, len(w.doc)), bool))
    padded = np.append(mark, [False, False])
    marked = padded[w.end] & padded[w.end + 1]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds[:-1]] = True
    begins[np.flatnonzero(data == 10) + 1] = True
    start = np.flatnonzero(begins[:-1])
    end = np.append(start[1:], len(data))
    line = np.searchsorted(bounds, start, side="right") - 1
    lines = np.bincount(line, minlength=n).astype(float)
    distinct_lines, _ = _distinct(line, hashes(data, start, end), n)
    top_byte = _top_byte(data, bounds)
    stats = np.column_stack(
        (
            np.log1p(size), np.log1p(n_words), _share(np.bincount(w.doc, w.end - w.start, n), n_words), _share(count(upper), size),
            _share(count(digit), size), _share(count(mark), size), _share(count(space), size), _share(count(beyond), size),
            _share(distinct, n_words), _share(top, n_words), _share(of_words(again), n_words), _share(pairs, n_pairs),
            _share(of_words(marked), n_words), _share(of_words(w.end - w.start < 3), n_words),
            _share(of_words(upper[w.start] & upper[w.end - 1] & (w.end - w.start > 1)), n_words), np.log1p(lines), _share(distinct_lines, lines),
            _share(n_words, lines), _share(top_byte, size), *np.log1p(np.maximum(metadata, 0.0)).T,
        )
    )
    cell = np.unique(w.doc * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64))
    ptr = np.searchsorted(cell // BUCKETS, np.arange(n + 1))
    return Rows(ptr, cell % BUCKETS, stats)


def encode(rows: Rows, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all features: the words of a text weigh WORDS_WEIGH together, its statistics and metadata 1."""
    n, k = rows.stats.shape
    size = np.diff(rows.ptr)
    bins = np.column_stack([np.searchsorted(edges[j], rows.stats[:, j], side="right") for j in range(k)]) if n else np.zeros((0, k), np.int64)
    row = np.repeat(np.arange(n, dtype=np.int32), size + k)
    is_word, at = np.ones(len(row), bool), (np.cumsum(size + k)[:, None] - k + np.arange(k)).ravel()
    is_word[at] = False  # a row's words come first, then its statistics
    feature, value = np.empty(len(row), np.int32), np.empty(len(row))
    feature[is_word], feature[at] = rows.bucket, (BUCKETS + np.arange(k) * BINS + bins).ravel()
    value[is_word], value[at] = np.repeat(WORDS_WEIGH / np.sqrt(np.maximum(size, 1)), size), 1 / np.sqrt(k)
    return row, feature, value


def _sums(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of x by row; rows are sorted and each has an entry at least."""
    return np.add.reduceat(x, np.searchsorted(row, np.arange(n)), axis=0) if n else np.zeros((0, *x.shape[1:]))


def margins(model: Model, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias, linear terms and all pairs' interactions, as half of (square of the sum - sum of the squares)."""
    part = model.factor[feature] * value[:, None]
    total = _sums(row, part, n)
    pairs = 0.5 * ((total**2).sum(1) - _sums(row, (part**2).sum(1), n))
    return model.bias + _sums(row, model.weight[feature] * value, n) + pairs, total


def probability(model: Model, rows: Rows) -> np.ndarray:
    n = len(rows.stats)
    m, _ = margins(model, *encode(rows, model.edges), n)
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


def fit(rows: Rows, label: np.ndarray, epochs: int = 60, patience: int = 4, batch: int = 128, rate: float = 0.03, decay: float = 1.6, seed: int = 7) -> Model:
    """Least logistic loss by Adam over shuffled batches; reruns agree. With one label only, the score is that share.

    Both labels weigh alike in all. A tenth of the rows is put by: fitting ends when their loss
    has not fallen for `patience` epochs, and the parameters of its least loss are taken.
    """
    k = rows.stats.shape[1]
    edges = np.quantile(rows.stats, np.arange(1, BINS) / BINS, axis=0).T if len(label) else np.zeros((k, BINS - 1))
    rng = np.random.default_rng(seed)
    n_features = BUCKETS + k * BINS
    if len(set(label.tolist())) < 2:
        bias = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        return Model(edges, bias, np.zeros(n_features), np.zeros((n_features, FACTORS)))
    share = label.mean()
    weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    params = [np.zeros(1), np.zeros(n_features), rng.normal(0, 0.05, (n_features, FACTORS))]
    begin = rows.ptr + np.arange(len(label) + 1) * k
    _, feature, value = encode(rows, edges)
    del rows, _  # the driver holds the sample in one form at a time
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def some_rows(some: np.ndarray):
        size = begin[some + 1] - begin[some]
        at = np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        r, f, x = np.repeat(np.arange(len(some)), size), feature[at], value[at]
        m, total = margins(Model(edges, params[0][0], params[1], params[2]), r, f, x, len(some))
        return r, f, x, np.clip(m, -40, 40), total

    order = rng.permutation(len(label))
    aside, order = order[: len(order) // 10], order[len(order) // 10 :]
    decay, best, since = decay / len(order), (np.inf, [p.copy() for p in params]), 0
    for _ in range(epochs):
        order = rng.permutation(order)
        for some in np.array_split(order, max(1, len(order) // batch)):
            r, f, x, m, total = some_rows(some)
            g = weight[some] * (1 / (1 + np.exp(-m)) - label[some]) / len(some)
            used, inverse = np.unique(f, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            at_used = np.searchsorted(inverse[by], np.arange(len(used)))
            gw = np.add.reduceat((g[r] * x)[by], at_used)
            gv = np.add.reduceat(((g[r] * x)[:, None] * (total[r] - params[2][f] * x[:, None]))[by], at_used)
            step += 1
            grads = (g.sum(keepdims=True), gw + decay * params[1][used], gv + decay * params[2][used])
            for p, a, b, grad, where in zip(params, first, second, grads, (slice(None), used, used), strict=True):
                a[where] = 0.9 * a[where] + 0.1 * grad
                b[where] = 0.999 * b[where] + 0.001 * grad**2
                p[where] -= rate * (a[where] / (1 - 0.9**step)) / (np.sqrt(b[where] / (1 - 0.999**step)) + 1e-8)
        rate *= 0.93
        if len(aside):
            m = np.concatenate([some_rows(some)[3] for some in np.array_split(aside, max(1, len(aside) // batch))])
            loss = float((weight[aside] * (np.logaddexp(0, m) - label[aside] * m)).mean())
            if loss < best[0] * 0.999:
                best, since = (loss, [p.copy() for p in params]), 0
            else:
                since += 1
                if since >= patience:
                    break
    if not len(aside):
        return Model(edges, float(params[0][0]), *params[1:])
    bias, linear, factor = best[1]
    return Model(edges, float(bias[0]), linear, factor)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _numbers(batch, metadata: tuple[str, ...]) -> np.ndarray:
    cols = [np.nan_to_num(batch[m].to_numpy(zero_copy_only=False).astype(float)) for m in metadata]
    return np.column_stack(cols) if cols else np.zeros((batch.num_rows, 0))


def _gathered(counted: DataFrame, width: int) -> tuple[Rows, np.ndarray]:
    """The sample's rows, each as often as it counts, and labels, in order of id and label."""
    got = counted.toArrow()
    ids, label, times = (got[c].to_numpy() for c in ("id", "label", "times"))
    order = np.lexsort((label, ids))
    order = np.repeat(order, times[order])
    got = got.select(["buckets", "stats"]).combine_chunks().take(pa.array(order))
    ptr = np.append(0, np.cumsum(pc.list_value_length(got["buckets"]).to_numpy(), dtype=np.int64))
    bucket, stats = (pc.list_flatten(got[c]).to_numpy() for c in ("buckets", "stats"))
    return Rows(ptr, bucket, stats.reshape(len(order), width)), label[order].astype(float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, metadata: tuple[str, ...] = METADATA) -> Model:
    """Fit on a sample of labelled texts whose crc32 of doc_id leaves a remainder of 1 to 4 by 5.

    The sample is the `sample` labelled ids of least hash, so it is bounded, and so is what
    goes to the driver. Null ids and labels are passed over; a text labelled twice counts
    twice; of several texts under one id the one of least hash is read. Without any label the
    score is 0.5 everywhere.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", F.col("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    chosen = chosen.groupBy("doc_id", "_label").agg(F.count("*").cast("int").alias("_times"))
    own = docs.select("doc_id", F.struct("text", *[F.col(m).cast("double").alias(m) for m in metadata]).alias("r"))
    texts = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label", "_times").agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    texts = texts.select("doc_id", "_label", "_times", "r.*")

    def counted(batches):
        for batch in batches:
            label, ids, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_label", "doc_id", "_times"))
            meta = _numbers(batch, metadata)
            for first, data, bounds in shards(batch.column("text")):
                r = describe(data, bounds, meta[first : first + len(bounds) - 1])
                n, k = r.stats.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first : first + n]),
                        pa.array(label[first : first + n].astype(np.int32)),
                        pa.array(times[first : first + n].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(r.ptr.astype(np.int32)), pa.array(r.bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * k).astype(np.int32)), pa.array(r.stats.ravel())),
                    ],
                    ["id", "label", "times", "buckets", "stats"],
                )

    schema = "id bigint, label int, times int, buckets array<int>, stats array<double>"
    rows, label = _gathered(texts.mapInArrow(counted, schema), len(STATS) + len(metadata))
    model = fit(rows, label)
    del rows
    pa.default_memory_pool().release_unused()  # the driver lives on for the stages that follow
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """docs with the score of each whole text, 0 to 1; null and empty texts are scored as texts without words.

    A text above a shard's size is held whole in one task. The model is of fixed size. A
    column called `name` is replaced; `metadata` are the columns the model was fitted with.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def scores(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
        m = Model(*shared.value)
        meta = _numbers(pa.RecordBatch.from_arrays([texts, *numbers], ["text", *metadata]), metadata)
        parts = [probability(m, describe(d, b, meta[first : first + len(b) - 1])) for first, d, b in shards(texts)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(name, scores(F.col(f"`{text}`"), *[F.col(f"`{m}`").cast("double") for m in metadata]))


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *METADATA)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
