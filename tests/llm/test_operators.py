import hashlib
import os
import re
import tracemalloc
from datetime import date

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

llm = pytest.importorskip("inkledger.llm")

from inkledger.llm import decontamination, licences, mixing, passages, private, quality, registry, sharding, simhash, tokens, vectors  # noqa: E402
from inkledger.llm.common import components  # noqa: E402

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
TEXTS = [LONG, LONG + " pi", LONG, None, "", "  \n\t", "one", "ONE", "é " * 5000, "All rights reserved. CC BY-SA 4.0 and the GNU General Public License, version 3."]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string, leaks string, _fp string, _size string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 7 else None, t, "en", "s" if k % 3 else None, 0, "x", "x", "x", "x", "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA).cache()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in (100, 101, 102, 103)}}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "x beta gamma delta epsilon zeta eta theta iota kappa lambda y"), (2, "One"), (3, None), (4, "!!"), (None, "omicron pi")], "item_id bigint, text string")
    wins = {}
    for item, text in [("1", "x beta gamma delta epsilon zeta eta theta iota kappa lambda y"), ("2", "one"), ("", "omicron pi")]:
        w = words(text)
        for j in range(max(1, len(w) - 9)):
            wins.setdefault(tuple(w[j : j + 10]), set()).add(item)
    for block in (8 << 20, 1):  # one block, and one for each item
        got = decontamination.find_leaks(docs, bench, block_bytes=block).select("text", "leaks.*").collect()
        assert len(got) == len(TEXTS) + 1
        for r in got:
            w, hit, items = words(r.text), set(), set()
            for g, names in wins.items():
                for j in range(len(w) - len(g) + 1):
                    if tuple(w[j : j + len(g)]) == g:
                        hit |= set(range(j, j + len(g)))
                        items |= names
            assert (r.n_words, r.n_hit, set(r["items"])) == (len(w), len(hit), items)
    assert decontamination.remove_leaks(docs, bench).columns == docs.columns
    assert decontamination.remove_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.remove_leaks(docs.limit(0), bench).count() == 0


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, docs):
    assert [simhash.fingerprint(t) for t in TEXTS] == [brute_print(t) for t in TEXTS]
    _, classes = simhash.near_classes(docs)
    assert classes.count() == len({brute_print(t) for t in TEXTS})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == classes.select("class").distinct().count()
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("tile", "blocks"), [(2048, 4), (8, 4), (2048, 5)])
def test_simhash_links(spark, tile, blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (60, 4), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (60, 4), dtype=np.uint64))
    prints = np.unique(np.concatenate((base, near.ravel(), base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    got = {r.node: r.component for r in components(simhash.near_links(df, blocks=blocks, tile=tile)).collect()}
    signed = prints.view(np.int64)
    group = {int(x): int(x) for x in signed}
    for _ in range(20):
        for x, u in zip(signed, prints, strict=True):
            near = signed[np.bitwise_count(prints ^ u) <= 3]
            low = min(group[int(y)] for y in near)
            for y in near:
                group[int(y)] = low
    assert {k: got.get(k, k) for k in group} == group


@pytest.mark.parametrize("tile", [1024, 20])
def test_vectors(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + rng.normal(0, 0.05, (10, 16)), base[:1] + rng.normal(0, 0.08, (60, 16)), base[:3]]).astype(np.float32)
    rows = [(k, [float(y) for y in v], 1) for k, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [], 1), (905, rows[0][1], None), (None, rows[0][1], 1)]
    got = vectors.near_vectors(spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, label int"), tile=tile).collect()
    y = np.concatenate([x, x[:1]]).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.93).sum(1) - 1
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert [by[k].n_links for k in range(len(x))] == links[:-1].tolist()
    assert all(by[k].n_links == 0 and by[k].component_id == k and by[k].kept for k in range(900, 906))
    assert by[None].component_id == 0 and not by[None].kept
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_passages(spark):
    passage = "This passage has a few words of its own here. And a second sentence follows it now. And a third one closes it."
    rows = [(1, f"First. {passage} Own end one."), (2, f"Second start.\n{passage}\nOwn end two."), (3, None), (4, ""), (5, "Own. Words."), (None, "Own. Words.")]
    got = {r.doc_id: r for r in passages.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_removed", F.lit("x"))).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].n_removed == 3 and got[2].text == "Second start.\nOwn end two."
    assert got[3].text == got[4].text == "" and got[5].text == got[None].text == "Own. Words."


def test_passages_of_rows_without_or_sharing_a_key(spark):
    passage = "This passage has a few words of its own here. And a second sentence follows it now. And a third one closes it."
    head = "Unique opening words of a text. Its second sentence is also its own. The third is not found elsewhere."
    for key in (None, 7):
        texts = [f"Own. {passage} End one.", f"Own. {passage} End two.", f"Own. {head} Last.", f"Own. {head} Last."]
        df = spark.createDataFrame([(key, t) for t in texts], "doc_id bigint, text string")
        got = sorted(passages.drop_repeats(df).collect(), key=lambda r: r.text)
        assert sorted(r.n_removed for r in got) == [0, 0, 0, 4]  # "Own." and the passage, from one of the two
        assert [r.text for r in got if head in r.text] == texts[2:]  # equal rows are one document
        assert sum(passage in r.text for r in got) == 1 and sum("End" in r.text for r in got) == 2


def test_tokens(spark, docs):
    encoding, sizes = tokens.encoder(tokens.RANKS, tokens.PIECES)
    for r in tokens.count_tokens(docs).select("text", "counts").collect():
        assert len(r.counts) == 2 + len((r.text or "").split("\n"))
    data, names, start, _ = tokens.sections([("a", "héllo wor"), ("text", "x \n\n y  z")], "text")
    ids = np.array(encoding.encode_ordinary(data.decode()))
    owned, _ = tokens.attribute(data, start, sizes, ids)
    brute, at = [0] * len(names), 0
    for token in encoding.decode_tokens_bytes(ids.tolist()):
        first = next((at + k for k, c in enumerate(token) if c not in b" \t\n\x0b\x0c\r"), at)
        brute[max(k for k, s in enumerate(start) if s <= first)] += 1
        at += len(token)
    assert at == len(data) and owned.tolist() == brute
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_licences(spark, docs):
    got = {r.text: r for r in licences.scan(docs).collect()}
    last = got[TEXTS[-1]]
    assert last.n_words == len(words(TEXTS[-1]))
    assert {(b.first, b.label) for b in last.base} == {(0, "reserved"), (3, "cc-by"), (11, "gpl")}
    assert {f.label for f in last.found} == {"reserved", "cc-by-sa-4.0", "gpl-3"}
    assert got[None].n_words == 0 and got[""].base == [] and got["one"].n_words == 1
    assert len(licences.rules()) > 200 and licences.scan(docs.limit(0)).count() == 0


def test_pseudonyms(spark):
    text = "Call +1 (743) 555-3824, card 4785380592391139 or 4785380592391138, ip 1.2.3.4 and 300.1.1.1, on 2024-02-29 and 2023-02-29, me@mail.org, password=abcdef1234, 03/04/2021."
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "plain words")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in private.pseudonyms(df).collect()}
    assert got[1].text == got[2].text and got[3].text is None and got[4].text == "" and got[5].text == "plain words"
    for old in ("743", "4785380592391139", "1.2.3.4", "2024-02-29", "me@mail.org", "abcdef1234", "03/04/2021"):
        assert old not in got[1].text
    for stays in ("4785380592391138", "300.1.1.1", "2023-02-29", "+1 ("):
        assert stays in got[1].text
    number = re.search(r"card (\d{16}) or", got[1].text)[1]
    digits = [int(c) for c in number[::-1]]
    assert sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    date.fromisoformat(re.search(r"on (\S+) and", got[1].text)[1])
    key = F.lit("k")
    for form, value in ((private.card, "4785 3805 9239 1139"), (private.phone, "+1 (743) 555-3824"), (private.ip, "10.20.30.40"), (private.date, "2024-02-29"), (private.date, "31.12.1999"), (private.ssn, "123-45-6789")):
        one = spark.createDataFrame([(value,)], "x string").select(form(F.col("x"), key).alias("x"))
        assert one.first().x != value and len(one.first().x) in range(7, 20)
        assert one.select(form(F.col("x"), key, True).alias("x")).first().x == value


def test_mixing(spark, docs):
    sized = docs.withColumn("words", mixing.words(F.col("text")))
    got = mixing.mix(sized, "words", key=("doc_id", "text")).collect()
    total, by = sum(r.words for r in got), {}
    for r in got:
        assert r.taken <= 2 * r.words
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 1
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(sized.limit(0), "words").count() == 0


def test_sharding(spark, docs):
    many = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.col("doc_id").cast("string"))
    got = sharding.shard_records(many).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    grown = {r.doc_id: r.shard for r in sharding.shard_records(many, shards=25).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 60 < len(slots) < 200
    assert sharding.shard_records(docs).count() == docs.count() and sharding.shard_records(docs.limit(0)).count() == 0


def test_quality_encodes_in_little_memory():
    n, size = 100, 2000
    rng = np.random.default_rng(3)
    bucket = np.concatenate([np.sort(rng.choice(quality.BUCKETS, size, replace=False)) for _ in range(n)]).astype(np.int32)
    rows = quality.Rows(np.arange(n + 1) * size, bucket, rng.normal(size=(n, quality.FEATURES)))
    edges = np.sort(rng.normal(size=(quality.FEATURES, quality.BINS - 1)))
    tracemalloc.start()
    row, feature, value = quality.encode(rows, edges)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(row)
    for k in (0, n - 1):
        bins = [quality.BUCKETS + j * quality.BINS + int((edges[j] <= x).sum()) for j, x in enumerate(rows.stats[k])]
        assert feature[row == k].tolist() == [*bucket[k * size : (k + 1) * size], *bins]
        assert value[row == k] == pytest.approx([quality.WORDS_WEIGH / size**0.5] * size + [quality.FEATURES**-0.5] * quality.FEATURES)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = quality.score(docs, quality.train(docs, known)).collect()
        assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in got)
    rng = np.random.default_rng(1)
    m = quality.Model(np.zeros((quality.FEATURES, quality.BINS - 1)), 0.1, rng.normal(size=quality.BUCKETS + quality.FEATURES * quality.BINS), rng.normal(size=(quality.BUCKETS + quality.FEATURES * quality.BINS, 3)))
    rows = quality.describe(np.frombuffer(b"a bb a", np.uint8), np.array([0, 6]), np.array([[6.0]]))
    _, f, v = quality.encode(rows, m.edges)
    pairs = sum(m.factor[f[i]] @ m.factor[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
    assert quality.margins(m, *quality.encode(rows, m.edges), 1)[0][0] == pytest.approx(0.1 + (m.weight[f] * v).sum() + pairs)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def clashing(spark, rows):
    """rows (doc_id, text) with columns that bear the names the operators use inside."""
    names = ("_line", "_words", "_keys", "_all", "_key", "_gone", "_kept", "_Leaks", "Leaks", "_hits", "_made", "_gaps", "_best", "_start", "_hash", "_piece", "_source", "source", "lang", "pair", "fp")
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", *[F.lit("x").alias(n) for n in names])


def test_clashing_names_and_repeats(spark):
    rows = [(1, LONG), (1, LONG), (2, None), (None, ""), (3, "word " * 40_000), (4, "CC BY 4.0")]
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    sized = docs.withColumn("size", mixing.words(F.col("text")))
    for out, new, n in (
        (licences.scan(docs), {"n_words", "base", "found"}, 6),
        (passages.drop_repeats(docs), {"n_sentences", "n_removed"}, 6),
        (decontamination.remove_leaks(docs, bench), set(), 4),
        (private.pseudonyms(docs), {"finds"}, 6),
        (sharding.shard_records(docs), {"shard", "slot", "grown_shard"}, 6),
        (mixing.mix(sized, "size"), {"size", "source_size", "target", "taken", "positions"}, 6),
        (tokens.count_tokens(docs), {"counts"}, 6),
        (simhash.keep_one(docs), set(), 4),
    ):
        got = out.collect()
        assert len(got) == n and set(out.columns) == set(docs.columns) | new
        assert all(r[c] == "x" for r in got for c in docs.columns[2:])
    empty = docs.limit(0)
    assert passages.drop_repeats(empty).count() == private.pseudonyms(empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    mine = registry.QUERIES[name](spark, sf)
    columns = sorted(mine.columns)
    near = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert near(mine.select(*columns).collect()) == near(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())
