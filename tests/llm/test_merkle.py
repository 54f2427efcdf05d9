"""The manifest against plain Python."""

import hashlib

import pytest

pytest.importorskip("inkledger.llm")

from pyspark.sql import functions as F  # noqa: E402

from inkledger.llm import merkle  # noqa: E402

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """(last node, for each lowest node its path of (siblings before, siblings behind))."""
    paths, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, merged = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for leaf_ in own[k + j]:
                    paths[leaf_].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            merged.append([x for o in own[k : k + 3] for x in o])
        nodes, own = up, merged
    return nodes[0], paths


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in by[s]) if all(r[0] is not None for r in by[s]) else sorted(((r[0] is not None, r[0] or 0, leaf(r)), repr(r), r) for r in by[s])
        made[s] = ([x[-1] for x in own], *tree([x[0][2] for x in own]))
    root, above = tree([made[s][1] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        own, subroot, paths = made[s]
        for r, p in zip(own, paths, strict=True):
            out.append((r[0], leaf(r), subroot, root, h(*[x for step in p + up for x in step])))
    return out


def manifest(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    fields = {f: F.col(f) for f in merkle.FIELDS}
    clashing = df.select("*", merkle.leaf(fields).alias("leaf"), *[F.lit("x").alias(c) for c in ("g", "i", "N", "node", "block", "Path", "root", "_c0", "_range")])
    return merkle.manifest(clashing)


@pytest.mark.parametrize("size", [0, 1, 4, 28, 900])
def test_roots_and_proofs(spark, size):
    rows = [(k, "hot", "en", 3, f"text {k}\n") for k in range(size)]
    if size in (4, 900):
        rows += [(None, None, None, None, None), (7, None, "", 0, ""), (3, "", "en", 1, "é" * 3), (9, "é", "en", 1, "x" * 300_000), (9, "é", "en", 1, "x"), (None, "é", "en", 1, "x")]
        rows += [(2, "b", "en", 1, "same")] * 5 + [(k, f"s{k:03d}", None, 1, "-") for k in range(40)]
    made = manifest(spark, rows)
    got = made.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert all(r.folded == r.root for r in got) and len(got) == len(rows)
    if rows:
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, expected(rows)))
        other = made.select(merkle.folded(F.sha2(F.lit("other"), 256), F.col("path")).alias("f"), "root")
        assert other.where("f = root").count() == 0


def test_any_changed_row_changes_the_root(spark):
    rows = [(k, "ab"[k % 2], "en", k, f"t{k}") for k in range(30)]
    root = lambda rows: manifest(spark, rows).first().root
    first = root(rows)
    assert root(rows[::-1]) == first
    assert root(rows[:-1]) != first and root([*rows[:-1], (29, "b", "en", 29, "t2 9")]) != first and root([*rows[:-1], (29, "a", "en", 29, "t29")]) != first
