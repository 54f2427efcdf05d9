"""Archives written, spoilt and read again, against plain Python."""

import base64
import hashlib
import random

import pytest

pytest.importorskip("inkledger.llm")

from inkledger.llm import warc  # noqa: E402

KIND = "page_id bigint, url string, html string, record string, h string, target string"


def record(payload, kind="response", extra="", version="1.1"):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def read(spark, folder, strict=True):
    found, files = warc.read_warc(spark, str(folder), strict)
    rows = sorted((r.file.rsplit("/", 1)[-1], r.offset, bytes(r.payload)) for r in found.collect())
    return rows, {r.file.rsplit("/", 1)[-1]: r for r in files.collect()}


def hostile(rng, k):
    """A payload that may hold whole records, the magic alone, broken headers, or bytes of no text."""
    inner = record(b"inner " * rng.randint(0, 9))
    parts = [b"plain text ", inner, b"\r\n\r\n" + inner, b"\nWARC/1.", b"\nWARC/1.1\r\n", b"WARC/1.1\r\n", b"\nWARC/1.0\r\nContent-Length: 5\r\n\r\nabc", b"\r\n\r\n", bytes(range(128, 256)), b"\xff\xfe\x00", b"\n" * 3]
    return b"".join(rng.choice(parts) for _ in range(rng.randint(0, k)))


@pytest.mark.parametrize("block", [97, 1 << 20])
def test_only_records_of_the_chain(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for f in range(4):
        data = b""
        for k in range(12 if f else 1):
            body = hostile(rng, 12)
            want.append((f"f{f}.warc", len(data), body))
            data += record(body, version=rng.choice(("1.0", "1.1")), extra=rng.choice(("", "X-Note: WARC/1.1\r\n")))
        (tmp_path / f"f{f}.warc").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    conf = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "0"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows, files = read(spark, tmp_path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert rows == sorted(want)
    assert all(r.read_to == r.size == (tmp_path / name).stat().st_size for name, r in files.items()) and len(files) == 4
    assert {name: r.n_records for name, r in files.items()} == {f"f{f}.warc": 12 if f else 1 for f in range(4)}
    assert sum(r.n_rejected for r in files.values()) > 0


def test_a_record_that_leads_into_the_chain_but_is_not_on_it(spark, tmp_path):
    """A false record in a payload whose length ends where a true one begins."""
    tail = b"z" * 30
    false = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % (len(tail) + 4 - 4)
    body = b"\n" + false + tail
    data = record(body) + record(b"second") + record(b"\n" + record(b"third inside") + b"x")
    (tmp_path / "a.warc").write_bytes(data)
    rows, files = read(spark, tmp_path)
    assert [r[2] for r in rows] == [body, b"second", b"\n" + record(b"third inside") + b"x"] and files["a.warc"].n_rejected == 2


def test_broken_chains_are_errors(spark, tmp_path):
    data = b"".join(record(b"body %d" % k) for k in range(9))
    whole = [b"body %d" % k for k in range(9)]
    spoilt = {"cut": (data[:-30], whole[:8]), "behind": (b"x" + data, []), "length": (data.replace(b"Content-Length: 6", b"Content-Length: 7", 1), []), "other": (b"no archive", []), "good": (data, whole)}
    for name, (raw, _) in spoilt.items():
        (tmp_path / name).write_bytes(raw)
    with pytest.raises(ValueError, match="chain of records breaks"):
        warc.read_warc(spark, str(tmp_path))
    rows, files = read(spark, tmp_path, strict=False)
    for name, (raw, want) in spoilt.items():
        assert [r[2] for r in rows if r[0] == name] == want
        assert (files[name].n_records, files[name].size) == (len(want), len(raw)) and files[name].read_to == len(record(b"body 0")) * len(want)


def pages(spark):
    rng = random.Random(4)
    rows = [(k, f"http://x/{k}", rng.choice(["<p>same</p>", "", None, f"<p>{k}</p>", "é" * 50, hostile(rng, 6).decode("utf-8", "ignore")])) for k in range(80)]
    rows += [(None, None, "<p>same</p>"), (None, "", "<p>lone</p>"), (5, "http://y\r\nX-Page-Id: 7", "<p>5</p>"), (80, "u", "long " * 200_000), (81, "u", None), (81, "u", None), (82, "WARC/1.1", "\r\nWARC/1.1\r\n")]
    return rows, spark.createDataFrame([(*r, "x", "x", "x") for r in rows], KIND)


@pytest.mark.parametrize(("least", "broadcast"), [(0, 500_000), (12, 0)])
def test_pages(spark, tmp_path, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows, df = pages(spark)
    warc.write_warc(df, str(tmp_path / "a"), min_bytes=least)
    found, files = warc.read_warc(spark, str(tmp_path / "a"))
    body = lambda r: (r[2] or "").encode()
    top = {}
    for r in rows:
        top[body(r)] = max(top.get(body(r), -1), -1 if r[0] is None else r[0])
    want = []
    for r in rows:
        again = len(body(r)) >= least and (-1 if r[0] is None else r[0]) != top[body(r)]
        digest = base64.b32encode(hashlib.sha1(body(r)).digest()).decode()
        want.append((r[0], "revisit" if again else "response", digest, top[body(r)] if again else None, b"" if again else body(r)))
    named = lambda header, name: next((x.split(": ", 1)[1] for x in header.split("\r\n") if x.startswith(name + ": ")), None)
    number = lambda x: None if x is None else int(x)
    got = [(number(named(r.header, "X-Page-Id")), named(r.header, "WARC-Type"), named(r.header, "WARC-Payload-Digest").removeprefix("sha1:"), number(named(r.header, "X-Refers-To-Page-Id")), bytes(r.payload)) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    ids = {named(r.header, "WARC-Record-ID") for r in found.collect()}
    assert all(named(r.header, "WARC-Refers-To") in ids for r in found.collect() if named(r.header, "WARC-Type") == "revisit")
    assert files.agg({"n_records": "sum"}).first()[0] == len(rows)


def test_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], KIND), str(tmp_path / "none"))
    found, files = warc.read_warc(spark, str(tmp_path / "none"))
    assert found.count() == 0 and files.count() == 0
