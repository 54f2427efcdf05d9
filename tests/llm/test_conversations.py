"""Repair of conversations against plain Python that tries every edit."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

pytest.importorskip("inkledger.llm")

from inkledger.llm import conversations  # noqa: E402

KIND = "conv bigint, turn bigint, role string, text string, i int, stretch string"


def cheapest(turns):
    """(cost, audit) by a search over how many turns are read, what stands last, and so the cheapest first."""
    heap, done = [(0, "", 0, "e")], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(turns) and state in "ea":
            return cost, audit
        puts = [("u", "esa"), ("a", "u")]
        for now, was in puts:
            if state in was:
                heapq.heappush(heap, (cost + 3, audit + "I", k, now))
        if k == len(turns):
            continue
        fault, initial = turns[k]
        heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state))
        if fault in ("", "t"):
            stays = 3 * (fault == "t")
            for now, was in [*puts, ("s", "e")]:
                if state in was and now == initial:
                    heapq.heappush(heap, (cost + stays, audit + "K", k + 1, now))
                if state in was and now != "s":
                    heapq.heappush(heap, (cost + 3 + stays, audit + "R", k + 1, now))
    raise AssertionError


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        seen, flags, illegal = set(), [], 0
        for k, (_, _, role, text, _) in enumerate(own):
            ink = re.sub(r"[\x20\x09-\x0D]", "", text)
            flags.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
            illegal += k > 0 and own[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        numbers = [x[4] for x in own if x[4] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = cheapest([(f, x[2][:1]) for f, x in zip(flags, own, strict=True)])
        lines, k, state = [], 0, "e"
        for op in audit:
            if op == "I":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, _, role, text, _ = own[k]
            k += 1
            if op == "K":
                state = role[:1]
                lines.append(f"{role}:{text}")
            elif op == "R":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[state] + text)
        out[conv] = (gaps, flags.count("b"), flags.count("d"), flags.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], KIND)
    found, lines = conversations.repair(df)
    digests = {r.conv: r.sha256 for r in conversations.text_digests(lines).collect()}
    assert digests.keys() == {r.conv for r in found.collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv]) for r in found.collect()}


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle", "System"])
            text = rng.choice([f"All well {turn}.", f"All well {turn}.", "Again!", "cut of", "", " \t", None, "Why?\n", "é. ", "line\nfeed."])
            rows.append((conv if conv else None, None if rng.random() < 0.1 else turn - turn % 3 * (rng.random() < 0.2), role, text))
    return rows


@pytest.mark.parametrize(("seed", "convs", "most"), [(1, 120, 7), (2, 6, 400)])
def test_against_search(spark, seed, convs, most):
    rows = random_rows(seed, convs, most)
    assert repaired(spark, rows) == expected(rows)


@pytest.mark.parametrize("stretch", [1, 2, 3])
def test_stretches_are_joined(spark, monkeypatch, stretch):
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    rows = random_rows(3, 60, 9)
    assert repaired(spark, rows) == expected(rows)


def test_single_cases(spark):
    say = "Well."
    cases = {
        1: ([("system", say)], "D"), 2: ([("assistant", say)], "IK"), 3: ([("user", say)], "KI"), 4: ([("user", say), ("assistant", say)], "KK"),
        5: ([("user", ""), ("assistant", "")], "DD"), 6: ([("system", say), ("user", say), ("assistant", "x " * 100_000 + say)], "KKK"),
    }
    rows = [(conv, k, *turn) for conv, (turns, _) in cases.items() for k, turn in enumerate(turns)]
    got = repaired(spark, rows)
    assert {conv: x[6] for conv, x in got.items()} == {conv: audit for conv, (_, audit) in cases.items()} and got == expected(rows)
    found, lines = conversations.repair(spark.createDataFrame([], KIND))
    assert found.count() == 0 and conversations.text_digests(lines).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None), (None, 3, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        now = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [now] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, (tuple(r) for r in conversations.damaged(df).collect()))) == sorted(map(repr, want))
