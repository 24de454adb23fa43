"""Packing, point-in-time features and conversation repair against brute force, with nulls, ties, repeated rows, very long values, empty tables and clashing columns."""

import heapq
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stressloom.llm import conversations, features, packing

EPOCH = datetime(1970, 1, 1)


# packing


def test_combinations_fill_the_window():
    found = packing.combinations(64)
    assert len(found) == len(set(found))
    assert all(sum(length * times for length, times in c) == 64 and len(c) <= 3 for c in found)
    assert all(any(dict(c).get(a) and dict(c).get(64 - a) for c in found) for a in range(1, 64))


def test_least_squares_is_exact_where_it_can_be():
    # two columns fit exactly; a third that would only do harm stays at 0
    rows, columns = np.array([1, 3, 2, 2, 3]), np.array([0, 0, 1, 2, 2])
    x = packing.least_squares(rows, columns, np.array([1.0, 1, 2, 1, 1]), np.array([0.0, 5, 8, 5, 0]), 3, 2000)
    assert np.allclose(x, [5, 4, 0], atol=1e-2)


def test_a_plan_gives_each_place_once():
    rng = random.Random(3)
    counts = {length: rng.randrange(0, 40) for length in range(64)}
    made = packing.plan(counts, 64)
    assert made.starts.tolist() == sorted(set(made.starts.tolist()))
    total = sum(n for n in counts.values())
    held = {}
    for number in range(counts[0], total):
        slot = np.searchsorted(made.starts, number, side="right") - 1
        if made.offsets[slot] >= 0:
            held.setdefault(int(made.bases[slot] + number - made.starts[slot]), []).append((int(made.offsets[slot]), int(made.lengths[slot])))
    assert sorted(held) == list(range(made.first))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64


@pytest.mark.parametrize("window", [1024, 16])
def test_pieces_hold_each_id_once(spark, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "Ünïcode", "x1", "don't", "3.14"]) for _ in range(n))
    texts = [None, "", " ", "one", "<|endoftext|> and <|endoftext|>", say(6000), "a" * 30_000, *[say(5)] * 9, *[say(rng.randrange(1, 500)) for _ in range(60)]]
    rows = [(i if i != 3 else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, row int, start int")
    got = packing.pack(docs, window=window).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by.pop(i), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        at = 0
        for r in pieces:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    assert not by
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding


def test_repeated_rows_and_no_rows_are_packed(spark):
    docs = spark.createDataFrame([(7, "same text")] * 5, "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got) == 5 * got[0]["doc_tokens"]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, window=1000)


# point-in-time features


def _shop(seed, clients=4, sales=60, days=40, year=2024):
    rng = random.Random(seed)
    at = lambda: datetime(year, 1, 1) + timedelta(seconds=rng.randrange(days * 86_400) // 3600 * 1800, microseconds=rng.choice([0, 0, 1]))
    late = lambda t: None if rng.random() < 0.05 else t + timedelta(minutes=rng.choice([-5, 0, 0, 1, 60, 60 * 24 * 3, 60 * 24 * 20]))
    client = lambda: None if rng.random() < 0.05 else 0 if rng.random() < 0.4 else rng.randrange(clients)
    money = lambda: rng.choice([None, 0.005, 1.115, -3.3, 250.0])
    sold = []
    for i in range(sales):
        t = None if rng.random() < 0.05 else at()
        sold.append((i, client(), "done", money(), t, late(t or at()), 1))
    sold.append((None, 1, "done", 5.0, at(), at(), 1))
    clicks = []
    for i in range(sales * 3):
        t = None if rng.random() < 0.03 else at()
        row = (None if rng.random() < 0.02 else i, t, late(t or at()), client(), rng.choice(["purchase", "view", None]), money(), rng.choice([None, "{}", '{"a": 1}']))
        clicks += [row] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.05:
            clicks.append((*row[:6], "other"))
    lines = []
    for i in range(sales * 4):
        sale = rng.choice([None, 3, rng.randrange(sales), rng.randrange(sales)])
        row = (sale, i, rng.choice([None, 1, 2, 3]), money(), None if rng.random() < 0.1 else at())
        lines += [row] * rng.choice([1, 1, 2])
    return sold, clicks, lines


def _micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def _by_hand(sold, clicks, lines):
    cents = lambda x: 0 if x is None else int(np.floor(100.0 * x + 0.5))
    rows = [(s, c, _micros(t), None if a is None else _micros(a) + features.LATENCY, cents(x)) for s, c, _, x, t, a, _ in sold if c is not None and t is not None]
    out = {}
    for sale, client, at, _, _ in rows:
        t = at + zlib.crc32(("" if sale is None else str(sale)).encode()) % 259_200 * 1_000_000
        label = any(c == client and t < e <= t + 7 * 86_400_000_000 for _, c, e, _, _ in rows)
        for d in (2, 14):
            low = t - d * 86_400_000_000
            own = [(_micros(c[1]), c[0], c[4], cents(c[5])) for c in set(clicks) if c[3] == client and c[1] and c[2] and low < _micros(c[1]) <= t and _micros(c[2]) + features.LATENCY <= t]
            before = [r for r in rows if r[1] == client and low < r[2] <= t and r[3] is not None and r[3] <= t]
            sent = [x for r in before for x in lines if x[0] is not None and x[0] == r[0] and x[4] is not None and _micros(x[4]) <= t]
            last = max(((e, -(2**63) if i is None else i) for e, i, _, _ in own), default=(0, None))[1]
            out[sale, d] = (t, label, len(own), sum(k == "purchase" for _, _, k, _ in own), sum(x for *_, x in own), None if last == -(2**63) else last,
                            len(before), sum(r[4] for r in before), len(sent), len({x[2] for x in sent} - {None}), sum(cents(x[3]) for x in sent))
    return out


@pytest.mark.parametrize(("seed", "most", "chunk", "year"), [(1, 10_000, 1 << 18, 2024), (3, 4, 7, 2024), (4, 0, 1, 1968)])
def test_features_are_what_was_known(spark, seed, most, chunk, year):
    """From trees inside tasks down to leaves of a few events, with windows over blocks of many levels and ranges, and tasks that take a few rows at a time."""
    sold, clicks, lines = _shop(seed, year=year)
    tables = (
        spark.createDataFrame(sold, "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, row int"),
        spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"),
        spark.createDataFrame(lines, "sale_id long, e int, item_id long, amount double, shipped_at timestamp_ntz"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = features.point_in_time(*tables, most=most, chunk=chunk)
    rows = {(r["sale_id"], r["d"]): tuple(r[c] for c in ("t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")) for r in got.collect()}
    assert rows == _by_hand(sold, clicks, lines)


def test_a_client_is_spread_over_tasks(spark):
    """One client with all rows: no group that a task reads is larger than a few leaves, and results are those of one tree."""
    sales = spark.range(3000).selectExpr("id AS sale_id", "9L AS client_id", "1.5D AS total", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 601) AS sold_at")
    sales = sales.withColumn("arrived_at", F.col("sold_at"))
    clicks = spark.range(6000).selectExpr("id AS click_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 307) AS ts", "9L AS client_id", "'view' AS kind", "2.5D AS value", "'' AS props")
    clicks = clicks.withColumn("arrived_at", F.col("ts"))
    lines = spark.range(0).selectExpr("id AS sale_id", "id AS item_id", "1.0D AS amount", "TIMESTAMP_NTZ '2024-01-01' AS shipped_at")
    asked = features.probes(sales)
    every = features.collapsed(features.events(asked, clicks, lines))
    fine = features.leaves(every, asked, 500).collect()[0]["fine"]
    assert every.groupBy(F.expr(f"shiftright(e, {fine})")).count().agg(F.max("count")).first()[0] <= 500
    key = ["sale_id", "d"]
    assert features.point_in_time(sales, clicks, lines, most=500).orderBy(key).collect() == features.point_in_time(sales, clicks, lines).orderBy(key).collect()


def test_no_sales_give_no_rows(spark):
    sold, clicks, lines = _shop(5, sales=5)
    sales = spark.createDataFrame(sold, "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int")
    none = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    lines = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz")
    assert features.point_in_time(sales.limit(0), none, lines).count() == 0
    got = features.point_in_time(sales, none, lines.limit(0)).collect()
    assert got and all(r["n_clicks"] == r["n_lines"] == 0 and r["last_click_id"] is None for r in got)


# conversation repair


def _cheapest(signature):
    """Dijkstra over (rows read, what was given out), by cost and then audit."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(signature) and state in ("", "a"):
            return cost, audit
        turn = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, turn))
        if i < len(signature):
            c = signature[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if c != "x":
                more = 3 if c.isupper() else 0
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, turn))
                if c.lower() == turn or (c.lower() == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, c.lower()))
    raise AssertionError


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(2)
    every = ["", "x", "s", "o", "su", "sua", "ssuaua"] + ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    for signature in every:
        assert conversations.solve(signature) == _cheapest(signature), signature


def test_long_signatures_are_solved():
    cost, audit = conversations.solve("ua" * 20_000 + "x")
    assert (cost, len(audit)) == (4, 40_001) and audit.endswith("D")


def test_conversations_are_repaired(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(0, 9)):
            text = rng.choice(["Fine.", "fine", "", " \t", "What?", None, "la " * 3000 + "!", "End!\x0b "])
            rows.append((None if conv == 3 else conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None]), text, "clash", 1))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, signature string, cost int")
    damaged = {}
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = damaged.setdefault(conv, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = {r["conv_id"]: r for r in conversations.repair(conversations.damaged(turns)).collect()}
    digests = {r["conv_id"]: r for r in conversations.digest(conversations.repair(conversations.damaged(turns))).collect()}
    assert set(got) == set(damaged) == set(digests)
    for conv, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, signature, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            k = role[0] if role[0] in "sua" else "o"
            signature += "x" if fault in ("b", "d") else k.upper() if fault == "t" else k
        r = got[conv]
        cost, audit = _cheapest(signature)
        assert (r["signature"], r["cost"], r["audit"]) == (signature, cost, audit)
        assert (r["blank"], r["duplicate"], r["truncated"]) == (counts["b"], counts["d"], counts["t"])
        at = {t for t, *_ in own} - {None}
        assert r["gaps"] == (max(at) - min(at) + 1 - len(at) if at else 0)
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        initials = "".join(x["role"][0] for x in r["repaired"])
        assert re.fullmatch("(s?(ua)+)?", initials)
        assert sum(x["text"] == "" for x in r["repaired"]) == audit.count("I")
        kept = [x["text"] for x in r["repaired"] if x["text"]]
        assert kept == [row[2] for row, e in zip(own, audit.replace("I", "")) if e != "D"]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(none).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "x", True)], "conv_id long, turn long, role string, text string, gone boolean")
    r = conversations.digest(conversations.repair(gone)).first()
    assert (r["cost"], r["audit"], r["repaired_sha256"]) == (0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
