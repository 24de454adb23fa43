"""Stages of the pipeline on rows that share a doc_id or have none."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], SCHEMA)


def _text(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100))


def _told(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (_text(i) for i in range(4))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, b + " end"), (7, b), (None, c), (1, d), (5, d), (None, None), (None, None), (9, " "), (9, " ")]
    got = _told(corpus_pipeline.near_duplicates(spark, _rows(spark, rows), ""))
    near = [x for x in got if x[0] is None and x[1] in (b, b + " end")]
    assert len(near) == 1
    rest = [(1, a), (None, c), (1, d), (None, None), (None, None), (9, " "), (9, " ")]
    assert sorted((x for x in got if x not in near), key=str) == sorted(rest, key=str)


def test_only_rows_that_leak_go(spark, tmp_path):
    item, clean, other = _text(10)[:120], _text(11), _text(12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, clean), (None, f"x {item} y"), (3, other), (3, f"{item} z"), (4, f"u {item}"), (4, f"u {item}"), (5, None)]
    got = _told(corpus_pipeline.benchmark_leaks(spark, _rows(spark, rows), str(tmp_path)))
    assert got == sorted([(None, clean), (3, other), (5, None)], key=str)


def test_first_place_of_a_passage_stays(spark):
    a, b, c = (_text(i) for i in range(20, 23))
    passage = _text(30)[:300]
    rows = [(1, a[:250] + passage), (2, passage + b[:250]), (3, c), (3, c), (None, passage), (None, None), (4, ""), (5, None)]
    got = _told(corpus_pipeline.repeated_strings(spark, _rows(spark, rows), ""))
    assert got == sorted([(1, a[:250]), (2, b[:250]), (3, c), (None, passage), (None, None), (4, ""), (5, None)], key=str)


def _plain_near(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 10 * len(a & b) >= 8 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    first = {}
    for g, r in zip(group, rows):
        first[g] = min(first.get(g, r), r, key=lambda r: (r[0] is not None, r[0] or 0))
    return list(first.values())


def _plain_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data, gone = (r[1] or "").encode(), set()
        for a in range(len(data) - 199):
            if data[a : a + 200] in seen:
                gone |= set(range(a, a + 200))
            seen.add(data[a : a + 200])
        left = bytes(c for i, c in enumerate(data) if i not in gone).decode()
        if left or not gone:
            out.append((r[0], left if r[1] is not None else None, *r[2:4], len(left) if r[1] is not None else None))
    return out


def test_the_whole_chain_against_plain_python(spark, tmp_path):
    rng = random.Random(17)
    words = {x: ["".join(rng.choice(part) for _ in range(rng.randint(2, 4))) for _ in range(60)] for x, part in (("aa", ["ba", "no", "ti", "ru"]), ("bb", ["sch", "eu", "wy", "ex"]))}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    passage, item = say("aa", 60), say("aa", 40)
    rows = []
    for i in range(60):
        x = rng.choice(["aa", "bb"])
        rows.append((i, say(x, rng.randint(30, 120)), x, f"s{i % 3}"))
    rows[5], rows[9] = (5, rows[4][1], "aa", "s0"), (9, rows[4][1] + " ba", None, "s1")
    for i in (20, 31, 44):
        rows[i] = (i, say("aa", 40) + " " + passage + " " + say("aa", 30), "aa", "s2")
    rows[50] = (50, say("aa", 20) + " " + item.upper() + "\n" + say("aa", 10), "aa", "s1")
    rows += [(70, None, "aa", "s0"), (71, "", None, "s0"), (72, "12 34", "bb", "s1"), (73, "qqq zzz jjj kkk vvv " * 6, None, None), (None, rows[8][1] + " x", "aa", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [tuple(r) for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()]
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert {70, 71, 72} <= gone and len(gone) <= 7
    left = [r for r in _plain_repeats(_plain_near(kept)) if item.lower() not in " ".join((r[1] or "").lower().split())]
    assert len(left) < len(kept) - 2
    want = corpus_pipeline.source_mix(spark, spark.createDataFrame(left, SCHEMA), str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_tables_run_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_columns_of_other_names(spark):
    rows = _rows(spark, [(1, _text(1)), (2, _text(1)), (3, None)]).withColumns({c: F.lit(1) for c in ("id", "key", "check", "class", "component", "spans", "kept", "_row", "rejected", "size", "taken")})
    assert _told(corpus_pipeline.near_duplicates(spark, rows, "")) == [(1, _text(1)), (3, None)]
    assert _told(corpus_pipeline.repeated_strings(spark, rows, "")) == [(1, _text(1)), (3, None)]
    assert corpus_pipeline.language_id(spark, rows, "").count() == 2
    assert [r["doc_id"] for r in corpus_pipeline.source_mix(spark, rows, "").orderBy("doc_id").collect()] == [1, 2]
