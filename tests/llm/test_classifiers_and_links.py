"""Quality against plain zstandard, calibration of few rows, windows over short partitions, and links of embeddings against their SQL."""

import random

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stressloom.llm import embeddings, quality, queries, toxicity


def labelled(rows, seed=1):
    rng = random.Random(seed)
    good = ["harvest", "river", "letter", "season", "village", "bridge", "quiet", "morning", "stone", "window"]
    bad = ["click", "free", "winner", "$$$", "cheap", "deal", "!!!", "bonus", "offer", "now"]
    docs, labels = [], []
    for i in range(rows):
        y = int(rng.random() < 0.7)
        docs.append((i, " ".join(rng.choice(good if rng.random() < (0.8 if y else 0.2) else bad) for _ in range(rng.randrange(20, 200)))))
        labels.append((i, y))
    return docs, labels


def test_quality_scores_are_plain_zstandard(spark):
    docs, _ = labelled(60)
    texts = [*(t for _, t in docs), None, "", "short", "é" * 700, "long text of words " * 20_000]
    bad, good = ("\n".join(t for i, t in docs if i % 2 == k).encode()[:9000] for k in (0, 1))
    model = quality.Quality(bad, good, 7.0, -0.4)
    frame = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(texts)], "doc_id long, text string, score double, label int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(frame, model).collect()}

    def size(known, data):
        kept = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        make = zstandard.ZstdCompressor(level=6, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(make.compress(data[a : a + 512])) for a in range(0, len(data), 512))

    for i, t in enumerate(texts):
        data = (t or "").encode()
        x = (size(bad, data) - size(good, data)) / len(data) if data else 0.0
        assert np.isclose(got[i], 1 / (1 + np.exp(-np.clip(7.0 * x - 0.4, -40, 40)))), i


@pytest.mark.parametrize("rows", [12, 90, 900])
def test_few_rows_calibrate_too(spark, rows):
    docs, labels = labelled(rows)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.learn_quality(frame, spark.createDataFrame(labels, "doc_id long, label int"))
    assert (model.slope, model.offset) != (10.0, 0.0)
    assert abs(len(model.bad) - len(model.good)) <= 2048
    told = {r["doc_id"]: r["score"] >= 0.5 for r in quality.score_quality(frame, model).collect()}
    assert sum(told[i] == bool(y) for i, y in labels) >= 0.9 * rows


def test_rare_toxic_texts_count_as_much(spark):
    rng = random.Random(6)
    plain = ["tea", "rain", "road", "book", "lamp", "wool", "salt", "corn"]
    texts, y = [], []
    for i in range(400):
        toxic = i % 20 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if toxic or rng.random() < 0.01:
            words[rng.randrange(30)] = "vilest"
        texts.append(". ".join(" ".join(words[k : k + 6]) for k in range(0, 30, 6)))
        y.append(float(toxic))
    model = toxicity.train(texts, np.array(y), 0.5)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame, model).collect()}
    assert all(got[i] >= 0.5 for i in range(400) if y[i])
    assert sum(got[i] >= 0.5 for i in range(400) if not y[i]) <= 12


def grown(n, d, seed):
    """Vectors in near groups, so that many links hang on windows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, d))
    return (centres[rng.integers(0, len(centres), n)] + 0.12 * rng.standard_normal((n, d))).astype(np.float64)


def test_windows_are_the_same_over_any_partitions(spark):
    x = grown(2000, 32, 3)
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "class long, group long, embedding array<double>")
    mean = (x / np.linalg.norm(x, axis=1)[:, None]).mean(axis=0)
    placed = frame.select("group", "class", "embedding", F.lit(1).alias("turns"), F.lit(200).alias("wide"), F.lit(mean.tobytes()).alias("mean"))
    coded = placed.mapInArrow(embeddings._coded, "pass int, group long, code long, class long, wide int, vector binary").cache()
    found = []
    for parts in (1, 4, 100, 700):
        order = ["pass", "group", "code", "class"]
        ordered = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found.append(sorted({tuple(r) for r in embeddings._window_links(ordered, 0.98).collect()}))
    assert len(found[0]) > 500
    assert found[0] == found[1] == found[2] == found[3]


def test_links_are_those_of_the_sql(spark):
    """The query's SQL on vectors that do link: near groups, copies, scaled copies, nulls, zeros, other lengths and equal vectors of other labels."""
    x = grown(600, 24, 8)
    rows = [(i, v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(x)]
    rows += [(1000 + i, x[i].tolist(), rows[i][2]) for i in range(40)] + [(2000 + i, (2 * x[i]).tolist(), rows[i][2]) for i in range(40)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [float("nan")] * 24, 1), (3004, [1.0] * 5, 1), (3005, [1.0] * 5, 1), (3006, x[1].tolist(), 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embeddings.link_embeddings(frame).select("vec_id", "n_links", "component_id", "kept").collect()))
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    want = sorted(con.sql(queries.OP6).fetchall())
    assert sum(r[1] > 0 for r in want) > 300
    assert got == want


@pytest.mark.parametrize("words", [False, True])
def test_a_passage_of_any_number_of_places_sends_one_row(words):
    """5,000 texts that share a passage: a task keeps its least place, and marks the others at once."""
    import pyarrow as pa

    from stressloom.llm import repeats

    plan = repeats.Plan(words=words, window=20 if words else 400, gram=8)
    rng = random.Random(3)
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(100))
    n = len(passage.split()) - plan.window + 1 if words else len(passage) - plan.window + 1
    place = {"gram": 7, "where": (0 << 20) | (0 << 10) | n, "hot": False}
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("where", pa.int64()), ("hot", pa.bool_())]))
    batches = [pa.record_batch([pa.array([i]), pa.array([i * 11]), pa.array([passage]), pa.array([[place]], kind)], ["id", "key", "text", "places"]) for i in range(4999, -1, -1)]
    out = [r for b in repeats._segment_rows(plan)(iter(batches)) for r in b.to_pylist()]
    own = [r for r in out if r["segment"] is not None]
    assert len(own) == 1 and np.frombuffer(own[0]["stands"], np.int64).tolist() == [0, 0, 0 << 1 | 1]
    runs = np.concatenate([np.frombuffer(r["stands"], np.int64).reshape(-1, 3) for r in out if r["segment"] is None])
    assert sorted(map(tuple, runs.tolist())) == [(i, i * 11, n) for i in range(1, 5000)]
    mark = repeats.mark_with_fm_index(plan) if words else repeats.mark_with_run_length_index(plan)
    rows = pa.record_batch([pa.array([r[c] for r in out], t) for c, t in (("shard_key", pa.int64()), ("segment", pa.binary()), ("stands", pa.binary()))], ["shard_key", "segment", "stands"])
    marked = sorted(tuple(r.values()) for b in repeats._mark_rows(plan, mark)(iter([rows])) for r in b.to_pylist())
    assert marked == [(i, i * 11, 0, n) for i in range(1 if words else 0, 5000)]
