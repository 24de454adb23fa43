"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from stressloom.llm import bytescan, chat, components, decontam, embeddings, fm_dedup, jaccard, language, mixing, quality, repeats, run_length_dedup, toxicity
from stressloom.llm.suffixes import FMIndex, RunLengthIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = say(90), say(120)
    out = [None, "", " \t\n", "one", "two words", say(3000), passage, passage, passage]
    out += [say(40) + " " + passage + " " + say(30), say(5) + "\n" + other, other + say(20), ("la " * 400).strip()]
    base = say(150).split(" ")
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out + [say(60) for _ in range(10)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", f"s{i % 3}", "clash", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, copies int, class int").cache()


def cover(n, starts, w):
    gone = [False] * n
    for a in starts:
        gone[a : a + w] = [True] * w
    return gone


@pytest.mark.parametrize("hot", [8192, 1])
def test_bytes_that_start_elsewhere_go(docs, texts, hot):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for a in range(len(b) - 399):
            seen[b[a : a + 400]] = seen.get(b[a : a + 400], 0) + 1
    got = {r["doc_id"]: r for r in run_length_dedup.digest(run_length_dedup.remove_repeats(docs, hot=hot)).collect()}
    assert len(got) == len(raw)
    for i, b in enumerate(raw):
        gone = cover(len(b), [a for a in range(len(b) - 399) if seen[b[a : a + 400]] > 1], 400)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        assert tuple(got[i])[1:] == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("hot", "bits"), [(8192, 64), (1, 1)])
def test_first_place_of_bytes_stays(docs, texts, hot, bits):
    seen = set()
    got = {r["doc_id"]: bytes(r["kept"]) for r in run_length_dedup.remove_repeats(docs, window=100, hot=hot, keep_first=True, key_bits=bits).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        starts = []
        for a in range(len(b) - 99):
            if b[a : a + 100] in seen:
                starts.append(a)
            seen.add(b[a : a + 100])
        assert got[i] == bytes(c for c, g in zip(b, cover(len(b), starts, 100)) if not g)


@pytest.mark.parametrize("hot", [8192, 1])
def test_words_that_stand_earlier_go(docs, texts, hot):
    got = {r["doc_id"]: r for r in fm_dedup.digest(fm_dedup.remove_later_repeats(docs, hot=hot)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        starts = []
        for a in range(len(w) - 19):
            if tuple(w[a : a + 20]) in seen:
                starts.append(a)
            seen.add(tuple(w[a : a + 20]))
        gone = cover(len(w), starts, 20)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert tuple(got[i])[1:] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_a_line_at_many_places_of_few_texts_is_dealt_out(spark):
    rng = random.Random(3)
    say = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(40))
    hashes = lambda x: bytescan.grams(bytescan.letters(np.frombuffer(x.encode(), np.uint8)), 64)
    line = min((say()[:90] for _ in range(500)), key=lambda x: hashes(x).min())  # an anchor of nearly all windows that it lies in
    rows = [(i, "\n".join(say() + "\n" + line for _ in range(60))) for i in range(4)]
    again = rows[0][1][:3000]
    docs = spark.createDataFrame([*rows, (4, again)], "doc_id long, text string")

    class Widest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    largest = spark.sparkContext.accumulator(0, Widest())
    plan = repeats.Plan(words=False, window=400, gram=64, hot=16, block=1)
    mark = repeats.mark_with_run_length_index(plan)

    def watched(segments):
        largest.add(len(segments))
        return mark(segments)

    found = {r["id"]: r["marks"] for r in repeats.marked_texts(docs, plan, watched).collect()}
    assert {i for i, m in found.items() if m} == {0, 4}
    for i in (0, 4):
        assert sorted(x for m in found[i] for x in range(m["first"], m["end"])) == list(range(3000 - 399))
    assert 0 < largest.value <= 16


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(1, long), (1, long), (None, "x " + long), (2, None)], "doc_id long, text string")
    out = sorted(tuple(r)[:3] for r in fm_dedup.remove_later_repeats(rows).collect() if r["doc_id"] is not None)
    assert out == [(1, 200, 200), (1, 200, 200), (2, 0, 0)]
    one = sorted((r["doc_id"], len(r["kept"])) for r in run_length_dedup.remove_repeats(rows).where("doc_id is not null").collect())
    assert one == [(1, 0), (1, 0), (2, 0)]
    near = {r["doc_id"]: r["component_id"] for r in jaccard.similar_texts(rows).collect()}
    assert near[1] is None and near[2] == 2


def test_a_repeated_row_leaves_one_copy_whole(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(1, long), (1, long), (5, f"x y {long} z")], "doc_id long, text string")
    out = sorted(tuple(r)[:3] for r in fm_dedup.remove_later_repeats(rows).collect())
    assert out == [(1, 200, 0), (1, 200, 200), (5, 203, 200)]


@pytest.mark.parametrize(("words", "least"), [(3, 90), (5, 80)])
def test_similar_texts(docs, texts, words, least):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    component = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    component[a] = component[b] = min(component[a], component[b])
    bits = 64 if words == 3 else 2  # unequal sets of one first half are told apart
    got = {r["doc_id"]: r for r in jaccard.similar_texts(docs, jaccard.Similarity(words, least, key_bits=bits)).collect()}
    assert {i: (len(s), component[i]) for i, s in enumerate(sets)} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_indexes_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        parts = [rng.integers(1, 4, rng.integers(3, 9)) for _ in range(rng.integers(1, 7))]
        text = np.concatenate([np.r_[p, 0] for p in parts])
        n, b = len(text), text.tolist()
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or b[i + k] != b[j + k]), n)
        brute = [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        index = RunLengthIndex(text.astype(np.uint8))
        assert index.matching_statistics().tolist() == brute
        assert index.earlier(2).tolist() == [any(common(i, j) >= 2 for j in range(i)) for i in range(n)]
        assert index.transform().tolist() == [b[i - 1] if i else -1 for i in sorted(range(n), key=lambda i: b[i:])]
        start = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        count, first = FMIndex(text, 3).stream(text, start, start + [len(p) for p in parts])
        places = [i for s, p in zip(start, parts) for i in range(s, s + len(p) - 2)]
        for i in places:
            same = [j for j in places if b[j : j + 3] == b[i : i + 3]]
            assert (count[i], first[i]) == (len(same), same[0])


def test_chat_round_trip(spark):
    odd = ["a\\b", "<\\s>", "<s>", "</s>\\", "[INST][/INST]", "\\", "x\\\\<s>", "[\\INST]", "", None, "[INST", "\n</s>", "é" * 50_000]
    rows = [(i, j, r, t) for i, a in enumerate(odd) for j, (r, t) in enumerate([("user", a), (a, "ok"), ("assistant", a), ("assistant", a)])]
    turns = chat.with_conflicts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    out = chat.format_conversations(turns)
    assert out.where("not identical").count() == 0
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    for i, a in enumerate(odd):
        a = a or ""
        told = "".join(f"{r}\n{t}\n" for r, t in [("user", a), (a, "ok"), ("assistant", a), ("assistant", a)])
        loss = a * 2 if a != "assistant" else ""
        assert (got[i]["n_turns"], got[i]["turns_sha256"]) == (4, hashlib.sha256(told.encode()).hexdigest())
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1]["n_turns"] == 2


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    v = [c + 0.05 * rng.standard_normal(16) for c in centre for _ in range(12)] + list(rng.standard_normal((60, 16)))
    v = [x.tolist() for x in v] + [v[0].tolist(), [0.0] * 16, None, [float("nan")] * 16, [], [None] * 16, [1.0, 2.0]]
    label = [1 if i % 5 else None if i % 7 == 0 else 2 for i in range(len(v))]
    frame = spark.createDataFrame(list(zip(range(len(v)), v, label, ["x"] * len(v))), "vec_id long, embedding array<double>, label int, component string")
    good = [i for i, x in enumerate(v) if x and label[i] is not None and None not in x and np.isfinite(x).all() and any(x)]
    unit = {i: np.array(v[i]) / np.linalg.norm(v[i]) for i in good}
    links = {i: {j for j in good if j != i and label[i] == label[j] and len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= 0.98} for i in good}
    for block in (2048, 4):
        got = {r["vec_id"]: r for r in embeddings.link_embeddings(frame, block=block).collect()}
        assert {i: len(links.get(i, ())) for i in range(len(v))} == {i: r["n_links"] for i, r in got.items()}
        for i in good:
            reach, todo = {i}, [i]
            while todo:
                more = links[todo.pop()] - reach
                reach |= more
                todo += more
            assert got[i]["component_id"] == min(reach) and got[i]["kept"] == (i == min(reach))


def test_links_in_a_crowded_label_are_found(spark):
    rng = np.random.default_rng(8)
    d, n = 64, 5000
    # mean cosine of about 0.925, and 100 pairs that are the only links of their members
    v = 1 + np.sqrt(0.075 / 0.925) * rng.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    twins = v[:100] + 0.018 * rng.standard_normal((100, d))
    v = np.concatenate([v, twins / np.linalg.norm(twins, axis=1)[:, None]])
    near = v @ v.T >= 0.98
    np.fill_diagonal(near, False)
    assert near[np.arange(100), n + np.arange(100)].sum() > 50
    frame = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.link_embeddings(frame).collect()}
    assert [got[i] for i in range(len(v))] == near.sum(axis=1).tolist()


def fewest_edits(item, text):
    """Of item against any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_leaks_against_edit_distance(spark, block_bytes, monkeypatch):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n)).strip()

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            i = rng.randrange(len(text))
            kind = rng.choice("sid")
            if kind == "s":
                text[i] = rng.choice("klmnop")
            elif kind == "i":
                text.insert(i, rng.choice("klmnop"))
            else:
                del text[i]
        return "".join(text)

    items = [(i, say(n)) for i, n in enumerate([60, 80, 100, 120, 150, 30])] + [(90, "42 is it"), (91, None), (None, say(50)), (92, ""), (0, say(70))]
    rows = [(0, None), (1, ""), (2, say(800)), (None, say(100) + items[3][1]), (3, "so 42  IS it, no?"), (4, "142 is it"), (5, "42 is item"), (6, items[0][1]), (6, items[0][1])]
    for i, t in items[:6]:
        rows += [(10 * (i + 1) + n, say(150) + " " + edited(t, n).upper() + "\n" + say(60)) for n in range(10)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, end int")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(docs, bench, block_bytes=block_bytes).collect()), key=str)
    want, leaking = [], []
    for d, text in rows:
        text, best = decontam.normal(text), {}
        for i, item in items:
            if i is None or not item:
                continue
            item = decontam.normal(item)
            if len(item) < 24:
                n = 0 if re.search(rf"(?<![a-z0-9]){re.escape(item)}(?![a-z0-9])", text) else 1
            else:
                n = fewest_edits(item, text)
            if n <= int(len(item) * 0.06) and (len(item) >= 24 or n == 0):
                best[i] = min(n, best.get(i, n))
        want += [(d, i, n) for i, n in best.items()]
        leaking.append(bool(best))
    assert got == sorted(want, key=str) and len(want) > 25
    kept = [tuple(r)[:2] for r in decontam.decontaminate(docs, bench, block_bytes=block_bytes).collect()]
    assert sorted(kept, key=str) == sorted((x for x, gone in zip(rows, leaking) if not gone), key=str)


def test_windows_reach_over_sort_partitions(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8))
    v = np.concatenate([v, v + 0.02 * rng.standard_normal(v.shape)])
    frame = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int").cache()

    def links():
        return sorted((r["vec_id"], r["n_links"]) for r in embeddings.link_embeddings(frame, passes=1, window=4).collect())

    whole = links()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert links() == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_leaks_in_slices(monkeypatch):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdef ") for _ in range(n)).strip()
    items = [(i, "common start of every one " + say(60)) for i in range(40)]
    text = " ".join(say(200) + " " + t for _, t in items) + " common start of every one" * 50
    whole = decontam.ItemIndex(items, 10, 0.06, 24)
    found = {x for x, *_ in decontam._found(whole, text)}
    assert found == set(range(40))
    monkeypatch.setattr(decontam, "_SLICE", 500)
    monkeypatch.setattr(decontam, "_ENTRIES", 700)
    chars = decontam.codes(decontam.normal(text))
    in_slices = sorted(whole.candidates(chars))
    monkeypatch.undo()
    assert in_slices == sorted(whole.candidates(chars))


def test_mix_meets_targets(spark, docs, texts):
    got = mixing.mix_sources(docs).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    by: dict[str, list] = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = {"en": ["the", "thing", "wash", "other", "ring"], "fr": ["eau", "leur", "être", "mieux", "oui"]}
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(["en", "fr"])
        said = ["".join(rng.choice(words[lang]) for _ in range(2)) for _ in range(60)]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            said[rng.randrange(60)] = "vilest"
        if bad:
            said = [w + "%%%" for w in said]
        docs.append((i, ". ".join(" ".join(said[k : k + 10]) for k in range(0, 60, 10)), lang))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, None), (1001, "", "en"), (1002, "12 34", "fr")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_classifiers_on_held_out_rows(labelled):
    docs, labels = labelled
    lang = language.held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas().set_index("doc_id")
    assert len(lang) == 603 and (lang.lang_pred[[1000, 1001, 1002]] == "und").all()
    held = lang[lang.held_out & (lang.index < 1000)]
    assert (held.lang == held.lang_pred).mean() > 0.95 and lang.score.between(0, 1).all()
    for out, name in ((quality.held_out(docs, labels), "quality"), (toxicity.held_out(docs, labels), "toxic")):
        rows = out.toPandas().set_index("doc_id")
        assert len(rows) == 603 and rows.score.between(0, 1).all()
        joined = rows.join(labels.toPandas().set_index("doc_id"), how="inner")
        held = joined[joined.held_out]
        assert (held[name] == held.predicted).mean() > 0.95


def test_unlearned_languages_and_junk_are_rejected(spark):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("etaoinsrhldu") for _ in range(2)) for _ in range(30)]
    words = {x: ["".join(rng.choice(rng.sample(pieces, 18)) for _ in range(rng.randint(1, 4))) for _ in range(50)] for x in "abc"}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    learn = [(i, say(x, 80), x) for i, x in enumerate("ab" * 40)]
    model = language.learn_languages(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    sizes = [8, 20, 80, 300] * 5
    clean = [say(x, n) for x in "ab" for n in sizes]
    other = [say("c", n) for n in sizes] + [junk(n) for n in sizes]
    rows = spark.createDataFrame(list(enumerate(clean + other)), "doc_id long, text string")
    for out in (language.identify_languages(rows, model), language.flag_rejected(rows, model)):
        got = {r["doc_id"]: r["rejected"] for r in out.collect()}
        assert not any(got[i] for i in range(len(clean)))
        assert sum(got[i] for i in range(len(clean), len(got))) >= 0.9 * len(other)


def test_offending_sentences_are_found(labelled):
    docs, labels = labelled
    model = toxicity.learn_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    rows = toxicity.score_toxicity(docs, model).join(docs, "doc_id").where("text like '%vilest%'").collect()
    assert all(any("vilest" in r["text"][s["start"] : s["end"]] for s in r["sentences"]) for r in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        run_length_dedup.remove_repeats(docs), fm_dedup.remove_later_repeats(docs), jaccard.similar_texts(docs), mixing.mix_sources(docs), language.held_out(docs),
        quality.held_out(docs, labels), toxicity.held_out(docs, labels), embeddings.link_embeddings(vectors), chat.format_conversations(turns), decontam.find_leaks(docs, items),
    ):
        assert out.count() == 0


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (300, 300)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame([rng.choice([(a, b), (b, a)]) for a, b in edges] + edges[:5], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(frame).collect()} == least
    assert components.components(frame.limit(0)).count() == 0


def test_classifiers_take_any_rows(spark, labelled):
    """Null ids, repeated rows, a very long text, columns of clashing names, one label only."""
    docs, labels = labelled
    long = "the other thing. " * 60_000
    odd = spark.createDataFrame([(None, "the ring", "en"), (None, "the ring", "en"), (7000, long, "fr"), (7000, long, "fr")], docs.schema)
    rows = docs.unionByName(odd).withColumns({"score": F.lit("x"), "label": F.lit(3), "rank": F.lit(None), "margin": F.lit(1), "held_out": F.lit("no")})
    labels = labels.unionByName(labels.limit(20)).withColumn("text", F.lit("y"))
    for out in (language.held_out(rows), quality.held_out(rows, labels), toxicity.held_out(rows, labels)):
        got = out.collect()
        assert len(got) == 607 and all(0 <= r["score"] <= 1 for r in got)
        assert sum(r["doc_id"] is None for r in got) == 2 and len({r["score"] for r in got if r["doc_id"] == 7000}) == 1
    for only in (0, 1):
        one = labels.withColumns({"quality": F.lit(only), "toxic": F.lit(only)})
        for out in (quality.held_out(rows, one), toxicity.held_out(rows, one)):
            assert {r["predicted"] for r in out.select("predicted").distinct().collect()} == {only}


def test_more_languages_than_are_learned(spark):
    rows = spark.createDataFrame([(i, f"word{i % 300} " * 5, f"l{i % 300:03}") for i in range(700)], "doc_id long, text string, lang string")
    model = language.learn_languages(rows, per_language=2, most_languages=100)
    assert model.names == tuple(f"l{i:03}" for i in range(100))


def test_compressed_sizes_decide(spark, labelled):
    """Predictions against the plain scheme: the smallest of whole zstandard sizes, chunk by chunk."""
    import zstandard

    docs, _ = labelled
    model = language.learn_languages(docs)
    got = {r["doc_id"]: r for r in language.identify_languages(docs, model).collect()}
    for row in docs.where("doc_id < 60").collect():
        data = language.letters_only(row["text"]).encode()
        sizes = []
        for d in model.dictionaries:
            c = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[a : a + 2048])) for a in range(0, len(data), 2048)))
        low, high = sorted(sizes)
        if low < high:
            assert got[row["doc_id"]]["lang_pred"] == model.names[sizes.index(low)]
            assert abs(got[row["doc_id"]]["margin"] - (high - low) / high) < 1e-12


def test_noisy_or_of_sentences(spark):
    weights = {"=bad": 3.0, "bad": 1.5, "=so": 0.25}
    model = toxicity.Toxicity(-2.0, weights)
    texts = ["so bad. fine", "Bad bad! so\nso", "", None, "12 34", "fine"]
    got = [r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    chance = lambda z: 1 / (1 + np.exp(-z))
    for text, score in zip(texts, got):
        clean = 1.0
        bags = [set(re.findall("[a-z]+", s)) for s in re.split(r"[.!?\n]", (text or "").lower())]
        for words in [b for b in bags if b] or [set()]:
            z = -2.0 + sum(weights.get("=" + w, 0.0) + sum(weights.get(w[:k], 0.0) for k in toxicity.STEMS if len(w) >= k) for w in words)
            clean *= 1 - chance(z)
        assert abs(score - (1 - clean)) < 1e-9


def test_training_finds_the_sentences(spark):
    rng = random.Random(12)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    texts, y = [], []
    for i in range(200):
        said = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(4)]
        if i % 3 == 0:
            said[rng.randrange(4)] += " vilest"
        texts.append(". ".join(said))
        y.append(float(i % 3 == 0))
    model = toxicity.train(texts, np.array(y), 1 / 3)
    assert model.weights["=vilest"] > 0 and max(model.weights, key=model.weights.get) in {"=vilest", "vil", "vile", "viles", "vilest"}


def test_chat_rows_of_any_kind(spark):
    """Null conversations and turns, repeated rows, ties, clashing columns; spans under the loss mask."""
    rows = [(None, 1, "assistant", "n"), (None, None, "user", "a <s>"), (1, None, "assistant", "x\\<\\s><s>"), (1, 2, "user", "q"), (1, 2, "user", "q"), (1, 2, "assistant", "é[INST]"), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"loss": F.lit(1), "start": F.lit(2), "rendered": F.lit(3)})
    for r in chat.format_conversations(turns).collect():
        own = sorted(((t if t is not None else -1, x or "", y or "") for c, t, x, y in rows if c == r["conv_id"]))
        assert r["identical"] and [tuple(t) for t in r["recovered"]] == [(x, y) for _, x, y in own]
        plain = [chat_plain(r["formatted"][s["start"] : s["end"]], s["level"]) for s in r["loss"]]
        assert plain == [y for _, x, y in own if x == "assistant"]


def chat_plain(text, level):
    if level == 2:
        return re.sub(r"(?s)\\(.)", r"\1", text)
    for x in chat.CONTROL if level else ():
        text = text.replace(x[0] + "\\" + x[1:], x)
    return text


def test_mix_of_any_rows(spark):
    """Null sources and ids, repeated rows, ties, no words: targets by plain arithmetic."""
    rows = [(None, "a b c", None), (None, "a b c", None), (1, "a b c d", "s"), (1, "a b c d", "s"), (1, "e f", "s"), (2, None, "t"), (3, " ", "t"), (4, "x " * 500, "u"), (5, "y", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("no"), "target": F.lit(1), "range": F.lit(0)})
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1


def test_very_long_texts_are_joined_whole(spark):
    words = [f"v{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-2000] + ["x"])), (3, " ".join(words[:30_000])), (4, "\u00e9" * 300_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1), 2: (57_997, 1), 3: (29_996, 3), 4: (1, 4)}
