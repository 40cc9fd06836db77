"""Quality rules, language identification, quality classifier and decontamination."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farelens.llm import decontamination as D
from farelens.llm import language_id as L
from farelens.llm import quality_classifier as C
from farelens.llm import quality_rules as Q
from farelens.llm import textnum as tn
from tests.llm.helpers import LOREM, odd_docs, rows

WHITE = "[^\x20\x09-\x0d]+"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té漢\x85A", max_size=40)), max_size=12))
def test_words_match_a_regular_expression(texts):
    got = []
    for part in tn.slices(pa.array(texts, pa.string())):
        w = tn.Words(part)
        got += [[part.data[s:e].tobytes().decode() for s, e, r in zip(w.start, w.end, w.row, strict=True) if r == k] for k in range(len(part))]
    assert got == [re.findall(WHITE, t or "") for t in texts]


def test_equal_words_have_equal_hashes_and_others_do_not():
    words = ["ab", "ba", "a", "b", "ab", "abc", "é", "é"]
    part = next(tn.slices(pa.array([" ".join(words)])))
    h = tn.Words(part).hashes()
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(8) for j in range(8))


def _repeat_words(words, n=5):
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    seen = Counter(grams)
    return len({k + o for k, g in enumerate(grams) if seen[g] > 1 for o in range(n)})


def test_quality_counts_match_brute_force(spark):
    docs = odd_docs(spark, [(20, "a b c d e a b c d e f"), (21, "x y\nx y\n\nx y\n z"), (22, "#a $b | <c> " * 9)])
    got = {(r.doc_id, r.n_words, r.n_repeat_words): r for r in Q.quality_rules(docs).collect()}
    assert len(rows(Q.quality_rules(docs))) == docs.count()
    for d in docs.collect():
        text = d.text or ""
        words = re.findall(WHITE, text)
        lines = [x for x in text.split("\n") if re.search(WHITE, x)]
        r = got[d.doc_id, len(words), _repeat_words(words)]
        assert r.word_chars == sum(map(len, words)) and r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 10 or 100 * _repeat_words(words) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_rules_on_an_empty_table(spark):
    assert rows(Q.quality_rules(odd_docs(spark).limit(0))) == []


def _train(spark):
    rng = random.Random(5)
    parts = {"en": ["the", "and", "tion", "ing", "er"], "de": ["der", "ung", "keit", "sch", "ü"], "fr": ["eau", "que", "ment", "é", "les"]}
    out = []
    for k in range(240):
        lang = list(parts)[k % 3]
        out.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(40)), lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string")


def test_language_is_found_on_held_out_rows(spark):
    docs = _train(spark)
    got = L.identify(docs, L.fit(L.training_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").where(L.row_fold(F.col("doc_id"), 3) == 1).collect()
    assert got and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    model = L.fit(_train(spark))
    got = rows(L.identify(odd_docs(spark), model))
    assert len(got) == 13
    by = {}
    for i, lang, score in got:
        by.setdefault(i, []).append((lang, score))
    assert by[3] == by[4] == by[5] == [("und", 0.0)] and by[9][0] == by[9][1]
    assert rows(L.identify(odd_docs(spark).limit(0), model)) == []
    kept = L.keep_identified(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and {3, 4, 5}.isdisjoint({r.doc_id for r in kept.collect()})


def _naive_language(model, text):
    """Words in the table by their own entry, else the longest n-gram from left to right; sums of log frequencies."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = [0.0] * len(model.languages)
    for w in words:
        picks = [model.words[w]] if w in model.words else []
        rest = "" if picks else f"<{w}>"
        while rest:
            n = next((n for n in range(len(model.grams), 0, -1) if len(rest) >= n and rest[:n] in model.grams[n - 1]), 0)
            picks.append(model.grams[n - 1][rest[:n]] if n else model.floor)
            rest = rest[n or 1 :]
        for p in picks:
            total = [a + float(b) for a, b in zip(total, p, strict=True)]
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return model.languages[best], 1 / sum(math.exp(max(-700, t - total[best])) for t in total)


def test_language_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "123 ..."), (-3, "zzq xx the"), (-4, "tion " * 50_000)], "doc_id long, text string"))
    model = L.fit(L.training_rows(spark.read.parquet(f"{folder}/documents.parquet")), L.LanguageModelSize(max_words=300, max_grams=200))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.identify(docs, model).collect():
        lang, score = _naive_language(model, texts[r.doc_id])
        assert (r.lang_pred, pytest.approx(r.score, abs=1e-9)) == (lang, score), r.doc_id


def test_no_language_is_dropped_from_a_bounded_model(spark):
    rows_in = [(k, f"word{k % 40:02d}x alpha{k % 40:02d}", f"l{k % 40:02d}") for k in range(400)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, lang string")
    model = L.fit(docs, L.LanguageModelSize(model_entries=4000))
    assert len(model.languages) == 40 and sum(map(len, [model.words, *model.grams])) <= 4000
    with pytest.raises(ValueError, match="languages"):
        L.fit(docs, L.LanguageModelSize(model_entries=3900))


def test_language_without_training_rows_is_unknown(spark):
    docs = _train(spark)
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs.limit(0))).collect()} == {"und"}


def test_unseen_words_take_the_longest_known_grams(spark):
    s = L._Scorer(L.LanguageModel(["x"], {}, [{"a": np.array([-1.0])}, {"ab": np.array([-2.0])}], np.array([-9.0])))
    assert s.rows[s.unseen("aba")].ravel().tolist() == [-9.0, -2.0, -1.0, -9.0]


def _quality_tables(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(300):
        words = ["".join(rng.choices(["th", "er", "an", "ing"], k=2)) for _ in range(60)]
        bad = k % 4 == 0
        docs.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."))
        labels.append((k, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_is_found_on_held_out_rows(spark):
    docs, labels = _quality_tables(spark)
    got = C.score(docs, C.fit(docs, C.training_rows(labels))).join(labels, "doc_id").where(C.row_fold(F.col("doc_id"), 5) == 0).collect()
    assert got and all((r.score >= 0.3) == (r.quality == 1) for r in got)


def test_quality_votes_match_all_cosines(spark):
    docs, labels = _quality_tables(spark)
    model = C.fit(docs, C.training_rows(labels))
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + ["", "One more TEXT!! " * 500]
    share = {c: 0.5 / sum(model.labels == c) * len(model.labels) for c in (0, 1)}
    got = [r.score for r in C.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        terms = C.term_rows(next(tn.slices(pa.array([text]))))[0].astype(float)
        v = (terms * model.weight) @ model.projection.astype(float)
        if not v.any():
            assert score == 0.5
            continue
        cosines = sorted(((float(v @ u) / max(float(np.sqrt(v @ v)), 1e-12), int(y)) for u, y in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)[: model.neighbours]
        votes = [(max(c, 1e-6) ** 4 * share[y], y) for c, y in cosines]
        assert score == pytest.approx(sum(w for w, y in votes if y == 1) / sum(w for w, _ in votes), abs=0.02)


def test_equally_near_neighbours_share_the_votes():
    vectors, labels = np.array([[1, 0]] + [[0.8, 0.6]] * 4 + [[0, 1]], np.float32), np.array([1, 1, 0, 0, 0, 0])
    found = []
    for order in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [2, 1, 0, 5, 3, 4]):
        model = C.Classifier(np.ones(2, np.float32), np.eye(2, dtype=np.float32), vectors[order], labels[order], 3, 8)
        found.append(model.score(np.array([[2.0, 0.0]], np.float32))[0])
    good, bad = 0.5 / 2 * 6, 0.5 / 4 * 6  # a vote of either class; two places are left for four equal neighbours
    weight = 0.8**4 * 2 / 4
    assert found == pytest.approx([(good + weight * good) / (good + weight * good + 3 * weight * bad)] * 3)


def test_shapes_of_long_words_differ_anywhere():
    part = next(tn.slices(pa.array(["a1" * 20, "a1" * 19 + "aA", "a1" * 20])))
    a, b, c = C._shape_hashes(part, tn.Words(part)).tolist()
    assert a == c != b


def test_fit_takes_the_same_text_of_a_repeated_id(spark):
    docs, labels = _quality_tables(spark)
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    models = [C.fit(d, labels) for d in (twice, twice.repartition(7).orderBy(F.desc("text")))]
    assert np.array_equal(models[0].labels, models[1].labels) and np.allclose(models[0].weight, models[1].weight)


def test_quality_scores_of_odd_rows(spark):
    docs, labels = _quality_tables(spark)
    model = C.fit(docs, labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0)], labels.schema)))
    got = rows(C.score(odd_docs(spark), model))
    assert len(got) == 13 and all(s is not None and 0 <= s <= 1 for _, s in got)
    assert C.keep_good(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert rows(C.score(docs.limit(0), model)) == []
    assert {s for _, s in rows(C.score(docs, C.fit(docs, labels.limit(0))))} == {0.5}


def _naive_hits(text, items, n=10):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            window = w[k : k + n]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 14])))) for k in range(30)] + [(99, ""), (98, None), (2, "Dup ITEM text")]
    texts = [" ".join(rng.choices(vocab, k=80)) for _ in range(20)] + [f"start, {t}! end" for _, t in items if t] + [items[0][1] + " " + items[1][1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in D.find_passages(docs, bench).collect():
        assert (r.n_words, r.n_hit, list(r["items"])) == _naive_hits(texts[r.doc_id], items)
        for s in r.spans:
            assert 0 <= s.begin < s.end <= len(texts[r.doc_id])
    clean = D.decontaminate(docs.selectExpr("doc_id", "text", "length(text) AS n_chars", "1 AS hit"), bench)
    assert clean.columns == ["doc_id", "text", "n_chars", "hit"]
    for r in clean.collect():
        assert (texts[r.doc_id] is None) == (r.text is None) and _naive_hits(r.text, items)[1] == 0
        assert r.text is None or r.n_chars == len(r.text)


def test_decontamination_in_blocks_gives_the_same(spark, monkeypatch):
    docs = odd_docs(spark, [(30, "x " + LOREM + " y")])
    bench = spark.createDataFrame([(k, LOREM[k * 5 :]) for k in range(6)], "item_id long, text string")
    whole = sorted(rows(D.find_passages(docs, bench)), key=repr)
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert sorted(rows(D.find_passages(docs, bench)), key=repr) == whole


def test_blocks_do_not_change_what_is_cut(spark, monkeypatch):
    w = [f"w{k}" for k in range(40)]
    items = [" ".join(w[:10]), " ".join(w[6:16]), " ".join(w[20:30]), " ".join(w[30:40]), "short one"]
    texts = ["x " + " ".join(w[:16]) + " y", " ".join([*w[20:25], *w[30:40], *w[25:30], "z"]), " ".join([*w[30:33], *w[20:30], *w[33:40], "z"]), " ".join(["short", *w[6:9], *w[:10], *w[9:16], "one", "z"]), "clean", None, "clean"]
    docs = spark.createDataFrame([(k, t, 0, "h", "i") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, _hit string, items string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    order = lambda df: sorted(rows(df), key=repr)
    whole = order(D.decontaminate(docs, bench))
    assert [r[1] for r in whole][:3] == ["x  y", " z", " z"]
    for size in (10, 60):  # about 17 and 3 blocks
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        assert order(D.decontaminate(docs, bench)) == whole


def test_decontamination_holds_one_block_at_a_time(spark, monkeypatch):
    held, most, plain = [], [], D._collected
    monkeypatch.setattr(D, "_collected", lambda items: held.append(out := plain(items)) or most.append(len(out)) or out)
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    bench = spark.createDataFrame([(k, LOREM[k * 5 :]) for k in range(12)], "item_id long, text string")
    D.find_passages(odd_docs(spark), bench).collect()
    assert sum(most) == 12 and max(most) < 12


def test_decontamination_with_empty_tables(spark):
    docs, bench = odd_docs(spark), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.find_passages(docs, bench).collect()} == {0} and D.find_passages(docs, bench).count() == 13
    assert rows(D.find_passages(docs.limit(0), bench)) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(2, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(2, 5), min_size=2, max_size=2), min_size=1, max_size=5))
def test_fm_index_finds_and_locates(text, patterns):
    index = D.FMIndex(np.array(text))
    which, lo, hi = index.search(np.array(patterns))
    for k, p in enumerate(patterns):
        places = [i for i in range(len(text) - 1) if text[i : i + 2] == p]
        at = np.flatnonzero(which == k)
        found = sorted(index.locate(np.arange(lo[at[0]], hi[at[0]])).tolist()) if len(at) else []
        assert found == places


def test_item_digest_of_a_clean_document_is_that_of_nothing(spark, folder):
    from farelens.llm.entry import queries

    row = queries()["op7_decontamination"](spark, folder).where("n_hit = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("text", ["", "a b", None])
def test_short_texts_have_no_windows(text):
    part = next(tn.slices(pa.array([text], pa.string())))
    w = tn.Words(part)
    assert len(tn.windows(w.hashes(), w.row, 5)[0]) == 0


def test_the_classifiers_sample_window_is_bounded(spark):
    """Of 60,000 labelled rows of a class, little more than the wanted rows reach the window that picks them."""
    labels = spark.range(120_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    size = C.ClassifierSize(fit_rows=300)
    chosen = C._sample(labels.select("doc_id", F.lit("some text").alias("text")), labels, size)
    assert {r["quality"]: r["count"] for r in chosen.groupBy("quality").count().collect()} == {0: 300, 1: 300}
    hashes = labels.withColumn("_h", F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5)
    assert all(r["count"] < 2 * size.fit_rows for r in hashes.where(F.col("_h") <= (1.5 * 300 + 100) / 60_000).groupBy("quality").count().collect())
