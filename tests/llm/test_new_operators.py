"""Personal data, resampling and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farelens.llm import fill_in_middle as M
from farelens.llm import personal_data as P
from farelens.llm import target_sampling as T
from tests.llm.helpers import LOREM, odd_docs, rows

# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(d):
    total = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d))))
    return 12 <= len(d) <= 19 and total % 10 == 0


def _passes(kind, found):
    if kind == "ip":
        return ":" in found or all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return _luhn(_digits(found))
    return kind == "email" or 9 <= len(_digits(found)) <= 15


def _python(rx):
    """The expression without the anchor that Python lacks; found by hand where it matters."""
    return rx.replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "").replace(r"(?:(?<![0-9])|\G)", "")


def _normal(kind, found):
    plain = re.sub(r" ?[(\[]dot[)\]] ?", ".", re.sub(r" ?[(\[]at[)\]] ?", "@", found.lower()))
    return _digits(found) if kind in ("card", "phone") else plain


def _zeroed(s):
    return re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), s))


def _brute_force(texts, rules):
    """Spans of each text and the new ones, with every count by plain loops."""
    white, word = "[\x20\x09-\x0d]", "[^\x20\x09-\x0d]+"
    found = []
    for row, text in enumerate(texts):
        text = text or ""
        mine = []
        for base, of in ((True, PLAIN), (False, {k: _python(rx) for k, rx in P.LOOSE.items()})):
            for kind, rx in of.items():
                hits = list(re.finditer(rx, text))
                for k, m in enumerate(hits):
                    gap = text[hits[k - 1].end() if k else 0 : m.start()]
                    after = text[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(text)]
                    left = " " + gap if len(gap) < rules.window else gap[-rules.window :]
                    right = after + " " if len(after) < rules.window else after[: rules.window]
                    if _passes(kind, m.group()):
                        mine.append([row, kind, base, m.start(), m.end(), m.group(), left, right])
        bases = [(m[3], m[4]) for m in mine if m[2]]
        found += [m for m in mine if m[2] or not any(s < m[4] and m[3] < e for s, e in bases)]
    edges = Counter()
    for _, kind, _, _, _, surface, left, right in found:
        cues = {"shape": re.sub("[a-z]+", "a", _zeroed(surface))}
        for side, where, rx in (("before", left, f"{white}({word}){white}+[(\\[<\"']*$"), ("second", left, f"{white}({word}){white}+{word}{white}+[(\\[<\"']*$"), ("after", right, f"^[)\\]>\"'.,;:!?]*{white}+({word}){white}")):
            m = re.search(rx, _zeroed(where))
            if m:
                cues[side] = m.group(1)
        for side, cue in cues.items():
            edges[kind, side, cue, _normal(kind, surface)] += 1
    places = Counter(w for t in texts if t for w in re.split(white + "+", _zeroed(t)))
    seeds = {(m[1], _normal(m[1], m[5])) for m in found if m[2]}
    known = set(seeds)
    for _ in range(rules.rounds):
        hits, count, total = Counter(), Counter(), Counter()
        for (kind, side, cue, inst), n in edges.items():
            total[kind, side, cue] += n
            hits[kind, side, cue] += n * ((kind, inst) in known)
            count[kind, side, cue] += (kind, inst) in known
        sure = {}
        for p in total:
            of_all = total[p] if p[1] == "shape" else max(total[p], places[p[2]])
            if count[p] >= rules.least_instances and round(hits[p] / of_all, 6) >= rules.least_confidence:
                sure[p] = round(hits[p] / of_all, 6)
        wrong = defaultdict(lambda: 1.0)
        for (kind, side, cue, inst), _n in edges.items():
            if (kind, side, cue) in sure:
                wrong[kind, inst] *= 1 - min(sure[kind, side, cue], 0.999)
        known = seeds | {i for i, w in wrong.items() if round(1 - w, 6) >= rules.least_score}
    out = [[] for _ in texts]
    for row, kind, base, start, end, surface, *_ in found:
        if base or (kind, _normal(kind, surface)) in known:
            out[row].append((start, P.KINDS.index(kind) + 1, end, kind, surface, base))
    return [sorted(o) for o in out]


def _held(spark, texts, rules):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.personal_data(docs, rules).collect()}
    want = _brute_force(texts, rules)
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert got[k] == want[k], (texts[k] or "")[:200]
    return want


def _card(prefix):
    return next(prefix + str(d) for d in range(10) if _luhn(prefix + str(d)))


def test_swallowed_and_cued_identifiers_are_found_by_learned_patterns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    card = lambda: _card("4" + "".join(rng.choices("0123456789", k=14)))
    bad = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choices("0123456789", k=15)), "") if not _luhn(c))
    texts = []
    for _ in range(12):
        texts += [f"{word()} {word()} {phone()} {word()}", f"{word()} {card()} {word()}", f"{word()} {bad()} {word()}"]  # a failing checksum is no card
        texts += [f"write helpdesk: {word()}@{word()}.com now", f"{word()} call hotline: {phone()} today"]
    swallowed = f"so {phone()} {bad()} end"  # the base expression takes both numbers for one
    merged = next(f"so {c} 27.109.211.155 end" for c in iter(card, "") if not _luhn(c + "27"))
    texts += [swallowed, merged, "call hotline: 555 123 4567 today", "the order 555 999 4567 came", "write helpdesk: ann (at) mail (dot) org now", "written to ann [at] nowhere there", None, "", "version 1.2.3.4.5 and 10.0.0.300, fe80:0:0:0:1"]
    want = _held(spark, texts, P.BootstrapRules())
    new = lambda t: [s[3:5] for s in want[texts.index(t)] if not s[5]]
    assert new(swallowed)[0][0] == "phone" and new(merged)[0][0] == "card"
    assert new("call hotline: 555 123 4567 today") == [("phone", "555 123 4567")] and new("write helpdesk: ann (at) mail (dot) org now") == [("email", "ann (at) mail (dot) org")]
    assert new("the order 555 999 4567 came") == [] and new("written to ann [at] nowhere there") == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+-() 9:é\n", max_size=60), min_size=1, max_size=25))
def test_spans_match_brute_force_on_odd_texts(spark, texts):
    _held(spark, texts, P.BootstrapRules(least_instances=1, least_confidence=0.3, rounds=2, window=8))


def test_expressions_take_linear_time_and_whole_texts(spark):
    long = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "(1) " * 80_000 + " tail x.1@b.com", "a.b@c.d " * 3000]
    got = {r.doc_id: r.spans for r in P.personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert [s.found for s in got[6] if s.kind == "email"] == ["x.1@b.com"] and len(got[7]) == 3000 and got[0] == []


def test_corpus_words_are_the_same_broadcast_or_joined(spark):
    docs = spark.createDataFrame([(k, f"call hotline: +1 (2{k:02d}) 555-1{k:03d} now and again call me") for k in range(20)], "doc_id long, text string")
    take = lambda most: sorted(rows(P.personal_data(docs, P.BootstrapRules(broadcast_words=most))))
    assert take(0) == take(50_000)


def test_personal_data_of_odd_rows(spark):
    docs = odd_docs(spark, [(20, "mail me.1@x.org or me.1@x.org"), (20, "mail me.1@x.org or me.1@x.org")])
    got = rows(P.personal_data(docs))
    assert len(got) == docs.count() and sum(len(s) for i, s in got if i == 20) == 4
    assert rows(P.personal_data(docs.limit(0))) == []


# ---- resampling


def _resampled(docs, target, rules):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    grams = lambda w: [" ".join(w[k : k + n]) for n in range(1, rules.most_words + 1) for k in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % rules.buckets
    s, t = (Counter(bucket(g) for x in side for g in grams(words(x))) for side in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log((t[b] + 1.0) * (big_s + float(rules.buckets)) / ((s[b] + 1.0) * (big_t + float(rules.buckets)))))
    out = []
    for i, text in docs:
        w = words(text)
        g = [gain(bucket(x)) for x in grams(w)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{rules.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(g), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    drawable = sorted((r for r in out if r[1] >= rules.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(drawable[: rules.percent * len(drawable) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_matches_brute_force(spark, most):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma7", "δέλτα", "漢字", "x"]
    docs = [(k, " ".join(rng.choices(vocabulary, weights=[1, 1, 1, 1, 1, 1 + k % 9], k=rng.randint(0, 30)))) for k in range(150)] + [(k, None) for k in (200, None)] + [(300, "one-two,three")] * 40
    target = ["alpha beta gamma7", "alpha alpha", None, ""]
    rules = T.SamplingRules(most_words=most, buckets=97, least_words=3, percent=30)
    frame = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], "doc_id long, text string, _row string, n_words int, bucket int")
    got = T.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), rules)
    assert sorted(map(tuple, got.collect()), key=repr) == _resampled(docs, target, rules)


def test_resampling_of_odd_and_empty_tables(spark):
    target = spark.createDataFrame([("alpha",)], "text string")
    docs = odd_docs(spark)
    got = rows(T.resample(docs, target, T.SamplingRules(percent=100)))
    assert len(got) == docs.count() and sorted(r[5] for r in got if r[5] is not None) == list(range(1, 1 + sum(r[1] >= 20 for r in got)))
    assert rows(T.resample(docs.limit(0), target)) == []
    assert {r[3] for r in rows(T.resample(docs, target.limit(0))) if r[2] == 0} == {0}
    assert T.sample(docs.where("doc_id < 3"), target, T.SamplingRules(percent=50)).columns == docs.columns


# ---- fill in the middle


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\té漢\x85<PSM>\U0001f600", max_size=40))
def test_ranks_by_events_match_walking(text):
    events = M.Events(text, M.automaton(M.MiddleRules()))
    starts = [m.start() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    assert [events.words_before(c) for c in range(len(text) + 1)] == [sum(s < c for s in starts) for c in range(len(text) + 1)]
    assert events.holds_sentinel == any(s in text for s in ("<P>", "<S>", "<M>")) and events.units == len(text)


def test_every_form_gives_its_text_back(spark):
    texts = [LOREM * k for k in range(1, 9)] + ["a<", "<P", "P>S>", "<<S", "x<M>y", "", None, "é漢\U0001f600" * 50, "word " * 60_000]
    docs = spark.createDataFrame([(k, t, 0, "o") for k, t in enumerate(texts * 6)] + [(None, LOREM, 0, "o")], "doc_id long, text string, n int, output string")
    for rules in (M.MiddleRules(), M.MiddleRules(seed=4, prefix="[a+b]", suffix="^$", middle="|.", fim_percent=100, spm_percent=50)):
        made = M.fill_in_middle(docs, rules).withColumn("back", M.restored_text("output", "form", rules)).collect()
        forms = Counter(r.form for r in made)
        assert len(made) == docs.count() and all(forms[f] for f in ("plain", "psm", "spm"))
        by = {d.doc_id: d.text or "" for d in docs.collect()}
        for r in made:
            text = by[r.doc_id]
            assert r.back == text and r.n == len(text)
            h = hashlib.sha256(f"{rules.seed}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            a, b = sorted(int(h[k : k + 8], 16) % (len(text) + 1) for k in (0, 8))
            if r.form == "plain":
                assert r.output == text and r.prefix_chars is None
                continue
            p, m, s = text[:a], text[a:b], text[b:]
            x, y, z = rules.sentinels
            assert (r.prefix_chars, r.middle_chars) == (a, b - a) and r.output == (f"{x}{p}{y}{s}{z}{m}" if r.form == "psm" else f"{y}{s}{x}{p}{z}{m}")


def test_sentinels_that_could_be_misread_are_refused(spark):
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.MiddleRules(prefix=bad[0], suffix=bad[1], middle=bad[2]).checked()


def test_fill_in_middle_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = M.fill_in_middle(docs)
    assert got.count() == docs.count() and rows(M.fill_in_middle(docs.limit(0))) == []
    assert got.where("doc_id = 9").distinct().count() == 1 and {r.form for r in got.where("doc_id IN (3, 4)").collect()} == {"plain"}


def test_every_form_is_dealt_as_asked(spark):
    made = M.fill_in_middle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(LOREM).alias("text"))).groupBy("form").count().collect()
    share = {r.form: r["count"] / 4000 for r in made}
    assert abs(share["plain"] - 0.1) < 0.03 and abs(share["spm"] - 0.18) < 0.03
