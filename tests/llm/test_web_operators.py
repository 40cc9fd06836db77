"""HTML extraction, URL filters, WARC and chat formatting."""

import hashlib
import json
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farelens.llm import chat_log as T
from farelens.llm import html_wrappers as H
from farelens.llm import url_filters as U
from farelens.llm import warc as W
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string, host string, wrapper string, n_pages string, digest string, first_id string, value string, rule string, index string"


def pages(spark, given):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", "d", "f", "v", "r", "i") for i, u, h in given], PAGES)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:1}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<main><article><h1>Head &lt;1&gt;</h1><p>First  <b>bold</b>&nbsp;text<br>more<p>Second caf&eacute; &#x41;&#66;<ul><li>one<li>two</ul>
<form><input name=q><p>Search</p></form><aside>Related</aside><div class="ad banner"><p>Buy</p></div><table><tr><td>a<td>b</table>
<section id="comments"><p>Nice!</p></section></article></main><div class="sidebar">Side</div><footer>&copy; us</footer></body></html>"""


def test_main_text_leaves_out_what_is_not_the_article():
    assert H.main_text(PAGE).split("\n") == ["Head <1>", "First bold text more", "Second café AB", "one", "two", "a", "b"]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<div>x <nav>menu</nav> y</div>", "x\ny"), ("<article><p>cut off <a href='/x", "cut off"),
    ("<p>5 < 6 and 7 > 2</p>", "5 < 6 and 7 > 2"), ("<script>only</script>", ""), ("<article></article><p>body</p>", "body"), ("<article><p>a</p></article><p>outside</p>", "a"),
    ("<article><p>x&am", "x&am"), ("<ARTICLE><P CLASS=ad>no</P><P>yes</P></ARTICLE>", "yes"), ("<div hidden><p>closed</p></div><p>x <math><mi>y</mi></math> z <svg><text>axis</text></svg></p>", "closed\nx y z axis"),
    ("<header><h1>Site</h1></header><article><div class='post-header'><h1>T</h1></div><header><p>by</p></header><p>x</p></article>", "T\nby\nx"),
])
def test_main_text_of_odd_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><article>{'<div>' * 70}{'</div>' * 70}<p>more</p></article></div>", "more"),
    (f"<article>{'<div>' * 70}x<nav>menu</nav><aside><p>see also</p></aside><form>send</form>{'</div>' * 70}y</article>", "x\ny"),
    (f"<p>out</p>{'<section>' * 3000}<article><p>a</p></article>{'</section>' * 3000}<p>out</p>", "a"),
    (f"<div class=banner>{'<div>' * 3000}<article><h1>t</h1></article>{'</div>' * 3000}</div>", "t"),
    (f"<ul>{'<li><ul>' * 500}<li>a<li>b{'</ul>' * 501}c", "a\nb\nc"),
])
def test_main_text_at_any_depth(page, text):
    items = H.page_items(H.parse(page))
    assert H.main_text(page) == text and H.main_text(page, H.Wrapper(H.closed(H.align(items, items), 2), 2)) == text


def wrapper_of(*pages_of_host):
    out = None
    for p in pages_of_host:
        items = H.page_items(H.parse(p))
        out = items if out is None else H.align(out, items)
    return H.Wrapper(H.closed(out, len(pages_of_host)), len(pages_of_host))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_alignment_names_every_item_once(a, b):
    make = lambda names: H.fold([[n, False, False, []] for n in names])
    out = H.align(make(a), make(b))
    names = [n for item in out for n in H._names(item)]
    assert len(names) == len(set(names)) and set(names) == set(a) | set(b)


def test_wrapper_is_folded_and_finds_the_region(spark):
    body = "<html><body><div>Portal</div><article><h1>{t}</h1><p class=x>Subscribe now</p><h3>Story</h3>{p}</article></body></html>"
    given = [(k, "http://one.test/a", body.format(t=f"Title {k}", p="".join(f"<p>para {k} {j}</p>" for j in range(k % 4 + 1)))) for k in range(12)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, given)).collect()}
    assert got[2].split("\n") == ["Title 2", "Subscribe now", "Story", "para 2 0", "para 2 1", "para 2 2"]  # nothing is cut inside an article
    wrapper = H.infer_wrappers(pages(spark, given)).first()
    items, way, keep = json.loads(wrapper.wrapper)
    assert wrapper.n_pages == 12 and way == ["html", "body", "article"] and keep == []
    heading, group = items[0][3][0][3][1][3]
    assert heading[:3] == ["h1", False, False] and heading[3][0][3][2] == {}  # its text differs
    assert group[:3] == ["()", True, False] and {x[0]: len(x[3][0][3][2]) for x in group[3]} == {"p": 1, "h3": 1}


@pytest.mark.parametrize("n", [2, 3, 7, 8, 40])
def test_wrapper_cuts_what_all_pages_share_at_any_size(n):
    body = "<html><body><div>Portal</div><div><h1>Title {k}</h1><p>Long enough paragraph number {k}.</p>{own}</div><div>All rights kept by Portal</div></body></html>"
    own = {1: "<blockquote>quoted once</blockquote>", 5: "<h3>one heading</h3><ul><li>one item</li></ul>"}
    texts = [body.format(k=k, own=own.get(k, "")) for k in range(n)]
    w = wrapper_of(*texts)
    for k, t in enumerate(texts):
        mine = {1: ["quoted once"], 5: ["one heading", "one item"]}.get(k, [])
        assert H.main_text(t, w).split("\n") == [f"Title {k}", f"Long enough paragraph number {k}.", *mine]
        assert H.main_text(t).split("\n")[0] == "Portal"  # tags alone don't tell


def test_copies_of_one_page_keep_their_text():
    page, other = "<div><p>same story</p></div>", "<div><p>another story</p></div>"
    w = wrapper_of(*[page] * 19, other)
    assert H.main_text(page, w) == "same story" and H.main_text(other, w) == "another story"


def test_slot_texts_count_their_pages():
    out = None
    for p in ("<p>a</p><p>a</p>", "<p>a</p>", "<p>a</p><h2>b</h2>", "<h2>b</h2>"):
        items = H.page_items(H.parse(p))
        out = items if out is None else H.align(out, items)
    assert {x[0]: [n for n, _ in x[3][0][3][2].values()] for x in out} == {"p": [3], "h2": [2]}


def _long_pages(n, own=150):
    """Pages of a host without telling tags: one list of paragraphs, most of them a page's own, and two of all pages among them."""
    body = lambda k: [f"Own paragraph {k} {j} of some length." for j in range(own)]
    return [(k, [*body(k)[: own // 2], "Kept by the portal", *body(k)[own // 2 :], "Kept at the end"]) for k in range(n)]


def test_template_text_among_any_number_of_texts(spark, monkeypatch):
    """Neither a page's many texts nor a host's hide what nearly all pages have."""
    told = _long_pages(12)
    html = {k: "<html><body><div><h1>Title {}</h1>{}</div></body></html>".format(k, "".join(f"<p>{t}</p>" for t in texts)) for k, texts in told}
    want = {k: [f"Title {k}", *(t for t in texts if not t.startswith("Kept"))] for k, texts in told}
    w = wrapper_of(*html.values())
    assert {k: H.main_text(t, w).split("\n") for k, t in html.items()} == want
    given = [(k, "http://long.test/a", t) for k, t in html.items()]
    for counted in (H.COUNTED_TEXTS, 100):
        monkeypatch.setattr(H, "COUNTED_TEXTS", counted)
        assert {r.page_id: r.text.split("\n") for r in H.extract(pages(spark, given).repartition(3)).collect()} == want


def test_counted_texts_give_the_wrapper_of_texts_in_slots(spark):
    """Texts counted as rows say what texts kept in the slots say."""
    texts = [f"<html><body><div class=a><p>Menu {k % 2}</p><ul><li>x<ul><li>y{k}</ul></ul></div><div><h1>T {k}</h1><p>{'word ' * (k + 3)}</p><p>Rights</p></div></body></html>" for k in range(9)]
    one = wrapper_of(*texts)
    got = H.infer_wrappers(pages(spark, [(k, "http://a.test/", t) for k, t in enumerate(texts)]).coalesce(1)).first()
    assert (json.loads(got.wrapper)[0], got.n_pages) == (one.items, 9)


def test_role_names_are_hints_only():
    """The whole site stands in an element called banner; the wrapper keeps it. A small one goes."""
    body = "<html><body><div class='top-banner'>Buy {k}</div><div class='page banner'><h1>Title {k}</h1><p>{p}</p></div></body></html>"
    texts = [body.format(k=k, p=f"words of page {k} " * 9) for k in range(3)]
    w = wrapper_of(*texts)
    assert [H.main_text(t, w).split("\n")[0] for t in texts] == [f"Title {k}" for k in range(3)] and "Buy" not in H.main_text(texts[0], w)


class Plain(HTMLParser):
    """A second way to the same blocks: every block's text with the classes around it."""

    def __init__(self, page):
        super().__init__()
        self.around, self.found, self.link = [], [], 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = 1
        else:
            self.around.append(dict(attrs).get("class", tag))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = 0
        else:
            self.around.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append((tuple(self.around), " ".join(data.split()), self.link))


def brute_force(site):
    """Blocks that are not inside links and that fewer than nine of ten pages have, by counting all of them."""
    read = [Plain(p).found for p in site]
    having = Counter(key for blocks in read for key in set(blocks))
    return ["\n".join(t for around, t, link in blocks if not link and having[around, t, link] < 0.9 * len(site)) for blocks in read]


@pytest.mark.parametrize("seed", range(6))
def test_generated_sites_match_brute_force(seed):
    """Sites of neutral elements: menus, links and footers are told from stories by the wrapper alone."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    c = [f"k{x}" for x in rng.sample(range(900), 8)] if seed % 2 else [f"a{'xyzuvwrs'[k]}" for k in range(8)]
    menu = "".join(f"<li><a href='/{k}'>{say(1)}</a></li>" for k in range(6))
    foot, note = say(8), say(5)

    def page():
        story = f"<h1>{say(5)}</h1>" + "".join(f"<{t}>{say(rng.randint(8, 60))}</{t}>" for t in rng.choices(["p", "p", "p", "h2", "blockquote"], k=rng.randint(3, 9)))
        more = "".join(f"<li><a href='/x{k}'>{say(3)}</a></li>" for k in range(rng.randint(1, 4)))
        return f"<html><body><div class='{c[0]}'>{note}</div><ul class='{c[1]}'>{menu}</ul><div class='{c[2]}'><div class='{c[3]}'>{story}</div></div><ul class='{c[4]}'>{more}</ul><div class='{c[5]}'><p>{foot}</p></div></body></html>"

    site = [page() for _ in range(rng.choice([2, 5, 30]))]
    w = wrapper_of(*site)
    assert [H.main_text(p, w) for p in site] == brute_force(site)
    assert all(H.main_text(p) != H.main_text(p, w) for p in site)  # without the wrapper every page comes out otherwise


def test_extraction_of_odd_rows(spark):
    given = [(1, None, None), (2, "no scheme", ""), (3, "http://a.test/", PAGE), (3, "http://a.test/", PAGE), (None, "http://a.test/", "<p>x</p>"), (4, "http://b.test", "<div>" * 5000 + "deep" + "</div>" * 5000), (5, "http://c.test", "<p>w</p>" * 20000)]
    got = H.extract(pages(spark, given)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == "" and by[4].text == "deep" and by[5].text.count("\n") == 19999 and all(r.n_chars == len(r.text) for r in got)
    assert rows(H.extract(pages(spark, given).limit(0))) == []


def test_broadcast_and_join_give_the_same(spark, monkeypatch):
    given = [(k, f"http://h{k % 3}.test/", PAGE.replace("First", f"First {k}")) for k in range(12)]
    one = sorted(rows(H.extract(pages(spark, given))))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(rows(H.extract(pages(spark, given)))) == one


def _judge(url, sites):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule, verdict in sites:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


URLS = [None, "", "x", "http://", "http://A.Example.NET/en/1?q#f", "https://example.net/de/", "http://net/", "http://net", "ftp://x.org/fr/a/b", "http://x.org/fr", "http://example.com/de/x", "http://badexample.com/de/x",
        "http://www.cheap-pills.example.com/de/1", "http://cheap-pills.test", "http://not-cheap-pills.test/", "http://a.test/cheap-pills/", "http://a.test?x=http://b.net/", "http://É.NET/", "HTTP://u@h.org:80/fr/ ", "http://a.net/\nline"]


def test_url_verdicts_match_brute_force(spark):
    got = {r.page_id: r for r in U.filter_urls(pages(spark, [(k, u, None) for k, u in enumerate(URLS)])).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host, path, best = _judge(url, U.SITE_RULES)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), url
        spam = any(label in U.BLOCKED_LABELS for label in host.split("."))
        assert r.verdict == (best[1] if best else "block" if spam else "allow"), url


def test_url_filter_plan_has_no_python(spark):
    plan = U.filter_urls(pages(spark, [(1, "http://a.net/", None)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_many_rules_cost_no_more_candidates(spark):
    rules = [*U.default_rules(), *(U.site_rule(f"site{k}.test/p{k}/", "block") for k in range(3000))]
    long = "http://site7.test/p7/" + "x/" * 50_000
    got = {r.page_id: r for r in U.filter_urls(pages(spark, [(1, "http://a.site2999.test/p2999/x", None), (2, "http://site1.test/p2/", None), (3, "http://example.com/de/", None), (4, long, None)]), rules).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == {1: ("site2999.test/p2999/", "block"), 2: (None, "allow"), 3: ("example.com/de/", "block"), 4: ("site7.test/p7/", "block")}
    assert all(r.n_candidates <= 6 for r in got.values())


def test_url_filter_parameters(spark):
    p = pages(spark, [(1, "http://a.net/", None), (None, "http://a.net/", None)])
    assert [r.verdict for r in U.filter_urls(p, []).collect()] == ["allow", "allow"]
    assert rows(U.filter_urls(p.limit(0))) == []
    with pytest.raises(ValueError):
        U.filter_urls(p, [U.UrlRule("x", "block", "pattern", ".", ())])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=20), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(W.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    rng = random.Random(8)
    long = "é" * 700
    given = [(k, f"http://h{rng.randint(0, 3)}.test/{rng.randint(0, 5)}", rng.choice([long, long + "x", "short", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n", "", None])) for k in range(40)]
    given += [(50, None, "n"), (51, "http://x.test/\r\nEvil: 1", "crlf"), (None, "http://x.test/", "null id"), (None, "http://x.test/", long), (7, given[7][1], given[7][2])]
    got = W.archive_pages(pages(spark, given), file_bytes=4000, range_rows=5).collect()
    assert len(got) == len(given)
    expected = []
    for i, _, html in given:
        data = (html or "").encode()
        same = [j for j, _, h in given if (h or "").encode() == data]
        top = max((j for j in same if j is not None), default=None)
        again = len(data) >= 1000 and i != top
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda x: tuple(map(repr, x))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected, key=key)
    ordered = sorted(got, key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in ordered] == list(range(len(given)))
    keys = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys) and len({r.key_range for r in got}) > 1 and len({r.file for r in got}) > 1


def test_warc_records_are_http_messages_and_hot_payloads_stay(spark, monkeypatch):
    from farelens.llm import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    hot, long = "h" * 1500, "é" * 1_500_000
    given = [*((k, "http://x.test/", hot) for k in range(30)), *((k, "http://x.test/", "") for k in range(30, 50)), (50, "http://x.test/long", long), (51, "http://x.test/long", long)]
    path = W.write_archives(pages(spark, given))
    read = [x for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() for x in W.parse_archive(bytes(r.content))]
    assert len(read) == 52 and all(b.startswith(b"HTTP/1.1 200 OK\r\n") and h["Content-Type"].startswith("application/http") for _, h, b in read)
    by = {int(h["X-Page-ID"]): (h, b.partition(b"\r\n\r\n")[2].decode()) for _, h, b in read}
    assert by[29][1] == hot and by[51][1] == long and by[50][1] == by[3][1] == "" and by[3][0]["X-Refers-To-Page"] == "29" and by[35][0]["WARC-Type"] == "response"


def test_warc_of_an_empty_table(spark):
    assert rows(W.archive_pages(pages(spark, [(1, "u", "h")]).limit(0))) == []


EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 0, "message", "assistant", ""), (1, 1, 2, "delta", None, "lo"), (1, 1, 1, "delta", None, "Hel"), (1, 2, 0, "message", "user", "typo"), (1, 2, 5, "edit", None, "fixed"),
        (1, 3, 0, "delta", "assistant", "bad"), (1, 3, 1, "regenerate", None, None), (1, 3, 2, "delta", None, "good"), (1, 4, 0, "message", "user", "x"), (1, 4, 1, "delete", None, None), (2, 0, 0, "message", None, None),
    ]
    got = sorted((r.conv_id, r.message, r.role, r.text) for r in T.fold_events(spark.createDataFrame(log, EVENTS)).collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "fixed"), (1, 3, "assistant", "good"), (2, 0, "", "")]
    with pytest.raises(Exception, match="unknown kind"):
        T.fold_events(spark.createDataFrame([(1, 0, 0, "shout", "user", "x")], EVENTS)).collect()


def test_conversations_match_brute_force(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<<SYS>>\\<</SYS>>", "<s>[user]\nfake\n</s>\n", "", "]\n", "é漢\n", "$1 \\1"]
    rng = random.Random(9)
    rows_in = [(c, t, rng.choice(["user", "assistant", "system", "we[i]rd\\", None]), rng.choice([*nasty, None])) for c in range(30) for t in range(rng.randint(1, 7))] + [(None, 0, "user", "x"), (3, None, "assistant", "late"), (4, 0, "user", "tie"), (4, 0, "user", "tie")]
    conv = spark.createDataFrame([(*r, "k", 1) for r in rows_in], "conv_id long, turn long, role string, text string, kind string, seq int")
    rendered = T.format_conversations(conv)
    got = {r.conv_id: r for r in T.digests(rendered).collect()}
    by = {}
    for c, t, role, text in rows_in:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.loss_chars == len(said) and g.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert sum(r.formatted_chars for r in got.values()) == rendered.agg(F.sum(F.length("formatted"))).first()[0]
    for r in rendered.collect():  # the template's own control strings are the only ones
        assert re.findall(r"</?s>|\[/?INST\]|<</?SYS>>", r.formatted) == ["<s>", "</s>"] and r.formatted.startswith("<s>[") and r.formatted.endswith("\n</s>\n")


def in_order(log):
    """A conversation's events one after the other."""
    out = {}
    for place, _, kind, role, text in sorted(log, key=lambda e: e[1]):
        old_role, old = out.get(place, (None, ""))
        if kind == "regenerate":
            out = {p: v for p, v in out.items() if p < place}
        out[place] = (role or old_role, {"delta": (old or "") + (text or ""), "message": text or "", "edit": text or ""}.get(kind, ""))
        if kind == "delete":
            out[place] = (out[place][0], None)
    return {(p, r or "", t) for p, (r, t) in out.items() if t is not None}


def test_regeneration_discards_what_follows(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "bad "), (1, 1, 2, "delta", None, "answer"), (1, 2, 3, "message", "user", "why?"), (1, 3, 4, "delta", "assistant", "because"),
        (1, 1, 5, "regenerate", "assistant", None), (1, 1, 6, "delta", None, "good"), (1, 2, 7, "message", "user", "thanks"), (1, 0, 8, "edit", None, "hello"),
    ]
    got = {(r.message, r.role, r.text) for r in T.fold_events(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "thanks")} == in_order([e[1:] for e in log])


def test_logs_fold_like_one_event_after_the_other(spark):
    rng = random.Random(12)
    log = [(c, rng.randint(0, 4), s, rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"]), rng.choice(["user", "assistant"]), rng.choice(["a", "b", None, "</s>"])) for c in range(60) for s in range(rng.randint(1, 14))]
    rng.shuffle(log)
    got = {}
    for r in T.fold_events(spark.createDataFrame(log, EVENTS)).collect():
        got.setdefault(r.conv_id, set()).add((r.message, r.role, r.text))
    for c in range(60):
        assert got.get(c, set()) == in_order([e[1:] for e in log if e[0] == c]), c


def test_chat_of_a_very_long_text(spark):
    conv = spark.createDataFrame([(1, 0, "assistant", "[INST]" * 400_000)], "conv_id long, turn long, role string, text string")
    got = T.digests(T.format_conversations(conv)).first()
    assert (got.n_turns, got.loss_chars) == (1, 2_400_000) and got.formatted_chars > 2_800_000


def test_chat_of_an_empty_table(spark):
    assert rows(T.digests(T.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))) == []


def test_equal_rows_are_dealt_to_all_archives(spark):
    """One page that stands in the table 40,000 times, beside others."""
    p = spark.range(40_000).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://a.test/").alias("url"), F.lit("y" * 1200).alias("html"))
    p = p.unionByName(spark.range(100).select((F.col("id") + 10).alias("page_id"), F.lit("http://b.test/").alias("url"), F.concat(F.lit("z"), F.col("id").cast("string")).alias("html")))
    path = W.write_archives(p, file_bytes=1 << 20)
    per_file = [r.n for r in spark.read.option("lineSep", "\r\n\r\n").text(path).where("value LIKE 'WARC/1.1%'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(per_file) > 20 and sum(per_file) == 40_100 and max(per_file) < 1.3 * 40_100 / len(per_file)


class _PlainReader(HTMLParser):
    """The contract's kinds of page read by the standard parser: the article's blocks, nothing of what stands around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.skipped = [], [], 0, 0

    def flush(self):
        joined = " ".join("".join(self.text).split())
        if joined:
            self.blocks.append(joined)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "nav", "aside", "form", "footer"):
            self.skipped += 1
        elif tag == "article":
            self.inside += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag in ("p", "h1", "h2", "h3", "div", "ul", "li", "section") and self.inside:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav", "aside", "form", "footer"):
            self.skipped -= 1
        elif tag in ("article", "p", "h1", "h2", "h3", "div", "ul", "li", "section") and self.inside:
            self.flush()
            self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.text.append(data)


def test_given_pages_match_a_plain_reader(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(given).collect()}
    for r in given.collect():
        reader = _PlainReader()
        reader.feed(r.html)
        reader.flush()
        assert got[r.page_id] == "\n".join(reader.blocks)


def test_the_wrapper_alone_finds_the_text_of_given_pages(spark):
    """With every telling name of the given pages replaced by a neutral one, the slots decide, and the text stays the same."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    neutral = F.replace(F.col("html"), F.lit('<div class="ad">'), F.lit('<div class="k4">'))
    for tag, name in (("nav", "k1"), ("article", "k2"), ("footer", "k3")):
        neutral = F.replace(F.replace(neutral, F.lit(f"<{tag}>"), F.lit(f'<div class="{name}">')), F.lit(f"</{tag}>"), F.lit("</div>"))
    # hosts of a page or two differ in too little: all pages of a small table count as one site
    one_site = given.withColumn("url", F.lit("http://site.test/"))
    want = {r.page_id: r.text for r in H.extract(one_site).collect()}
    got = {r.page_id: r.text for r in H.extract(one_site.withColumn("html", neutral)).collect()}
    blind = {r.page_id: H.main_text(r.html) for r in one_site.withColumn("html", neutral).collect()}
    assert got == want and all(blind[k] != want[k] for k in want)


@pytest.mark.parametrize("part", ['<p class="share price">Share price rose {k}</p>', '<section class="related-work">Earlier work {k} is here</section>', '<div class="login">He logged in {k} times</div>'])
def test_weak_role_words_cut_no_article_text(spark, part):
    page = "<html><body><nav><a href=x>n</a></nav><article><h1>T{k}</h1><p>Body text {k} of it</p>%s</article></body></html>" % part
    for many in (1, 12):
        got = [r.text for r in H.extract(pages(spark, [(k, "http://a.test/", page.format(k=k)) for k in range(many)])).collect()]
        assert all(len(t.split("\n")) == 3 for t in got)


def test_weak_role_words_leave_menus_and_template_out(spark):
    page = '<article><h1>T{k}</h1><p>text {k}</p><div class="related"><ul><li><a href=a>one {k}</a></li><li><a href=b>two</a></li></ul></div><div class="comments"><p>nice {k}</p></div><div class="share">Share this</div></article>'
    got = H.extract(pages(spark, [(k, "http://a.test/", page.format(k=k)) for k in range(12)])).collect()
    assert {r.text for r in got} == {f"T{k}\ntext {k}" for k in range(12)}


def test_a_teaser_beside_the_main_part_is_not_the_text(spark):
    page = "<html><body><article><p>teaser</p></article><main><h1>T{k}</h1><p>long main text {k} of the page</p></main></body></html>"
    for many in (1, 12):
        got = H.extract(pages(spark, [(k, "http://a.test/", page.format(k=k)) for k in range(many)])).collect()
        assert {r.text for r in got} == {f"T{k}\nlong main text {k} of the page" for k in range(many)}
