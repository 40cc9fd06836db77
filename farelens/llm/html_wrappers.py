"""HTML extraction by union-free wrapper inference (operator 2).

Pages of one host are aligned into a wrapper, a regular expression without unions. A page's token stream
is read as nested items: text, and elements named by tag, by a hash of their class and by role. Neighbouring items are
folded so that each name stands once in its list: a name that comes again makes its item a repeated group, and
names that come again around others make one repeated group of optional items. An element inside another
of its own name continues the outer one's item, so a name also stands once on its path, at any depth of a page. Two
lists are aligned by their longest common subsequence; what only one has becomes optional. Because
names come from a fixed set, a wrapper has a bound whatever a host sends. A text slot counts its characters,
those inside links, and on how many pages each of its texts occurs.

Each Arrow batch yields one partial wrapper per host, so a host with a third of all pages reaches the
merge as one row per batch; partial wrappers are merged per host and salt, then per host. Texts have no bound, so they
are no part of these: the same pass gives them as rows (host, a slot's place, 64-bit hashes of it and of the text), which are counted
by text, then summed by slot. A finished wrapper takes from them its slots' sums and template texts, which are no more than a page has.

The wrapper then says where the main text is. An item weighs as much as the text in its slots outside links,
each text counted once however many pages repeat it. From the whole page the way goes down to the item with
two thirds of the weight, as long as no title (``h1``) that changes from page to page stays behind; an ``article`` or ``main``
on the way, or below its end with a third of its weight, is the main region. A page is matched against its host's wrapper,
and its main text is what the slots of that region take up, without elements that are menu, header, footer, sidebar,
notice, advert, form, script, style or reader comments, without items that are mostly links on the whole host, and
without text that TEMPLATE_SHARE of the host's pages have in that slot. The last two apply outside ``article`` and
``main`` only; inside them nothing else is left out. Role names (class, id) are hints: an item whose name says menu
or banner, but which has most of the host's text, stays. Inside the main region the weak ones among them (share, related, login and the like)
decide nothing: such an element is text where its slots differ from page to page and are not mostly links.

One rule holds for all sizes: a wrapper speaks as soon as two of its pages differ. Where it cannot (one page, or
copies of one) or where a page has nothing in the region, tags alone decide: ``main``, or the articles in it or beside it if those have the text, else the body.
An article's own header stays, since it has its title. Formulas, drawings' labels and hidden elements are text
like any other.

Defined results: a null html gives an empty text; a page without host has the wrapper of the empty
host; character references are decoded once; tags cut off by the end of a page are dropped; pages of any length and
depth are read whole; if all of a region's text is template (many copies of one page), none is; repeated rows get
equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.sources.staging import materialize
from farelens.llm.tables import table
from farelens.llm.url_filters import url_host

#: A text that this share of a host's pages have in one slot is template text.
TEMPLATE_SHARE = 0.9
#: Texts that a task counts before it gives their counts away as rows; more rows of one text are added up later.
COUNTED_TEXTS = 50_000
#: Hashes of class names that tell elements of one tag apart.
CLASS_BUCKETS = 16
#: Wrappers and hosts' numbers of pages are broadcast up to this many bytes in all; beyond, they are joined by host.
BROADCAST_BYTES = 8 << 20
MERGE_SALTS = 32

# fixed values: element names by their part in a page
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_DROPPED = frozenset("aside button canvas datalist dialog embed footer form head iframe input link menu meta nav noframes noembed noscript object option optgroup script select style template textarea title xmp".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select body html".split())
_KEEPS_P = frozenset("option optgroup caption".split())
_SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars aside "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments "
    "disqus respond replies pagination pager toolbar widget widgets login search copyright contentinfo complementary skip".split()
)
#: Of these, words that an article's own parts are called by, too: inside the main region they decide nothing by themselves.
_WEAK_WORDS = frozenset("share sharing social related recommended recommendations login search signup subscription widget widgets skip".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ROLE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S | re.I)
_WORDS = re.compile(r"[a-z0-9]+")


_CLASSED = frozenset("div section ul ol table".split())
_REGION_TAGS = frozenset("html body div section main article center table tbody tr td".split())
_MENU_TAGS = frozenset("div section ul ol table dl".split())


class Element:
    """A block element: its tag, its name in a wrapper, whether its tag or role sets it aside, its texts (with the characters inside links) and elements in order, and whether a main region or a title is below it."""

    __slots__ = ("children", "has_main", "has_title", "label", "name", "side", "weak")

    def __init__(self, name: str, side: bool = False, label: str = "", weak: bool = False):
        self.name, self.side, self.label, self.weak, self.children, self.has_main, self.has_title = name, side, label or name, weak, [], False, False

    def texts(self) -> Iterator[tuple[str, int]]:
        """All texts below, with their characters inside links."""
        todo = [self]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, tuple):
                    yield c
                else:
                    todo.append(c)


def _named(name: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether tag or role set an element aside, its name in a wrapper, and whether only weak words do."""
    if name in _DROPPED:
        return True, name, False
    if not attributes or name in ("html", "body", "article", "main"):
        return False, name, False
    words = [w for m in _ROLE.finditer(attributes) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())]
    telling = _SIDE_WORDS.intersection(words)
    side = bool(telling)
    known = " ".join(w for w in words if not w.isdigit())
    label = f"{name}~{crc32(known.encode()) % CLASS_BUCKETS}" if known and name in _CLASSED else name
    return side, label + "-" * side, side and telling <= _WEAK_WORDS


def parse(page: str) -> Element:
    """Block elements and the texts between them; inline elements only carry text."""
    root = Element("#root")
    stack, text, links, link_depth = [root], [], [], 0  # pieces of text, those of them inside a link, and where the link was opened
    opened: Counter[str] = Counter()  # names on the stack, so that a tag that closes nothing is not looked for
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                stack[-1].children.append((joined, len("".join("".join(links).split()))))
            text.clear()
            links.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if link_depth:
            links.append(piece)

    def close(k: int) -> None:
        nonlocal link_depth
        while len(stack) > k:
            opened[stack.pop().name] -= 1
        if link_depth > k:
            link_depth = 0  # what the link was opened in is closed

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(entities.unescape(page[at:]))
            break
        if m.start() > at:
            add(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # a closing tag
            if name == "a":
                link_depth = 0
            if opened[name]:
                flush()
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            elif name in _BLOCKS:
                flush()
            continue
        attributes = m[3] if m[2] else m[6]
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            link_depth = len(stack)
        side, label, weak = _named(name, attributes)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name == "textarea" or name in _BLOCKS:
                flush()
            continue
        if name in _VOID and not (name == "hr"):
            continue
        if name not in _BLOCKS and not side:
            continue  # inline: it neither ends a block nor matters to the structure
        flush()
        closed = _CLOSED_BY.get(name)
        if closed:
            for k in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closed) else ():
                if stack[k].name in closed:
                    close(k)
                    break
                if stack[k].name in _SCOPE:
                    break
        elif stack[-1].name == "p" and name in _BLOCKS and name not in _KEEPS_P:
            close(len(stack) - 1)
        if name == "hr":
            continue
        element = Element(name, side, label, weak)
        stack[-1].children.append(element)
        for k in range(len(stack) - 1, -1, -1) if name in ("article", "main") else ():
            if stack[k].has_main:
                break  # so have all around it
            stack[k].has_main = True
        for k in range(len(stack) - 1, -1, -1) if name == "h1" else ():
            if stack[k].has_title:
                break
            stack[k].has_title = True
        stack.append(element)
        opened[name] += 1
    flush()
    return root


# A wrapper is a list of items [name, repeated, optional, content]; the content of "#" (text) is [characters, those inside
# links, {hash of a text: [pages, characters]}], that of an element or of a group "()" is a list of items. Where texts were counted
# as rows, a slot has its template texts only, and behind them what ``_counted`` says of all.
Item = list
TEXT, GROUP = "#", "()"


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _text_hash(text: str) -> str:
    return str(_hash(text))


@lru_cache(4096)
def _place_hash(place: str) -> int:
    """A slot's place is the names on the way to it; each stands once there."""
    return _hash(place)


def _counted(slot: list) -> tuple[int, int, float]:
    """Of a slot's texts: the characters of their pages but the first, the most that one has on all its pages, and the fewest pages of one."""
    if len(slot) > 3:
        return slot[3], slot[4], slot[5]
    counts = slot[2].values()
    return sum((pages - 1) * size for pages, size in counts), max((pages * size for pages, size in counts), default=0), min((pages for pages, _ in counts), default=float("inf"))


def _slot(text: str, linked: int, told: bool = True) -> list:
    chars = len(text) - text.count(" ")
    return [chars, linked, {_text_hash(text): [1, chars]} if told else {}]


def page_items(root: Element, seen: dict[tuple[int, int], int] | None = None) -> list[Item]:
    """The folded items of a page; elements that their tag sets aside are not looked into.

    With ``seen``, texts go there instead of into the slots: the hashes of place and text, with the text's characters.
    """
    top: list[Item] = []
    todo: list[tuple[Iterator, list[Item], Item | None, str]] = [(iter(root.children), top, None, "")]
    path: dict[str, list[Item]] = {}
    places: dict[str, str] = {}
    while todo:
        children, raw, item, place = todo[-1]
        for c in children:
            if isinstance(c, tuple):
                slot = _slot(*c, seen is None)
                if seen is not None:
                    seen[_place_hash(place), _hash(c[0])] = slot[0]
                raw.append([TEXT, False, False, slot])
            elif c.name in _DROPPED:
                raw.append([c.label, False, False, []])
            elif c.label in path:  # continues the item of the element around it that has its name
                todo.append((iter(c.children), path[c.label], None, places[c.label]))
                break
            else:
                path[c.label], places[c.label] = [], f"{place}/{c.label}"
                raw.append([c.label, False, False, path[c.label]])
                todo.append((iter(c.children), path[c.label], raw[-1], places[c.label]))
                break
        else:
            todo.pop()
            if item is not None:
                item[3] = fold(path.pop(item[0]))
    return fold(top)


def _names(item: Item) -> list[str]:
    return [x[0] for x in item[3]] if item[0] == GROUP else [item[0]]


def _merged_slots(a: list, b: list, one_page: bool) -> list:
    texts = a[2] if one_page else dict(a[2])  # a page's slots grow where they are
    for h, (pages, chars) in b[2].items():
        have = texts.get(h)
        texts[h] = [pages, chars] if have is None else [1 if one_page else have[0] + pages, chars]
    return [a[0] + b[0], a[1] + b[1], texts]


def _merge(a: Item, b: Item, one_page: bool) -> Item:
    """Two items of one name in one place; those of one page count its texts once, else pages add up."""
    content = _merged_slots(a[3], b[3], one_page) if a[0] == TEXT else align(a[3], b[3], one_page)
    return [a[0], a[1] or b[1], a[2] or b[2], content]


def _members(item: Item) -> list[Item]:
    return item[3] if item[0] == GROUP else [item]


def fold(items: list[Item], one_page: bool = True) -> list[Item]:
    """Lets each name stand once: repeats become repeated items or a repeated group of optional items.

    Items are of one page, or of two lists that have each name once and no page in common.
    """
    first: dict[str, int] = {}
    reach: dict[int, int] = {}
    for k, item in enumerate(items):
        for name in _names(item):
            start = first.setdefault(name, k)
            if start < k:
                reach[start] = k
    if not reach:
        return items
    out, k = [], 0
    while k < len(items):
        end = reach.get(k)
        if end is None:
            out.append(items[k])
            k += 1
            continue
        j = k
        while j <= end:  # spans that overlap are one
            end = max(end, reach.get(j, end))
            j += 1
        found: dict[str, Item] = {}
        for item in items[k : end + 1]:
            for part in _members(item):
                found[part[0]] = _merge(found[part[0]], part, one_page) if part[0] in found else part
        optional = any(x[2] for x in items[k : end + 1]) and len(found) == 1
        if len(found) == 1:
            name, _, _, content = next(iter(found.values()))
            out.append([name, True, optional, content])
        else:
            out.append([GROUP, True, False, [[n, False, True, c] for n, _, _, c in found.values()]])
        k = end + 1
    return out


def align(a: list[Item], b: list[Item], one_page: bool = False) -> list[Item]:
    """One list of items that covers both; they are of other pages unless ``one_page``."""
    if not a or not b:
        return [[n, r, True, c] for n, r, _, c in a or b]
    na, nb = [frozenset(_names(x)) for x in a], [frozenset(_names(x)) for x in b]
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if na[i] & nb[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if na[i] & nb[j]:
            if a[i][0] == b[j][0] != GROUP:
                out.append(_merge(a[i], b[j], one_page))
            else:
                out += [a[i], b[j]]  # the fold below joins them into one group
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            out.append([a[i][0], a[i][1], True, a[i][3]])
            i += 1
        else:
            out.append([b[j][0], b[j][1], True, b[j][3]])
            j += 1
    out += [[n, r, True, c] for n, r, _, c in [*a[i:], *b[j:]]]
    return fold(out, one_page)


def _find(items: list[Item] | None, name: str) -> Item | None:
    for item in items or ():
        for part in _members(item):
            if part[0] == name:
                return part
    return None


def _parts(items: list[Item]) -> Iterator[tuple[Item, bool]]:
    """The items of a list, those of groups too, and whether each is repeated."""
    for item in items:
        for part in _members(item):
            yield part, item[1] or part[1]


def _tag(name: str) -> str:
    return name.partition("~")[0].rstrip("-")


def _weight(items: list[Item], keep: frozenset[str], sides: bool = False) -> int:
    """Characters outside links, a text of many pages counted once; ``sides``: with those that roles set aside."""
    total = 0
    for part, _ in _parts(items):
        if part[0] == TEXT:
            total += max(0, part[3][0] - part[3][1] - _counted(part[3])[0])
        elif sides or not part[0].endswith("-") or part[0] in keep:
            total += _weight(part[3], keep, sides)
    return total


def _all_items(items: list[Item]) -> Iterator[Item]:
    for part, _ in _parts(items):
        yield part
        if part[0] != TEXT:
            yield from _all_items(part[3])


def _titles(items: list[Item]) -> bool:
    """Whether a title that changes from page to page is below."""
    return any(x[0] == "h1" and any(y[0] == TEXT and y[3][0] > _counted(y[3])[1] for y in _all_items(x[3])) for x in _all_items(items))


def _inner_main(items: list[Item], keep: frozenset[str], least: float, path: tuple[str, ...] = ()) -> tuple[str, ...] | None:
    """The way to the first ``article``, else ``main``, that weighs ``least``."""
    for tag in ("article", "main"):
        todo = [(items, path)]
        while todo:
            here, way = todo.pop()
            for part, _ in _parts(here):
                if part[0] == tag and _weight(part[3], keep) >= least:
                    return (*way, tag)
                if part[0] != TEXT and (not part[0].endswith("-") or part[0] in keep):
                    todo.append((part[3], (*way, part[0])))
    return None


def main_region(items: list[Item], pages: int) -> tuple[tuple[str, ...], frozenset[str]] | None:
    """The way to the main region and the names that keep their place in spite of their role; None if no two pages differ."""
    if not any(x[0] == TEXT and _counted(x[3])[2] < pages for x in _all_items(items)):
        return None
    whole = _weight(items, frozenset(), True)
    keep = frozenset(x[0] for x in _all_items(items) if x[0].endswith("-") and 2 * _weight(x[3], frozenset(), True) > whole)
    way: tuple[str, ...] = ()
    while True:
        weight = _weight(items, keep)
        among = [(p, again) for p, again in _parts(items) if _tag(p[0]) in _REGION_TAGS and (not p[0].endswith("-") or p[0] in keep)]
        best, again = max(among, key=lambda x: _weight(x[0][3], keep), default=(None, False))
        if best is None or 3 * _weight(best[3], keep) < 2 * weight:
            break
        main = best[0] in ("article", "main")
        if not main and (again or any(_titles([x]) for x in items if x is not best)):
            break
        way, items = (*way, best[0]), best[3]
        if main:
            return way, keep
    return _inner_main(items, keep, weight / 3, way) or way, keep


class Wrapper:
    """A host's wrapper at rest: items with the texts that are template, and the way to the main region."""

    def __init__(self, stored: str, pages: int):
        self.items, way, keep = json.loads(stored)
        self.pages, self.way, self.keep = pages, None if way is None else tuple(way), frozenset(keep)
        self.menus: dict[int, bool] = {}

    def is_template(self, text: str, items: list[Item] | None) -> bool:
        slot = _find(items, TEXT)
        return slot is not None and _text_hash(text) in slot[3][2]

    def is_menu(self, item: Item | None) -> bool:
        """Whether most of what the host has in an item stands inside links."""
        if item is None or _tag(item[0]) not in _MENU_TAGS:
            return False
        known = self.menus.get(id(item))
        if known is None:
            slots = [x[3] for x in _all_items(item[3]) if x[0] == TEXT]
            known = self.menus[id(item)] = 3 * sum(x[1] for x in slots) >= 2 * max(1, sum(x[0] for x in slots))
        return known


def closed(items: list[Item], pages: int) -> str:
    """A host's finished wrapper as it is stored."""
    region = main_region(items, pages)
    least = max(2.0, TEMPLATE_SHARE * pages)
    for x in _all_items(items):
        if x[0] == TEXT:
            x[3][2:] = [{h: v for h, v in x[3][2].items() if v[0] >= least}]
    way, keep = region or (None, ())
    return json.dumps([items if region else [], way, sorted(keep)], separators=(",", ":"))


#: Where a walk through a page is in the wrapper: the names on its path with their items.
_Levels = dict


def _step(levels: _Levels, element: Element) -> _Levels:
    """One element down: an element inside one of its own name is in the outer one's place."""
    if element.label in levels:
        at = list(levels)
        return {k: levels[k] for k in at[: at.index(element.label) + 1]}
    inside = levels[next(reversed(levels))]
    item = _find(inside[3], element.label) if inside is not None else None
    return {**levels, element.label: item}


def _matched(root: Element, wrapper: Wrapper) -> Iterator[tuple[Element, _Levels, bool]]:
    """The page's elements that the wrapper's main region takes up, in order, with their place."""
    start: _Levels = {"": ["", False, False, wrapper.items]}
    if not wrapper.way:
        yield root, start, False
        return
    todo = [(root, start)]
    while todo:
        element, levels = todo.pop()
        found = tuple(levels)[1:] == wrapper.way
        if found:
            yield element, levels, not {"article", "main"}.isdisjoint(wrapper.way)
        elif not element.side or element.has_main or element.label in wrapper.keep:
            todo += [(c, _step(levels, c)) for c in reversed(element.children) if not isinstance(c, tuple)]


def _by_tag(root: Element, name: str | None) -> Iterator[Element]:
    """The outermost elements of a tag, in order; without a tag the whole page."""
    todo = [root]
    while todo:
        element = todo.pop()
        if name is None or (element.name == name and not element.side):
            yield element
        elif not element.side or element.has_main:
            todo += [c for c in reversed(element.children) if not isinstance(c, tuple)]


def _mostly_links(texts: list[tuple[str, int]]) -> bool:
    return 3 * sum(linked for _, linked in texts) >= 2 * max(1, sum(len(t) - t.count(" ") for t, _ in texts))


def _weak_stays(c: Element, item: Item | None, wrapper: Wrapper | None) -> bool:
    """Whether an element of the main region that only a weak word sets aside is text: it is not mostly links, and on its host
    its texts are not the same from page to page."""
    texts = list(c.texts())
    if item is None:
        return not _mostly_links(texts)
    slots = [x[3] for x in _all_items(item[3]) if x[0] == TEXT]
    if 3 * sum(x[1] for x in slots) >= 2 * max(1, sum(x[0] for x in slots)):
        return False
    template = set().union(*(x[2] for x in slots)) if slots else set()
    return any(_text_hash(t) not in template for t, _ in texts)


def _left_out(c: Element, inside: bool, keep: frozenset[str], item: Item | None = None, wrapper: Wrapper | None = None) -> bool:
    """A side element stays out, unless its role alone says so and it holds the main region or the article's title, or a weak word alone says so inside it."""
    if c.side:
        return c.name in _DROPPED or not (c.has_main or c.label in keep or (inside and (c.has_title or (c.weak and _weak_stays(c, item, wrapper)))))
    return c.name == "header" and not inside


def _blocks(region: Element, inside: bool, out: list[str], wrapper: Wrapper | None = None, levels: _Levels | None = None) -> None:
    """The texts of a region; with a wrapper, without template text and menus outside ``article`` and ``main``."""
    keep = frozenset() if wrapper is None else wrapper.keep
    todo = [(iter(region.children), inside, levels)]
    while todo:
        children, inside, levels = todo[-1]
        for c in children:
            if isinstance(c, tuple):
                here = None if levels is None or inside else levels[next(reversed(levels))]
                if here is None or not wrapper.is_template(c[0], here[3]):
                    out.append(c[0])
                continue
            below = None if levels is None or (c.side and not c.weak and c.label not in keep and not c.has_main) else _step(levels, c)
            if not _left_out(c, inside, keep, None if below is None else below[c.label], wrapper):
                below = _step(levels, c) if below is None and levels is not None else below
                if below is None or inside or c.name in ("article", "main") or not wrapper.is_menu(below[c.label]):
                    todo.append((iter(c.children), inside or c.name in ("article", "main"), below))
                    break
        else:
            todo.pop()


def _by_tags_alone(root: Element) -> list[str]:
    """Without a wrapper: the page's ``main``, or the articles in it if they have a third of its text; articles outside
    it if they have more text; where there is neither, the page."""

    def read(regions: Iterator[Element], inside: bool = True) -> list[str]:
        out: list[str] = []
        for element in regions:
            _blocks(element, inside, out)
        return out

    weight = lambda texts: sum(map(len, texts))
    mains = list(_by_tag(root, "main"))
    inner, every = read(a for m in mains for a in _by_tag(m, "article")), read(_by_tag(root, "article"))
    best = read(mains)
    if inner and 3 * weight(inner) >= weight(best):
        best = inner
    if weight(every) > weight(best) or not best:
        best = every
    return best or read(iter([root]), False)


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The blocks of the main region, one per line."""
    if not page:
        return ""
    root = parse(page)
    out: list[str] = []
    if wrapper is not None and wrapper.way is not None:
        regions = list(_matched(root, wrapper))
        for element, levels, inside in regions:
            _blocks(element, inside, out, wrapper, levels)
        if not out:  # all of it template
            for element, _, inside in regions:
                _blocks(element, inside, out)
    return "\n".join(out or _by_tags_alone(root))


def _deep() -> None:
    """A wrapper is as deep as there are names; walks over it may be too."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of hosts, and rows with the pages of their slots' texts."""
    _deep()
    for batch in batches:
        found: dict[str, tuple[list[Item], int]] = {}
        texts: dict[tuple[str, int, int], list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen: dict[tuple[int, int], int] = {}
            items = page_items(parse(page.as_py() or ""), seen)
            have = found.get(host)
            found[host] = (items, 1) if have is None else (align(have[0], items), have[1] + 1)
            for (place, text), chars in seen.items():
                texts.setdefault((host, place, text), [0, chars])[0] += 1
            if len(texts) > COUNTED_TEXTS:
                yield _text_batch(texts)
                texts = {}
        yield _text_batch(texts)
        wrappers = _wrapper_batch([(h, w, n) for h, (w, n) in found.items()])
        yield pa.RecordBatch.from_arrays([*wrappers.columns, *(pa.nulls(wrappers.num_rows, pa.int64()) for _ in range(3))], names=_PARTS_NAMES)


def _text_batch(texts: dict[tuple[str, int, int], list[int]]) -> pa.RecordBatch:
    hosts, places, hashes = zip(*texts, strict=True) if texts else ((), (), ())
    pages, chars = zip(*texts.values(), strict=True) if texts else ((), ())
    columns = (pages, places, hashes, chars)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.nulls(len(hosts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=_PARTS_NAMES)


def _wrapper_batch(rows: list[tuple[str, list[Item], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([json.dumps(r[1], separators=(",", ":")) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "wrapper", "n_pages"])


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges wrappers of one host that follow each other, holding one at a time."""
    _deep()
    now: tuple[str, list[Item], int] | None = None
    for batch in batches:
        done = []
        for host, wrapper, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            items = json.loads(wrapper)
            if now is not None and now[0] == host:
                now = (host, align(now[1], items), now[2] + n)
            else:
                if now is not None:
                    done.append(now)
                now = (host, items, n)
        if done:
            yield _wrapper_batch(done)
    if now is not None:
        yield _wrapper_batch([now])


def _tell(items: list[Item], slots: dict[int, dict], place: str = "") -> None:
    """Gives the slots of a wrapper what was counted of their texts."""
    for part, _ in _parts(items):
        if part[0] != TEXT:
            _tell(part[3], slots, f"{place}/{part[0]}")
        elif (known := slots.get(_place_hash(place))) is not None:
            part[3][2:] = [{str(t["text"]): [t["pages"], t["chars"]] for t in known["template"]}, known["again"], known["most"], known["fewest"]]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _deep()
    for batch in batches:
        for k in range(batch.num_rows):  # one wrapper at a time
            host, wrapper, n, slots = (c[k].as_py() for c in batch.columns)
            items = json.loads(wrapper)
            _tell(items, {s["place"]: s for s in slots or ()})
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([closed(items, n)], pa.string()), pa.array([n], pa.int64())], names=["host", "wrapper", "n_pages"])


_WRAPPERS = "host string, wrapper string, n_pages long"
_PARTS = f"{_WRAPPERS}, place long, text long, chars long"
_PARTS_NAMES = ["host", "wrapper", "n_pages", "place", "text", "chars"]


def counted_slots(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``host, slots``: what all pages of a host say of each slot's texts, and the texts that are template there.

    ``texts`` has rows of (host, place, text) with pages and characters, ``pages`` each host's number of pages.
    """
    each = texts.groupBy("host", "place", "text").agg(F.sum("n_pages").alias("pages"), F.max("chars").alias("chars"))
    size = pages.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0)).alias("n")).first()["n"]
    known = each.join(F.broadcast(pages) if size <= BROADCAST_BYTES else pages, "host")
    template = F.when(F.col("pages") >= F.greatest(F.lit(2.0), F.col("of") * TEMPLATE_SHARE), F.struct("text", "pages", "chars"))
    slots = known.groupBy("host", "place").agg(F.sum((F.col("pages") - 1) * F.col("chars")).alias("again"), F.max(F.col("pages") * F.col("chars")).alias("most"), F.min("pages").alias("fewest"), F.collect_list(template).alias("template"))
    return slots.groupBy("host").agg(F.collect_list(F.struct("place", "again", "most", "fewest", "template")).alias("slots"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, n_pages``: one wrapper per host over all its pages."""
    given = pages.select(url_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    parts = materialize(given.mapInArrow(_partial, _PARTS), "wrapper-parts")
    partial = parts.where("wrapper IS NOT NULL").select("host", "wrapper", "n_pages")
    texts = parts.where("wrapper IS NULL").select("host", "place", "text", "n_pages", "chars")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_SALTS))).repartition("host", "salt").sortWithinPartitions("host", "wrapper").select("host", "wrapper", "n_pages").mapInArrow(_merge_sorted, _WRAPPERS)
    merged = salted.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge_sorted, _WRAPPERS)
    slots = counted_slots(texts, partial.groupBy("host").agg(F.sum("n_pages").alias("of")))
    return merged.join(slots, "host", "left").select("host", "wrapper", "n_pages", "slots").mapInArrow(_close, _WRAPPERS)


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    wrappers = materialize(infer_wrappers(pages), "wrappers") if wrappers is None else wrappers
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 16), F.lit(0)).alias("n")).first()["n"]
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", url_host(F.col("url")))
    joined = given.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        parsed: dict[str | None, Wrapper | None] = {None: None}
        for batch in batches:
            texts = []
            for page, wrapper, n in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                wrapper = wrapper.as_py()
                if wrapper not in parsed:
                    if len(parsed) > 1000:
                        parsed = {None: None}
                    parsed[wrapper] = Wrapper(wrapper, n.as_py())
                texts.append(main_text(page.as_py(), parsed[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "wrapper", "n_pages").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
