"""Fill-in-the-middle transformation of documents (operator 13).

A text is cut at two hashed places of its code points into prefix, middle and suffix, which are put in the order that
a form asks for, each behind its sentinel; ``restored_text`` gives the exact text back from output and form.

One Aho-Corasick automaton holds the sentinels and the ASCII characters that end or begin a word (white space). A scan
reports only where they stand. Between two such events nothing changes its class, so a gap's units come by arithmetic:
as many code points as it is long, one word if it is not empty. ``Events`` keeps the events' places and running
counts, and the rank of any place (how many words begin before it) is a binary search among them, so that a text is
never walked unit by unit in Python.

Defined results: a null text is an empty one; empty texts and texts that hold a sentinel stay plain; a null id hashes as an
empty one; rows that repeat are transformed alike, each for itself; a text of any length is cut whole; an empty
table gives an empty result; extra columns are ignored. Sentinels must be distinct, not empty, and none may overlap
another or itself, so that an output is read in one way only. One pass, no shuffle; a task holds one
slice of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm import textnum as tn
from farelens.llm.tables import table

WHITE = "\t\n\x0b\x0c\r "
_SPACE, _SENTINEL = 0, 1


@dataclass(frozen=True)
class MiddleRules:
    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    fim_percent: int = 90
    spm_percent: int = 20

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def checked(self) -> MiddleRules:
        """Raises if an output could be read in two ways."""
        three = self.sentinels
        if len(set(three)) < 3 or not all(three):
            raise ValueError("sentinels must be distinct and not empty")
        for a in three:
            for b in three:
                if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")
        return self


def automaton(rules: MiddleRules) -> ahocorasick.Automaton:
    """Sentinels and the ASCII characters at which a word begins or ends."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for char in WHITE:
        found.add_word(char, _SPACE)
    for sentinel in rules.sentinels:
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


class Events:
    """Where a text's words end, found in one scan, with the number of words before each place."""

    def __init__(self, text: str, scan: ahocorasick.Automaton):
        # place and kind in one number, so that a scan needs no list of pairs
        events = np.fromiter((2 * end + kind for end, kind in scan.iter(text)), dtype=np.int64)
        self.holds_sentinel = bool((events & 1).any())
        self.units = len(text)
        self._spaces = (events >> 1)[(events & 1) == _SPACE]
        gaps = np.diff(self._spaces, prepend=-1) - 1  # code points between two spaces: a word if there are any
        self._words = np.concatenate(([0], np.cumsum(gaps > 0)))

    def words_before(self, place: int) -> int:
        """Words that begin before the code point ``place``."""
        k = int(np.searchsorted(self._spaces, place))
        last = int(self._spaces[k - 1]) if k else -1
        return int(self._words[k]) + (last + 1 < place)


def transform_one(doc_id: int | None, text: str, rules: MiddleRules, scan: ahocorasick.Automaton) -> tuple:
    """form, output, units of prefix and middle, words of the text and words that begin in prefix and middle."""
    digest = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    events = Events(text, scan)
    n = events.units
    if not text or events.holds_sentinel or h3 % 100 >= rules.fim_percent:
        return "plain", text, None, None, events.words_before(n), None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    before, inside = events.words_before(first), events.words_before(second)
    if h4 % 100 < rules.spm_percent:
        form, output = "spm", f"{rules.suffix}{suffix}{rules.prefix}{prefix}{rules.middle}{middle}"
    else:
        form, output = "psm", f"{rules.prefix}{prefix}{rules.suffix}{suffix}{rules.middle}{middle}"
    return form, output, first, second - first, events.words_before(n), before, inside - before


def fill_in_middle(docs: DataFrame, rules: MiddleRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n (code points), form, prefix_chars, middle_chars, n_words, prefix_words, middle_words, output.

    Words are counted where they begin; the four counts of parts are null for plain texts.
    """
    rules = (rules or MiddleRules()).checked()
    longs = ("prefix_chars", "middle_chars", "n_words", "prefix_words", "middle_words")
    schema = f"{id_col} long, n long, form string, " + ", ".join(f"{c} long" for c in longs) + ", output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(rules)
        for batch in batches:
            ids = batch.column(0)
            for part in tn.slices(batch.column(1)):
                here = ids.slice(part.lo, len(part))
                texts = [part.text(k).decode() for k in range(len(part))]
                made = [transform_one(i, t, rules, scan) for i, t in zip(here.to_pylist(), texts, strict=True)]
                form, output, *counts = zip(*made, strict=True)
                arrays = [here, pa.array([len(t) for t in texts], pa.int64()), pa.array(form), *(pa.array(c, pa.int64()) for c in counts), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n", "form", *longs, "output"])

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return rows.mapInArrow(run, schema)


def restored_text(output: Column | str, form: Column | str, rules: MiddleRules | None = None) -> Column:
    """The text that an output of a form was made of."""
    rules = (rules or MiddleRules()).checked()
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    quoted = ("".join("\\" + c if c in r"\.[]{}()*+-?^$|<>=!#&" else c for c in s) for s in rules.sentinels)
    parts = F.split(output, "|".join(quoted), -1)  # nothing, then the three parts in the form's order
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("restored", restored_text("output", "form"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"), "n_words", "prefix_words", "middle_words")


def _oracle(rules: MiddleRules) -> str:
    p, s, m = rules.sentinels
    h = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    words = lambda x: f"len(regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+'))"
    cut = lambda x: f"CASE WHEN form <> 'plain' THEN {x} END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{rules.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, length(text) AS n, {h(0)} % (length(text) + 1) AS a, {h(1)} % (length(text) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR {h(2)} % 100 >= {rules.fim_percent} THEN 'plain' WHEN {h(3)} % 100 < {rules.spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, substr(text, 1, least(a, b)) AS prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(text, greatest(a, b) + 1) AS suffix FROM c)
SELECT doc_id, n, form, {cut('least(a, b)')} AS prefix_chars, {cut('greatest(a, b) - least(a, b)')} AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256, {words('text')} AS n_words, {cut(words('prefix'))} AS prefix_words, {cut(f"{words('prefix || middle')} - {words('prefix')}")} AS middle_words
FROM x
"""


ORACLE_SQL = _oracle(MiddleRules())
