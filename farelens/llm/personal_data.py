"""Personal data in whole texts: fixed expressions, and what their findings teach (operator 11).

Base spans are the leftmost, non-overlapping matches of one expression for each kind that pass the kind's check (parts
of an address, digits and checksum of a card, digits of a phone number). They seed a bootstrap:

* Every seed induces lexical patterns: its own shape (digits as 0, runs of letters as a), the word before it, the one
  before that, and the word after it.
* Looser expressions give candidates that the base rules missed (a card or phone number that a longer failing match swallowed, a
  number without its plus, an address written with "(at)", an address of hexadecimal groups); a candidate has to pass its
  kind's check and to lie outside all base spans.
* Patterns and instances (a kind and its bare digits or letters) are a graph, scored in rounds. A pattern's
  confidence is the number of its mentions of known instances over all its mentions; for a word that is all
  places where the whole corpus has the word. Patterns of at least ``least_instances`` known instances and
  ``least_confidence`` are kept; an instance's score is the chance that one of its kept patterns is right;
  instances of at least ``least_score`` are known in the next round.
* Candidates whose instance is known in the end are added to the base spans.

All of it is DataFrame functions. A text is split at a kind's matches once, so places are sums of gap lengths and no
text is searched from its start twice; what leaves the scan are mentions with at most ``window`` characters of context
on each side. Counts of patterns and words are combined map-side; words of the corpus are counted only where a pattern needs
them; joins with instances and patterns that hold very many rows go through ``joins.join_unique``.

The expressions are written so that Java's engine takes linear time: repeated groups are possessive, and runs are
entered at their beginning or where the last match ended, which finds the same matches.

Defined results: a null text is an empty one; texts without matches give a row with no span; rows that repeat are
found in alike, each for itself, and count as mentions of the same instances; a null id stays null; texts of any length are
taken whole; spans of one start are in the order of the kinds; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm.joins import join_unique
from farelens.llm.tables import table
from farelens.sources.staging import materialize

#: The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base expressions, in the form that takes linear time.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser expressions: what may be an entity of the kind where its patterns say so.
LOOSE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?)(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z]|\.[0-9])",
}
#: White space and words in expressions, and brackets and marks that may stand between a word and an entity.
_WHITE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_OPENING, _CLOSING = r"[(\[<\"']*", r"[)\]>\"'.,;:!?]*"
SIDES = ("shape", "before", "second", "after")
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "123456789"


@dataclass(frozen=True)
class BootstrapRules:
    window: int = 64
    rounds: int = 3
    least_instances: int = 3
    least_confidence: float = 0.5
    least_score: float = 0.5
    #: Words of at most so many patterns are broadcast to the corpus; beyond, the corpus's words are counted first and joined.
    broadcast_words: int = 50_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the checksum."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th digit from the right
    weighed = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + weighed(i))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _passes(kind: Column, found: Column) -> Column:
    """The check of a kind; an address of hexadecimal groups has none beyond its expression."""
    part = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255).otherwise(F.lit(False))
    return (
        F.when(kind == "email", True).when(kind == "ip", F.contains(found, F.lit(":")) | F.forall(F.split(found, r"\."), part))
        .when(kind == "card", _luhn(_digits(found))).when(kind == "phone", F.length(_digits(found)).between(9, 15)).otherwise(False)
    )


def matches(docs: DataFrame, rules: BootstrapRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every expression in one scan, and one row with a null ``kind`` for each document.

    _row (the document's place), id, kind, base (by the base expression), at (its number in the document), step (length of the
    gap before it and of itself), found, left, right. A context that begins or ends with the text has a space there.
    """
    given = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    scans = [(kind, base, rx) for base, of in ((True, BASE), (False, LOOSE)) for kind, rx in of.items()]
    needed = {kind: F.regexp_like("_text", F.lit("[0-9]")) for kind in KINDS} | {"email": F.contains("_text", F.lit("@")) | F.regexp_like("_text", F.lit(r"[(\[]at[)\]]")), "loose ip": F.contains("_text", F.lit(":")) & F.regexp_like("_text", F.lit("[0-9]"))}
    needs = lambda kind, base: needed[kind if base or f"loose {kind}" not in needed else f"loose {kind}"]
    nothing = F.array().cast("array<string>")
    split = given.select(
        id_col, "_row",
        *(F.when(needs(kind, base), F.split("_text", rx, -1)).otherwise(nothing).alias(f"_gaps{k}") for k, (kind, base, rx) in enumerate(scans)),
        *(F.when(needs(kind, base), F.regexp_extract_all("_text", F.lit(rx), 0)).otherwise(nothing).alias(f"_hits{k}") for k, (kind, base, rx) in enumerate(scans)),
    )
    edge, kinds = rules.window, "array<struct<kind:string,base:boolean,at:int,step:bigint,found:string,left:string,right:string>>"

    def of(k: int, kind: str, base: bool) -> Column:
        gaps, hits = f"_gaps{k}", f"_hits{k}"
        zipped = F.arrays_zip(hits, gaps, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))))  # a gap more than hits
        hit, gap, after = (lambda z, i=i: z.getField([hits, gaps, "2"][i]) for i in range(3))
        one = lambda z, i: F.struct(
            F.lit(kind), F.lit(base), i, (F.length(gap(z)) + F.length(hit(z))).cast("long"), hit(z),
            F.when(F.length(gap(z)) < edge, F.concat(F.lit(" "), gap(z))).otherwise(F.right(gap(z), F.lit(edge))),
            F.when(F.length(after(z)) < edge, F.concat(after(z), F.lit(" "))).otherwise(F.left(after(z), F.lit(edge))),
        )
        return F.transform(F.filter(zipped, lambda z: hit(z).isNotNull()), one).cast(kinds)

    document = F.array(F.struct(*(F.lit(None) for _ in range(7)))).cast(kinds)
    return split.select("_row", id_col, F.explode(F.concat(document, *(of(k, kind, base) for k, (kind, base, _) in enumerate(scans)))).alias("m")).select("_row", id_col, "m.*")


def _instance(kind: Column, found: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, letters of addresses."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(found, _UPPER, _UPPER.lower()), r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    return F.when(kind.isin("card", "phone"), _digits(found)).otherwise(plain)


def _zeroed(text: Column) -> Column:
    """Lower case, all digits alike: the form in which words and shapes are compared."""
    return F.translate(text, _UPPER + _DIGITS, _UPPER.lower() + "0" * len(_DIGITS))


def mentions(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base spans, and candidates outside all of them: _row, id, kind, base, start, end, found, inst and the words of SIDES."""
    # a window of a document's own matches; they come back in one row of the result
    end = F.sum("step").over(Window.partitionBy("_row", "kind", "base").orderBy("at"))
    placed = matched.where("kind IS NOT NULL").withColumn("end", end).withColumn("start", F.col("end") - F.length("found")).where(_passes(F.col("kind"), F.col("found")))
    document = Window.partitionBy("_row")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(document.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    next_start = F.min(F.when(F.col("base"), F.col("start"))).over(document.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0))
    free = placed.withColumns({"_reached": reached, "_next": next_start}).where("base OR ((_reached IS NULL OR _reached <= start) AND (_next IS NULL OR _next >= end))")
    word = lambda side, rx: F.nullif(F.regexp_extract(_zeroed(F.col(side)), rx, 1), F.lit(""))
    return free.select(
        "_row", id_col, "kind", "base", "start", "end", "found", _instance(F.col("kind"), F.col("found")).alias("inst"),
        F.regexp_replace(_zeroed(F.col("found")), "[a-z]+", "a").alias("shape"), word("left", f"{_WHITE}({_WORD}){_WHITE}+{_OPENING}$").alias("before"),
        word("left", f"{_WHITE}({_WORD}){_WHITE}+{_WORD}{_WHITE}+{_OPENING}$").alias("second"), word("right", f"^{_CLOSING}{_WHITE}+({_WORD}){_WHITE}").alias("after"),
    )


def pattern_edges(found: DataFrame) -> DataFrame:
    """The graph: kind, side, word, inst and the number of mentions ``n`` that join them."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in SIDES))
    return found.select("kind", "inst", F.explode(sides).alias("p")).where("p.word IS NOT NULL").groupBy("kind", F.col("p.side").alias("side"), F.col("p.word").alias("word"), "inst").agg(F.count("*").alias("n"))


def corpus_counts(docs: DataFrame, edges: DataFrame, rules: BootstrapRules, text_col: str = "text") -> DataFrame:
    """word, places: how often the corpus has each word that some pattern with enough instances asks for."""
    asked = edges.where("side <> 'shape'").groupBy("kind", "side", "word").agg(F.count("*").alias("k")).where(F.col("k") >= rules.least_instances).select("word").distinct()
    asked = materialize(asked, "pattern-words")
    words = docs.select(F.explode(F.split(_zeroed(F.col(text_col).cast("string")), f"{_WHITE}+")).alias("word"))
    if asked.count() <= rules.broadcast_words:
        return words.join(F.broadcast(asked), "word", "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    return words.groupBy("word").agg(F.count("*").alias("places")).join(asked, "word", "left_semi")


def bootstrap(edges: DataFrame, seeds: DataFrame, places: DataFrame, rules: BootstrapRules) -> tuple[DataFrame, DataFrame]:
    """Known instances (kind, inst) and kept patterns (kind, side, word, confidence) after the last round."""
    known, patterns = seeds, None
    for _ in range(rules.rounds):
        told = join_unique(edges, known.withColumn("_known", F.lit(True)), ["kind", "inst"], how="left").withColumn("_known", F.coalesce("_known", F.lit(False)))
        counted = told.groupBy("kind", "side", "word").agg(F.sum(F.when(F.col("_known"), F.col("n")).otherwise(0)).alias("hits"), F.count_if("_known").alias("instances"), F.sum("n").alias("mentions"))
        enough = counted.where(F.col("instances") >= rules.least_instances).join(places, "word", "left")
        of_all = F.when(F.col("side") == "shape", F.col("mentions")).otherwise(F.greatest("mentions", F.coalesce("places", F.lit(0))))
        patterns = materialize(enough.select("kind", "side", "word", F.round(F.col("hits") / of_all, 6).alias("confidence")).where(F.col("confidence") >= rules.least_confidence), "patterns")
        wrong = F.exp(F.sum(F.ln(1.0 - F.least("confidence", F.lit(0.999)))))
        scored = join_unique(edges, patterns, ["kind", "side", "word"]).groupBy("kind", "inst").agg(F.round(1.0 - wrong, 6).alias("score"))
        known = materialize(scored.where(F.col("score") >= rules.least_score).select("kind", "inst").unionByName(seeds).distinct(), "known")
    return known, patterns


def personal_data(docs: DataFrame, rules: BootstrapRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, place of the kind, end, kind, found, base) by start and kind."""
    rules = rules or BootstrapRules()
    matched = materialize(matches(docs, rules, id_col, text_col), "matches")
    found = materialize(mentions(matched, id_col), "mentions")
    edges = materialize(pattern_edges(found), "pattern-edges")
    seeds = found.where("base").select("kind", "inst").distinct()
    known, _ = bootstrap(edges, seeds, materialize(corpus_counts(docs, edges, rules, text_col), "places"), rules)
    new = join_unique(found.where("NOT base"), known, ["kind", "inst"])
    every = found.where("base").unionByName(new.select(found.columns)).select("_row", id_col, "start", "end", "kind", "found", "base")
    every = every.unionByName(matched.where("kind IS NULL").select("_row", id_col), allowMissingColumns=True)
    place = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", place.alias("place"), "end", "kind", "found", "base"))
    return every.groupBy("_row", id_col).agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("_row")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_found"))
