"""Small tables with every kind of odd row."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, nid long, _h string, words int, key string, _n string, _key string, items string"
LOREM = "the quick brown fox jumps over the lazy dog while seven small birds sing in old green trees near running water every cool morning "


def odd_docs(spark, extra=()):
    """Nulls in every column, empty, blank, long and repeated texts, and columns with clashing names."""
    texts = [
        (1, LOREM * 3), (2, LOREM * 3), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "ÄÖÜ straße 漢字 " * 40), (8, "word " * 60_000), (9, LOREM * 3 + "tail"), (9, LOREM * 3 + "tail"),
        (None, LOREM), (None, None), (10, "a\x00b c\x85d e f"), *extra,
    ]
    rows = [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, len(t) if t else None, "x", k, None, 5, "k", "n", "kk", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]
