"""Tables that hold every awkward case, with extra columns whose names operators might use themselves."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, bucket int, id long, th long, g long, position double, kept string, n_removed int, ord int, word string, _text string, url string, node long, fp string, row long, label int, score double"
LONG = "\n".join(f"line {i % 977} of a very long text with password = hunter{i % 91}xyz and more" for i in range(6000))


def pad(rows):
    return [(i, t, "en", s, len(t) if t is not None else None, "k", 1, 1, 1, 1, 1, 0.5, "x", 9, 1, "w", "t", "u", 1, "f", 1, 1, 0.1) for i, t, s in rows]


def awkward(spark):
    passage = "\n".join(f"shared line number {k} that several documents hold word for word" for k in range(12))
    rows = [
        (None, None, None), (None, "an id that is null", "a"), (1, "", "a"), (2, None, "b"), (3, "   \n\t ", None), (4, LONG, "a"), (5, LONG, "b"),
        (6, "twice the same row " * 9, "b"), (6, "twice the same row " * 9, "b"), (7, passage + "\nown end", "c"), (8, "own start\n" + passage, "c"), (9, "é ü 漢字 😀 ﬁn", "ß"), (10, "one", "a"), (11, "one two", "a"), (12, "one two three", "a"),
    ]
    return spark.createDataFrame(pad(rows), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, rows):
    """Documents of ``(id, text)``."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
