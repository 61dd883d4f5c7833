"""A small table with every awkward case, and columns named like the operators' own."""

LONG = "lorem ipsum dolor " * 3 + " ".join(f"wörd{k}x" for k in range(25_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear", "en", "a"),
    (2, None, None, None),
    (None, "No id here but some words to look at and to count up", "en", "a"),
    (3, "", "fr", "b"),
    (4, " \n\t ", "fr", "b"),
    (5, LONG, None, "b"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear", "en", None),
    (6, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear", "en", None),
    (7, "single", "de", "c"),
    (8, "The quick brown fox jumps over the lazy dog and runs away from the very angry cat", "en", "c"),
    (9, "same same same same same same same same same same same same same same same", "en", "c"),
    (10, "emoji 🎉🎉 漢字 and\r\nlines\r\n\r\nend", "zz", "a"),
]
EXTRA = ["tokens", "n_tokens", "score", "keep", "rate", "copies", "key", "row", "set_id", "jaccard", "rank", "packed", "offsets", "round_trip", "positive", "x", "k", "_text"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def docs(spark, extra=True, rows=ROWS):
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *(["e"] * len(EXTRA))) for r in rows], SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return docs(spark).limit(0)
