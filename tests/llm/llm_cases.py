"""Rows every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, rank int, block long, score double, kept string"


def frame(spark, rows):
    """(doc_id, text, lang) rows as a documents table with further columns whose names operators use inside."""
    full = [(i, t, lang, f"s{(i or 0) % 2}", len(t or ""), "w", 1, 2, 0.5, "k") for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS)


EDGES = [
    (1, None, "en"),
    (2, "", None),
    (3, " \t\n ", "en"),
    (4, "one", None),
    (5, "the same text twice with a few words", "en"),
    (5, "the same text twice with a few words", "en"),
    (6, "the same text twice with a few words", "de"),
    (None, "a row without an id, but with text", "en"),
    (7, "été café naïve 日本語 🙂   x" * 3, "fr"),
    (8, "long " * 20_000, "en"),
    (9, "1234 5678 -- !!", "en"),
]
