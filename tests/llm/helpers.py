"""Small fixtures with the awkward rows every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, pos int, chunk string, ids int, node int"


def frame(spark, rows, parts=3):
    """documents-like rows of (doc_id, text), with extra columns whose names clash with inner ones."""
    full = [(d, t, "en", "s", None if t is None else len(t), "x", 1, "y", 2, 3) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


LOWER = {c: c + 32 for c in range(65, 91)}
AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "no id here at all"), (7, "é ü — ß " * 30), (8, "a" * 5000), (9, "word " * 4000)]
