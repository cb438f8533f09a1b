"""Frames of documents for the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, g long"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with inner ones; rows (doc_id, text)."""
    full = [(d, t, None if i % 3 else "en", None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), 0.5, "x", 7) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)
