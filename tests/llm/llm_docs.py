"""Small tables that the tests of this folder share."""

#: Columns whose names an operator might use itself.
CLASHING = [
    "id", "_id", "_text", "text_", "score", "kept", "fp", "fingerprint", "component_id", "words", "key",
    "kind", "n", "batch", "part", "doc", "hash", "lines", "deleted_lines", "emptied", "piece", "bucket", "spans",
]


def docs_of(spark, rows, extra=()):
    names = ", ".join(f"`{c}` string" for c in extra)
    schema = "doc_id bigint, text string" + (", " + names if extra else "")
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


LONG = " ".join(f"word{k % 977}" for k in range(60_000))

ODD = [
    (1, "One two three.\nfour five\n"), (1, "One two three.\nfour five\n"), (2, None), (None, "no id here"),
    (None, None), (3, ""), (4, " \t\n\x0b "), (5, "x" * 5_000), (6, LONG), (7, "Grün ñandú 日本 😀"), (8, "Grün ñandú 日本 😀"),
    (9, "a@b.co +1 (437) 555-0689 10.0.0.1 4111 1111 1111 1111"), (-3, "negative id"), (1, "another text with this id"),
]
