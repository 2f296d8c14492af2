"""Small inputs with the awkward rows that every operator must take."""

import re

import pandas as pd

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"long{k % 7919}" for k in range(60_000))
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (None, "no id at all but some words here", "en", "a", 32),
    (4, "Same text in two rows that repeat", "de", "b", 33),
    (4, "Same text in two rows that repeat", "de", "b", 33),
    (5, LONG, "en", "a", len(LONG)),
    (6, "é ü   x\x1fy 'twas don't\n\n  two  blanks \r\n", "fr", "b", 40),
]


def awkward(spark, rows=AWKWARD):
    """The rows above, with extra columns whose names operators might use themselves."""
    frame = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("node", "key", "block", "shard", "size", "score", "row", "held_out", "text_key", "component_id", "found_id", "found_key", "_id_and_text", "document", "own_key", "copy"):
        frame = frame.selectExpr("*", f"'{name}' AS {name}")
    return frame


def empty(spark, schema=DOCUMENTS):
    return spark.createDataFrame([], schema)


def small_documents() -> pd.DataFrame:
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def words(text, lower=True):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)
