"""Folders of small tables: odd rows in every table, and tables without rows."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, h string, n int, base string, k int, sig string, pretoken string, _h string, rank string"
LABELS = "doc_id long, quality int, toxic int, y string, label string"
BENCHMARK = "item_id long, text string, key string, windows string"
PAGES = "page_id long, url string, html string, n string, sha string, salt string, payload string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, rep string, d string, ids string"
SCHEMAS = {"documents": DOCUMENTS, "labels": LABELS, "benchmark": BENCHMARK, "pages": PAGES, "embeddings": EMBEDDINGS}

LONG = "plain words of a very long text. " * 20_000
#: doc_id and text: nulls, empties, repeats, ties, one long text, signs, other scripts, special strings.
TEXTS = [
    (None, None), (None, "words without a number"), (None, "words without a number"),
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two Words"), (6, LONG),
    (7, "the same row"), (7, "the same row"), (8, "the same row"), (8, "another text under the same id"),
    (9, "日本語 текст ελληνικά \U0001f600 é"), (10, "!!! ??? ... 12345"), (11, "<|endoftext|> inside <|startoftext|> and <s> </s> <unk>"),
    (12, "line\n\nline\r\nline\x00\x0b\x1c ﻿▁x"), (13, "A" * 30_000), (-5, "a negative number as the name"),
]


def write(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_rows():
    pad = lambda row, n: (*row, *[None] * (n - len(row)))
    return {
        "documents": [pad((i, t, "en" if k % 3 else None, None, None, "x", "y"), 15) for k, (i, t) in enumerate(TEXTS)],
        "labels": [pad(r, 5) for r in [(1, 1, 0), (4, None, None), (5, 0, 1), (5, 1, 0), (7, 1, 0), (None, 0, 1), (99, 0, 0)]],
        "benchmark": [pad(r, 4) for r in [(1, None), (2, ""), (3, "one"), (None, "an item that has no name but a text of ten words"), (4, "plain words of a very long text. plain words of a very long text."), (4, "plain words of a very long text. plain words of a very long text.")]],
        "pages": [pad(r, 7) for r in [(None, "u", None), (None, "u", "x" * 2000), (1, None, "x" * 2000), (2, "u", "x" * 2000), (2, "u", "x" * 2000), (3, "u", "short"), (4, "u", "short"), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 20_000), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 20_000)]],
        "embeddings": [pad(r, 7) for r in [(None, [1.0, 2.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (100, [1.0, 2.0]), (101, [-3.0, 4.0])]],
    }


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), odd_rows)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})
