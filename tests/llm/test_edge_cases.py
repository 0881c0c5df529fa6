"""Every query and the pipeline on rows with nulls, empty and very long texts, repeated rows, clashing columns, and on empty tables."""

import pytest

import __spark_entry__ as entry

ROWS = [
    (1, "x " * 100_000, "en", 1), (2, None, None, None), (None, "hello world the of and to in a is that", "en", 3), (4, "", "de", 0), (4, "", "de", 0), (5, " \n\n ", None, 0),
    (6, "\x00   ﻿ a", "fr", 1), (7, "word" * 20_000, "es", 5), (8, "hello world the of and to in a is that", "en", 3), (8, "hello world the of and to in a is that", "en", 3),
]
CLASHING = ("row", "ord", "key", "kept", "n_tokens", "ids", "answers", "gone", "id", "class_id", "n_words", "lines")
NAMES = sorted(n for n in entry.queries() if n == "pipeline" or (n.startswith("op") and n[2].isdigit()))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    kind = "doc_id long, text string, lang string, n_chars long, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, "s", *CLASHING) for r in ROWS]
    vectors = [(1, [1.0, 2.0], "a"), (2, None, "b"), (None, [1.0, 2.0], "c"), (3, [1.0, 2.0], "d"), (3, [1.0, 2.0], "d"), (4, [], "e")]
    for folder, docs, vecs in ((full, rows, vectors), (empty, [], [])):
        spark.createDataFrame(docs, kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(vecs, "vec_id long, embedding array<float>, kept string").write.parquet(f"{folder}/embeddings.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, folders, name):
    got = entry.queries()[name](spark, folders[0]).collect()
    if name in ("op8_packing", "pipeline"):
        ids = {r["doc_id"] for r in got}
        assert ids == ({r[0] for r in ROWS} if name == "op8_packing" else {8, None}) and all(r["length"] > 0 for r in got)
    else:
        assert len(got) == (6 if name.startswith("op10_") else len(ROWS))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, folders, name):
    assert entry.queries()[name](spark, folders[1]).count() == 0
