import json

from hirameki import cli, sources
from hirameki.operators import review, training
from hirameki.review_server import ReviewStore


def document(path, rows, **root):
    path.write_text(json.dumps({**root, "annotations": rows}), encoding="utf-8")
    return str(path)


def test_a_saved_review_keeps_unknown_fields(spark, tmp_path):
    rows = [
        {"id": 1, "image_id": 4, "caption": "a", "lm_ppl": 2.5, "note": {"x": [1, None]}, "odd key": "v"},
        {"id": 2, "caption": None, "lm_ppl": None, "reviewed": "yes", "n": 3},
        {"id": 3, "caption": "c", "missing_tokens": ["t"], "lm_ppl": 7},
    ]
    base = review.opened(sources.annotations(spark, document(tmp_path / "b.json", rows)))
    assert dict(base.dtypes)["lm_ppl"] == "double" and dict(base.dtypes)["note"] == "string"
    merged = cli.merged_fields(spark, document(tmp_path / "m.json", [{"id": 3, "caption": "other", "fluent": True}, {"id": 2, "caption": "new", "lm_ppl": 1.5}]))
    store = ReviewStore(review.merge_scores(base, merged, "_place"), {"info": 1}, str(tmp_path / "out.json"))
    assert store.fields == ["fluent", "lm_ppl", "n", "note", "odd key"]
    assert [x["id"] for x in store.items(0, 5, "lm_ppl")["items"]] == [2, 1, 3]
    assert store.add(1, caption="A") and store.add(3, reviewed=True)
    store.save()
    one, two, three = json.loads((tmp_path / "out.json").read_text())["annotations"]
    assert one == {**rows[0], "caption_replaced": "A"}
    assert two == {**rows[1], "caption": "new", "lm_ppl": 1.5}
    assert three == {**rows[2], "reviewed": True, "fluent": "true"}


def test_files_are_written_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources.writers, "PIECE", 3)
    with sources.text_file(spark, str(tmp_path / "deep" / "t.txt")) as write:
        for part in ("猫", "ab\n", "", "cde", "f"):
            write(part)
    assert (tmp_path / "deep" / "t.txt").read_text(encoding="utf-8") == "猫ab\ncdef"
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["t.txt"]


def test_outer_white_space_of_tables(spark, tmp_path):
    rows = spark.createDataFrame([(" a", "b\t"), ("", "x"), (None, "y"), ("\n", " ")], "source string, target string")
    sources.write_pairs_csv(rows, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in sources.pairs_csv(spark, str(tmp_path / "t"), "source", "target").collect()) == [("\n", " "), (" a", "b\t")]


def test_unmasked_labels(spark):
    rows = spark.createDataFrame([([5, -100, 0],), ([],), (None,)], "labels array<int>")
    assert [r[0] for r in rows.select(training.unmasked(rows.labels, 1)).collect()] == [[5, 1, 0], [], None]
