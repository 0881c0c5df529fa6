import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hirameki import sources as S
from hirameki.errors import DataContractError
from hirameki.functions.vocabulary import Vocabulary
from hirameki.operators import review
from hirameki.streaming import captions, checked


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_annotation_document_round_trip(spark, tmp_path):
    rows = [{"id": 1, "caption": "猫", "x": float("inf")}, {"id": 2, "caption": None}]
    path = put(tmp_path / "a.json", json.dumps({"info": {"v": 1}, "annotations": rows}))
    found = S.annotations(spark, path)
    assert [r["index"] for r in found.orderBy("index").collect()] == [0, 1]
    assert {r["key"] for r in S.root_metadata(spark, path).collect()} == {"info"}
    S.require_field(found, "id", "caption")
    with pytest.raises(DataContractError):
        S.require_field(found, "x")
    assert S.export_document(found, {"info": {"v": 1}}, str(tmp_path / "b.json")) == 2
    assert json.loads((tmp_path / "b.json").read_text()) == {"info": {"v": 1}, "annotations": rows}
    with pytest.raises(DataContractError):
        S.annotations(spark, put(tmp_path / "c.json", '{"annotations": {"a": 1}}'))


def test_json_lines_records_samples(spark, tmp_path):
    lines = put(tmp_path / "l.jsonl", '{"source":"a","target":"b"}\n\n{"source":"c","target":null}\n')
    assert [tuple(r) for r in S.json_lines(spark, lines, "source string, target string").collect()] == [("a", "b"), ("c", None)]
    array = put(tmp_path / "a.json", '[{"id": 1, "missing_tokens": ["x"]}]')
    assert S.failures(spark, array).first()["missing_tokens"] == ["x"]
    assert S.failures(spark, put(tmp_path / "f.jsonl", '{"id": 1}\n{"id": 2}\n')).count() == 2
    with pytest.raises(DataContractError):
        S.samples(spark, put(tmp_path / "s.jsonl", '{"index":1,"candidates":[]}\n{"index":1,"candidates":[]}\n'))
    good = S.samples(spark, put(tmp_path / "g.jsonl", '{"index":1,"candidates":[{"text":"t","score":null}]}\n'))
    assert good.first()["candidates"][0]["score"] is None
    S.write_json_lines(good, str(tmp_path / "out"))
    assert '"id":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_tables(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'a,b,c\n"x ""q""\nz",y,1\nNA,y,2\n1.0,2,3\n')
    got = S.pairs_csv(spark, path, "a", "b")
    assert [tuple(r) for r in got.collect()] == [('x "q"\nz', "y"), ("1.0", "2")]
    with pytest.raises(DataContractError):
        S.pairs_csv(spark, path, "a", "nothing")
    S.write_pairs_csv(got, str(tmp_path / "out"), "s", "t")
    assert sorted(tuple(r) for r in S.pairs_csv(spark, str(tmp_path / "out"), "s", "t").collect()) == [("1.0", "2"), ('x "q"\nz', "y")]


def test_spreadsheet(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>to</t></is></c></row><row r="2"><c r="A2"><v>5</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>from</t></si><si><r><t>ne</t></r><r><t>ko</t></r></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="one" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [tuple(r) for r in S.pairs_xlsx(spark, str(tmp_path / "t.xlsx"), "from", "to", "no such sheet").collect()] == [("5", "neko")]
    (tmp_path / "same.xlsx").write_bytes((tmp_path / "t.xlsx").read_bytes())
    assert S.pairs_xlsx(spark, str(tmp_path / "*.xlsx"), "from", "to").count() == 2
    with zipfile.ZipFile(tmp_path / "t.xlsx") as z, zipfile.ZipFile(tmp_path / "other.xlsx", "w") as other:
        for name in z.namelist():
            other.writestr(name, z.read(name).replace(b"from", b"begin"))
    with pytest.raises(DataContractError):
        S.pairs_xlsx(spark, str(tmp_path / "*.xlsx"), "from", "to")


def test_vocabulary_and_replacements(spark, tmp_path):
    tokens = S.vocabulary(spark, put(tmp_path / "v.txt", "猫\n\n犬\n猫\n a"))
    assert sorted(r["token"] for r in tokens.collect()) == [" a", "犬", "猫"]
    with pytest.raises(DataContractError):
        S.vocabulary(spark, put(tmp_path / "e.txt", "\n\n"))
    assert S.replacements(spark, put(tmp_path / "r.json", '{"いぬ":"犬"}'), tokens).count() == 1
    with pytest.raises(DataContractError):
        S.replacements(spark, put(tmp_path / "r2.json", '{"いぬ":"鳥"}'), tokens)
    assert S.outside_tokens(spark, None) is None
    for text in ('[{"token":"a"},{"token":"a"}]', '["a"]'):
        assert [r["token"] for r in S.outside_tokens(spark, put(tmp_path / "o.json", text)).collect()] == ["a"]
    assert S.outside_tokens(spark, put(tmp_path / "o2.json", "[]")).count() == 0


def test_texts_shards_checkpoints(spark, tmp_path):
    path = put(tmp_path / "t.txt", " a \n\nb\n")
    assert [tuple(r) for r in S.inline_texts(spark, ["x"], path).orderBy("index").collect()] == [(0, "x"), (1, "a"), (3, "b")]
    with pytest.raises(DataContractError):
        S.inline_texts(spark)
    for i in (2, 1):
        put(tmp_path / f"shard{i}.json", json.dumps({"annotations": [{"id": i}]}))
    assert {(r["file_no"], r["ann"].toPython()["id"]) for r in S.shards(spark, f"{tmp_path}/shard*.json").collect()} == {(0, 1), (1, 2)}
    with pytest.raises(DataContractError):
        S.shards(spark, f"{tmp_path}/nothing*.json")
    run = tmp_path / "run"
    for n in ("checkpoint-9", "checkpoint-10", "checkpoint-x"):
        (run / n).mkdir(parents=True)
    assert S.checkpoint(spark, str(run))[1].endswith("checkpoint-10")
    (run / "trainer_state.json").write_text("{}")
    assert S.checkpoint(spark, str(run)) == (str(run), str(run))
    with pytest.raises(DataContractError):
        S.checkpoint(spark, str(tmp_path / "nowhere"))


def test_reviewed_root_drops_scores():
    assert S.reviewed_root({"info": 1, "lm_scoring": 2, "annotations": [], "simplification": 3}) == {"info": 1, "images": None, "licenses": None, "simplification": 3}
    assert review.strictest({}) is None


def test_stream_gives_the_same_as_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.jsonl", '{"index":0,"caption":"ab","at":"2024-01-01T00:00:00"}\n{"index":1,"caption":"axb","at":"2024-01-01T00:01:00"}\n')
    stream = checked(captions(spark, str(folder)), Vocabulary(["a", "b"])).select("index", "ok", "missing_tokens")
    job = stream.writeStream.format("memory").queryName("checked_captions").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("checked_captions").collect()) == [(0, True, None), (1, False, ["x"])]


def test_a_large_document(spark, tmp_path):
    """Larger than one VARIANT may be."""
    row = json.dumps({"id": 1, "caption": "c" * 300, "score": 1.25, "none": None})
    n = 150_000_000 // len(row)
    with open(tmp_path / "large.json", "w") as f:
        f.write('{"info": {"v": 1}, "annotations": [' + row)
        for _ in range(n - 1):
            f.write("," + row)
        f.write('], "tail": "t"}')
    rows = S.annotations(spark, str(tmp_path / "large.json"))
    got = rows.agg(F.count("*").alias("n"), F.max("index").alias("last"), F.sum(F.expr("variant_get(ann, '$.score', 'double')")).alias("s")).first()
    assert (got["n"], got["last"], got["s"]) == (n, n - 1, 1.25 * n)
    assert {r["key"]: r["value"].toPython() for r in S.root_metadata(spark, str(tmp_path / "large.json")).collect()} == {"info": {"v": 1}, "tail": "t"}
    (tmp_path / "bad.json").write_text('{"annotations": [{"id": 1}, {"id": ')
    with pytest.raises(DataContractError, match="can't be read"):
        S.annotations(spark, str(tmp_path / "bad.json"))
