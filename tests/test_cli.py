import json

import pytest

from hirameki import cli


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_check_split_select_merge(spark, tmp_path, capsys):
    rows = [{"id": 3, "image_id": 1, "caption": "abx", "source_caption": "s"}, {"id": 1, "caption": "ab", "source_caption": "t"}]
    document = put(tmp_path / "a.json", {"info": 1, "simplification": {"m": 1}, "annotations": rows})
    tokens = put(tmp_path / "v.txt", "a\nb\n")
    cli.main(["check", "--input-json", document, "--tokens", tokens, "--failures-output", str(tmp_path / "failed")])
    assert json.loads(capsys.readouterr().out) == {"total": 2, "passed": 1, "failed": 1, "pass_rate": 0.5}
    assert spark.read.json(str(tmp_path / "failed")).first()["missing_tokens"] == ["x"]
    cli.main(["split", "--input-json", document, "--tokens", tokens, "--output-fail-json", str(tmp_path / "fail.json"), "--output-pass-jsonl", str(tmp_path / "pass")])
    assert spark.read.json(str(tmp_path / "pass")).first().asDict() == {"source": "t", "target": "ab"}
    assert [a["id"] for a in json.loads((tmp_path / "fail.json").read_text())["annotations"]] == [3]
    samples = put(tmp_path / "s.jsonl", '{"index":0,"candidates":[{"text":"zz","score":9},{"text":"ba","score":1}]}\n{"index":1,"candidates":[]}\n')
    cli.main(["select", "--input-json", document, "--samples-jsonl", samples, "--tokens", tokens, "--output-json", str(tmp_path / "out1.json")])
    out = json.loads((tmp_path / "out1.json").read_text())
    assert [a["caption"] for a in out["annotations"]] == ["ba", "ab"] and "sampling_filtering" in out and out["annotations"][0]["source_caption"] == "s"
    cli.main(["merge", "--input-glob", str(tmp_path / "out*.json"), "--output-json", str(tmp_path / "merged.json")])
    merged = json.loads((tmp_path / "merged.json").read_text())
    assert [a["id"] for a in merged["annotations"]] == [1, 3] and merged["simplification"]["sharding"] == {"num_shards": 1, "merged": True}
    with pytest.raises(SystemExit):
        cli.main(["merge", "--input-glob", str(tmp_path / "nothing*.json"), "--output-json", str(tmp_path / "x.json")])


def test_prepare_count_scores_losses(spark, tmp_path, capsys):
    table = put(tmp_path / "t.csv", "s,t\n" + "".join(f"a{i},a{i % 4}\n" for i in range(40)))
    cli.main(["prepare", "--input-files", table, "--source-column", "s", "--target-column", "t", "--output-dir", str(tmp_path / "data")])
    assert json.loads(capsys.readouterr().out)["total"] == 40
    assert spark.read.json(str(tmp_path / "data/valid.jsonl")).count() == 2 and spark.read.json(str(tmp_path / "data/train.jsonl")).count() == 38
    document = put(tmp_path / "a.json", {"annotations": [{"id": 1, "caption": "a b a", "caption_replaced": "a b"}]})
    cli.main(["count", "--input-json", document, "--analyzer", "hirameki.providers:WhiteSpaceAnalyzer", "--output", str(tmp_path / "counts"), "--top-k", "0"])
    assert json.loads(capsys.readouterr().out) == {"total_captions": 1, "total_tokens": 3, "unique_tokens": 2}
    cli.main(["fluency", "--input-json", document, "--model", "hirameki.providers:LengthScorer", "--output", str(tmp_path / "ppl")])
    assert json.loads(capsys.readouterr().out) == pytest.approx({"0.95": 2.0, "0.99": 2.0})
    cli.main(["losses", "--input", put(tmp_path / "l.jsonl", '{"step":1,"eval_loss":2.0}\n{"step":2,"eval_loss":1.0}\n')])
    assert '"step": 2' in capsys.readouterr().out


def test_score_generate_samples_replace(spark, tmp_path):
    rows = [{"id": 3, "image_id": 1, "caption": "big dog", "note": {"a": [1]}}, {"id": 1, "image_id": 2, "caption": "", "source_caption": None}]
    document = put(tmp_path / "a.json", {"info": 1, "annotations": rows})

    def out(name):
        return json.loads((tmp_path / name).read_text())

    cli.main(["score", "--input-json", document, "--model", "hirameki.providers:LengthScorer", "--output-json", str(tmp_path / "s.json")])
    first, second = out("s.json")["annotations"]
    assert first["lm_ppl"] == pytest.approx(4.0) and first["note"] == {"a": [1]} and second["lm_ppl"] in (float("inf"), "Infinity") and out("s.json")["lm_scoring"]["caption_field"] == "caption"
    cli.main(["generate", "--input-json", document, "--model", "tests.test_cli:small", "--output-json", str(tmp_path / "g.json")])
    made = out("g.json")
    assert [a["caption"] for a in made["annotations"]] == ["small dog", ""] and [a["source_caption"] for a in made["annotations"]] == ["big dog", None]
    assert made["simplification"]["sharding"] == {"num_shards": 1, "shard_id": 0} and made["info"] == 1
    cli.main(["samples", "--input-json", document, "--model", "hirameki.providers:CopySampler", "--num-sequences", "2", "--output-jsonl", str(tmp_path / "c")])
    got = {r["index"]: r for r in spark.read.json(str(tmp_path / "c")).collect()}
    assert got[0]["id"] == 3 and got[0]["source"] == "big dog" and [c["text"] for c in got[0]["candidates"]] == ["big dog", "dog big"]
    tokens, table = put(tmp_path / "v.txt", "dog\nsmall\n"), put(tmp_path / "r.json", {"big": "small"})
    cli.main(["replace", "--input-json", document, "--tokens", tokens, "--replacements", table, "--analyzer", "hirameki.providers:WhiteSpaceAnalyzer", "--output-field", "caption_replaced", "--output-json", str(tmp_path / "r2.json")])
    assert [a["caption_replaced"] for a in out("r2.json")["annotations"]] == ["smalldog", ""] and out("r2.json")["annotations"][0]["caption"] == "big dog"


def small():
    from hirameki.providers import RuleSimplifier

    return RuleSimplifier({"big": "small"})


def test_predict_evaluate_count_segments(spark, tmp_path, capsys):
    cli.main(["predict", "--model", "tests.test_cli:small", "--text", "a big cat", "--json"])
    assert json.loads(capsys.readouterr().out) == {"source": "a big cat", "prediction": "a small cat"}
    data = put(tmp_path / "d.jsonl", '{"source":"a big cat","target":"a small cat"}\n{"source":"x","target":"x y"}\n')
    for more in (["--tokenize", "whitespace"], ["--tokenize", "analyzer", "--analyzer", "hirameki.providers:WhiteSpaceAnalyzer"]):
        cli.main(["evaluate", "--model", "tests.test_cli:small", "--data-file", data, "--predictions-path", str(tmp_path / more[1]), *more])
        got = json.loads(capsys.readouterr().out)
        assert (got["copy_rate"], got["avg_len_pred"], got["avg_len_ref"]) == (0.5, 2.0, 2.5) and got["len_ratio"] == pytest.approx(0.8) and 0 < got["sari"] < 1
    document = put(tmp_path / "a.json", {"annotations": [{"id": 1, "caption": "redhot pan"}, {"id": 2, "caption": "red"}]})
    base = ["count", "--input-json", document, "--analyzer", "hirameki.providers:WhiteSpaceAnalyzer", "--tokens", put(tmp_path / "v.txt", "red\nhot\npan\n"), "--top-k", "0"]
    for more, tokens, unique, outside in (([], 3, 3, 1), (["--segment-to-tokens"], 4, 3, 0)):
        cli.main([*base, "--output", str(tmp_path / f"n{outside}"), *more])
        got = json.loads(capsys.readouterr().out)
        assert (got["total_captions"], got["total_tokens"], got["unique_tokens"], got["captions_with_outside_tokens"]) == (2, tokens, unique, outside)
