import random

import pytest
from pyspark.sql import functions as F

from hirameki import cli
from hirameki.errors import DataContractError
from hirameki.functions.vocabulary import Vocabulary, segments
from hirameki.operators import coverage


def test_a_table_gives_what_literals_give(spark):
    r = random.Random(5)
    tokens = sorted({"".join(r.choice("ab猫") for _ in range(r.randint(1, 4))) for _ in range(14)} | {"a"})
    texts = ["".join(r.choice("ab猫c ") for _ in range(r.randint(0, 14))) for _ in range(300)] + ["", None, " ", "a" * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "i int, text string")
    table = spark.createDataFrame([(t,) for t in [*tokens, *tokens, ""]], "token string")
    joined, vocabulary = coverage.with_known(rows, F.col("text"), table)

    def results(frame, v):
        plain = F.regexp_replace("text", " ", "")
        found = frame.select("i", coverage.verdict(F.col("text"), v), coverage.missing_tokens(F.col("text"), v), segments(plain, v))
        return sorted(tuple(x) for x in found.collect())

    assert results(joined, vocabulary) == results(rows, Vocabulary(tokens))
    with pytest.raises(DataContractError):
        coverage.with_known(rows, F.col("text"), table.where("false"))
    assert coverage.with_known(rows.where("false"), F.col("text"), table)[0].count() == 0


def test_the_check_of_many_tokens(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.json").write_text('{"annotations": [{"id": 1, "caption": "ab a"}, {"id": 2, "caption": "abx"}]}')
    (tmp_path / "v.txt").write_text("a\nab\nb\n")
    monkeypatch.setattr(cli, "MOST_TOKENS", 2)
    cli.main(["check", "--input-json", str(tmp_path / "a.json"), "--tokens", str(tmp_path / "v.txt"), "--failures-output", str(tmp_path / "failed")])
    assert '"passed": 1, "failed": 1' in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "failed")).first()["missing_tokens"] == ["x"]
