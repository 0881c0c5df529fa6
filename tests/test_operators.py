import pytest
from pyspark.sql import functions as F

from hirameki import providers
from hirameki.errors import DataContractError
from hirameki.functions.vocabulary import Vocabulary
from hirameki.operators import coverage, dataset, review, selection, training


@pytest.mark.parametrize("total,ratio,valid", [(1, 0.05, 1), (39, 0.05, 1), (40, 0.05, 2), (1000, 0.3, 300), (10, 1.0, 10), (7, 0.0, 1)])
def test_split_sizes(spark, total, ratio, valid):
    rows = dataset.split(spark.range(total).repartition(3), "id", ratio)
    sides = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sides.get("valid") == valid and sides.get("train", 0) == total - valid
    again = dataset.split(spark.range(total).repartition(7), "id", ratio)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_passthrough_of_no_rows(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert str(dataset.passthrough_total(none).first()["passthrough_rate"]) == "nan"


def test_shards_merge_to_the_whole(spark):
    rows = spark.range(20).select((F.col("id") % 5).alias("key"), F.col("id").alias("index"))
    merged = dataset.merged([dataset.shard(rows, "index", 3, k) for k in range(3)], sort_key="key").collect()
    assert [(r["key"], r["index"]) for r in merged] == sorted(((i % 5, i) for i in range(20)), key=lambda x: (x[0], x[1] % 3, x[1]))
    with pytest.raises(DataContractError):
        dataset.shard(rows, "index", 3, 3)
    with pytest.raises(DataContractError):
        dataset.merged([rows.withColumn("key", F.lit(None).cast("long"))], sort_key="key")
    assert dataset.merged_metadata({"simplification": {"m": 1}}, 3)["simplification"] == {"m": 1, "sharding": {"num_shards": 3, "merged": True}}
    assert dataset.merged_metadata({"info": 1}, 3) == {"info": 1}


def test_source_copy_tells_absent_from_null(spark):
    rows = spark.createDataFrame([('{"caption":"x"}',), ('{"caption":"x","source_caption":null}',), ('{"caption":null}',)], "t string").select(F.parse_json("t").alias("ann"))
    got = [r["j"] for r in dataset.with_source_copy(rows).select(F.to_json("ann").alias("j")).collect()]
    assert got == ['{"caption":"x","source_caption":"x"}', '{"caption":"x","source_caption":null}', '{"caption":null,"source_caption":null}']
    assert [r["c"] for r in rows.select(dataset.caption_text().alias("c")).collect()] == ["x", "x", "None"]


def test_best_candidate(spark):
    kind = "array<struct<text:string,score:double>>"
    nan = float("nan")
    rows = [([("a", None), ("b", -2.0), ("c", -2.0)], "b"), ([("a", None), ("b", None)], "a"), ([(None, 1.0), ("no", 5.0)], None), ([], None), ([("a", nan), ("b", -9.0)], "b"), ([("a", 1.0), ("b", nan)], "a")]
    df = spark.createDataFrame(rows, f"c {kind}, want string")
    got = df.select("want", selection.best_candidate(F.col("c"), lambda t: t != "no").alias("b")).collect()
    assert [r["b"] and r["b"]["text"] for r in got] == [r["want"] for r in got]


def test_samples_have_to_be_there(spark):
    rows, samples = spark.range(2).withColumnRenamed("id", "index"), spark.createDataFrame([(0, [("a", 1.0)]), (9, [])], "index long, candidates array<struct<text:string,score:double>>")
    with pytest.raises(DataContractError):
        selection.with_samples(rows, samples)
    assert selection.with_samples(rows.where("index = 0"), samples).count() == 1


def test_coverage(spark):
    v = Vocabulary(["ab", "c"])
    df = spark.createDataFrame([(1, "ab c"), (2, "abx"), (3, ""), (4, None)], "id int, t string")
    ok = coverage.verdict(F.col("t"), v)
    passed, failed = coverage.sides(df, ok)
    assert [r["id"] for r in passed.collect()] == [1, 3] and [r["id"] for r in failed.collect()] == [2, 4]
    assert coverage.pass_rate(df.where("id < 4"), ok).first().asDict() == {"total": 3, "passed": 2, "failed": 1, "pass_rate": 2 / 3}
    assert coverage.pass_rate(df.limit(0), ok).first()["pass_rate"] == 0.0
    words = F.split("t", " ")
    one = coverage.token_stats(df.where("id < 3"), words, spark.createDataFrame([("ab",), ("c",)], "token string")).first()
    assert (one["total_captions"], one["total_tokens"], one["unique_tokens"], one["captions_with_outside_tokens"], one["captions_with_outside_tokens_rate"]) == (2, 3, 3, 1, 0.5)
    assert df.where("id = 1").select(coverage.outside_of_failed(F.array(F.lit("abc"), F.lit("x"), F.lit("")), v).alias("o")).first()["o"] == ["x"]


def test_merged_scores(spark):
    base = spark.createDataFrame([(0, 1, "a", None, 5.0), (1, 1, "b", None, 6.0), (2, 2, "c", "s", 7.0)], "index int, id int, caption string, source_caption string, ppl double")
    scores = spark.createDataFrame([(0, 1, "zz", "new", 1.0, "k"), (1, 1, "yy", "newer", None, "l"), (2, 9, "x", "x", 1.0, "m"), (3, 2, "x", "x", 3.0, None)], "place int, id int, caption string, source_caption string, ppl double, extra string")
    got = sorted(tuple(r) for r in review.merge_scores(base, scores, "place").select("index", "id", "caption", "source_caption", "ppl", "extra").collect())
    assert got == [(0, 1, "a", None, 5.0, None), (1, 1, "b", "newer", None, "l"), (2, 2, "c", "s", 3.0, None)]


def test_review_order_pages_and_edits(spark):
    rows = spark.createDataFrame([(0, 5, 1.0), (1, 6, None), (2, 7, 1.0), (3, None, 3.0)], "index int, id int, s double")
    assert [r["index"] for r in review.ordered(rows, "s").collect()] == [0, 2, 3, 1]
    assert [r["index"] for r in review.ordered(rows, "s", descending=True).collect()] == [1, 3, 0, 2]
    assert [r["index"] for r in review.ordered(rows).collect()] == [3, 0, 1, 2]
    assert [r["index"] for r in review.page(rows, 1, 2, "s").collect()] == [2, 3]
    base = spark.createDataFrame([(1, "a", None), (2, "b", True)], "id int, caption string, reviewed boolean")
    log = spark.createDataFrame([(1, 1, "x", None), (2, 1, "y", None), (3, 1, None, True), (4, 9, "z", None), (5, 2, None, False)], "seq int, id int, caption string, reviewed boolean")
    assert sorted(tuple(r) for r in review.apply_edits(base, log, field="caption").select("id", "caption", "reviewed", "_edited").collect()) == [(1, "y", True, True), (2, "b", False, False)]
    open_rows = spark.createDataFrame([('{"id":1,"z":2}',), ('{"caption":"c","a":null,"missing_tokens":[]}',)], "t string").select(F.parse_json("t").alias("ann"))
    assert [r["name"] for r in review.extra_fields(open_rows).collect()] == ["a", "z"]
    assert review.strictest({"0.95": 1.0, "0.99": 4.0}) == 4.0 and review.strictest(None) is None


def test_training_records(spark):
    logs = spark.createDataFrame([(1, 2.0, None), (2, None, 5.0), (3, None, 4.0), (4, None, 4.0), (5, None, 6.0), (6, None, 4.5), (7, None, None)], "step int, loss double, eval_loss double").withColumn("learning_rate", F.lit(None)).withColumn("epoch", F.lit(None))
    assert training.kept_records(logs).count() == 6 and training.best_evaluation(logs).first().asDict() == {"step": 3, "eval_loss": 4.0}
    assert training.early_stop(logs).first()["step"] == 6 and training.early_stop(logs, 9).first()["step"] is None
    assert [r["step"] for r in training.kept_checkpoints(logs.select("step")).collect()] == [7, 6]


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    got = providers.morphemes(df, "t", providers.WhiteSpaceAnalyzer).collect()
    assert [len(r["morphemes"]) for r in got] == [2, 0] and got[0]["morphemes"][1]["surface"] == "b"
    simple = providers.provided(df, "t", "out", "string", lambda: providers.RuleSimplifier({"a": "x"})).collect()
    assert [r["out"] for r in simple] == ["x b", ""]
