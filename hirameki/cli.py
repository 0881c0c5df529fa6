"""Command line: one subcommand per stage. Run as `python -m hirameki.cli STAGE --help`.

Tables go in and out as annotation documents, JSON lines or Parquet, by their suffix (a folder without one is Parquet).
Analyzers and models are named as module:factory.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirameki import providers, sources
from hirameki.cluster import ship
from hirameki.errors import DataContractError
from hirameki.functions import metrics
from hirameki.functions import morphology as M
from hirameki.functions.vocabulary import MOST_TOKENS, Tokens, Vocabulary
from hirameki.operators import coverage, dataset, generation, review, selection, training



def named(name: str) -> Callable[[], Any]:
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def tokens_of(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary([r["token"] for r in sources.vocabulary(spark, path).limit(60_000).collect()])  # its size is checked


def with_vocabulary(rows: DataFrame, path: str, analyzer: str | None) -> tuple[DataFrame, Tokens]:
    """rows and a vocabulary for them: literals, or the table that too many tokens need (which morphemes don't meet)."""
    table = sources.vocabulary(rows.sparkSession, path)
    if analyzer or table.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS:
        return rows, tokens_of(rows.sparkSession, path)
    return coverage.with_known(rows, F.col("text"), table)


def captions(spark: SparkSession, path: str, field: str = "caption") -> DataFrame:
    """index, id, image_id, text (the field), ann."""
    rows = sources.require_field(sources.annotations(spark, path), field)
    return rows.select("index", F.expr("try_variant_get(ann, '$.id', 'bigint')").alias("id"), F.expr("try_variant_get(ann, '$.image_id', 'bigint')").alias("image_id"), dataset.caption_text("ann", field).alias("text"), "ann")


def root_of(spark: SparkSession, path: str) -> dict[str, Any]:
    return {r["key"]: r["value"].toPython() if r["value"] is not None else None for r in sources.root_metadata(spark, path).collect()}  # metadata of one document


def with_morphemes(rows: DataFrame, analyzer: str | None) -> tuple[DataFrame, Any]:
    return (providers.morphemes(rows, "text", named(analyzer)), F.col("morphemes")) if analyzer else (rows, None)


def set_field(rows: DataFrame, field: str, value: Any) -> DataFrame:
    """ann with the field set."""
    others = F.map_filter(F.expr("cast(ann AS map<string, variant>)"), lambda k, _: k != field)
    new = F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")
    return rows.withColumn("ann", F.to_variant_object(F.map_concat(others, F.create_map(F.lit(field), new))))


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = []
    for path in a.input_files:
        read = sources.pairs_csv if path.lower().endswith(".csv") else sources.pairs_xlsx
        more = {} if path.lower().endswith(".csv") else {"sheet": a.sheet}
        parts.append(read(spark, path, a.source_column, a.target_column, **more).withColumn("file", F.lit(path)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("key", F.concat_ws("\x1f", "file", "source", "target"))
    both = dataset.split(rows, "key", a.validation_ratio, a.seed)
    for side in ("train", "valid"):
        sources.write_json_lines(both.where(F.col("split") == side).select("source", "target"), f"{a.output_dir}/{side}.jsonl")
    dataset.passthrough_rates(rows, "file").write.json(f"{a.output_dir}/stats_by_file")
    total = dataset.passthrough_total(rows).first()
    print(json.dumps({"total": total["rows"], "passthrough_rate": total["passthrough_rate"], "validation_ratio": a.validation_ratio, "seed": a.seed}))


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, morphemes = with_morphemes(captions(spark, a.input_json, a.field), a.analyzer)
    rows, vocabulary = with_vocabulary(rows, a.tokens, a.analyzer)
    ok = coverage.verdict(F.col("text"), vocabulary, morphemes, a.mode)
    failed = coverage.sides(rows, ok)[1].withColumn("missing_tokens", coverage.missing_tokens(F.col("text"), vocabulary, morphemes))
    if a.failures_output:
        sources.write_json_lines(failed.select("index", "id", "image_id", F.col("text").alias("caption"), "missing_tokens"), a.failures_output)
    if a.missing_tokens_output:
        coverage.frequencies(failed, F.col("missing_tokens")).coalesce(1).write.json(a.missing_tokens_output)
    print(json.dumps(coverage.pass_rate(rows, ok).first().asDict()))


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, morphemes = with_morphemes(captions(spark, a.input_json, a.field), a.analyzer)
    vocabulary = tokens_of(spark, a.tokens) if a.tokens else None
    tokens = coverage.normalized_tokens(morphemes, a.normalize, vocabulary, not a.surface, a.kana, a.normalize_numbers)
    if a.segment_to_tokens and vocabulary:
        tokens = coverage.segmented(tokens, vocabulary)
    known = sources.vocabulary(spark, a.tokens) if a.tokens else None
    print(json.dumps(coverage.token_stats(rows, tokens, known).first().asDict()))
    coverage.frequencies(rows, tokens).write.json(a.output)
    if a.top_k:
        coverage.frequencies(rows, tokens, a.top_k).show(a.top_k, truncate=False)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, morphemes = with_morphemes(captions(spark, a.input_json, a.target_field), a.analyzer)
    rows, vocabulary = with_vocabulary(rows, a.tokens, a.analyzer)
    lacks = F.expr(f"variant_get(ann, '$.{a.source_field}', 'string')").isNull() | F.expr(f"variant_get(ann, '$.{a.target_field}', 'string')").isNull()
    passed, failed = coverage.sides(rows, ~lacks & coverage.verdict(F.col("text"), vocabulary, morphemes, a.mode))
    pairs = passed.select(F.expr(f"variant_get(ann, '$.{a.source_field}', 'string')").alias("source"), F.col("text").alias("target"))
    if a.output_pass_jsonl:
        sources.write_json_lines(pairs, a.output_pass_jsonl)
    if a.output_pass_csv:
        sources.write_pairs_csv(pairs, a.output_pass_csv, a.csv_source_column, a.csv_target_column)
    sources.export_document(failed, root_of(spark, a.input_json), a.output_fail_json)


def select(spark: SparkSession, a: argparse.Namespace) -> None:
    vocabulary = tokens_of(spark, a.tokens)
    rows = dataset.shard(captions(spark, a.input_json), "index", a.num_shards, a.shard)
    found = selection.with_samples(rows, sources.samples(spark, a.samples_jsonl))
    best = selection.best_candidate(F.col("candidates"), lambda t: coverage.verdict(t, vocabulary))["text"]
    kept = dataset.with_source_copy(found, a.source_field).withColumn("best", best)
    done = set_field(kept, a.output_field, F.coalesce("best", "text"))
    root = dataset.stage_metadata(root_of(spark, a.input_json), "sampling_filtering", {"samples": a.samples_jsonl, "num_shards": a.num_shards, "shard": a.shard})
    sources.export_document(done, root, a.output_json)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sources.shards(spark, a.input_glob).withColumn("key", F.expr(f"try_variant_get(ann, '$.{a.sort_key}', 'bigint')"))
    n = rows.agg(F.max("file_no")).first()[0] + 1
    if not rows.where("key IS NULL").isEmpty():
        raise DataContractError(f"rows without {a.sort_key} can't be sorted")
    first = spark.read.format("binaryFile").load(a.input_glob).select(F.min("path")).first()[0]
    placed = rows.withColumn("index", F.struct("key", "file_no", "index"))
    sources.export_document(placed, dataset.merged_metadata(root_of(spark, first), n), a.output_json)


def fluency(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sources.require_field(sources.annotations(spark, a.input_json), a.source_field, a.target_field)
    rows = rows.select("index", dataset.caption_text("ann", a.source_field).alias("s"), dataset.caption_text("ann", a.target_field).alias("t"))
    done = generation.fluency(rows, "s", "t", named(a.model)).drop("s", "t")
    done.write.parquet(a.output)
    print(json.dumps(generation.thresholds(spark.read.parquet(a.output), "lm_source_ppl", a.percentiles).first()["thresholds"]))


def meaning(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sources.require_field(sources.annotations(spark, a.input_json), a.source_field, a.target_field)
    rows = rows.select("index", dataset.caption_text("ann", a.source_field).alias("s"), dataset.caption_text("ann", a.target_field).alias("t"))
    generation.meaning(rows, "s", "t", named(a.model), a.threshold).drop("s", "t").write.parquet(a.output)
    print(json.dumps(generation.thresholds(spark.read.parquet(a.output), "semantic_similarity", a.percentiles).first()["thresholds"]))


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = captions(spark, a.input_json, a.field)
    done = generation.scored(rows, "text", named(a.model))
    for name in ("lm_total_logprob", "lm_avg_logprob", "lm_ppl"):
        done = set_field(done, name, F.col(name))
    root = dataset.stage_metadata(root_of(spark, a.input_json), "lm_scoring", {"model": a.model, "caption_field": a.field})
    sources.export_document(done, root, a.output_json)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = dataset.shard(captions(spark, a.input_json, a.field), "index", a.num_shards, a.shard)
    done = dataset.with_source_copy(generation.simplified(rows, "text", named(a.model), "simplified"), a.source_field, a.field)
    done = set_field(done, a.output_field, F.col("simplified"))
    told = {"model": a.model, "caption_field": a.field, "output_caption_field": a.output_field, "source_caption_field": a.source_field, "sharding": {"num_shards": a.num_shards, "shard_id": a.shard}}
    sources.export_document(done, dataset.stage_metadata(root_of(spark, a.input_json), "simplification", told), a.output_json)


def samples(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = dataset.shard(captions(spark, a.input_json, a.field), "index", a.num_shards, a.shard)
    done = generation.sampled(rows, "text", named(a.model), a.num_sequences)
    sources.write_json_lines(done.select("index", "id", "image_id", F.col("text").alias("source"), "candidates"), a.output_jsonl)


def replace(spark: SparkSession, a: argparse.Namespace) -> None:
    vocabulary, table = tokens_of(spark, a.tokens), {}
    if a.replacements:
        found = sources.replacements(spark, a.replacements, sources.vocabulary(spark, a.tokens)).limit(60_001).collect()  # literals of a plan, as the vocabulary
        if len(found) > 60_000:
            raise DataContractError("60000 replacements at most")
        table = {r["token"]: r["replacement"] for r in found}
    rows, morphemes = with_morphemes(captions(spark, a.input_json, a.field), a.analyzer)
    # without an analyzer texts stay as they are
    done = set_field(rows, a.output_field or a.field, F.col("text") if morphemes is None else M.replaced_caption(morphemes, vocabulary, table))
    sources.export_document(done, root_of(spark, a.input_json), a.output_json)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    done = generation.simplified(sources.inline_texts(spark, a.text, a.input_file), "text", named(a.model), "prediction").orderBy("index")
    for r in done.select("text", "prediction").toLocalIterator():  # what is printed
        print(json.dumps({"source": r["text"], "prediction": r["prediction"]}, ensure_ascii=False) if a.json else r["prediction"])


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = generation.simplified(sources.json_lines(spark, a.data_file, "source STRING, target STRING"), "source", named(a.model), "prediction")
    texts, tokens = ("source", "prediction", "target"), None
    if a.predictions_path:
        sources.write_json_lines(rows.select("source", "target", "prediction"), a.predictions_path)
        rows = sources.json_lines(spark, a.predictions_path, "source STRING, target STRING, prediction STRING")
    if a.tokenize == "analyzer":
        tokens = tuple(f"_{c}" for c in texts)
        for c, t in zip(texts, tokens, strict=True):
            rows = providers.surfaces(rows, c, named(a.analyzer), t)
    else:
        rows = rows.select(*texts, *[metrics.TOKENIZERS[a.tokenize](F.coalesce(F.col(c), F.lit(""))).alias(f"_{c}") for c in texts])
        tokens = tuple(f"_{c}" for c in texts)
    found = metrics.corpus_means(rows, *texts, tokens=tokens).first()
    score_ = metrics.bleu(rows, "_prediction", "_target").first()["bleu"]
    names = {"sari": "sari", "rougeL": "rouge_l", "copy_rate": "copy_rate", "avg_len_pred": "mean_prediction_length", "avg_len_ref": "mean_reference_length", "len_ratio": "length_ratio"}
    print(json.dumps({k: found[v] for k, v in names.items()} | {"bleu": score_}))


def merged_fields(spark: SparkSession, path: str) -> DataFrame:
    """What a review merges, with _place: an annotation document (.json), JSON lines (.jsonl) or Parquet."""
    if path.endswith(".json"):
        return review.opened(sources.annotations(spark, path), whole=False).withColumnRenamed("index", "_place")
    rows = spark.read.json(path) if path.endswith(".jsonl") else spark.read.parquet(path)
    return rows.drop("ann", "index").withColumn("_place", F.monotonically_increasing_id())


def serve(spark: SparkSession, a: argparse.Namespace) -> None:
    from hirameki.review_server import ReviewStore, server

    base = review.opened(sources.annotations(spark, a.input_json))
    for path in a.scores or []:
        base = review.merge_scores(base, merged_fields(spark, path), "_place")
    for path in a.failures or []:
        base = review.attach_missing(base, sources.failures(spark, path).withColumn("_place", F.monotonically_increasing_id()), "_place")
    found = server(ReviewStore(base, root_of(spark, a.input_json), a.output_json, a.page_size), a.host, a.port)
    print(f"http://{a.host}:{found.server_address[1]}", flush=True)
    found.serve_forever()


def losses(spark: SparkSession, a: argparse.Namespace) -> None:
    logs = training.kept_records(sources.json_lines(spark, a.input, "step BIGINT, loss DOUBLE, eval_loss DOUBLE, learning_rate DOUBLE, epoch DOUBLE"))
    print(json.dumps({"best": training.best_evaluation(logs).first().asDict(), "early_stop": training.early_stop(logs, a.patience).first()["step"]}))
    for value in ("loss", "eval_loss"):
        training.series(logs, value).orderBy("step").show(20)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hirameki", description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, run: Callable, *required: str, **optional: Any) -> argparse.ArgumentParser:
        p = stages.add_parser(name)
        p.set_defaults(run=run)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            flag = f"--{o.replace('_', '-')}"
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else str)
        return p

    p = stage("prepare", prepare, sheet="平易化コーパス", source_column="#日本語(原文)", target_column="#やさしい日本語", output_dir="data/processed", validation_ratio=0.05, seed=42)
    p.add_argument("--input-files", nargs="+", required=True)
    stage("check", check, "input-json", "tokens", field="caption", mode="char", analyzer=None, failures_output=None, missing_tokens_output=None)
    stage("count", count, "input-json", "analyzer", "output", field="caption", tokens=None, normalize=False, surface=False, kana=False, normalize_numbers=False, segment_to_tokens=False, top_k=20)
    stage("split", split, "input-json", "tokens", "output-fail-json", source_field="source_caption", target_field="caption", mode="char", analyzer=None, output_pass_jsonl=None, output_pass_csv=None, csv_source_column="source", csv_target_column="target")
    stage("select", select, "input-json", "samples-jsonl", "tokens", "output-json", source_field="source_caption", output_field="caption", num_shards=1, shard=0)
    stage("score", score, "input-json", "model", "output-json", field="caption")
    stage("generate", generate, "input-json", "model", "output-json", field="caption", output_field="caption", source_field="source_caption", num_shards=1, shard=0)
    stage("samples", samples, "input-json", "model", "output-jsonl", field="caption", num_sequences=16, num_shards=1, shard=0)
    stage("replace", replace, "input-json", "tokens", "output-json", field="caption", output_field=None, analyzer=None, replacements=None)
    p = stage("predict", predict, "model", input_file=None, json=False)
    p.add_argument("--text", action="append")
    stage("evaluate", evaluate, "model", "data-file", tokenize="char", analyzer="hirameki.providers:TaggerAnalyzer", predictions_path=None)
    stage("merge", merge, "input-glob", "output-json", sort_key="id")
    for name, run, shares in (("fluency", fluency, [0.95, 0.99]), ("meaning", meaning, [0.05, 0.01])):
        p = stage(name, run, "input-json", "model", "output", source_field="caption", target_field="caption_replaced")
        p.add_argument("--percentiles", type=lambda s: [float(x) for x in s.split(",") if x.strip()], default=shares)
        p.add_argument("--threshold", type=float)
    p = stage("review", serve, "input-json", "output-json", host="127.0.0.1", port=8000, page_size=50)
    p.add_argument("--scores", action="append")
    p.add_argument("--failures", action="append")
    stage("losses", losses, "input", patience=3)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"hirameki-{a.stage}").getOrCreate()
    ship(spark)
    try:
        a.run(spark, a)
    except DataContractError as e:
        sys.exit(str(e))


if __name__ == "__main__":
    main()
