"""Command lines: build a data set, train, evaluate, classify a capture, run the cascade over stored requests.

    spark-submit sparksentry/__main__.py build --docs D --events E --out FOLDER [--sqli CSV] [--xss CSV] [--labelled CSV] [--seed 42]
    ... train --data FOLDER/train --models FOLDER
    ... evaluate --data FOLDER --out FOLDER [--models FOLDER] [--top 200]
    ... classify --captures FOLDER [--port 80] [--model signature_baseline | --models FOLDER --model NAME] [--count N]
    ... cascade --requests FOLDER --config FILE --out FOLDER

The session is the one that spark-submit or python -m makes; folders are any that Spark reaches.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksentry.operators import decision, stored_models
from sparksentry.operators.settings import load_settings
from sparksentry.sources import capture, corpus
from sparksentry.sources.scratch import stored


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order, for a short benchmark: a top-n, so nothing is sorted in full."""
    return df.orderBy(*order).limit(n)


def build(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Writes train, test_clean and test_obfuscated; the rows of each."""
    paths = {k: v for k, v in (("sqli", args.sqli), ("xss", args.xss), ("labelled", args.labelled)) if v}
    synthetic = corpus.synthetic_corpus(spark.read.parquet(args.docs), spark.read.parquet(args.events), args.seed) if args.docs and args.events else None
    parts = corpus.build_dataset(spark, stored(corpus.combined_dataset(spark, paths, synthetic, args.seed)), args.seed)
    corpus.save_partitions(parts, args.out)
    return {name: corpus.read_csv(spark, f"{args.out}/{name}").count() for name in parts}


def train(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Fits all models on a partition that build wrote, and saves them."""
    rows = corpus.read_csv(spark, args.data).select(F.xxhash64("payload", "label").alias("id"), F.col("payload").alias("text"), "label")
    found = stored_models.train_all(rows)
    for model in found.values():
        model.save(args.models)
    return list(found)


def _detectors(spark: SparkSession, folder: str | None) -> list[str]:
    for name, model in (stored_models.load_all(spark, folder) if folder else {}).items():
        decision.register_model(name, model)
    return ["signature_baseline", "anomaly", *(stored_models.NAMES if folder else [])]


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes the evaluation table of all detectors over both test partitions (the first rows of each, if --top says how many)."""
    parts = []
    for split, name in (("clean", "test_clean"), ("obfuscated", "test_obfuscated")):
        rows = corpus.read_csv(spark, f"{args.data}/{name}").select(F.lit(split).alias("split"), "label", "payload")
        parts.append(first_rows(rows, ["payload", "label"], args.top) if args.top else rows)
    table = stored(decision.evaluation_table(parts[0].unionByName(parts[1]), _detectors(spark, args.models), corpus.LABELS))
    decision.save_metrics(table.orderBy(F.desc("f1_obfuscated"), "detector"), args.out)
    return table


def classify(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The session's summary of the requests in capture files; --count: of the first so many packets."""
    _detectors(spark, args.models)
    seen = capture.packets(capture.read_captures(spark, args.captures)).filter(F.col("dst_port") == args.port)
    seen = first_rows(seen, ["ts", *capture.FLOW, "seq"], args.count) if args.count else seen
    text = capture.requests_in(seen, args.port).select(decision.request_payload(F.col("request")).alias("payload")).filter("payload is not null")
    label = decision.DETECTORS[decision.known([args.model])[0]](F.array("payload"))[0]
    counted = text.agg(F.count("*").alias("requests"), F.count_if(label != "benign").alias("malicious"))
    return seen.agg(F.count("*").alias("packets")).crossJoin(counted).select(F.lit(args.model).alias("model"), "packets", "requests", "malicious")


def cascade(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes the whole cascade's rows for stored requests."""
    settings = load_settings(args.config)
    every = F.create_map(F.lit("user-agent"), F.col("user_agent"), F.lit("x-forwarded-for"), F.col("xff"))
    decided = decision.cascade(spark.read.parquet(args.requests), F.map_filter(every, lambda k, v: v.isNotNull()), settings)
    made = decision.with_bans(stored(decided), settings.limits)
    made.write.mode("overwrite").parquet(args.out)
    return spark.read.parquet(args.out).groupBy("decision", "status").count()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparksentry")
    commands = top.add_subparsers(required=True)
    known = {
        build: [("--docs", {}), ("--events", {}), ("--out", {"required": True}), ("--sqli", {}), ("--xss", {}), ("--labelled", {}), ("--seed", {"type": int, "default": 42})],
        train: [("--data", {"required": True}), ("--models", {"required": True})],
        evaluate: [("--data", {"required": True}), ("--out", {"required": True}), ("--models", {}), ("--top", {"type": int})],
        classify: [("--captures", {"required": True}), ("--port", {"type": int, "default": 80}), ("--models", {}), ("--model", {"default": "signature_baseline"}), ("--count", {"type": int})],
        cascade: [("--requests", {"required": True}), ("--config", {"required": True}), ("--out", {"required": True})],
    }
    for run, options in known.items():
        command = commands.add_parser(run.__name__, help=run.__doc__)
        command.set_defaults(run=run)
        for name, how in options:
            command.add_argument(name, **how)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    found = args.run(SparkSession.builder.getOrCreate(), args)
    found.show(truncate=False) if isinstance(found, DataFrame) else print(found)


if __name__ == "__main__":
    main()
