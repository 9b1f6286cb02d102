"""python -m loam preprocess|health|lengths|index|label|qa|records ..."""

from __future__ import annotations

import argparse
import importlib
import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from loam.functions import templates
from loam.operators import messages, vector
from loam.operators.profile import length_stats
from loam.plans import pipelines
from loam.sources import readers, sinks

LOG = logging.getLogger("loam")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loam")
    jobs = parser.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("preprocess", help="raw folder to split chat messages, with reports")
    p.add_argument("--raw-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--seed", type=int, default=42)
    for name, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        p.add_argument(f"--{name}-ratio", type=float, default=share)
    h = jobs.add_parser("health", help="counts, duplicates and leaks of datasets")
    h.add_argument("--train", required=True)
    h.add_argument("--test", required=True)
    h.add_argument("--val")
    h.add_argument("--report-name")
    jobs.add_parser("lengths", help="lengths of answers").add_argument("--dataset", required=True)
    i = jobs.add_parser("index", help="build or query a vector index of articles")
    i.add_argument("--build", action="store_true")
    i.add_argument("--query")
    i.add_argument("--articles", default="data/processed/articles_cleaned.json")
    i.add_argument("--db_path", default="index")
    i.add_argument("--top_k", type=int, default=5)
    i.add_argument("--code")
    i.add_argument("--embedder", default="loam.operators.vector:hashed", help="module:function that adds a column embedding to rows with a column document")
    b = jobs.add_parser("label", help="names of laws for records of an array file")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    q = jobs.add_parser("qa", help="questions and answers from article files")
    q.add_argument("--file", action="append", required=True, metavar="PATH=NAME")
    q.add_argument("--output", required=True)
    r = jobs.add_parser("records", help="training records that fit a window")
    r.add_argument("--data", required=True)
    r.add_argument("--output")
    r.add_argument("--max_seq_length", type=int, default=2048)
    r.add_argument("--overlong", choices=("chunk", "drop", "keep"), default="chunk")
    r.add_argument("--keep_ratio", type=float, default=1.0)
    r.add_argument("--template", choices=("inst", "chatml"), default="inst")
    r.add_argument("--template_file", help="a tokenizer's chat template, instead of --template")
    r.add_argument("--bos_token", default="")
    r.add_argument("--eos_token", default="")
    r.add_argument("--seed", type=int, default=42)
    return parser


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    if a.job == "index" and not a.build and not a.query:
        LOG.info("Give --build, or --query and a question.")
        return 0
    spark = SparkSession.builder.appName("loam").getOrCreate()
    if a.job == "preprocess":
        pipelines.preprocess(spark, a.raw_dir, a.output_dir, a.seed, a.train_ratio, a.val_ratio, a.test_ratio)
        for row in spark.read.json(f"{a.output_dir}/report").collect():  # one row
            LOG.info("%s", json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2))
    elif a.job == "health":
        paths = {k: v for k, v in (("train", a.train), ("test", a.test), ("val", a.val)) if v}
        pipelines.health(spark, paths, a.report_name).show(truncate=False)
    elif a.job == "lengths":
        try:
            found = length_stats(readers.training_records(spark, a.dataset)).first()
        except AnalysisException:
            LOG.error("No such file: %s", a.dataset)
            return 0
        if not found["n"]:
            LOG.warning("No record with messages")
            return 0
        LOG.info("Mean length: %.0f\nShortest: %d\nLongest: %d\nRecords: %d", *(found[c] for c in ("avg_len", "min_len", "max_len", "n")))
    elif a.job == "index":
        module, _, name = a.embedder.partition(":")
        embed = getattr(importlib.import_module(module), name) if name else module
        if a.build:
            LOG.info("%s", pipelines.build_retrieval(spark, a.articles, a.db_path, embed))
        if a.query:
            for row in pipelines.ask(spark, a.db_path, a.query, embed, a.top_k, a.code).collect():  # top_k rows
                LOG.info("%d. %s\n   %s\n   %s...\n", row["rank"], row["article_title"], row["legal_code"], row["text"][:200])
    elif a.job == "label":
        pipelines.label_file(spark, a.input, a.output).show(truncate=False)
    elif a.job == "qa":
        LOG.info("%d pairs", pipelines.qa_dataset(spark, dict(f.split("=", 1) for f in a.file), a.output).count())
    else:
        render = {"inst": messages.inst_text, "chatml": messages.chat_text}[a.template]
        if a.template_file:
            source = spark.read.text(a.template_file, wholetext=True).first()[0]
            render = lambda m: templates.render(source, m, bos_token=a.bos_token, eos_token=a.eos_token, add_generation_prompt=False)
        made, counts = pipelines.training_set(spark, a.data, a.max_seq_length, a.overlong, a.keep_ratio, a.seed, render)
        LOG.info("%s", counts.first().asDict())
        if a.output:
            sinks.jsonl(made, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
