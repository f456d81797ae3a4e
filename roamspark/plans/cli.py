"""Runs the datasets of a configuration: python -m roamspark.plans.cli --config FILE [--output-root DIR] [--dataset NAME]...

Where the configuration or the environment gives an address and ROAMSPARK_API_KEY is set, the named models induce; otherwise the offline rules do."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from ..operators.evaluate import evaluate
from ..operators.induce import Chat, RuleBased
from ..session import ship
from ..sources import lines as sources
from ..sources.sinks import run_folder, write_json, write_records, write_summary
from .engines import get_engine


def run(spark: SparkSession, config: str, out: str, only: list[str] | None = None, engine: str | None = None, run_id: str | None = None) -> list[dict]:
    ship(spark)
    plan = sources.Experiment.of(json.loads(spark.read.text(config, wholetext=True).first()[0]), only)
    summary = []
    for d in plan.datasets:
        folder = run_folder(out, d.name, run_id)
        kind = get_engine(engine)
        key = os.environ.get("ROAMSPARK_API_KEY")
        inducer = Chat.of(plan.settings, key, kind.style) if key and plan.settings.base_url else RuleBased()
        got = kind(spark, inducer, plan.settings).process_file(d.log_path)
        write_records(got.payload(), f"{folder}/records.jsonl")
        write_json(spark, got.stats, f"{folder}/stats.json")
        row = {"dataset": d.name, **{k: got.stats.get(k) for k in ("lines", "groups", "records", "processed", "consolidated", "skipped", "llm_calls", "runtime_sec")}}
        if d.gt_path:
            truth = sources.read_ground_truth(spark, d.gt_path)
            row |= evaluate(got.events, got.records, truth, got.stats["lines"], d.matching, not d.exclude_client_in_fea, d.field_metrics_on_extracted_only).first().asDict()
            write_json(spark, row, f"{folder}/metrics.json")
        summary.append(row)
    root = run_folder(out, "", run_id).rstrip("/")
    write_summary(spark, summary, f"{root}/summary_main.csv")
    write_json(spark, {"config": config, "results": summary}, f"{root}/summary_main.json")
    return summary


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--output-root", default="outputs")
    p.add_argument("--dataset", action="append")
    p.add_argument("--engine")
    a = p.parse_args(args)
    run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.config, a.output_root, a.dataset, a.engine)


if __name__ == "__main__":
    main()
