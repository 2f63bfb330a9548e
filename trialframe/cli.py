"""Command line: build data sets, evaluate completions, make preference pairs, compare logs.

``python -m trialframe.cli COMMAND --help`` lists a command's parameters. Models come from ``--model module:callable``.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.completion import Sampling, load_completer
from .operators.ordering import numbered
from .operators.records import sft_records
from .operators.synthesis import SPLITS, verified_splits
from .operators.trials import counts_by
from .plans.evaluation import build_pairs, evaluate_checkpoint, with_throughput
from .plans.report import markdown, report_rows
from .schemas import SFT_RECORDS, TRIALS
from .sources.files import read_jsonl, write_jsonl, write_text
from .sources.shared import kept

log = logging.getLogger("trialframe")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="trialframe", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="verified (prompt, program) records, one file a split")
    build.add_argument("--output-dir", required=True)
    for name, n in (("train", 1000), ("val", 150), ("test", 250)):
        build.add_argument(f"--num-{name}", type=int, default=n)
    build.add_argument("--seed", type=int, default=42)
    build.add_argument("--timeout", type=float, default=10.0)
    for command, temperature, limit in (("evaluate", 0.0, "--max-samples"), ("pairs", 0.8, "--max-prompts")):
        p = commands.add_parser(command, help="grade a model's completions" if command == "evaluate" else "preference pairs from failed completions")
        p.add_argument("--model", required=True, help="module:callable that makes a completer")
        p.add_argument("--adapter")
        p.add_argument("--input-file", required=True)
        p.add_argument("--output-file", required=True)
        p.add_argument("--batch-size", type=int, default=16)
        p.add_argument("--temperature", type=float, default=temperature)
        p.add_argument(limit, type=int, default=None if command == "evaluate" else 300, dest="limit")
        p.add_argument("--timeout", type=float, default=4.0 if command == "evaluate" else 10.0)
    analyze = commands.add_parser("analyze", help="compare trial logs with a baseline")
    analyze.add_argument("--baseline", required=True, help="name=log.jsonl")
    analyze.add_argument("--log", action="append", required=True, help="name=log.jsonl; may be repeated")
    analyze.add_argument("--output-file", required=True)
    for name, n in (("n-boot", 5000), ("n-perm", 10_000), ("n-sims", 1000), ("size", 50), ("seed", 42)):
        analyze.add_argument(f"--{name}", type=int, default=n)
    analyze.add_argument("--compat", action="store_true", help="p-values and fallbacks without corrections")
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``seq`` from the number that ends their id."""
    return read_jsonl(spark, path, SFT_RECORDS).withColumn("seq", F.substring_index("id", "_", -1).cast("long"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """A trial log with ``seq``, its order: by the number that ends the id, then the id."""
    rows = read_jsonl(spark, path, TRIALS).withColumn("_n", F.coalesce(F.expr("try_cast(substring_index(id, '_', -1) AS long)"), F.lit(0)))
    return numbered(rows, "_n", "id", name="seq").drop("_n")


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    from .operators.grading import verify_programs

    sizes = dict(zip([s for s, _ in SPLITS], (args.num_train, args.num_val, args.num_test)))
    rows = kept(verified_splits(spark, sizes, args.seed, lambda r: verify_programs(r, timeout=args.timeout)))
    for r in counts_by(rows, "split", "task_family").orderBy("split", "task_family").collect():  # a row for each split and family
        log.info("%s %s: %d", r["split"], r["task_family"], r["n"])
    records = sft_records(rows)
    for split, n in sizes.items():
        if n:
            write_jsonl(records.where(F.startswith("id", F.lit(split + "_"))), filled_path(args.output_dir, split), "id")


def filled_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.jsonl"


def _completer(args: argparse.Namespace, top_p: float, most: int):
    return load_completer(args.model, *([args.adapter] if args.adapter else []), sampling=Sampling(args.temperature, top_p, most))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    records = read_records(spark, args.input_file)
    _, summary = evaluate_checkpoint(records, _completer(args, 1.0, 512), args.output_file, args.batch_size, args.limit, args.timeout)
    log.info("%s", with_throughput(summary).first().asDict())


def pairs(spark: SparkSession, args: argparse.Namespace) -> None:
    made = build_pairs(read_records(spark, args.input_file), _completer(args, 0.95, 400), args.output_file, args.batch_size, args.limit, args.timeout)
    log.info("%d pairs", made.count())


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    logs = dict(x.split("=", 1) for x in [args.baseline, *args.log])
    tables = {name: kept(read_trials(spark, path)) for name, path in logs.items()}
    rows = report_rows(tables, args.baseline.split("=", 1)[0], n_boot=args.n_boot, n_perm=args.n_perm, n_sims=args.n_sims, size=args.size, seed=args.seed, compat=args.compat)
    write_text(args.output_file, markdown(rows))


COMMANDS = {"build": build, "evaluate": evaluate, "pairs": pairs, "analyze": analyze}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](spark or SparkSession.builder.appName("trialframe").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    main()
