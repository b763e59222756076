"""The command line: ``python -m tremorscope analyze mdi-table --store FOLDER --out FOLDER``, and others."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cells, cost, planning, reports
from .schema import ALPHAS, CI_LEVEL, RESAMPLES, SEED, SWEEP
from .sources import config, inputs, records


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tremorscope", description="Noise of repeated automatic measurements.")
    sub = out.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="write the tables of one analysis as Parquet")
    a.add_argument("what", choices=sorted(reports.ANALYSES))
    a.add_argument("--store", required=True, help="folder of record shards; for promotions the reports")
    a.add_argument("--out", required=True)
    a.add_argument("--envs", default="", help="comma-separated environments; all by default")
    a.add_argument("--screening", default="0")
    a.add_argument("--estimation", default="", help="like 1-9; by default every repeat not for screening")
    a.add_argument("--sweep", default="", help="numbers of repeats")
    a.add_argument("--alphas", default=",".join(map(str, ALPHAS)))
    a.add_argument("--seed", type=int, default=SEED)
    a.add_argument("--resamples", type=int, default=RESAMPLES)
    a.add_argument("--level", type=float, default=CI_LEVEL)
    a.add_argument("--annotations", help="payload of annotations, for oracle")
    a.add_argument("--thresholds", help="Parquet of env_id, n_repeats, threshold, for oracle")
    v = sub.add_parser("validate", help="read shards, set broken last lines aside, count what is left")
    v.add_argument("--store", required=True)
    c = sub.add_parser("calls", help="calls that a configuration makes at least and at most")
    c.add_argument("--config", required=True)
    c.add_argument("--inputs", required=True, help="folder of pinned sources")
    s = sub.add_parser("ledger", help="what was spent, by experiment")
    s.add_argument("--ledger", required=True)
    return out


def _tables(spark: SparkSession, args: argparse.Namespace) -> reports.Tables:
    if args.what == "promotions":
        return reports.promotion_tables(inputs.promotions(spark.read.option("multiLine", "true").json(args.store)))
    own, _ = records.read(spark, args.store)
    own = cells.scored(cells.require_version(own))
    options: dict[str, object] = {"seed": args.seed, "resamples": args.resamples, "ci_level": args.level}
    if args.what in ("fip", "decay", "mdi-table"):
        options["sweep"] = cells.repeats_of(args.sweep) if args.sweep else ((1,) if args.what == "fip" else SWEEP)
    if args.what == "mdi-table":
        options["alphas"] = cells.numbers_of(args.alphas)
    if args.what == "oracle":
        if not args.annotations or not args.thresholds:
            raise SystemExit("oracle needs --annotations and --thresholds")
        payload = spark.read.schema(config.SUMMARIES).option("multiLine", "true").json(args.annotations)
        options |= {"annotations": inputs.annotations(payload), "thresholds": spark.read.parquet(args.thresholds)}
    estimation = cells.repeats_of(args.estimation) if args.estimation else None
    return reports.analyze(args.what, own, envs=[e for e in args.envs.split(",") if e] or None, screening=cells.repeats_of(args.screening), estimation=estimation, **options)


def _calls(spark: SparkSession, path: str, folder: str) -> tuple[int, int]:
    conf = config.load(path)
    item_rows = config.items(spark, conf["inputs"], folder)
    count = item_rows.agg(F.count("*"), F.max(F.size("outputs"))).first()
    envs = 1
    for values in conf.get("grid", {}).values():
        envs *= len(values)
    repeats = conf["repeats"]
    return planning.call_counts(envs * count[0] * (count[1] or 0), int(repeats["n"]), int(repeats.get("max_attempts_factor", 2)))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command; the session is the given one or the active one."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tremorscope").getOrCreate()
    if args.command == "analyze":
        for name, rows in _tables(spark, args).items():
            rows.write.mode("overwrite").parquet(f"{args.out}/{args.what}/{name}")
            print(f"{args.out}/{args.what}/{name}")
    elif args.command == "validate":
        good, broken = records.read(spark, args.store)
        counts = good.count(), broken.count()
        records.set_aside(broken, args.store)
        print(f"{counts[0]} records, {counts[1]} broken last lines")
    elif args.command == "calls":
        print("{} to {} calls".format(*_calls(spark, args.config, args.inputs)))
    else:
        _show(cost.ledger_total(inputs.ledger(spark, args.ledger)).orderBy("experiment"))
    return 0


def _show(rows: DataFrame) -> None:
    for r in rows.collect():  # a row for each experiment
        print("\t".join("" if x is None else str(x) for x in r))


if __name__ == "__main__":
    raise SystemExit(main())
