"""Command line: ``python -m meridian.cli COMMAND``; results are JSON on standard output.

Vectors are Parquet tables of (id, vec) or .npy matrices, where the row number is the id.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import calibration, gate, mapping, migrate, monitor, recalibration, reports
from meridian.operators.knn import self_ranks
from meridian.sources import models, stores

VERSION = "0.1.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("meridian").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def vectors(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".npy"):
        return stores.read_npy(spark, path).select(F.col("position").alias("id"), "vec")
    return stores.read_parquet(spark, path)


def pairs(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(id, x, y) of ids that both sides have."""
    x, y = vectors(spark, source).select("id", F.col("vec").alias("x")), vectors(spark, target).select("id", F.col("vec").alias("y"))
    return x.join(y, "id")


def show(value) -> None:
    print(json.dumps(value.asDict(recursive=True) if hasattr(value, "asDict") else value, default=str))


def version(args) -> int:
    show({"version": VERSION})
    return 0


def plan(args) -> int:
    spark = session()
    table = spark.createDataFrame([(m, args.d_src, args.d_tgt, args.corpus_size) for m in (args.source_model, args.target_model)], "model string, dim_old long, dim_new long, corpus long")
    rows = {r["model"]: r.asDict() for r in calibration.cost_plan(table).collect()}
    show(rows)
    return 0


def calibrate(args) -> int:
    spark = session()
    both = calibration.holdout(pairs(spark, args.source_vectors, args.target_vectors), args.holdout, args.seed)
    options = {"alpha": args.alpha} if args.alpha is not None else {}
    if args.rank is not None:
        options["rank"] = args.rank
    fitted = mapping.fit(args.kind, both.where("not is_holdout").select("id", "x", "y"), **options)
    from meridian.functions import vec
    from meridian.operators.metrics import retention_report

    mapped = fitted.transform(both.where("is_holdout").select("id", "x", vec.l2_normalize(vec.doubles("y")).alias("t")), "x", "m")
    fitted.validation = retention_report(mapped, "m", "t").first().asDict()
    if args.recalibrate:
        whole = fitted.transform(both.select("id", "x", vec.l2_normalize(vec.doubles("y")).alias("t")), "x", "m")
        fitted.recalibrator = recalibration.fit_isotonic(recalibration.score_pairs(whole, "m", "t", seed=args.seed))
    models.save(spark, fitted, args.output)
    show({"output": args.output, "checksum": fitted.checksum, "validation": fitted.validation})
    return 0


def transform(args) -> int:
    spark = session()
    source = vectors(spark, args.source)
    if "payload" not in source.columns:
        source = source.select(F.col("id").cast("string").alias("id"), "vec", F.lit(None).cast("string").alias("text"), F.create_map().cast("map<string,string>").alias("payload"))
    if args.dry_run:
        show(migrate.dry_run(source).first())
        return 0
    show(migrate.migrate(spark, source, args.target, models.load(spark, args.mapping), args.source).first())
    return 0


def inspect(args) -> int:
    show(models.inspect(session(), args.mapping))
    return 0


def gate_command(args) -> int:
    """0 for PASS, 1 for WARN or FAIL, 2 for input that can't be judged."""
    spark = session()
    try:
        fitted = models.load(spark, args.mapping)
        sample = pairs(spark, args.source_vectors, args.target_vectors)
        if mapping.validate(sample)[1:] != (fitted.d_src, fitted.d_tgt):
            raise mapping.MappingError(f"the map goes from {fitted.d_src} to {fitted.d_tgt} dimensions, the vectors don't")
        both = fitted.transform(sample, "x", "m").withColumn("t", F.col("y").cast("array<double>"))
        report = gate.evaluate(both, "m", "t", holdout_top1=fitted.validation.get("top1_retention"), model=gate.GateModel.load(args.gate_model), thresholds=gate.load_thresholds(args.thresholds))
        if args.bootstrap:
            interval = gate.bootstrap(self_ranks(both, "m", "t"), args.bootstrap)
            entry = F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high"))))
            report = report.crossJoin(interval.agg(entry.alias("interval_80")))
        row = report.first()
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    if args.html:
        with open(args.html, "w", encoding="utf-8") as file:
            file.write(reports.page(row))
    if args.format == "markdown":
        print(reports.markdown(row))
    else:
        show(row)
    return reports.exit_code(row)


def doctor(args) -> int:
    show(stores.doctor(vectors(session(), args.store), args.model).first())
    return 0


def report(args) -> int:
    """Counts of a folder of telemetry lines, by wrapper and in total."""
    events = session().read.schema("ts double, event string, wrapper string").json(args.telemetry)
    rows = monitor.telemetry_summary(events).collect()
    show({"total": sum(r["n"] for r in rows if r["wrapper"] is None), "by_wrapper": {r["wrapper"]: r["n"] for r in rows if r["wrapper"] is not None}})
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meridian", description=__doc__)
    commands = top.add_subparsers(required=True)

    def add(name, run, *options):
        sub = commands.add_parser(name)
        for names, settings in options:
            sub.add_argument(*names, **settings)
        sub.set_defaults(run=run)

    need = lambda name, **more: ((f"--{name}",), {"required": True} | more)
    may = lambda name, **more: ((f"--{name}",), more)
    add("version", version)
    add("plan", plan, need("source-model"), need("target-model"), need("corpus-size", type=int), may("d-src", type=int, default=384), may("d-tgt", type=int, default=1024))
    add("calibrate", calibrate, need("source-vectors"), need("target-vectors"), need("output"), may("kind", default="ridge", choices=sorted(mapping.FITTERS)), may("alpha", type=float), may("rank", type=int), may("holdout", type=float, default=0.1), may("seed", type=int, default=0), may("recalibrate", action="store_true"))
    add("transform", transform, need("source"), need("target"), need("mapping"), may("dry-run", action="store_true"))
    add("inspect", inspect, (("mapping",), {}))
    add("gate", gate_command, need("mapping"), need("source-vectors"), need("target-vectors"), may("format", default="json", choices=["json", "markdown"]), may("html"), may("bootstrap", type=int, default=1000), may("gate-model"), may("thresholds"))
    add("doctor", doctor, (("store",), {}), may("model"))
    add("report", report, (("telemetry",), {}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
