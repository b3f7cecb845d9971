"""python -m tidemark inspect BUNDLE TABLE...  |  python -m tidemark run SPEC.json BUNDLE OUT"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.plans import compile_task
from tidemark.session import SETTINGS
from tidemark.sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("inspect", help="row and column counts of a bundle")
    p.add_argument("bundle")
    p.add_argument("tables", nargs="+")
    p = sub.add_parser("run", help="compile, score and gate one task")
    p.add_argument("spec")
    p.add_argument("bundle")
    p.add_argument("out")
    p.add_argument("--test", action="store_true", help="there is a test split as well")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("tidemark")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    if args.command == "inspect":
        tables.bundle_profile(tables.read_bundle(spark, args.bundle, args.tables)).show(1000, truncate=False)
        return
    spec = compile_task.TaskSpec.read(args.spec)
    names = {spec.child_table, *([spec.entity_table] if spec.entity_table else []), *(t for b in spec.blocks for t in b["tables"])}
    splits = ["train", "val", *(["test"] if args.test else [])]
    data = tables.read_bundle(spark, args.bundle, sorted(names), splits)
    targets = {s: data.pop(f"target_{s}") for s in splits}
    chosen, decision, runs, edges = compile_task.run_task(spark, spec, targets, data)
    for split, matrix in chosen.items():
        tables.write_table(matrix, f"{args.out}/matrix_{split}.parquet")
    if runs is not None:
        tables.write_csv(runs, f"{args.out}/runs")
    for split in splits[1:]:
        tables.write_table(compile_task.predictions(spec, chosen, split), f"{args.out}/predictions_{split}.parquet")
    told = {"task": spec.name, **decision.asDict(), "edges": "; ".join(f"{a}->{b}" for a, b in edges)}
    tables.write_csv(spark.createDataFrame([{k: str(v) for k, v in told.items()}]), f"{args.out}/decision")
    features = compile_task.feature_columns(spec, chosen["train"])
    tables.write_csv(spark.createDataFrame([(c,) for c in features], "feature string"), f"{args.out}/manifest")
    print(decision.asDict(), "edges:", edges)


if __name__ == "__main__":
    main()
