"""Command line: python -m lavra profile|mask|map|overlap|compare ... (MSK-11, STA-13)."""

from __future__ import annotations

import argparse
import json

from lavra.session import local_session, ship


def parse(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lavra")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("profile", help="column profile of a parquet table")
    a.add_argument("table")
    a.add_argument("out")
    a = sub.add_parser("mask", help="pseudonymise a parquet table by {column: rule}")
    a.add_argument("table")
    a.add_argument("rules", help='JSON file; a rule is manter, texto_livre, valor, data, contador, or {"entity": category}')
    a.add_argument("order", help="column that gives the order of first appearance")
    a.add_argument("out")
    a.add_argument("--days", type=int, default=365)
    a = sub.add_parser("map", help="map the columns of a CSV to dictionaries {category: {value: code}}")
    a.add_argument("csv")
    a.add_argument("dictionaries")
    a.add_argument("plan", help='JSON file: [["column", "category"], ...]')
    a.add_argument("out")
    a.add_argument("--similarity-threshold", type=float, default=0.92)
    a.add_argument("--max-suggestions", type=int, default=3)
    a = sub.add_parser("compare", help="compare results_*.json of several models")
    a.add_argument("results", help="glob")
    a.add_argument("out")
    a.add_argument("--metric", default="f1")
    a.add_argument("--vs-best", action="store_true")
    a.add_argument("--difficulty")
    a.add_argument("--cluster")
    got = p.parse_args(args)
    if got.job == "map" and not 0 <= got.similarity_threshold <= 1:
        p.error("the similarity threshold lies in 0..1")
    if got.job == "map" and got.max_suggestions < 1:
        p.error("at least one suggestion")
    return got


def run(got: argparse.Namespace) -> None:
    from lavra.operators import mapping, masking, profile
    from lavra.plans import benchmark
    from lavra.session import materialize
    from lavra.sources import files

    spark = local_session()
    ship(spark)
    if got.job == "profile":
        files.write_csv(profile.profile(spark.read.parquet(got.table), 100_000), got.out)
    elif got.job == "mask":
        df = spark.read.parquet(got.table)
        with open(got.rules, encoding="utf-8") as f:
            rules = {c: masking.Entity(r["entity"]) if isinstance(r, dict) else masking.Counter() if r == "contador" else r for c, r in json.load(f).items()}
        coded = any(isinstance(r, (masking.Entity, masking.Counter)) for r in rules.values())
        codes = materialize(masking.dictionary([(df, got.order, rules)]), "codes") if coded else None
        masking.mask(df, rules, codes, got.order, got.days).write.mode("overwrite").parquet(f"{got.out}/table")
        if codes is not None:
            codes.write.mode("overwrite").parquet(f"{got.out}/dictionary")
    elif got.job == "map":
        from pyspark.sql import functions as F

        rows = files.read_csv_text(spark, got.csv).withColumn("__at", F.monotonically_increasing_id())
        rows = materialize(rows, "rows")
        with open(got.dictionaries, encoding="utf-8") as f:
            listed = [(c, k, v, n) for c, m in json.load(f).items() if not c.startswith("_counter_") for n, (k, v) in enumerate(m.items())]
        with open(got.plan, encoding="utf-8") as f:
            plan = [tuple(x) for x in json.load(f)]
        refs = spark.createDataFrame(listed, "category string, key string, code string, ord bigint")
        done = mapping.run_plan(rows, "__at", plan, refs, default=mapping.FuzzyRule(got.similarity_threshold, True))
        files.write_csv(done["rows"].drop("__at"), f"{got.out}/mapped")
        for name in ("report", "similar", "unmapped"):
            files.write_csv(done[name], f"{got.out}/{name}")
    else:
        results = files.per_query_metric(files.read_results(spark, got.results), got.metric, got.difficulty, got.cluster)
        renamed = results.withColumnsRenamed({"id": "query_id", "value": got.metric})
        table = benchmark.compare_models(renamed, got.metric, got.vs_best)
        files.write_csv(table, got.out)


if __name__ == "__main__":
    run(parse())
