"""The exploration of record tables and their true matches, as small tables and as one HTML report.

    python -m tallyweave.plans.explore --first s1.tsv --pool s2.tsv s3.tsv --truth gt.tsv -o exploration.html
"""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tallyweave.operators import eda, ground_truth
from tallyweave.plans import report
from tallyweave.sources.delimited import _path, read_records, read_truth


def explore(sources: dict[str, DataFrame], truth: DataFrame | None = None, devanagari_country: str = "India", sample_country: str = "France") -> dict[str, list[dict]]:
    """Named lists of rows. The sources are names and record tables, the first source first; all counts are over all of them."""
    first, *pool = sources.values()
    every, others = reduce(DataFrame.unionByName, sources.values()), reduce(DataFrame.unionByName, pool or [first.limit(0)])
    tables = {"Rows": eda.row_counts(sources | ({"truth": truth} if truth is not None else {}))}
    for name, table in sources.items():
        tables[f"Countries of {name}"] = eda.distribution(table)
        tables[f"Missing in {name}"] = eda.missing_fields(table)
    tables |= {
        "Null and empty": eda.null_vs_empty(every),
        "Case": eda.case_variation(every),
        "Scripts": eda.script_classes(every),
        f"Devanagari in {devanagari_country}": eda.devanagari_in_country(every, devanagari_country),
        "Punctuation": eda.punctuation(every),
        "Abbreviations": eda.abbreviations(every),
        "Addresses": eda.address_patterns(every),
        "Lengths": eda.length_stats(every),
        f"Records of {sample_country}": eda.country_rows(every, sample_country, 5).select("entity_id", "business_name", "business_address"),
    }
    if truth is not None:
        pairs = ground_truth.pairs(truth)
        details = ground_truth.pair_details(pairs, first, others)
        tables |= {
            "Matches of a record": ground_truth.match_histogram(truth).orderBy("num_matches"),
            "Pairs by source": ground_truth.pairs_by_source(pairs),
            "Sources of matches": ground_truth.source_combinations(pairs),
            "Pairs across scripts": ground_truth.cross_script(details),
            "First pairs": details.orderBy("source1_entity_id", "target_entity_id").limit(10),
        }
    return {name: [r.asDict() for r in table.collect()] for name, table in tables.items()}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave.plans.explore", description="Explore record tables.")
    parser.add_argument("--first", required=True)
    parser.add_argument("--pool", nargs="+", default=[])
    parser.add_argument("--truth")
    parser.add_argument("-o", "--output", default="exploration.html")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tallyweave").getOrCreate()
    for path in [given.first, *given.pool, *([given.truth] if given.truth else [])]:
        where, fs = _path(spark, path)
        if not fs.exists(where):
            print(f"There is no file {path}.")
            return 1
    began = time.monotonic()
    sources = {path: read_records(spark, path) for path in [given.first, *given.pool]}
    found = explore(sources, read_truth(spark, given.truth) if given.truth else None)
    cards = {r["table_name"]: report.human_number(r["n_rows"]) for r in found["Rows"]} | {"seconds": f"{time.monotonic() - began:.1f}"}
    report.write(report.eda_html(found, cards), given.output)
    print(f"{len(found)} tables: {given.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
