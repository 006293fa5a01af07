"""python -m tallyweave -f FILE [-d SEPARATOR] [-o REPORT]: profile a table and write the report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyweave.operators.profile import profile
from tallyweave.plans import report
from tallyweave.sources.delimited import _path, read_any, read_table


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave", description="Profile a table.")
    parser.add_argument("-f", "--file", required=True)
    parser.add_argument("-d", "--delimiter")
    parser.add_argument("-o", "--output", default="profile.html")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tallyweave").getOrCreate()
    where, fs = _path(spark, given.file)
    if not fs.exists(where):
        print(f"There is no file {given.file}.")
        return 1
    df = read_any(spark, given.file, given.delimiter) if given.delimiter else read_table(spark, given.file)
    result = profile(df)
    report.write(report.profile_html(result, given.file), given.output)
    print(f"{report.human_number(result['total_rows'])} rows, {result['total_cols']} columns: {given.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
