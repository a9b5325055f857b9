"""Job script, for ``spark-submit``: ``--JOB_NAME … --SOURCE_DATABASE …``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from weirline.config import JobConfig
from weirline.plans import run_arrivals, run_batch


def main(argv: list[str]) -> None:
    config = JobConfig.from_arguments(argv)
    spark = SparkSession.builder.appName(config.job_name).getOrCreate()
    print(f"reading {config.source}")
    spark.table(config.source).printSchema()
    if config.bookmark:
        report = run_arrivals(spark, config)
        counts = report.counts
        if report.deleted is not None:
            # Printed as they come, a part of the report at a time.
            for row in report.deleted.toLocalIterator():
                print(f"partition without files: {row.partition}")
    else:
        counts = run_batch(spark, config)
    print(f"raw rows: {counts.raw_rows}, cleaned rows: {counts.clean_rows}, written to {config.target_path}")
    if counts.faults:
        print(f"lines that do not fit their header: {counts.faults}")


if __name__ == "__main__":
    main(sys.argv[1:])
