import os
import subprocess
import sys
from pathlib import Path

from lake import CLEAN, PARTITIONS, drop

from weirline.__main__ import main
from weirline.catalog import register_partitions, register_raw_table
from weirline.config import CurateRules
from weirline.operators import first_rows, grouped_count
from weirline.operators.governance import AccessRules, Policy
from weirline.plans import answer
from weirline.sinks import ResultStore


def arguments(database, tmp_path, target):
    return [
        "--JOB_NAME", "curate", "--SOURCE_DATABASE", database, "--SOURCE_TABLE", "customers",
        "--TARGET_PATH", str(tmp_path / target), "--TARGET_DATABASE", database, "--TARGET_TABLE", target,
    ]


def test_job_script(spark, tmp_path, database, capsys):
    root = tmp_path / "raw"
    drop(root, "a.csv", [*CLEAN, ",A,B,e,s,r,2023-01-01,1"])
    register_raw_table(spark, f"{database}.customers", str(root), CurateRules().raw_columns, PARTITIONS)
    register_partitions(spark, f"{database}.customers")
    main(arguments(database, tmp_path, "once"))
    assert "raw rows: 9, cleaned rows: 8" in capsys.readouterr().out
    incremental = ["--job-bookmark-option", "job-bookmark-enable", "--STATE_PATH", str(tmp_path / "state")]
    main(arguments(database, tmp_path, "kept") + incremental)
    main(arguments(database, tmp_path, "kept") + incremental)
    assert "raw rows: 0, cleaned rows: 0" in capsys.readouterr().out
    for target in ("once", "kept"):
        assert spark.table(f"{database}.{target}").count() == 8


def test_the_three_analyst_queries(spark, tmp_path, database):
    """Full preview, restricted preview, restricted grouped count, each to its result folder."""
    root = tmp_path / "raw"
    drop(root, "a.csv", CLEAN)
    raw, curated = f"{database}.customers", f"{database}.curated_customers"
    register_raw_table(spark, raw, str(root), CurateRules().raw_columns, PARTITIONS)
    register_partitions(spark, raw)
    main(arguments(database, tmp_path, "curated_customers"))
    allowed = tuple(c for c in CurateRules().raw_columns if c != "ssn")
    rules = AccessRules(
        [
            Policy("alice", "*"),
            Policy("bob", raw, allowed),
            Policy("bob", curated, allowed, "region = 'us-east-1'"),
        ]
    )
    store = ResultStore(str(tmp_path / "results"))

    def header(location):
        return next(Path(location).glob("*.csv")).read_text().splitlines()[0].split(",")

    assert header(answer(spark, rules, "alice", raw, first_rows, store, "preview")) == [
        *CurateRules().raw_columns,
        *PARTITIONS,
    ]
    assert header(answer(spark, rules, "bob", raw, first_rows, store, "preview")) == list(allowed)
    counted = answer(spark, rules, "bob", curated, lambda df: grouped_count(df, "region"), store, "regions")
    assert [tuple(r) for r in store.read(spark, counted, "region string, cnt bigint").collect()] == [("us-east-1", 4)]


def test_workers_need_no_copy_of_the_package(spark, tmp_path):
    """A process started elsewhere, which alone knows where the package is."""
    root = Path(__file__).resolve().parent.parent
    drop(tmp_path / "raw", "a.csv", ["1"], "a")
    script = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from weirline.catalog import discover\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('headers', [x.header for x in discover(spark, {str(tmp_path / 'raw')!r}, {str(tmp_path / 's')!r}).layouts])\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "headers ['a']" in run.stdout, run.stderr[-2000:]
