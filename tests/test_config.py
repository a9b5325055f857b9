import pytest

from weirline.config import CUSTOMER_MAPPING, JobConfig, LakeNames
from weirline.scratch import new_workspace, shared_folder
from weirline.sinks import ResultStore

ARGUMENTS = [
    "--JOB_NAME=j", "--SOURCE_DATABASE", "db", "--SOURCE_TABLE", "customers", "--TARGET_PATH", "/c",
    "--TARGET_DATABASE", "db", "--TARGET_TABLE", "curated_customers",
]


def test_names_come_from_the_prefix():
    names = LakeNames("acme", "s3a://bucket/")
    config = JobConfig.for_lake(names)
    assert config.source == "acme_database.customers"
    assert config.target == "acme_database.curated_customers"
    assert config.target_path == "s3a://bucket/curated/customers"
    assert config.job_name == "acme_etl" and config.bookmark
    assert names.cleaned("customers") == "s3a://bucket/cleaned/customers"
    assert names.results == "s3a://bucket/results"
    assert config.partition_keys == ("region",) and config.cleaned_partition_keys == ("year", "month")
    assert config.rules.mapping == CUSTOMER_MAPPING


def test_arguments():
    config = JobConfig.from_arguments([*ARGUMENTS, "--extra", "ignored"])
    assert config.source == "db.customers" and config.target == "db.curated_customers" and config.bookmark
    with_state = JobConfig.from_arguments(
        [*ARGUMENTS, "--job-bookmark-option", "job-bookmark-enable", "--STATE_PATH", "/s", "--PARTITION_KEYS", "y, m"]
    )
    assert with_state.bookmark and with_state.cleaned_partition_keys == ("y", "m")
    once = JobConfig.from_arguments([*ARGUMENTS, "--job-bookmark-option", "job-bookmark-disable"])
    assert not once.bookmark and once.state_path is None


def test_arguments_from_a_prefix():
    config = JobConfig.from_arguments(["--PREFIX", "acme", "--ROOT", "/lake", "--ADDED_COLUMNS", "--NO_REBALANCE"])
    assert config.source == "acme_database.customers" and config.target_path == "/lake/curated/customers"
    assert config.cleaned_path == "/lake/cleaned/customers" and config.state_path == "/lake/state/acme_etl"
    assert config.bookmark and config.added_columns and not config.rebalance and config.raw_pattern == "*"


def test_refused_arguments():
    with pytest.raises(SystemExit):
        JobConfig.from_arguments(ARGUMENTS[:-2])
    assert JobConfig.from_arguments(ARGUMENTS).state_path == "/c.state"
    with pytest.raises(ValueError):
        JobConfig("j", "db", "", "/c", "db", "t", bookmark=False)


def test_config_is_frozen():
    with pytest.raises(AttributeError):
        JobConfig.from_arguments(ARGUMENTS).job_name = "other"


def test_workspace_is_in_the_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark) == configured.rstrip("/")
    one, other = new_workspace(spark, "x"), new_workspace(spark, "x")
    assert one != other


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_folder(_Session(spark_master="yarn"))
    assert shared_folder(_Session(spark_master="yarn", spark_checkpoint_dir="hdfs://n/c/")) == "hdfs://n/c"
    local = _Session(**{"spark_master": "local[2]", "spark_sql_warehouse.dir": "file:/w/"})
    assert shared_folder(local) == "file:/w"


def test_results_stay_below_their_root(spark, tmp_path):
    store = ResultStore(str(tmp_path / "results"))
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, "")], "n int, s string")
    location = store.write(df, "first-query")
    assert location.startswith(str(tmp_path / "results" / "first-query"))
    assert store.write(df, "first-query") != location
    assert sorted(map(tuple, store.read(spark, location, "n int, s string").collect())) == [(1, "a,b"), (2, None), (3, "")]
    for name in ("", "../x", "/x", "a/b", "s3://b", ".hidden"):
        with pytest.raises(ValueError):
            store.write(df, name)
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "results" / ".." / "x"), "n int")
