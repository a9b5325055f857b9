"""Job arguments, their defaults, and names derived from one prefix."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from weirline.operators.mapping import FieldMapping

# The customer mapping, date pattern, key columns, stamp column
# and partition keys that decide what the curated table holds.
CUSTOMER_MAPPING = (
    FieldMapping("customer_id", "string", "customer_id", "int"),
    FieldMapping("first_name", "string", "first_name", "string"),
    FieldMapping("last_name", "string", "last_name", "string"),
    FieldMapping("email", "string", "email", "string"),
    FieldMapping("ssn", "string", "ssn", "string"),
    FieldMapping("region", "string", "region", "string"),
    FieldMapping("signup_date", "string", "signup_date", "string"),
    FieldMapping("annual_spend", "string", "annual_spend", "double"),
)
CUSTOMER_DATES = (("signup_date", "yyyy-MM-dd"),)
CUSTOMER_KEYS = ("customer_id", "email")
STAMP_COLUMN = "ingested_at"
CURATED_PARTITIONS = ("region",)
RAW_PARTITIONS = ("year", "month")

# The arguments a job is started with and cannot do without.
REQUIRED_ARGUMENTS = (
    "JOB_NAME",
    "SOURCE_DATABASE",
    "SOURCE_TABLE",
    "TARGET_PATH",
    "TARGET_DATABASE",
    "TARGET_TABLE",
)


def _listed(names: str) -> tuple[str, ...]:
    return tuple(k.strip() for k in names.split(",") if k.strip())


@dataclass(frozen=True)
class CurateRules:
    """What turns raw text rows into curated rows."""

    mapping: tuple[FieldMapping, ...] = CUSTOMER_MAPPING
    dates: tuple[tuple[str, str], ...] = CUSTOMER_DATES
    keys: tuple[str, ...] = CUSTOMER_KEYS
    stamp: str = STAMP_COLUMN

    def __post_init__(self) -> None:
        object.__setattr__(self, "mapping", tuple(FieldMapping(*m) for m in self.mapping))

    @property
    def raw_columns(self) -> tuple[str, ...]:
        return tuple(m.source for m in self.mapping)


@dataclass(frozen=True)
class LakeNames:
    """Every default name and path of one lake, from a prefix and a storage root."""

    prefix: str
    root: str

    def _named(self, suffix: str) -> str:
        return f"{self.prefix}_{suffix}"

    def _under(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def database(self) -> str:
        return self._named("database")

    @property
    def job(self) -> str:
        return self._named("etl")

    def raw(self, table: str) -> str:
        return self._under("raw", table)

    def cleaned(self, table: str) -> str:
        return self._under("cleaned", table)

    def curated(self, table: str) -> str:
        return self._under("curated", table)

    def quarantine(self, table: str) -> str:
        return self._under("quarantine", table)

    @property
    def results(self) -> str:
        return self._under("results")

    def state(self, job: str) -> str:
        return self._under("state", job)


@dataclass(frozen=True)
class JobConfig:
    """Arguments of one curate job. The first six have no default.

    A bookmarked job takes each raw file once and keeps its progress under
    ``state_path``; any other job curates the whole table on every run.
    With ``added_columns``, raw files may have columns after the known ones.
    Lines that do not fit their header are counted and left out. With ``quarantine_path``
    they are kept there by file and line, and with ``max_faults`` a run with more of them
    writes nothing else. ``choice_columns`` are curated text columns whose values may have
    several types; each type found gets a column of its own.
    With ``merge_batches``, so many finished batches of a partition value are merged into one
    after a run, and what they replace is deleted by the next run.
    ``max_bytes`` or ``max_files`` cut a large backlog into several commits, so that
    a failure repeats no more than one of them; each commit has its own time stamp.
    """

    job_name: str
    source_database: str
    source_table: str
    target_path: str
    target_database: str
    target_table: str
    bookmark: bool = True
    state_path: str | None = None
    cleaned_path: str | None = None
    partition_keys: tuple[str, ...] = CURATED_PARTITIONS
    cleaned_partition_keys: tuple[str, ...] = RAW_PARTITIONS
    rebalance: bool = True
    raw_pattern: str = "*"
    added_columns: bool = False
    max_files: int | None = None
    max_bytes: int | None = None
    quarantine_path: str | None = None
    max_faults: int | None = None
    choice_columns: tuple[str, ...] = ()
    merge_batches: int | None = None
    rules: CurateRules = CurateRules()

    def __post_init__(self) -> None:
        empty = [name for name in REQUIRED_ARGUMENTS if not getattr(self, name.lower())]
        if empty:
            raise ValueError(f"arguments must not be empty: {empty}")
        if self.bookmark and not self.state_path:
            raise ValueError("a bookmarked job needs state_path, shared storage for its progress")
        if self.merge_batches is not None and (self.merge_batches < 2 or not self.bookmark):
            raise ValueError("merge_batches takes two or more, and a bookmarked job")

    @property
    def source(self) -> str:
        return f"{self.source_database}.{self.source_table}"

    @property
    def staged(self) -> bool:
        """Whether shaped rows are written once and read again, instead of each sink reading raw files."""
        return bool(self.cleaned_path or self.quarantine_path or self.choice_columns) or self.max_faults is not None

    @property
    def target(self) -> str:
        return f"{self.target_database}.{self.target_table}"

    @classmethod
    def for_lake(cls, names: LakeNames, table: str = "customers", **overrides) -> JobConfig:
        """The default job of a lake: raw ``table`` to ``curated_<table>``."""
        values = {
            "job_name": names.job,
            "source_database": names.database,
            "source_table": table,
            "target_path": names.curated(table),
            "target_database": names.database,
            "target_table": f"curated_{table}",
            "state_path": names.state(names.job),
        }
        return cls(**{**values, **overrides})

    @classmethod
    def from_arguments(cls, argv: Sequence[str]) -> JobConfig:
        """Parse ``--NAME value`` job arguments; unknown arguments are ignored.

        With ``--PREFIX`` and ``--ROOT`` all names and paths have the defaults of
        that lake, its cleaned zone included; without them the first six are
        required. A job is incremental unless told otherwise, and then keeps its
        state beside its target unless told where.
        """
        parser = argparse.ArgumentParser(prog="weirline", allow_abbrev=False)
        lake = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
        lake.add_argument("--PREFIX")
        lake.add_argument("--ROOT")
        lake.add_argument("--TABLE", default="customers")
        given, argv = lake.parse_known_args(list(argv))
        defaults: dict[str, str] = {}
        if given.PREFIX and given.ROOT:
            names = LakeNames(given.PREFIX, given.ROOT)
            job = cls.for_lake(names, given.TABLE)
            defaults = {name: getattr(job, name.lower()) for name in REQUIRED_ARGUMENTS}
            defaults |= {"STATE_PATH": job.state_path, "CLEANED_PATH": names.cleaned(given.TABLE)}
        for name in REQUIRED_ARGUMENTS:
            parser.add_argument(f"--{name}", required=name not in defaults, default=defaults.get(name))
        parser.add_argument("--STATE_PATH", default=defaults.get("STATE_PATH"))
        parser.add_argument("--CLEANED_PATH", default=defaults.get("CLEANED_PATH"))
        parser.add_argument("--MAX_BYTES", type=int)
        parser.add_argument("--MAX_FILES", type=int)
        parser.add_argument("--QUARANTINE_PATH")
        parser.add_argument("--MAX_FAULTS", type=int)
        parser.add_argument("--CHOICE_COLUMNS", default="")
        parser.add_argument("--MERGE_BATCHES", type=int)
        parser.add_argument("--PARTITION_KEYS", default=",".join(RAW_PARTITIONS))
        parser.add_argument("--CURATED_PARTITION_KEYS", default=",".join(CURATED_PARTITIONS))
        parser.add_argument("--RAW_PATTERN", default="*")
        parser.add_argument("--ADDED_COLUMNS", action="store_true")
        parser.add_argument("--NO_REBALANCE", action="store_true")
        parser.add_argument(
            "--job-bookmark-option",
            dest="bookmark",
            choices=("job-bookmark-enable", "job-bookmark-disable"),
            default="job-bookmark-enable",
        )
        args, _ = parser.parse_known_args(list(argv))
        bookmark = args.bookmark == "job-bookmark-enable"
        return cls(
            **{name.lower(): getattr(args, name) for name in REQUIRED_ARGUMENTS},
            bookmark=bookmark,
            state_path=args.STATE_PATH or (args.TARGET_PATH.rstrip("/") + ".state" if bookmark else None),
            cleaned_path=args.CLEANED_PATH,
            max_bytes=args.MAX_BYTES,
            max_files=args.MAX_FILES,
            quarantine_path=args.QUARANTINE_PATH,
            max_faults=args.MAX_FAULTS,
            choice_columns=_listed(args.CHOICE_COLUMNS),
            merge_batches=args.MERGE_BATCHES,
            raw_pattern=args.RAW_PATTERN,
            added_columns=args.ADDED_COLUMNS,
            rebalance=not args.NO_REBALANCE,
            partition_keys=_listed(args.CURATED_PARTITION_KEYS),
            cleaned_partition_keys=_listed(args.PARTITION_KEYS),
        )
