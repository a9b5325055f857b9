"""What a principal may see of a table: columns, rows, and tags.

A governed frame is read back through a view. Without that boundary the analyzer
would resolve a hidden column named in a later ``where`` or ``orderBy`` against
the table underneath. Catalyst merges the view into the reader's query, so
filters and column lists still reach the scan.

This shapes data for readers who go through it. It does not stop anyone who can
read the files themselves, and an expression that fails on purpose may reveal
that a hidden row exists; guard the storage and the session as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.functions import field
from weirline.operators.cleaning import filter_rows

EVERY_TABLE = "*"
SELECT = "SELECT"
DESCRIBE = "DESCRIBE"

# The sensitivity tag and what it may be set to.
SENSITIVITY = "sensitivity"
SENSITIVITY_VALUES = ("public", "internal", "confidential")


class AccessDenied(PermissionError):
    pass


@dataclass(frozen=True)
class Policy:
    """One principal's access to one table, or to every table.

    ``columns=None`` means all columns; ``row_filter=None`` means all rows. The
    row filter may use a column that is not visible.
    """

    principal: str
    table: str
    columns: tuple[str, ...] | None = None
    row_filter: str | None = None
    permissions: frozenset[str] = frozenset({SELECT, DESCRIBE})

    def visible(self, table_columns: Sequence[str]) -> list[str]:
        if self.columns is None:
            return list(table_columns)
        unknown = [c for c in self.columns if c not in table_columns]
        if unknown:
            raise ValueError(f"policy for {self.table} lists unknown columns: {unknown}")
        return list(self.columns)


@dataclass(frozen=True)
class ColumnTag:
    """A sensitivity value on one column of one table."""

    table: str
    column: str
    value: str

    def __post_init__(self) -> None:
        if self.value not in SENSITIVITY_VALUES:
            raise ValueError(f"{SENSITIVITY} is one of {SENSITIVITY_VALUES}, not {self.value}")


@dataclass(frozen=True)
class TagPolicy:
    """A principal sees the columns whose tag is one of ``values``, in any table.

    The values form a set without an order: ``confidential`` does not imply the
    other two. Columns without a tag are hidden.
    """

    principal: str
    values: frozenset[str]
    permissions: frozenset[str] = frozenset({SELECT, DESCRIBE})

    def __post_init__(self) -> None:
        unknown = sorted(set(self.values) - set(SENSITIVITY_VALUES))
        if unknown:
            raise ValueError(f"not a value of {SENSITIVITY}: {unknown}")


class AccessRules:
    """All policies in force. What no policy allows is denied.

    Tables of the catalog go by ``database.table``, in any case.
    """

    def __init__(
        self,
        policies: Iterable[Policy] = (),
        tag_policies: Iterable[TagPolicy] = (),
        tags: Iterable[ColumnTag] = (),
    ) -> None:
        self._policies: dict[tuple[str, str], Policy] = {}
        for p in policies:
            key = p.principal, p.table.lower()
            if key in self._policies:
                raise ValueError(f"two policies for {p.principal} on {p.table}")
            self._policies[key] = p
        self._tag_policies: dict[str, TagPolicy] = {}
        for t in tag_policies:
            if t.principal in self._tag_policies:
                raise ValueError(f"two tag policies for {t.principal}")
            self._tag_policies[t.principal] = t
        self._tags: dict[tuple[str, str], str] = {}
        for tag in tags:
            key = tag.table.lower(), tag.column
            if key in self._tags:
                raise ValueError(f"two tags on {tag.table}.{tag.column}")
            self._tags[key] = tag.value

    @classmethod
    def from_tables(
        cls,
        policies: DataFrame | None = None,
        tag_policies: DataFrame | None = None,
        tags: DataFrame | None = None,
    ) -> AccessRules:
        """Read rules kept as tables. These hold a row per policy or tag, not data.

        Columns: ``principal, table, columns array<string>, row_filter, permissions
        array<string>``; ``principal, values array<string>, permissions array<string>``;
        ``table, column, value``. A row grants its permissions and no others; null
        permissions grant nothing.
        """
        for named in (policies, tag_policies):
            if named is not None and "permissions" not in named.columns:
                raise ValueError("a table of policies needs a column permissions")
        return cls(
            [
                Policy(
                    r.principal,
                    r.table,
                    None if r.columns is None else tuple(r.columns),
                    r.row_filter,
                    frozenset(p.upper() for p in r.permissions or ()),
                )
                for r in (
                    policies.select("principal", "table", "columns", "row_filter", "permissions").collect()
                    if policies is not None
                    else []
                )
            ],
            [
                TagPolicy(r.principal, frozenset(r["values"]), frozenset(p.upper() for p in r.permissions or ()))
                for r in (
                    tag_policies.select("principal", "values", "permissions").collect()
                    if tag_policies is not None
                    else []
                )
            ],
            [
                ColumnTag(r.table, r.column, r.value)
                for r in (tags.select("table", "column", "value").collect() if tags is not None else [])
            ],
        )

    def policy(self, principal: str, table: str, table_columns: Sequence[str], permission: str = SELECT) -> Policy:
        """The rule that applies: the table's own, else every-table, else tags."""
        table = table.lower()
        found = self._policies.get((principal, table)) or self._policies.get((principal, EVERY_TABLE))
        if found is None:
            found = self._by_tags(principal, table, table_columns)
        if found is None or permission not in found.permissions:
            raise AccessDenied(f"{principal} has no {permission} on {table}")
        return found

    def _by_tags(self, principal: str, table: str, table_columns: Sequence[str]) -> Policy | None:
        tag_policy = self._tag_policies.get(principal)
        if tag_policy is None:
            return None
        allowed = tuple(c for c in table_columns if self._tags.get((table, c)) in tag_policy.values)
        if not allowed:
            return None
        return Policy(principal, table, allowed, permissions=tag_policy.permissions)


def restrict(df: DataFrame, policy: Policy) -> DataFrame:
    """Rows first, then columns. Not safe to hand out: no boundary yet."""
    visible = policy.visible(df.columns)
    if policy.row_filter is not None:
        df = filter_rows(df, policy.row_filter)
    return df.select(*[field(c) for c in visible])


def _visible_part(
    spark: SparkSession, rules: AccessRules, principal: str, table: str, source: DataFrame | None, permission: str
) -> DataFrame:
    if source is None:
        # One table has many spellings; rules are looked up by its full name.
        found = spark.catalog.getTable(table)
        source = spark.table(table)
        table = f"{found.database}.{found.name}" if found.database else found.name
    return restrict(source, rules.policy(principal, table, source.columns, permission))


@contextmanager
def _behind_view(df: DataFrame) -> Iterator[str]:
    """A view for as long as it takes to resolve a query on it; no one else can name it later."""
    view = f"governed_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        yield view
    finally:
        df.sparkSession.catalog.dropTempView(view)


def govern(
    spark: SparkSession, rules: AccessRules, principal: str, table: str, source: DataFrame | None = None
) -> DataFrame:
    """The part of ``table`` that ``principal`` may read.

    ``source`` is the frame that holds the table where it is not in the catalog;
    the rules then know it by the name given.
    """
    with _behind_view(_visible_part(spark, rules, principal, table, source, SELECT)) as view:
        return spark.table(view)


def govern_as_view(
    spark: SparkSession,
    rules: AccessRules,
    principal: str,
    table: str,
    view: str,
    source: DataFrame | None = None,
) -> None:
    """Register what ``principal`` may read as a temporary view, for SQL."""
    _visible_part(spark, rules, principal, table, source, SELECT).createOrReplaceTempView(view)


def describe_governed(
    spark: SparkSession, rules: AccessRules, principal: str, table: str, source: DataFrame | None = None
) -> DataFrame:
    """``column_name`` and ``data_type`` of the columns the principal may see."""
    with _behind_view(_visible_part(spark, rules, principal, table, source, DESCRIBE)) as view:
        return spark.sql(f"DESCRIBE TABLE {view}").select(F.col("col_name").alias("column_name"), "data_type")
