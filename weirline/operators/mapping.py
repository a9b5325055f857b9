"""Projection by an ordered mapping: select, cast and rename in one step."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DataType

from weirline.functions import field, strict_cast


class FieldMapping(NamedTuple):
    source: str
    source_type: str
    target: str
    target_type: str


def _mapped(m: FieldMapping, actual: DataType, declared: DataType, wanted: DataType) -> Column:
    column = field(m.source)
    # A discovered table may hold a narrower type than the mapping declares;
    # going through the declared type makes both give the same result.
    if actual != declared:
        column = strict_cast(column, m.source_type)
    if declared != wanted:
        column = strict_cast(column, m.target_type)
    return column.alias(m.target)


def apply_mapping(
    df: DataFrame, mappings: Sequence[FieldMapping | tuple], beside: Sequence[str] = ()
) -> DataFrame:
    """Keep the mapped columns, in mapping order; every other column but those ``beside`` them is dropped.

    Values that do not fit the target type become null. A missing source column
    or a target named twice is an error.
    """
    mappings = [FieldMapping(*m) for m in mappings]
    if not mappings:
        raise ValueError("a mapping needs at least one column")
    targets = [m.target for m in mappings]
    repeated = sorted({t for t in targets if targets.count(t) > 1})
    if repeated:
        raise ValueError(f"mapping has repeated target columns: {repeated}")
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [m.source for m in mappings if m.source not in types]
    if missing:
        raise ValueError(f"mapping names source columns that are not present: {missing}")
    return df.select(
        *[
            _mapped(
                m,
                types[m.source],
                DataType.fromDDL(m.source_type),
                DataType.fromDDL(m.target_type),
            )
            for m in mappings
        ],
        *[field(c) for c in beside],
    )


def select_all(df: DataFrame) -> DataFrame:
    return df.select("*")
