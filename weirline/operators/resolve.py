"""Mixed-type columns: one output column for each type found in the values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

from weirline.functions import field, strict_cast

# Most specific first. A value goes to the first type that can hold it, and
# string, which holds every value, comes last.
SPECIFICITY = ("boolean", "int", "bigint", "double", "date", "timestamp", "string")
DEFAULT_TYPES = ("int", "bigint", "double", "string")

# Casting takes "1" and "y" for true, "1d" for 1.0, "2023" for a date and drops
# the time of day; such text is not of that type.
_TEXT_SHAPES = {
    "boolean": "^(?i:true|false)$",
    "double": r"[^dDfF]$|(?i:inf)$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}([ T].+)?$",
}

# Which variant kinds may feed a typed column. Checked before extraction, since
# extraction itself would convert (for example truncate 1.5 to 1).
_VARIANT_KINDS = {
    "boolean": "^BOOLEAN$",
    "int": "^BIGINT$",
    "bigint": "^BIGINT$",
    "double": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "date": "^DATE$",
    "timestamp": "^(TIMESTAMP|TIMESTAMP_NTZ|DATE)$",
}


def _ordered(types: Sequence[str]) -> list[str]:
    unknown = sorted(set(types) - set(SPECIFICITY))
    if unknown:
        raise ValueError(f"types that cannot be resolved: {unknown}")
    wanted = set(types) | {"string"}
    return [t for t in SPECIFICITY if t in wanted]


def _from_text(column: Column, data_type: str) -> Column:
    """A cast that leaves out text which casting would shorten or reinterpret."""
    value = strict_cast(column, data_type)
    if data_type in _TEXT_SHAPES:
        return F.when(F.trim(column).rlike(_TEXT_SHAPES[data_type]), value)
    return value


def _candidates(df: DataFrame, name: str, types: Sequence[str]) -> dict[str, Column]:
    """For each type, the value in that type, or null where it does not fit."""
    column = field(name)
    data_type = df.schema[name].dataType
    if isinstance(data_type, StringType):
        return {t: _from_text(column, t) for t in types}
    if isinstance(data_type, VariantType):
        kind = F.schema_of_variant(column)
        return {
            t: F.try_variant_get(column, "$", t)
            if t == "string"
            else F.when(kind.rlike(_VARIANT_KINDS[t]), F.try_variant_get(column, "$", t))
            for t in types
        }
    raise ValueError(f"column {name} has one type already: {data_type.simpleString()}")


def _type_of_value(df: DataFrame, name: str, types: Sequence[str]) -> Column:
    fits = _candidates(df, name, types)
    return F.coalesce(*[F.when(fits[t].isNotNull(), F.lit(t)) for t in types])


def make_columns(df: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """Split each mixed column into ``<column>_<type>`` columns.

    Every value lands in exactly one of them, the most specific that holds it;
    ``string`` is always among them, so that no value is lost. The new columns
    stand where the mixed column stood. Works on batch and streaming frames.
    """
    unknown = sorted(set(choices) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    output: list[Column] = []
    for name in df.columns:
        if name not in choices:
            output.append(field(name))
            continue
        types = _ordered(choices[name])
        fits = _candidates(df, name, types)
        landed = _type_of_value(df, name, types)
        output += [F.when(landed == t, fits[t]).alias(f"{name}_{t}") for t in types]
    resolved = df.select(*output)
    if len(set(resolved.columns)) != len(resolved.columns):
        raise ValueError("a split column would take the name of another column")
    return resolved


def observed_types(
    df: DataFrame, columns: Sequence[str], types: Sequence[str] = DEFAULT_TYPES
) -> dict[str, list[str]]:
    """The types that really occur in each column: one aggregate over the data."""
    ordered = _ordered(types)
    flags = [
        F.coalesce(F.bool_or(_type_of_value(df, name, ordered) == t), F.lit(False)).alias(f"{i}:{t}")
        for i, name in enumerate(columns)
        for t in ordered
    ]
    found = df.agg(*flags).first()
    return {name: [t for t in ordered if found[f"{i}:{t}"]] for i, name in enumerate(columns)}


def resolve_choice(
    df: DataFrame, columns: Sequence[str] | None = None, types: Sequence[str] = DEFAULT_TYPES
) -> DataFrame:
    """Find the mixed columns among ``columns`` and split only those.

    A column whose values all have one type is left as it is. By default every
    variant column is looked at; text columns are looked at when named.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, VariantType)]
    if not columns:
        return df
    found = observed_types(df, columns, types)
    mixed = {name: kinds for name, kinds in found.items() if len(kinds) > 1}
    return make_columns(df, mixed) if mixed else df
