from weirline.operators.cleaning import append_column, drop_missing, filter_rows, keys_present, replace_column
from weirline.operators.counts import counts_from_footers, first_rows, grouped_count, observe_rows, row_counts
from weirline.operators.mapping import FieldMapping, apply_mapping, select_all
from weirline.operators.resolve import make_columns, observed_types, resolve_choice

__all__ = [
    "FieldMapping",
    "append_column",
    "apply_mapping",
    "counts_from_footers",
    "drop_missing",
    "filter_rows",
    "first_rows",
    "grouped_count",
    "keys_present",
    "make_columns",
    "observe_rows",
    "observed_types",
    "replace_column",
    "resolve_choice",
    "row_counts",
    "select_all",
]
