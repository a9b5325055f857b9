from weirline.sources.files import list_files, partition_columns, require_depth
from weirline.sources.layouts import (
    Discovery,
    Layout,
    file_access,
    file_headers,
    find_layouts,
    group_compatible,
    infer_columns,
    read_files,
    read_layouts,
)
from weirline.sources.records import FAULT, FILE, locate
from weirline.sources.scans import scan_parquet, scan_raw_csv, scan_table, text_schema

__all__ = [
    "FAULT",
    "FILE",
    "Discovery",
    "Layout",
    "file_access",
    "file_headers",
    "find_layouts",
    "group_compatible",
    "infer_columns",
    "list_files",
    "locate",
    "partition_columns",
    "read_files",
    "read_layouts",
    "require_depth",
    "scan_parquet",
    "scan_raw_csv",
    "scan_table",
    "text_schema",
]
