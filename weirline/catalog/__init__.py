from weirline.catalog.discovery import HeaderLedger, discover, known_headers
from weirline.catalog.kinds import KindLedger, infer_known
from weirline.catalog.names import quoted
from weirline.catalog.partitions import PartitionLedger, add_partitions
from weirline.catalog.tables import (
    add_new_columns,
    create_database,
    deleted_partitions,
    describe_raw_table,
    fit_to_table,
    register_discovered,
    register_partitions,
    register_raw_table,
    schema_rows,
    update_raw_table,
)

__all__ = [
    "HeaderLedger",
    "KindLedger",
    "PartitionLedger",
    "add_new_columns",
    "add_partitions",
    "create_database",
    "deleted_partitions",
    "describe_raw_table",
    "discover",
    "fit_to_table",
    "infer_known",
    "known_headers",
    "quoted",
    "register_discovered",
    "register_partitions",
    "register_raw_table",
    "schema_rows",
    "update_raw_table",
]
