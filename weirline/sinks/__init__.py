from weirline.sinks.merging import BatchMerges
from weirline.sinks.results import ResultStore
from weirline.sinks.tables import (
    BATCH_COLUMN,
    append_parquet,
    append_to_table,
    prepare_write,
    replace_batch,
    replace_batch_in_table,
    spread_for_partitions,
)

__all__ = [
    "BATCH_COLUMN",
    "BatchMerges",
    "ResultStore",
    "append_parquet",
    "append_to_table",
    "prepare_write",
    "replace_batch",
    "replace_batch_in_table",
    "spread_for_partitions",
]
