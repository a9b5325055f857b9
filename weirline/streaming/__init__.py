from weirline.streaming.accepted import AcceptedFiles
from weirline.streaming.gate import DiscoveryFailed, TooManyFaults, require_layouts
from weirline.streaming.ingest import RAW_ROWS, RunCounts, ingest_into, raw_stream

__all__ = [
    "RAW_ROWS",
    "AcceptedFiles",
    "DiscoveryFailed",
    "RunCounts",
    "TooManyFaults",
    "ingest_into",
    "raw_stream",
    "require_layouts",
]
