"""weirline: a governed, incremental raw-to-curated data lake on PySpark."""

__version__ = "0.1.0"
