"""Nothing is curated unless discovery accepts every file."""

from __future__ import annotations

from collections.abc import Sequence

from weirline.sources.layouts import Layout


class DiscoveryFailed(RuntimeError):
    """Discovery found files that do not belong to the table."""


class TooManyFaults(RuntimeError):
    """More lines do not fit their header than the job lets pass."""


def require_layouts(
    layouts: Sequence[Layout], columns: Sequence[str], required: Sequence[str] | None = None
) -> list[str]:
    """Check header lines against the table's columns; give the columns to read.

    Columns bind by position, so each header must be ``columns`` exactly. Where
    ``required`` is given, headers and table may differ in how many columns they
    have: none may contradict another, and each has at least the required ones.
    """
    columns = list(columns)
    reading = columns
    if required is not None:
        reading = max([columns, *(list(x.columns) for x in layouts)], key=len)

    def fits(layout: Layout) -> bool:
        own = list(layout.columns)
        if required is None:
            return own == columns
        return own == reading[: len(own)] and set(required) <= set(own)

    bad = [x for x in layouts if not fits(x)]
    if bad or columns != reading[: len(columns)]:
        shown = "; ".join(f"{x.files} file(s) such as {x.example} start with {x.header!r}" for x in bad[:5])
        raise DiscoveryFailed(f"{len(bad)} header(s) do not match {columns}: {shown}")
    return reading
