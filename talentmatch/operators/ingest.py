"""Source fallback - the first source, in priority order, that has rows.

Sources are probed one after the other (``isEmpty`` stops at the first row),
and only the chosen one is returned, so the others are never computed in
full.  With no rows anywhere the last source is returned, empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_nonempty(*sources: DataFrame) -> DataFrame:
    for source in sources[:-1]:
        if not source.isEmpty():
            return source
    return sources[-1]
