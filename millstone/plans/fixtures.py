"""The test mapping of the supplied ``documents`` table onto the four
corpus sources of the original pipeline (src0-4 wiki, src5-9 namu,
src10-14 culturax, src15-19 stories)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPPED_SOURCES = ["wiki", "namu", "culturax", "stories"]
SYNTHETIC = ["stories"]
THRESHOLDED = ["wiki", "namu", "culturax"]


def mapped_source(col: str = "source") -> Column:
    i = F.substring(F.col(col), 4, 10).cast("int")
    return (F.when(i < 5, "wiki").when(i < 10, "namu").when(i < 15, "culturax").otherwise("stories"))


def mapped_source_sql(col: str = "source") -> str:
    i = f"CAST(substr({col}, 4) AS INTEGER)"
    return (f"(CASE WHEN {i} < 5 THEN 'wiki' WHEN {i} < 10 THEN 'namu' "
            f"WHEN {i} < 15 THEN 'culturax' ELSE 'stories' END)")
