"""Extracts that come as a fixed-width geography and several delimited segments of counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.sources.files import Field, read_delimited, read_fixed_width

# The columns by which the records of a geography and of its segments belong together, and the level.
RECORD = ("STUSAB", "LOGRECNO")
LEVEL = "SUMLEV"


@dataclass(frozen=True)
class Segment:
    """Headerless files of one segment; a path may be a folder or a glob over the states. Columns of ``texts`` stay text, others are whole numbers."""

    path: str
    names: Sequence[str]
    texts: Sequence[str] = ("FILEID", "STUSAB", "CHARITER", "CIFSN", "LOGRECNO")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType() if n in self.texts else T.LongType()) for n in self.names])


@dataclass(frozen=True)
class Extract:
    """One delivery: the geography of all its states, the layout of that file, and the segments."""

    geography: str
    layout: Sequence[Field]
    segments: Sequence[Segment]


def read_extract(spark: SparkSession, extract: Extract, counts: Mapping[str, str], levels: Sequence[str],
                 places: Sequence[str]) -> DataFrame:
    """Counts of the records of some summary levels with their places, over all states and segments at once.

    ``counts`` maps columns of the segments to the names they get; each is looked for in the segments in turn, and a segment
    without any is not read. ``places`` are columns of the geography. Records of other levels are dropped in the scan of the
    geography, before anything is shuffled; of a segment only the named columns are parsed. All joins are on (state, record),
    so the result of one is already where the next needs it. A record that a segment lacks has NULL counts there; one that
    none of them has, or that has no geography, is not in the result. Record numbers that repeat in a file pair up
    as in any join.
    """
    have = {n for s in extract.segments for n in s.names}
    unknown = [c for c in counts if c not in have] + [c for c in places if c not in {f.name for f in extract.layout}]
    if unknown:
        raise ValueError(f"no column {', '.join(unknown)}")
    where = list(dict.fromkeys(c for c in (*places, LEVEL) if c not in RECORD))
    rows = read_fixed_width(spark, extract.geography, extract.layout).where(F.col(LEVEL).isin(list(levels))).select(*RECORD, *where)
    left, marks = dict(counts), []
    for i, segment in enumerate(extract.segments):
        mine = [c for c in left if c in segment.names]
        if not mine:
            continue
        read = read_delimited(spark, segment.path, segment.schema(), header=False)
        mark = f"_in{i}"
        rows = rows.join(read.select(*RECORD, *[F.col(c).alias(left.pop(c)) for c in mine], F.lit(True).alias(mark)), list(RECORD), "left")
        marks.append(mark)
    seen = F.coalesce(*marks) if marks else F.lit(True)
    return rows.where(seen).select(*RECORD, *where, *counts.values())


def stack_extracts(spark: SparkSession, extracts: Mapping[str, Extract], counts: Mapping[str, str], levels: Sequence[str],
                   places: Sequence[str], source: str = "SOURCE") -> DataFrame:
    """Several deliveries of the same counts, one under the other, with the label of each in ``source``."""
    if not extracts:
        raise ValueError("no extract")
    parts = [read_extract(spark, e, counts, levels, places).withColumn(source, F.lit(label)) for label, e in extracts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
