"""Columns by their whole names, and helper names that no column of the caller has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(frames: DataFrame | list[DataFrame], *names: str) -> list[str]:
    """These names, each followed by as many underscores as make it differ from every column of the frames in any case."""
    frames = [frames] if isinstance(frames, DataFrame) else frames
    taken, out = {c.lower() for f in frames for c in f.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
