"""Catalogues whose track ids may be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_row(tracks: DataFrame) -> Column:
    """Of the rows of an id the one that comes first by all columns in order of name, nulls last.

    The choice does not hang on which columns are wanted, so all measures of an id are of one row.
    """
    ordered = sorted(f.name for f in tracks.schema.fields if f.name != "track_id" and not isinstance(f.dataType, T.MapType))
    return F.min(F.struct(*[x for c in ordered for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]))
