"""Keys as the tables write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def video_key(c: Column | str) -> Column:
    """Upper-case form with ``_`` of a video id: letter case, outer blanks, the separator and a file ending don't matter."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, r"^\s+|(\.[A-Za-z0-9]+)?\s*$", "")
    return F.upper(F.translate(bare, "- ", "__"))


VIDEO_KEY_SQL = "upper(translate(regexp_replace({0}, '^\\s+|(\\.[A-Za-z0-9]+)?\\s*$', '', 'g'), '- ', '__'))"


def millis(c: Column | str) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and infinite values."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(F.abs(c) < F.lit(9e15), F.round(c * 1000).cast("bigint"))
