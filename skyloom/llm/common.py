"""What several operators for training data share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """One spelling of a source name: lower case, words joined by underscores; blank is null."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")
    return F.when(key != "", key)
