"""Scanning texts for private details by pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

Pattern = tuple[str, str]


def scan_patterns(df: DataFrame, id_col: str, text_col: str, patterns: Sequence[Pattern] = fixed.PRIVATE_PATTERNS) -> DataFrame:
    """``(id, line_no, line, pattern, match)`` for every match of the named regular expressions, case ignored.

    A text is tested once as a whole against all patterns together; only texts with a match are cut into lines.
    """
    together = "(?i)" + "|".join(f"(?:{p})" for _, p in patterns)
    cut = F.when(F.col("text").rlike(together), F.split("text", "\n"))
    lines = (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", F.posexplode_outer(cut).alias("pos", "line"))
        .where(F.col("line").rlike(together))
    )
    checks = F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all("line", F.lit(f"(?i)({p})"), F.lit(1)).alias("matches"))
        for name, p in patterns
    ])
    found = lines.select("id", (F.col("pos") + 1).cast("long").alias("line_no"), "line", F.explode(checks).alias("c"))
    return found.select("id", "line_no", "line", "c.pattern", F.explode("c.matches").alias("match"))


def pattern_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("pattern").agg(F.count("*").alias("matches"), F.count_distinct("id").alias("texts"))
