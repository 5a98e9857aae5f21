"""Text column expressions (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._util import as_col

# The trim class of the JVM String.trim used by the tokenizer being matched
# (all code points 0x00-0x20), and the token separator (one or more whitespace characters).
TRIM_CLASS = r"[\x00-\x20]"
SPLIT_PATTERN = r"\s+"
# ``$`` would also match before a final U+0085 or U+2028, which the trim keeps.
TRIM_RE = rf"\A{TRIM_CLASS}+|{TRIM_CLASS}+\z"


def tokens(text) -> Column:
    """array<string> of tokens: trim chars <= 0x20 at both ends, split on whitespace, drop empties."""
    trimmed = F.regexp_replace(as_col(text), TRIM_RE, "")
    return F.filter(F.split(trimmed, SPLIT_PATTERN), lambda w: w != F.lit(""))
