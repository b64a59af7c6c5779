"""Text column expressions with the trimming, casing and padding rules of the inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``trim`` only removes blanks; the inputs also carry tabs and no-break spaces.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_lower(c: Column) -> Column:
    return F.lower(strip(c))


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.right(w, F.length(w) - 1))), ""
    )


def strip_title(c: Column) -> Column:
    return title_case(strip(c))


def zero_fill(c: Column, width: int) -> Column:
    """Left-pad with zeros and never shorten (``lpad`` truncates)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def zero_fill_right(c: Column, width: int) -> Column:
    return F.when(F.length(c) < width, F.rpad(c, width, "0")).otherwise(c)
