"""Fingerprints of whole tables that do not depend on the order of rows, to tell whether a table is still the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["n", "total", "mixed"]


def row_hash(text: Column) -> Column:
    """60 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shape_text(geometry: str) -> Column:
    """A geometry as text: points ``x y`` joined by commas, rings by bars, polygons by semicolons."""
    ring = "array_join(transform(r, p -> concat(string(p.x), ' ', string(p.y))), ',')"
    return F.expr(f"array_join(transform({geometry}, poly -> array_join(transform(poly, r -> {ring}), '|')), ';')")


def table_fingerprint(df: DataFrame, parts: Sequence[Column]) -> DataFrame:
    """One row: ``n`` rows, the ``total`` of their hashes and all of them ``mixed`` by exclusive or.

    A row's hash is that of its parts as text; a missing one counts as the text ``\\N``. A row more or less changes n, one
    that is changed or stands twice in another's place changes the total.
    """
    text = F.concat_ws("#", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    hashed = df.select(row_hash(text).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("h").cast("decimal(28,0)")), F.lit(0)).cast("string").alias("total"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"),
    )


def layer_fingerprint(layer: DataFrame, area_id: str, geometry: str = "area_geometry") -> DataFrame:
    """:func:`table_fingerprint` of the ids and shapes of a layer."""
    return table_fingerprint(layer, [F.col(area_id), shape_text(geometry)])
