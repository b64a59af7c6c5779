"""Sums of doubles that are exact and do not depend on the order of the rows.

A double is a whole number times a power of two. It is cut into three whole numbers at fixed places, multiples of 32
bits, so that numbers of one place add up exactly as decimals, whatever their order and partitioning. At the end the
places of a key, 69 at most, are joined: carried upwards, and rounded once to the nearest double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.functions.geometry import bind

_BITS = 32
_BASE = 1 << _BITS
_ABOVE = 4  # places that carries of up to 10^18 rows can reach
# Places of values that have no whole number; every finite double lies in places -37 to 31.
_PLUS, _MINUS, _NAN = 1000, 1001, 1002


def _cut(rows: DataFrame) -> DataFrame:
    """Adds to every ``_aq_v`` its ``place`` (none for null) and whole numbers ``_aq_p0`` at it, ``_aq_p1``, ``_aq_p2`` below.

    Plain columns one on the other, as this is done for each row: compiled, and no lists or decimals.
    """
    place = f"""
        CASE WHEN _aq_v IS NULL THEN NULL
             WHEN isnan(_aq_v) THEN {_NAN}
             WHEN _aq_v = double('infinity') THEN {_PLUS}
             WHEN _aq_v = double('-infinity') THEN {_MINUS}
             WHEN _aq_v = 0 THEN 0
             ELSE CAST(floor(log2(abs(_aq_v)) / {_BITS}) AS INT) END"""
    half = f"pow(2D, -{_BITS // 2} * place)"  # scaled in two steps, neither under- nor overflows
    scaled = f"CASE WHEN place IS NULL THEN 0D WHEN place >= {_PLUS} THEN 1D ELSE _aq_v * {half} * {half} END"
    cut = rows.withColumn("place", F.expr(place)).withColumn("_aq_x0", F.expr(scaled))
    for k in range(3):
        cut = cut.withColumn(f"_aq_p{k}", F.expr(f"CAST(_aq_x{k} AS BIGINT)"))  # towards zero
        cut = cut.withColumn(f"_aq_x{k + 1}", F.expr(f"(_aq_x{k} - _aq_p{k}) * {_BASE}D"))
    return cut.drop(*[f"_aq_x{k}" for k in range(4)])


def _joined(places: str) -> str:
    """The double nearest to the sum of ``array<struct<place,total>>``; null for an empty array."""
    low, high = f"array_min(transform({places}, p -> p.place))", f"array_max(transform({places}, p -> p.place))"

    def carried(sign: str) -> str:
        total = "coalesce(element_at(a.held, k), CAST(0 AS DECIMAL(38, 0)))"
        here = f"CAST(c.carry {sign} {total} AS DECIMAL(38, 0))"
        step = bind({"x": here}, "d", f"""named_struct(
            'carry', CAST((d.x - pmod(d.x, {_BASE}BD)) div {_BASE}BD AS DECIMAL(38, 0)),
            'digits', concat(c.digits, array(CAST(pmod(d.x, {_BASE}BD) AS BIGINT))))""")
        empty = "named_struct('carry', CAST(0 AS DECIMAL(38, 0)), 'digits', CAST(array() AS ARRAY<BIGINT>))"
        return f"aggregate(sequence(a.low, a.high + {_ABOVE}), {empty}, (c, k) -> {step})"

    digit = "coalesce(get(m.digits, t.top - {0}), 0L)".format
    sticky = "if(exists(transform(m.digits, (d, i) -> d > 0 AND i < t.top - 2), b -> b), 1L, 0L)"
    leading = f"""CAST(CAST({digit(0)} AS DECIMAL(38, 0)) * {_BASE * _BASE}BD + CAST({digit(1)} AS DECIMAL(38, 0)) * {_BASE}BD
        + ({digit(2)} | {sticky}) AS DECIMAL(38, 0))"""
    half = f"pow(2D, {_BITS // 2} * (a.low + t.top - 2))"
    value = f"if(t.top < 0, 0D, m.sign * CAST({leading} AS DOUBLE) * {half} * {half})"
    top = "array_max(transform(m.digits, (d, i) -> if(d > 0, i, -1)))"
    signed = bind({"plus": carried("+"), "minus": carried("-")}, "s", """
        if(s.plus.carry >= 0, named_struct('sign', 1D, 'digits', s.plus.digits), named_struct('sign', -1D, 'digits', s.minus.digits))""")
    held = f"map_from_entries({places})"
    finite = bind({"low": low, "high": high, "held": held}, "a", f"""
        transform(array({signed}), m -> {bind({"top": top}, "t", value)})[0]""")
    has = f"exists({places}, p -> p.place = {{0}})".format
    known = f"""
        CASE WHEN size({places}) = 0 THEN NULL
             WHEN {has(_NAN)} OR ({has(_PLUS)} AND {has(_MINUS)}) THEN double('nan')
             WHEN {has(_PLUS)} THEN double('infinity')
             WHEN {has(_MINUS)} THEN double('-infinity')
             ELSE {finite} END"""
    return known


_SHORT, _SHORT_SUM = "DECIMAL(36, 10)", "DECIMAL(38, 10)"
_TENTHS = 10_000_000_000  # of ten decimals in one
# Below this a value times 10^10 is a whole number under 10^15: if the quotient gives the value back, it is the only
# number of ten decimals that the double can stand for.
_PLAIN = 100_000


def _shorten(rows: DataFrame) -> DataFrame:
    """Adds the decimals that ``_aq_v`` stands for, as ``_aq_tenths`` if it is small (``_aq_plain``), else as ``short``;
    ``whole``: they are all of it."""
    plain = rows.withColumn("_aq_plain", F.expr(f"coalesce(abs(_aq_v) < {_PLAIN}D, true)"))
    found = plain.withColumn(
        "_aq_tenths", F.expr(f"CASE WHEN _aq_plain THEN CAST(rint(_aq_v * {_TENTHS}D) AS BIGINT) END")
    ).withColumn("short", F.expr(f"CASE WHEN NOT _aq_plain THEN try_cast(_aq_v AS {_SHORT}) END"))
    back = f"if(_aq_plain, _aq_tenths / {_TENTHS}D, CAST(short AS DOUBLE))"
    return found.withColumn("whole", F.expr(f"coalesce({back} = _aq_v, _aq_v IS NULL)"))


def _halves(c: str, bits: int) -> list[Column]:
    """Sums of the upper and lower part of a whole number under 2^50, which do not overflow below 2^36 rows."""
    return [F.sum(F.expr(f"shiftright({c}, {bits})")).alias(f"{c}_high"), F.sum(F.expr(f"{c} & {(1 << bits) - 1}L")).alias(f"{c}_low")]


def _whole_sum(c: str, bits: int) -> str:
    return f"CAST(CAST({c}_high AS DECIMAL(20, 0)) * {1 << bits}BD + {c}_low AS DECIMAL(38, 0))"


def exact_sums(df: DataFrame, keys: Sequence[str], values: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, the exact sum of every named value as the nearest double, and per condition in ``counts`` its rows.

    If all values of a key have at most ten decimals and 26 digits before them, as amounts have, what is summed are these
    decimals, which the doubles stand for; else the doubles themselves. A sum without known values is null; one with
    infinities or NaN is what doubles make of them. A result beyond the largest double is infinite. Partial sums are taken
    before the shuffle, so a hot key arrives as a few rows.
    """
    names = list(counts or {})
    given = df.select(*keys, *[c.cast("double").alias(f"_aq_v{k}") for k, c in enumerate(values.values())],
                      *[F.coalesce(c, F.lit(False)).alias(n) for n, c in (counts or {}).items()])
    if len(values) == 1:
        listed = given.select(*keys, *names, F.lit(0).alias("value"), F.col("_aq_v0").alias("_aq_v"))
    else:
        pairs = F.array(*[F.struct(F.lit(k).alias("value"), F.col(f"_aq_v{k}").alias("_aq_v")) for k in range(len(values))])
        listed = given.select(*keys, *names, F.inline(pairs))
    # Rows of one place, and of one way to hold their decimals, add up as whole numbers.
    partial = _shorten(_cut(listed)).groupBy(*keys, "value", "place", "_aq_plain").agg(
        *[c for k in range(3) for c in _halves(f"_aq_p{k}", 16)], *_halves("_aq_tenths", 24), F.try_sum("short").alias("short"),
        F.bool_and("whole").alias("whole"), *[F.count_if(F.col(n) & (F.col("value") == 0)).alias(n) for n in names],
    )
    tenths = f"CAST(CAST({_whole_sum('_aq_tenths', 24)} AS DECIMAL(27, 0)) * 0.0000000001BD AS {_SHORT_SUM})"
    totals = partial.select(
        *keys, "value", "place", *names, F.expr(f"if(_aq_plain, {tenths}, short)").alias("short"),
        F.expr("whole AND (_aq_plain OR short IS NOT NULL)").alias("whole"),  # a sum of decimals that overflows is null
        *[F.expr(_whole_sum(f"_aq_p{k}", 16)).alias(f"_aq_p{k}") for k in range(3)],
    )
    # One row without a place for the decimals and the counts, and one for each of the three places.
    no_decimals = f"'short', CAST(NULL AS {_SHORT_SUM}), 'whole', true" + "".join(f", '{n}', 0L" for n in names)
    entries = [f"named_struct('place', CAST(NULL AS INT), 'part', CAST(0 AS DECIMAL(38, 0)), 'short', short, 'whole', whole"
               + "".join(f", '{n}', `{n}`" for n in names) + ")"]
    entries += [f"named_struct('place', place - {k}, 'part', _aq_p{k}, {no_decimals})" for k in range(3)]
    # What is not finite has one entry, null none.
    upto = f"CASE WHEN place IS NULL THEN 1 WHEN place >= {_PLUS} THEN 2 ELSE 4 END"
    places = totals.select(*keys, "value", F.expr(f"inline(slice(array({', '.join(entries)}), 1, {upto}))")).groupBy(
        *keys, "value", "place"
    ).agg(
        F.sum("part").cast("decimal(38,0)").alias("total"), F.try_sum("short").alias("short"), F.bool_and("whole").alias("whole"),
        *[F.sum(n).alias(n) for n in names],
    )
    found = []
    for k in range(len(values)):
        mine, at = F.col("value") == k, F.col("place").isNotNull()
        found.append(F.collect_list(F.when(mine & at, F.struct("place", "total"))).alias(f"_aq_p{k}"))
        found.append(F.max(F.when(mine & ~at & F.col("whole"), F.col("short"))).alias(f"_aq_s{k}"))
    gathered = places.groupBy(*keys).agg(*found, *[F.sum(n).alias(n) for n in names])
    sums = [F.coalesce(F.col(f"_aq_s{k}").cast("double"), F.expr(_joined(f"_aq_p{k}"))).alias(n) for k, n in enumerate(values)]
    return gathered.select(*keys, *sums, *names)
