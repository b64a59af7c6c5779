"""Row filters of the eligibility rules, as boolean columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaqual import constants as K


def valid_lat_lon(latitude: Column, longitude: Column) -> Column:
    """Inclusive ranges; an unknown coordinate passes."""

    def within(c: Column, bound: float) -> Column:
        return c.isNull() | F.isnan(c) | c.between(-bound, bound)

    return within(latitude, 90.0) & within(longitude, 180.0)


def known_lat_lon(latitude: Column, longitude: Column) -> Column:
    """Inclusive ranges; an unknown coordinate does not pass. Each is named once, as a filter repeats all that a column is
    made of, and the JVM does not compile a filter of more than 8,000 bytes."""
    return (F.abs(latitude) <= 90.0) & (F.abs(longitude) <= 180.0)


def differs_or_unknown(c: Column, value: str) -> Column:
    """``c != value`` that keeps null rows."""
    return ~c.eqNullSafe(F.lit(value))


def monthly_period(c: Column) -> Column:
    """Drops annual rows such as ``M13``."""
    return c.between(K.FIRST_MONTH, K.LAST_MONTH)


def closed_coal_mine(status: Column, mine_type: Column, kind: Column, status_date: Column) -> Column:
    return (
        status.isin(K.CLOSED_MINE_STATUSES)
        & mine_type.isin(K.COAL_MINE_TYPES)
        & (kind == K.COAL_KIND)
        & (status_date >= F.lit(f"{K.FIRST_CLOSURE_YEAR}-01-01").cast("timestamp"))
    )


def coal_generator(report_date: Column, fuel_code: Column, technology: Column) -> Column:
    """Coal by fuel code in the early reports, by technology in the later ones."""
    first = F.lit(K.FIRST_GENERATOR_REPORT).cast("timestamp")
    change = F.lit(K.FIRST_TECHNOLOGY_REPORT).cast("timestamp")
    early = (report_date >= first) & (report_date < change) & fuel_code.isin(K.COAL_FUEL_CODES)
    late = (report_date >= change) & technology.isin(K.COAL_TECHNOLOGIES)
    return early | late


def retired(status: Column) -> Column:
    return status == "retired"


def retirement_planned(planned_date: Column, as_of: str) -> Column:
    return planned_date > F.lit(as_of).cast("timestamp")


def fact_of_interest(industry_code: Column, employment: Column, codes: Sequence[str]) -> Column:
    """Total rows and rows of the listed industries whose employment is not zero (unknown passes)."""
    return industry_code.isin([K.TOTAL_INDUSTRY_CODE, *codes]) & ~employment.eqNullSafe(F.lit(0))


def county_title(title: Column) -> Column:
    """False for statistical areas; a null title is dropped by the filter."""
    return ~title.rlike("MSA|CSA")
