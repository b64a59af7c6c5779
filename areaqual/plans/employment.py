"""The employment rule: fossil share above the threshold and unemployment at or above the nation's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import numeric, predicates, text
from areaqual.operators import aggregates, columns, dedupe, quality
from areaqual.plans import crosswalks
from areaqual.plans.layers import add_area_info, add_geometry
from areaqual.sources.sinks import Store, keep

AREA_YEAR = ["msa_code", "year"]

# The header of the result and its order.
COLUMNS = [
    "county_name", "county_id_fips", "state_id_fips", "state_abbr", "state_name", "geoid", "site_name",
    "qualifying_criteria", "qualifying_area",
]


# --- employment facts ------------------------------------------------------------------------


def clean_facts(raw: DataFrame, codes: Sequence[str] = K.FOSSIL_CODES) -> DataFrame:
    """County rows of the quarterly census that are totals or in one of the industries."""
    df = columns.normalise_headers(raw)
    df = columns.cast_columns(
        df,
        {
            "area_fips": "string", "area_title": "string", "industry_code": "string",
            "year": "int", "own_code": "int", "annual_avg_emplvl": "bigint",
        },
    )
    return (
        df.where(predicates.fact_of_interest(F.col("industry_code"), F.col("annual_avg_emplvl"), codes))
        .where(predicates.county_title(F.col("area_title")))
        .withColumn("county_id_fips", text.zero_fill(F.col("area_fips"), 5))
    )


def employment_facts(
    raw: DataFrame, metro: DataFrame, non_metro: DataFrame, codes: Sequence[str] = K.FOSSIL_CODES
) -> DataFrame:
    """Facts with the statistical area of their county; counties outside both crosswalks drop out.

    Both crosswalks are joined at once, so the fact table is read a single time.
    """
    areas = crosswalks.county_areas(metro, non_metro).withColumnRenamed("msa_name", "_aq_title")
    return clean_facts(raw, codes).join(areas, "county_id_fips").select(
        "msa_code",
        "county_id_fips",
        F.col("_aq_title").alias("area_title"),
        "year",
        "industry_code",
        "own_code",
        "annual_avg_emplvl",
    )


def unmatched_counties(raw: DataFrame, metro: DataFrame, non_metro: DataFrame) -> DataFrame:
    """Counties of the facts that no crosswalk knows; more than ten deserve a warning."""
    return quality.unmatched_keys(clean_facts(raw), crosswalks.county_areas(metro, non_metro), crosswalks.KEY)


def sum_facts(raw: DataFrame, codes: Sequence[str] = K.FOSSIL_CODES) -> DataFrame:
    """Employment per county, year and industry, in or outside the crosswalks. The only shuffle of the fact table is the one
    of these sums, and a county with very many rows arrives as a few."""
    return aggregates.industry_totals(clean_facts(raw, codes), ["county_id_fips", "year"])


# --- fossil share ----------------------------------------------------------------------------

COUNTY_TOTALS = ["msa_code", "county_id_fips", "area_title", "year"]


def county_totals(
    raw: DataFrame, metro: DataFrame, non_metro: DataFrame, codes: Sequence[str] = K.FOSSIL_CODES
) -> DataFrame:
    """Employment per county, year and industry with the statistical area of the county.

    The facts are summed before the crosswalk is joined.
    """
    return totals_in_areas(sum_facts(raw, codes), crosswalks.county_areas(metro, non_metro))


def totals_in_areas(sums: DataFrame, areas: DataFrame) -> DataFrame:
    """:func:`sum_facts` with the statistical area of the county; counties outside drop out."""
    return sums.join(areas.withColumnRenamed("msa_name", "area_title"), "county_id_fips")


def shares_of_totals(totals: DataFrame, codes: Sequence[str] = K.FOSSIL_CODES) -> DataFrame:
    """One row per area, county and year with the share of its area and the flag."""
    shares = aggregates.code_shares(totals, AREA_YEAR, F.col("industry_code").isin(list(codes)))
    counties = totals.groupBy("msa_code", "county_id_fips", "year").agg(F.min("area_title").alias("area_title"))
    return counties.join(shares, AREA_YEAR, "left").withColumn("geoid", F.col("county_id_fips"))


def areas_without_total(shares: DataFrame) -> DataFrame:
    """Areas and years with fossil employment but no total row; worth a warning."""
    missing = F.col("total_employees").isNull() & (F.col("fossil_employees") > 0)
    return shares.where(missing).select(*AREA_YEAR).distinct()


def fossil_share_by_county(
    facts: DataFrame, codes: Sequence[str] = K.FOSSIL_CODES, store: Store = keep
) -> DataFrame:
    """:func:`shares_of_totals` from fact rows that already carry their area."""
    return shares_of_totals(store(aggregates.industry_totals(facts, COUNTY_TOTALS), "industry-totals"), codes)


def shares_by_scenario(totals: DataFrame, scenarios: Mapping[str, Sequence[str]]) -> DataFrame:
    """The share rule under several industry lists at once: ``scenario, msa_code, year, ...``.

    ``totals`` must hold the union of the lists. Only summed rows are repeated, and only for the
    scenarios they matter to.
    """
    relevant = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("is_total") | F.col("industry_code").isin(list(codes)),
                    F.struct(
                        F.lit(name).alias("scenario"), F.col("industry_code").isin(list(codes)).alias("is_part")
                    ),
                )
                for name, codes in scenarios.items()
            ]
        )
    )
    expanded = totals.select("*", F.inline(relevant))
    return aggregates.code_shares(expanded, ["scenario", *AREA_YEAR], F.col("is_part"))


def fossil_share_by_scenario(facts: DataFrame, scenarios: Mapping[str, Sequence[str]]) -> DataFrame:
    """:func:`shares_by_scenario` from fact rows that already carry their area."""
    return shares_by_scenario(aggregates.industry_totals(facts, AREA_YEAR), scenarios)


# --- unemployment ----------------------------------------------------------------------------


def national_rate(raw: DataFrame) -> DataFrame:
    """Yearly national rate and the year it is compared with, the one after."""
    df = columns.normalise_headers(raw, underscore=False)
    df = columns.cast_columns(df.dropna(subset=["year"]), {"year": "int", "value": "double"})
    df = df.withColumn("value", numeric.nan_to_null(F.col("value"))).where(predicates.monthly_period(F.col("period")))
    return (
        df.dropna(subset=["year"])
        .groupBy("year")
        .agg(numeric.round_half_even(F.avg("value"), 1).alias("national_unemployment_rate"))
        .select(
            F.col("year").alias("real_year"),
            "national_unemployment_rate",
            (F.col("year") + 1).alias("applies_to_criteria_year"),
        )
    )


def local_area_table(raw: DataFrame) -> DataFrame:
    """Counties and metropolitan areas of the unemployment survey with their codes taken apart."""
    df = columns.normalise_headers(raw, underscore=False)
    code = F.col("area_code")
    kind = F.substring(code, 1, 2)
    return df.where(kind.isin(K.METRO_AREA_TYPE, K.COUNTY_AREA_TYPE)).withColumns(
        {
            "state_id_fips": F.substring(code, 3, 2),
            "series_id": text.zero_fill_right(F.concat(F.lit("LAU"), F.substring(code, 1, 10)), 18),
            "msa_code": F.when(kind == K.METRO_AREA_TYPE, F.concat(F.lit("C"), F.substring(code, 5, 4))),
            "county_id_fips": F.when(kind == K.COUNTY_AREA_TYPE, F.substring(code, 3, 5)),
        }
    )


def series_headers(raw: DataFrame) -> DataFrame:
    return columns.normalise_headers(raw, underscore=False)


def county_unemployment(raw: DataFrame) -> DataFrame:
    """Yearly mean unemployment and labour force per county, side by side.

    Both measures come out of one aggregate instead of a self-join. Years without an unemployment
    value drop out; a missing labour force stays null.
    """
    df = series_headers(raw)
    series = text.strip(F.col("series_id"))
    measure = F.substring(series, -2, 2)
    df = columns.cast_columns(df, {"year": "int"}).where(
        F.col("year").isNotNull()
        & predicates.monthly_period(F.col("period"))
        & (F.substring(series, 4, 2) == K.COUNTY_AREA_TYPE)
        & measure.isin(K.MEASURE_UNEMPLOYED, K.MEASURE_LABOR_FORCE)
    )
    df = df.select(
        "year",
        series.substr(F.lit(1), F.length(series) - 2).alias("prefix"),
        measure.alias("measure"),
        numeric.to_number(F.col("value").cast("string")).alias("value"),
    )
    means = aggregates.conditional_annual_means(
        df,
        ["prefix", "year"],
        "value",
        {
            "total_unemployment": F.col("measure") == K.MEASURE_UNEMPLOYED,
            "total_labor_force": F.col("measure") == K.MEASURE_LABOR_FORCE,
        },
    )
    return means.dropna(subset=["total_unemployment"]).select(
        F.concat("prefix", F.lit(K.MEASURE_UNEMPLOYED)).alias("series_id"),
        F.substring("prefix", 6, 5).alias("county_id_fips"),
        "year", "total_unemployment", "total_labor_force",
    )


def local_rates(raw: DataFrame, metro: DataFrame, non_metro: DataFrame, store: Store = keep) -> DataFrame:
    """County rows with the unemployment rate of their statistical area and year.

    A county that is in two areas, or has two series in a year, stops the run. With ``store`` the
    yearly county table is written, so the monthly series are read once.
    """
    return yearly_rates(county_unemployment(raw), metro, non_metro, store)


def yearly_rates(yearly: DataFrame, metro: DataFrame, non_metro: DataFrame, store: Store = keep) -> DataFrame:
    """:func:`local_rates` from :func:`county_unemployment`."""
    areas = crosswalks.checked_county_areas(metro, non_metro)
    counties = store(
        quality.require_unique(
            yearly.join(areas, "county_id_fips"),
            ["county_id_fips", "year"],
            "A county has two unemployment series in one year",
        ),
        "county-unemployment",
    )
    rates = aggregates.area_rates(
        counties, AREA_YEAR, "total_unemployment", "total_labor_force", "local_area_unemployment_rate"
    )
    return counties.join(rates, AREA_YEAR, "left")


def counties_without_rates(raw: DataFrame, metro: DataFrame, non_metro: DataFrame) -> DataFrame:
    """Crosswalk counties the unemployment survey does not report."""
    return quality.unmatched_keys(
        crosswalks.county_areas(metro, non_metro), county_unemployment(raw), crosswalks.KEY
    )


def areas_without_rates(areas: DataFrame, local: DataFrame) -> DataFrame:
    """Statistical areas of the crosswalk without a rate in any year; their codes may differ in the survey."""
    return quality.unmatched_keys(areas, local, ["msa_code"])


def unemployment_flags(national: DataFrame, local: DataFrame) -> DataFrame:
    """Compare each local rate with the national rate of the year before."""
    joined = local.join(national, local["year"] == national["applies_to_criteria_year"], "left")
    return joined.withColumns(
        {
            "meets_unemployment_threshold": numeric.flag(
                F.col("local_area_unemployment_rate") >= F.col("national_unemployment_rate")
            ),
            "geoid": F.col("county_id_fips"),
        }
    )


def areas_without_county(flags: DataFrame) -> DataFrame:
    """Statistical areas of the rates that have no county id; worth a warning."""
    return flags.where(F.col("geoid").isNull()).select("msa_code").distinct()


# --- both conditions -------------------------------------------------------------------------


def employment_rule(
    shares: DataFrame,
    unemployment: DataFrame,
    states: DataFrame,
    counties: DataFrame,
    county_layer: DataFrame | None = None,
) -> DataFrame:
    """One row per county that meets both conditions in the same year, from its earliest such year."""
    shares = shares.where(F.col("meets_fossil_employment_threshold") == 1)
    high = unemployment.where(F.col("meets_unemployment_threshold") == 1).select("geoid", "year")
    both = shares.select("geoid", "year", "county_id_fips", "msa_code", "area_title").join(
        high, ["geoid", "year"], "left_semi"
    )
    first = dedupe.keep_first(both, ["geoid"], ["year", "msa_code", "area_title"])
    named = add_area_info(first, "county_id_fips", states, counties)
    tagged = named.withColumnRenamed("area_title", "site_name").withColumns(
        {"qualifying_criteria": F.lit(K.EMPLOYMENT), "qualifying_area": F.lit(K.EMPLOYMENT_AREA)}
    )
    if county_layer is None:
        return tagged.select(*COLUMNS)
    return add_geometry(tagged, county_layer, "county_id_fips").select(*COLUMNS, "area_geometry")


def qualifying_counties(
    totals: DataFrame, national: DataFrame, local: DataFrame, states: DataFrame, counties: DataFrame,
    county_layer: DataFrame | None = None, codes: Sequence[str] = K.FOSSIL_CODES, store: Store = keep,
) -> DataFrame:
    """The whole rule from :func:`county_totals` and the two rates.

    The totals give both the shares and the list of counties. With ``store`` they are written, so
    the facts are read once.
    """
    shares = shares_of_totals(store(totals, "county-totals"), codes)
    return employment_rule(shares, unemployment_flags(national, local), states, counties, county_layer)
