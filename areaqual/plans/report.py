"""Reports on the qualifying areas and the feature tables behind the maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import geometry as geo
from areaqual.functions import numeric
from areaqual.operators import aggregates
from areaqual.operators.sums import exact_sums

COAL_CRITERIA = [K.MINE, K.PLANT, f"{K.MINE_CLOSURE}_adjacent_tract", f"{K.PLANT}_adjacent_tract"]


def brownfield_acreage(brownfields: DataFrame, key: str = "county_id_fips") -> DataFrame:
    """Acreage per county with unknown sizes left out, set to the mean and set to the median."""
    return aggregates.acreage_three_ways(brownfields, key, "brownfield_acreage")


def coal_area_share(qualifying: DataFrame, tracts: DataFrame, counties: DataFrame) -> DataFrame:
    """Per county: number of coal tracts and their share of the county's area.

    Areas are measured once per tract and county, after the ids are distinct, and only those of the coal ids: the others
    are dropped before any is projected. Sums are exact, so shares do not depend on the order of the rows.
    """
    coal = (
        qualifying.where(F.col("qualifying_criteria").isin(COAL_CRITERIA))
        .where(F.col("county_id_fips").isNotNull())
        .select("county_id_fips", "tract_id_fips")
        .distinct()
    )
    coal_tracts = tracts.join(coal.select("tract_id_fips").distinct(), "tract_id_fips", "left_semi")
    measured = coal_tracts.select("tract_id_fips", geo.utm_area("area_geometry").alias("tract_area"))
    per_county = exact_sums(
        coal.join(measured, "tract_id_fips", "left"), ["county_id_fips"], {"tract_area": F.col("tract_area")},
        {"num_coal_qualifying_tracts": F.lit(True)},
    ).fillna(0.0, ["tract_area"])
    coal_counties = counties.join(coal.select("county_id_fips").distinct(), "county_id_fips", "left_semi")
    county_area = coal_counties.select("county_id_fips", geo.utm_area("area_geometry").alias("county_area"))
    share = numeric.round_half_even(numeric.ratio(F.col("tract_area"), F.col("county_area")), 2)
    return per_county.join(county_area, "county_id_fips", "left").select(
        "county_id_fips", "num_coal_qualifying_tracts", share.alias("percent_of_county_coal_qualified")
    )


def county_report(
    qualifying: DataFrame, acreage: DataFrame, tracts: DataFrame, counties: DataFrame
) -> DataFrame:
    """One row per county with any qualifying record; missing numbers are 0, names stay as they are."""
    criteria = F.col("qualifying_criteria")
    # Names are keys of the first grouping: it stays a hash aggregate and leaves a row or two per county.
    per_name = (
        qualifying.where(F.col("county_id_fips").isNotNull())
        .groupBy("county_id_fips", "county_name", "state_name")
        .agg(F.count_if(criteria == K.BROWNFIELD).alias("n"), F.bool_or(criteria == K.EMPLOYMENT).alias("by_employment"))
    )
    base = per_name.groupBy("county_id_fips").agg(
        F.min("county_name").alias("county_name"),
        F.min("state_name").alias("state_name"),
        F.sum("n").alias("num_brownfields"),
        F.bool_or("by_employment").alias("qualifies_by_employment_criteria"),
    )
    report = base.join(acreage, "county_id_fips", "left").join(
        coal_area_share(qualifying, tracts, counties), "county_id_fips", "left"
    )
    amounts = [c for c in acreage.columns if c != "county_id_fips"] + ["percent_of_county_coal_qualified"]
    return report.fillna(0, subset=["num_coal_qualifying_tracts", *amounts]).select(
        "county_id_fips", "county_name", "state_name", "num_brownfields", *amounts[:-1],
        "num_coal_qualifying_tracts", "percent_of_county_coal_qualified", "qualifies_by_employment_criteria",
    )


def oversized_shares(report: DataFrame) -> DataFrame:
    """Counties whose coal share exceeds the whole county; worth a warning."""
    return report.where("percent_of_county_coal_qualified > 1").select(
        "county_id_fips", "percent_of_county_coal_qualified"
    )


def feature_labels(sites: DataFrame, adjacency: DataFrame, level: str) -> DataFrame:
    """``(geoid, primary_or_adj)``: areas with sites and their neighbours; ``primary`` wins."""
    area_id = f"{level}_id_fips"
    primary = sites.select(area_id).where(F.col(area_id).isNotNull()).distinct()
    neighbours = primary.join(adjacency, area_id).select(F.col(f"adjacent_{area_id}").alias("geoid"))
    both = primary.select(F.col(area_id).alias("geoid"), F.lit(1).alias("rank")).unionByName(
        neighbours.withColumn("rank", F.lit(0))
    )
    return both.groupBy("geoid").agg(F.max("rank").alias("rank")).select(
        "geoid", F.when(F.col("rank") == 1, "primary").otherwise("adjacent").alias("primary_or_adj")
    )


def feature_table(sites: DataFrame, adjacency: DataFrame, layer: DataFrame, level: str) -> DataFrame:
    """Feature labels with the geometry of areas the layer knows."""
    known = layer.select(F.col(f"{level}_id_fips").alias("geoid"), F.col("area_geometry").alias("geometry"))
    return feature_labels(sites, adjacency, level).join(known, "geoid")


# Labels from weakest to strongest; this is also their text order.
COMBINED_LABELS = ["adjacent_gen", "adjacent_mine", "primary_gen", "primary_mine"]


def combine_features(mines: DataFrame, generators: DataFrame) -> DataFrame:
    """One row per area of two feature tables, with the strongest label."""
    order = F.array(*[F.lit(label) for label in COMBINED_LABELS])
    labelled = [
        df.select("geoid", F.concat("primary_or_adj", F.lit(suffix)).alias("label"))
        for df, suffix in ((generators, "_gen"), (mines, "_mine"))
    ]
    ranked = labelled[0].unionByName(labelled[1]).select("geoid", F.array_position(order, F.col("label")).alias("rank"))
    strongest = ranked.groupBy("geoid").agg(F.max("rank").cast("int").alias("rank"))
    labels = strongest.select("geoid", F.element_at(order, F.col("rank")).alias("primary_or_adj"))
    if "geometry" not in mines.columns:
        return labels
    shapes = mines.select("geoid", "geometry").unionByName(generators.select("geoid", "geometry"))
    return labels.join(shapes.dropDuplicates(["geoid"]), "geoid")
