"""Batch jobs for ``spark-submit``: one command per rule and one for all of them.

Inputs are landed below one directory::

    areas/                   Parquet area table (level, geoid, name, abbr, geometry)
    adjacency/<level>/       Parquet edge table; built on first use, and again when the layer changes
    mines/                   pipe-delimited text
    generators/              Parquet
    brownfields/             CSV or gzipped CSV
    facts/                   Parquet by year (see the ``land`` command)
    unemployment/            tab-delimited text
    national/                JSON replies
    metro/, non_metro/       CSV crosswalks
    rejects/                 written: values that do not fit their type, by source
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from areaqual.operators import adjacency as adjacent
from areaqual.operators import quadtree, quality, rejects
from areaqual.operators.fingerprints import layer_fingerprint
from areaqual.plans import coal, crosswalks, employment, layers, report, sites
from areaqual.sources import archives, areas, delimited, derived, series
from areaqual.sources.sinks import RunStore, Store, write_and_reuse, write_result

log = logging.getLogger(__name__)

UNMATCHED_COUNTIES = 10  # up to so many counties outside the crosswalks are usual


@dataclass(frozen=True)
class Inputs:
    """Where the landed tables are, where intermediates go, and what is shared by the rules of one run.

    What no rule stops for is gathered while the tables are in use and logged by :meth:`warn`, after the result is written.
    """

    spark: SparkSession
    root: str
    store: Store = write_and_reuse
    policy: rejects.Policy = rejects.KEEP
    indices: dict[str, quadtree.AreaIndex] = field(default_factory=dict)
    observed: list[tuple[Observation, str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def areas(self) -> DataFrame:
        return areas.read_areas(self.spark, self.path("areas"))

    def layer(self, level: str) -> DataFrame:
        return layers.layer(self.areas(), layers.check_level(level))

    def index(self, level: str) -> quadtree.AreaIndex:
        """The cells of a level, built once in a run."""
        if level not in self.indices:
            self.indices[level] = quadtree.build_index(self.layer(level), f"{level}_id_fips", "area_geometry", self.store)
        return self.indices[level]

    def mines(self) -> DataFrame:
        raw = delimited.read_mines(self.spark, self.path("mines"))
        return rejects.checked(sites.mine_headers(raw), sites.MINE_TYPES, "mines", self.policy)

    def brownfields(self) -> DataFrame:
        """Spread over the cluster at once, as a gzip file is read by one task."""
        path = self.path("brownfields")
        return delimited.read_brownfields(self.spark, path, self.spark.sparkContext.defaultParallelism)

    def unemployment(self) -> DataFrame:
        raw = delimited.read_unemployment(self.spark, self.path("unemployment"))
        return rejects.checked(employment.series_headers(raw), {"year": "int"}, "unemployment", self.policy)

    def crosswalks(self) -> tuple[DataFrame, DataFrame]:
        metro = crosswalks.metro_crosswalk(delimited.read_metro_crosswalk(self.spark, self.path("metro")))
        definitions = delimited.read_non_metro_definitions(self.spark, self.path("non_metro"))
        return metro, crosswalks.non_metro_crosswalk(definitions, metro)

    def adjacency(self, level: str, refresh: bool = False) -> DataFrame:
        """The stored edge table of a level; built and stored when it is missing, incomplete, or of another layer."""
        stored = self.path(f"adjacency/{level}")
        layer = self.layer(level)
        now = layer_fingerprint(layer, f"{level}_id_fips")
        found = None if refresh else derived.read_derived(self.spark, stored, now)
        if found is not None:
            return found
        log.info("Building the adjacency of %s", level)
        built = adjacent.adjacency(layer, f"{level}_id_fips", "area_geometry", store=self.store)
        return derived.write_derived(built, stored, now)

    def observe(self, df: DataFrame, name: str, condition: Column, message: str) -> DataFrame:
        """Count rows while the table is in use, to be logged if there are any."""
        seen, counts = quality.observe_counts(df, name, {"n": condition})
        self.observed.append((counts, "n", message))
        return seen

    def note(self, rows: DataFrame, message: str, limit: int = 0) -> None:
        """Note distinct keys of a small table if there are more than ``limit``."""
        n = rows.count()
        if n > limit:
            self.warnings.append(message.format(n=n, sample=[tuple(r) for r in rows.limit(5).collect()]))

    def warn(self) -> list[str]:
        """Log and return what has been noted and observed; call it after the result has been written."""
        counted = [(observation.get[key], message) for observation, key, message in self.observed]
        found = self.warnings + [message.format(n=n) for n, message in counted if n]
        for text in found:
            log.warning(text)
        return found


def coal_areas(inputs: Inputs, level: str = "tract", planned: bool = False, as_of: str | None = None) -> DataFrame:
    """With ``planned``, units whose retirement is planned after ``as_of`` take the place of retired ones."""
    table, layer = inputs.areas(), inputs.layer(level)
    index = {"index": inputs.index(level), "store": inputs.store}
    mines = sites.clean_mines(inputs.mines(), layer, level, **index)
    generators = sites.clean_generators(
        delimited.read_generators(inputs.spark, inputs.path("generators")), layer, level, planned, as_of, **index
    )
    # Each table serves the rule itself and the search for neighbours.
    mines, generators = inputs.store(mines, "mines"), inputs.store(generators, "generators")
    return coal.coal_rule(
        mines, generators, inputs.adjacency(level), layer, layers.state_names(table), layers.county_names(table), level
    )


def brownfield_areas(inputs: Inputs, level: str = "tract") -> DataFrame:
    table, layer = inputs.areas(), inputs.layer(level)
    located = sites.clean_brownfields(inputs.brownfields(), layer, level, index=inputs.index(level), store=inputs.store)
    return coal.brownfield_rule(located, layer, layers.state_names(table), layers.county_names(table), level)


def employment_areas(inputs: Inputs, years: Sequence[int] | None = None) -> DataFrame:
    """All years at once: the year is a grouping key and a partition column.

    The facts are scanned once, for their sums by county, which are stored; so are the yearly rates. Shares, rates and all
    warnings come from these.
    """
    spark, table, store = inputs.spark, inputs.areas(), inputs.store
    metro, non_metro = inputs.crosswalks()
    known = store(crosswalks.county_areas(metro, non_metro), "county-areas")
    sums = store(employment.sum_facts(delimited.read_facts(spark, inputs.path("facts"), years)), "fact-sums")
    yearly = store(employment.county_unemployment(inputs.unemployment()), "yearly-unemployment")
    national = employment.national_rate(series.read_national_rates(spark, inputs.path("national")))
    local = store(employment.yearly_rates(yearly, metro, non_metro, store), "local-rates")
    inputs.note(quality.unmatched_keys(sums, known, crosswalks.KEY),
                "{n} counties of the facts are in no crosswalk, for example {sample}", UNMATCHED_COUNTIES)
    inputs.note(quality.unmatched_keys(known, yearly, crosswalks.KEY), "{n} crosswalk counties have no unemployment data, for example {sample}")
    inputs.note(employment.areas_without_rates(known, local), "{n} statistical areas have no unemployment rate, for example {sample}")
    shares = inputs.observe(
        employment.shares_of_totals(store(employment.totals_in_areas(sums, known), "county-totals")), "shares",
        F.col("total_employees").isNull() & (F.col("fossil_employees") > 0),
        "{n} counties and years lie in areas with fossil employment but no total",
    )
    return employment.employment_rule(
        store(shares, "shares"), employment.unemployment_flags(national, local),
        layers.state_names(table), layers.county_names(table), inputs.layer("county"),
    )


def all_areas(
    inputs: Inputs,
    coal_level: str = "tract",
    brownfield_level: str = "tract",
    planned: bool = False,
    as_of: str | None = None,
) -> DataFrame:
    return coal.all_rules(
        coal_areas(inputs, coal_level, planned, as_of),
        brownfield_areas(inputs, brownfield_level),
        employment_areas(inputs),
    )


def county_report(inputs: Inputs, result: DataFrame) -> DataFrame:
    """The county report on a stored result with both site rules at tract level."""
    counties = inputs.layer("county")
    located = sites.clean_brownfields(inputs.brownfields(), counties, "county", index=inputs.index("county"), store=inputs.store)
    acreage = report.brownfield_acreage(inputs.store(located, "brownfields"))
    made = report.county_report(result, acreage, inputs.layer("tract"), counties)
    share = F.col("percent_of_county_coal_qualified")
    return inputs.observe(made, "report", share > 1, "{n} counties have more coal area than area")


def _flag(text: str) -> bool:
    if text.lower() in {"true", "yes", "1"}:
        return True
    if text.lower() in {"false", "no", "0"}:
        return False
    raise argparse.ArgumentTypeError(f"Expected true or false, not {text!r}")


def parse_arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Find qualifying areas from landed tables.")
    parser.add_argument("rule", choices=["all", "coal", "brownfields", "employment", "report", "land"])
    parser.add_argument("--inputs", required=True, help="directory of the landed tables")
    parser.add_argument("--output", required=True, help="directory of the result")
    parser.add_argument("--coal-area", choices=["tract", "county"], default="tract")
    parser.add_argument("--brownfields-area", choices=["tract", "county"], default="tract")
    parser.add_argument("--refresh-adjacency", type=_flag, default=False, help="build the edge tables again")
    parser.add_argument("--update-employment", type=_flag, default=False, help="unpack the archives below zips/ first")
    parser.add_argument("--rejects", choices=rejects.MODES, default="fail",
                        help="values that do not fit their type: stop, set the rows aside, or take the values as missing")
    parser.add_argument("--planned", action="store_true", help="planned retirements of coal units, not past ones")
    parser.add_argument("--as-of", help="date after which a retirement counts as planned, as 2025-01-31")
    args = parser.parse_args(argv)
    if args.planned != (args.as_of is not None):
        parser.error("--planned and --as-of go together")
    return args


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    args = parse_arguments(argv)
    spark = spark or SparkSession.builder.appName("areaqual").getOrCreate()
    with RunStore(spark) as store:
        policy = rejects.Policy(args.rejects, f"{args.inputs.rstrip('/')}/rejects", store)
        _run(args, Inputs(spark, args.inputs, store, policy))


def _run(args: argparse.Namespace, inputs: Inputs) -> None:
    if args.rule == "land" or (args.update_employment and args.rule in ("all", "employment")):
        archives.land_zipped_facts(inputs.spark, inputs.path("zips"), inputs.path("facts"), inputs.policy)
        if args.rule == "land":
            return
    if args.refresh_adjacency and args.rule in ("all", "coal"):
        inputs.adjacency(args.coal_area, refresh=True)
    if args.rule == "report":
        # The report reads the result several times, so it works on a stored copy without polygons.
        result = all_areas(inputs, planned=args.planned, as_of=args.as_of).drop("area_geometry", "site_geometry")
        county_report(inputs, inputs.store(result, "all-areas")).write.mode("overwrite").parquet(args.output)
        inputs.warn()
        return
    if args.rule == "coal":
        result = coal_areas(inputs, args.coal_area, args.planned, args.as_of)
    elif args.rule == "brownfields":
        result = brownfield_areas(inputs, args.brownfields_area)
    elif args.rule == "employment":
        result = employment_areas(inputs)
    else:
        result = all_areas(inputs, args.coal_area, args.brownfields_area, args.planned, args.as_of)
    write_result(result, args.output)
    inputs.warn()


if __name__ == "__main__":
    main()
