"""The batch jobs on a small landed directory."""

import json

import pytest
from pyspark.sql import functions as F

from areaqual import constants as K
from areaqual.functions import geometry as geo
from areaqual.plans import jobs
from areaqual.sources import areas
from tests import shapes
from tests.test_employment import FACTS, SERIES


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")

    def text(name, content, file="part.csv"):
        (root / name).mkdir(parents=True)
        (root / name / file).write_text(content)

    rows = [("state", "48", "Texas", "TX", None), ("state", "01", "Alabama", "AL", None)]
    for k, county in enumerate(["48059", "48253", "48441", "04027", "01005", "01109"]):
        box = lambda x, s: shapes.geometry([([(x, 0), (x + s, 0), (x + s, 4), (x, 4)], [])])
        rows.append(("county", county, f"County {county}", None, box(k * 4, 4)))
        rows += [("tract", f"{county}00000{t}", f"Tract {t}", None, box(k * 4 + 2 * t, 2)) for t in (0, 1)]
    table = spark.createDataFrame(rows, "level string, geoid string, name string, abbr string, raw " + geo.GEOMETRY_DDL)
    shaped = table.select("level", "geoid", "name", "abbr", geo.normalise("raw").alias("geometry"))
    areas.write_areas(areas.in_crs(shaped, K.GEOGRAPHIC_CRS), str(root / "areas"))

    text("mines", "MINE_ID|CURRENT_MINE_NAME|CURRENT_MINE_STATUS|CURRENT_MINE_TYPE|COAL_METAL_IND|FIPS_CNTY_CD|CURRENT_STATUS_DT|LATITUDE|LONGITUDE\n"
                  "1|big hole|Abandoned|Surface|C|59|01/01/2010|1.0|1.0\n", "Mines.txt")
    spark.sql("""SELECT 1 AS plant_id_eia, 1 AS utility_id_eia, 'a' AS generator_id, TIMESTAMP '2015-01-01' AS report_date,
        'BIT' AS energy_source_code_1, 'Conventional Steam Coal' AS technology_description, 'retired' AS operational_status,
        CAST(NULL AS TIMESTAMP) AS planned_generator_retirement_date, 23.0D AS longitude, 1.0D AS latitude,
        'Plant' AS plant_name_eia""").write.parquet(str(root / "generators"))
    text("brownfields", "Site Name,State,Program,Latitude,Longitude,Acreage (acres),Zip Code\nyard,TX,Brownfields,1.0,9.0,12.5,00501\n"
                        "bad,TX,Superfund,1.0,9.0,1,00501\n")
    spark.createDataFrame(FACTS, "area_fips string, area_title string, year int, industry_code string, own_code int, "
                                 "annual_avg_emplvl int").write.partitionBy("year").parquet(str(root / "facts"))
    lines = ["series_id\tyear\tperiod\tvalue"]
    for county, year, unemployed, force in SERIES:
        for measure, values in (("04", unemployed), ("06", force)):
            lines += [f"LAUCN{county}00000000{measure}  \t{year}\tM{m:02d}\t   {v}" for m, v in enumerate(values, 1)]
    text("unemployment", "\n".join(lines) + "\n", "data.txt")
    data = [{"year": y, "period": "M01", "periodName": "January", "value": v} for y, v in (("2018", "3.9"), ("2019", "3.7"))]
    text("national", json.dumps({"status": "REQUEST_SUCCEEDED", "Results": {"series": [{"seriesID": "S", "data": data}]}}), "a.json")
    text("metro", "County Code,County Title,MSA Code,MSA Title,MSA Type\n" + "".join(
        f'{int(c)},x,C1018,"Abilene, TX",Metro\n' for c in ("48059", "48253", "48441")) + '4027,x,C4974,"Yuma, AZ",Metro\n')
    text("non_metro", "FIPS code,County code,Township code,May 2023 MSA name,May 2023 MSA code,County name\n"
                      "1,5,0,Southeast Alabama nonmetropolitan area,100004,Barbour\n1,109,0,Southeast Alabama nonmetropolitan area,100004,Pike\n")
    return root


def run(spark, landed, *arguments):
    output = str(landed / ("out-" + "-".join(a.strip("-") for a in arguments)))
    jobs.main([arguments[0], "--inputs", str(landed), "--output", output, *arguments[1:]], spark)
    return spark.read.parquet(output)


def test_all_rules(spark, landed):
    df = run(spark, landed, "all")
    counts = {r.qualifying_criteria: r["count"] for r in df.groupBy("qualifying_criteria").count().collect()}
    assert counts == {"coalmine": 1, "coal_plant": 1, "coal_mine_adjacent_tract": 1, "coal_plant_adjacent_tract": 1,
                      "brownfield": 1, "fossil_fuel_employment": 3}
    mine = df.where("qualifying_criteria = 'coalmine'").first()
    assert (mine.tract_id_fips, mine.county_name, mine.state_name, mine.site_name) == ("48059000000", "County 48059", "Texas", "Big Hole")
    assert mine.site_geometry.x == 1.0 and len(mine.area_geometry) == 1
    assert (landed / "adjacency" / "tract").exists()


def test_each_rule_alone(spark, landed):
    assert run(spark, landed, "coal", "--coal-area", "county").count() == 4
    assert run(spark, landed, "brownfields", "--brownfields-area", "county").first().geoid == "48441"
    rows = run(spark, landed, "employment").collect()
    assert sorted(r.geoid for r in rows) == ["01005", "01109", "48059"]
    assert all(r.area_geometry for r in rows)


def test_report(spark, landed):
    got = {r.county_id_fips: r for r in run(spark, landed, "report").collect()}
    assert got["48441"].num_brownfields == 1 and got["48441"].brownfield_acreage == 12.5
    assert got["48059"].qualifies_by_employment_criteria and got["48059"].num_coal_qualifying_tracts == 2
    # The squares lie far from the zone, where straight borders of tracts and county bend apart a little.
    assert got["48059"].percent_of_county_coal_qualified == pytest.approx(1.0, abs=0.02)


def test_planned_retirements(spark, landed):
    # The only unit is retired and has no planned date: no area qualifies through it.
    past = run(spark, landed, "coal", "--coal-area", "county")
    planned = run(spark, landed, "coal", "--coal-area", "county", "--planned", "--as-of", "2025-01-01")
    assert set(planned.columns) == set(past.columns) and 0 < planned.count() < past.count()
    with pytest.raises(SystemExit):
        jobs.parse_arguments(["coal", "--inputs", "a", "--output", "b", "--planned"])


def test_bad_levels_are_refused():
    for arguments in (["all", "--coal-area", "area"], ["all", "--brownfields-area", "state"], ["coal", "--refresh-adjacency", "maybe"]):
        with pytest.raises(SystemExit):
            jobs.parse_arguments([*arguments, "--inputs", "a", "--output", "b"])
    assert jobs.parse_arguments(["all", "--inputs", "a", "--output", "b", "--update-employment", "False"]).update_employment is False


def shared_tables(spark):
    from pathlib import Path

    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir() if p.name.startswith("areaqual-run")}


def test_intermediates_are_removed_and_an_index_is_built_once(spark, landed, monkeypatch):
    built = []
    build = jobs.quadtree.build_index
    monkeypatch.setattr(jobs.quadtree, "build_index", lambda df, area_id, *rest: built.append(area_id) or build(df, area_id, *rest))
    before = shared_tables(spark)
    run(spark, landed, "all", "--rejects", "warn")
    assert shared_tables(spark) == before and built == ["tract_id_fips"]  # coal and brownfields share it
    monkeypatch.setattr(jobs, "brownfield_areas", lambda *rest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, landed, "brownfields")
    assert shared_tables(spark) == before


def test_facts_and_series_are_scanned_once(spark, landed, monkeypatch):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("facts", "unemployment")}

    def counted(name, read):
        def count(batches):
            for batch in batches:
                seen[name].add(batch.num_rows)
                yield batch

        def wrapped(*arguments):
            df = read(*arguments)
            return df.mapInArrow(count, df.schema)

        return wrapped

    rows = {"facts": jobs.delimited.read_facts(spark, str(landed / "facts")).count(),
            "unemployment": jobs.delimited.read_unemployment(spark, str(landed / "unemployment")).count()}
    monkeypatch.setattr(jobs.delimited, "read_facts", counted("facts", jobs.delimited.read_facts))
    monkeypatch.setattr(jobs.delimited, "read_unemployment", counted("unemployment", jobs.delimited.read_unemployment))
    run(spark, landed, "employment", "--rejects", "fail")
    assert {k: a.value for k, a in seen.items()} == rows


def changed(landed, tmp_path, **files):
    """A copy of the landed directory with other content in some text tables."""
    import shutil

    root = tmp_path / "landed"
    shutil.copytree(landed, root, ignore=shutil.ignore_patterns("out-*", "adjacency*"))
    for name, content in files.items():
        for file in (root / name).iterdir():
            if not file.name.startswith("."):
                file.write_text(content(file.read_text()))
            elif file.suffix == ".crc":
                file.unlink()
    return root


@pytest.mark.parametrize("rule", ["employment", "all"])
def test_warnings_of_the_run(spark, landed, tmp_path, caplog, monkeypatch, rule):
    monkeypatch.setattr(jobs, "UNMATCHED_COUNTIES", 0)
    head = "County Code,County Title,MSA Code,MSA Title,MSA Type\n"
    # Taylor is in no crosswalk, 99001 has no unemployment data, C9999 no rate, and Yuma no total.
    root = changed(landed, tmp_path, metro=lambda t: head + "".join(
        f'{c},x,C1018,"Abilene, TX",Metro\n' for c in ("48059", "48253")) + '4027,x,C4974,"Yuma, AZ",Metro\n99001,x,C9999,Nowhere,Metro\n')
    facts = [f for f in FACTS if not (f[0] == "4027" and f[3] == "10")]
    spark.createDataFrame(facts, "area_fips string, area_title string, year int, industry_code string, own_code int, "
                                 "annual_avg_emplvl int").write.mode("overwrite").partitionBy("year").parquet(str(root / "facts"))
    run(spark, root, rule)
    text = caplog.text
    assert "3 counties of the facts are in no crosswalk" in text and "48441" in text
    assert "crosswalk counties have no unemployment data" in text and "99001" in text
    assert "statistical areas have no unemployment rate" in text and "C9999" in text
    assert "in areas with fossil employment but no total" in text


def test_a_share_above_the_county_is_reported(spark, landed, caplog):
    inputs = jobs.Inputs(spark, str(landed))
    result = jobs.all_areas(inputs).drop("area_geometry", "site_geometry")
    shrunk = inputs.layer("county").withColumn("area_geometry", F.expr("transform(area_geometry, p -> transform(p, r -> transform(r, v -> struct(v.x AS x, v.y / 2 AS y))))"))
    made = jobs.report.county_report(result, jobs.report.brownfield_acreage(
        jobs.sites.clean_brownfields(inputs.brownfields(), inputs.layer("county"), "county")), inputs.layer("tract"), shrunk)
    seen = inputs.observe(made, "r", F.col("percent_of_county_coal_qualified") > 1, "{n} counties have more coal area than area")
    seen.collect()
    assert any("counties have more coal area than area" in w for w in inputs.warn())


def test_bad_values_in_the_inputs(spark, landed, tmp_path, caplog):
    bad = "7|hole|Abandoned|Surface|C|59|soon|1.0|1.0\n"
    root = changed(landed, tmp_path, mines=lambda t: t + bad, unemployment=lambda t: t + "LAUCN480590000000004\tMMXX\tM01\t1\n")
    with pytest.raises(jobs.quality.DataCheckError, match="1 of 2 rows of mines.*soon"):
        run(spark, root, "coal")
    with pytest.raises(jobs.quality.DataCheckError, match="of unemployment.*MMXX"):
        run(spark, root, "employment")
    rows = run(spark, root, "all", "--rejects", "warn").count()
    assert rows == run(spark, root, "all", "--rejects", "keep").count()
    aside = spark.read.parquet(str(root / "rejects")).select("source", "column", "raw").collect()
    assert sorted(map(tuple, aside)) == [("mines", "current_status_dt", "soon"), ("unemployment", "year", "MMXX")]
    assert "rows of mines hold values that do not fit" in caplog.text


@pytest.mark.parametrize("change", ["moved", "added", "removed", "partial"])
def test_adjacency_follows_the_layer(spark, landed, tmp_path, change):
    root = changed(landed, tmp_path)
    inputs = jobs.Inputs(spark, str(root))
    first = {tuple(r) for r in inputs.adjacency("county").collect()}
    assert len(first) == 10 and {tuple(r) for r in inputs.adjacency("county").collect()} == first
    table = areas.read_areas(spark, str(root / "areas")).where("level = 'county'")
    box = "array(array(array({})))".format(", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ((24, 0), (28, 0), (28, 4), (24, 4), (24, 0))))
    if change == "moved":
        table = table.withColumn("geometry", F.expr(f"if(geoid = '48059', {box}, geometry)"))
    elif change == "added":
        table = table.unionByName(table.limit(1).withColumns({"geoid": F.lit("99999"), "geometry": F.expr(box)}))
    elif change == "removed":
        table = table.where("geoid != '48253'")
    else:
        spark.createDataFrame(sorted(first)[:4], "county_id_fips string, adjacent_county_id_fips string").write.mode("overwrite").parquet(str(root / "adjacency/county"))
    if change != "partial":
        kept = str(root / "kept")
        table.write.parquet(kept)
        areas.write_areas(areas.in_crs(spark.read.parquet(kept), K.GEOGRAPHIC_CRS), str(root / "areas"))
    now = {tuple(r) for r in inputs.adjacency("county").collect()}
    pair = {("01109", "48059"), ("48059", "01109")}
    want = {
        "moved": first - {("48059", "48253"), ("48253", "48059")} | pair, "added": first | {("01109", "99999"), ("99999", "01109")},
        "removed": {p for p in first if "48253" not in p}, "partial": first,
    }
    assert now == want[change]
