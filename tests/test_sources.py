"""Landed files in, results out."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from areaqual.functions import geometry as geo
from areaqual.operators import quality, rejects
from areaqual.plans import crosswalks, layers
from areaqual.sources import archives, areas, delimited, series, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_mines_are_latin_1_text(spark, tmp_path):
    path = write(tmp_path / "Mines.txt", 'MINE_ID|CURRENT_MINE_NAME\n0012|"Cañón | Nº 1"\n7|\n', "latin-1")
    assert [tuple(r) for r in delimited.read_mines(spark, path).collect()] == [("0012", "Cañón | Nº 1"), ("7", None)]


def test_period_files_are_appended(spark, tmp_path):
    paths = [write(tmp_path / f"p{i}", f"series_id    \tyear\tperiod\t       value\nLAU{i}  \t2010\tM01\t         {i}.5\n") for i in (1, 2)]
    df = delimited.read_unemployment(spark, paths)
    assert df.columns[0].strip() == "series_id" and sorted(r[3].strip() for r in df.collect()) == ["1.5", "2.5"]


def test_crosswalk_csv(spark, tmp_path):
    path = write(tmp_path / "x.csv", "County Code,County Title,MSA Code,MSA Title,MSA Type\n1001,\"Doña Ana, NM\",C1,T,Metro\n", "latin-1")
    row = crosswalks.metro_crosswalk(delimited.read_metro_crosswalk(spark, path)).first()
    assert (row.county_id_fips, row.county_name) == ("01001", "Doña Ana, NM")


def test_missing_years_are_empty(spark, tmp_path):
    for year in (2019, 2020):
        (tmp_path / f"year={year}").mkdir()
        write(tmp_path / f"year={year}" / "a.csv", "area_fips,industry_code\n01001,10\n")
    df = delimited.read_yearly_csv(spark, str(tmp_path), [2020, 2035])
    assert [(r.area_fips, r.industry_code, r.year) for r in df.collect()] == [("01001", "10", 2020)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def test_archives_keep_county_and_metro_members(spark, tmp_path):
    head = "area_fips,own_code,industry_code,year,area_title,annual_avg_emplvl,extra\n"
    archive(tmp_path / "2020.zip", {
        "2020 a/2020 01001 Autauga County.csv": head + '01001,0,10,2020,"Autauga, AL",5,x\n',
        "2020 a/2020 C1018 Abilene MSA.csv": head + "C1018,0,10,2020,Abilene MSA,7,x\n",
        "2020 a/2020 US000 national.csv": head + "US000,0,10,2020,U.S.,9,x\n",
    })
    archive(tmp_path / "2021.zip", {"2021 01001 COUNTY.csv": head + "01001,0,10,2021,,\n"})
    df = archives.read_zipped_facts(spark, str(tmp_path))
    got = {(r.area_fips, r.area_title, r.year, r.annual_avg_emplvl) for r in df.collect()}
    assert got == {("01001", "Autauga, AL", "2020", "5"), ("C1018", "Abilene MSA", "2020", "7"), ("01001", None, "2021", None)}
    target = str(tmp_path / "facts")
    archives.land_zipped_facts(spark, str(tmp_path / "*.zip"), target)
    archives.land_zipped_facts(spark, str(tmp_path / "2021.zip"), target)
    assert {(r.year, r.n) for r in delimited.read_facts(spark, target).groupBy("year").agg(F.count("*").alias("n")).collect()} == {
        (2020, 2), (2021, 1)}
    assert delimited.read_facts(spark, target, [2021]).count() == 1


def test_each_member_is_a_task_and_is_read_as_a_stream(spark, tmp_path, monkeypatch):
    """Archives beyond the size that Spark reads as one value, here lowered, and a member of several batches."""
    head = "area_fips,own_code,industry_code,year,area_title,annual_avg_emplvl\n"
    lines = "".join(f'{k:05d},0,10,2020,"A ""quoted"", title\nof two lines",{k}\n' for k in range(1200))
    archive(tmp_path / "2020.zip", {f"2020 {n} County.csv": head + lines for n in "abc"} | {"2020 d County.csv": "\ufeff" + head})
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        with pytest.raises(Exception, match="exceeds|larger|EXCEED"):
            spark.read.format("binaryFile").load(str(tmp_path / "2020.zip")).select("content").collect()
        df = archives.read_zipped_facts(spark, f"file://{tmp_path}/*.zip")
        assert df.rdd.getNumPartitions() == 4
        assert df.count() == 3600 and df.where("area_title LIKE 'A \"quoted\"%two lines'").count() == 3600
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept)
    reader = archives.ZipMembers({"paths": json.dumps([str(tmp_path)]), "columns": json.dumps(["area_fips"])})
    reader = reader.reader(reader.schema())
    monkeypatch.setattr(archives, "BATCH_ROWS", 500)
    members = reader.partitions()
    assert len(members) == 4 and [b.num_rows for b in reader.read(members[0])] == [500, 500, 200]


def test_archives_with_bad_members_stop_the_run(spark, tmp_path):
    short = archive(tmp_path / "short.zip", {"2020 a County.csv": "area_fips,year\n1,2\n"})
    with pytest.raises(Exception, match="lacks the columns"):
        archives.read_zipped_facts(spark, short).collect()
    head = "area_fips,own_code,industry_code,year,area_title,annual_avg_emplvl\n"
    long = archive(tmp_path / "long.zip", {"2020 a County.csv": head + "1,2,3,4,5,6,7\n"})
    with pytest.raises(Exception, match="line of 7 fields"):
        archives.read_zipped_facts(spark, long).collect()
    none = archive(tmp_path / "none.zip", {"2020 national.csv": head})
    assert archives.read_zipped_facts(spark, none).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        archives.read_zipped_facts(spark, str(tmp_path / "nowhere.zip")).collect()


def test_bad_years_and_numbers_are_set_aside_on_landing(spark, tmp_path):
    head = "area_fips,own_code,industry_code,year,area_title,annual_avg_emplvl\n"
    path = archive(tmp_path / "a.zip", {"a County.csv": head + "1,0,10,2020,A,5\n2,0,10,MMXX,A,6\n3,0,10,2020,A,\"1,234\"\n4,x,10,2020,A,7\n"})
    with pytest.raises(quality.DataCheckError, match="3 of 4 rows of facts"):
        archives.land_zipped_facts(spark, path, str(tmp_path / "facts"), rejects.Policy("fail"))
    archives.land_zipped_facts(spark, path, str(tmp_path / "facts"), rejects.Policy("warn", str(tmp_path / "bad")))
    assert [r.area_fips for r in delimited.read_facts(spark, str(tmp_path / "facts")).collect()] == ["1"]
    bad = spark.read.parquet(str(tmp_path / "bad")).select("column", "raw").collect()
    assert sorted(map(tuple, bad)) == [("annual_avg_emplvl", "1,234"), ("own_code", "x"), ("year", "MMXX")]


def test_mines_archive_must_hold_one_file(spark, tmp_path):
    good = archive(tmp_path / "good.zip", {"Mines.txt": "MINE_ID|NAME\n1|x\n"})
    assert archives.read_zipped_mines(spark, good, ["MINE_ID", "NAME"]).first().NAME == "x"
    for name, members in (("two", {"Mines.txt": "", "b": ""}), ("other", {"Sites.txt": ""})):
        with pytest.raises(Exception, match="expected"):
            archives.read_zipped_mines(spark, archive(tmp_path / f"{name}.zip", members), ["MINE_ID"]).collect()


def reply(status, *all_series):
    return json.dumps({"status": status, "Results": {"series": [
        {"seriesID": s, "data": [{"year": y, "period": p, "periodName": "x", "value": v, "footnotes": [{}]} for y, p, v in data]}
        for s, data in all_series]}}, indent=1)


def test_replies_are_flattened(spark, tmp_path):
    write(tmp_path / "a.json", reply("REQUEST_SUCCEEDED", ("S1", [("2018", "M01", "4.0"), ("2018", "M02", "4.1")]), ("S2", [("2018", "M01", "9")])))
    write(tmp_path / "b.json", reply("REQUEST_SUCCEEDED", ("S1", [("2019", "M01", "3.9")])))
    got = sorted((r.series_id, r.year, r.period, r.value) for r in series.read_national_rates(spark, str(tmp_path)).collect())
    assert got == [("S1", "2018", "M01", "4.0"), ("S1", "2018", "M02", "4.1"), ("S1", "2019", "M01", "3.9"), ("S2", "2018", "M01", "9")]


def test_failed_reply_stops_the_run(spark, tmp_path):
    write(tmp_path / "a.json", reply("REQUEST_NOT_PROCESSED", ("S1", [("2018", "M01", "4.0")])))
    with pytest.raises(Exception, match="REQUEST_NOT_PROCESSED"):
        series.read_national_rates(spark, str(tmp_path)).collect()


def test_area_table_from_geojson(spark, tmp_path):
    square = [[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]]
    features = [
        {"properties": {"GEOID10": "01001", "NAMELSAD10": "Autauga"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"properties": {"GEOID10": "01003", "NAMELSAD10": "Baldwin"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[x + 9, y] for x, y in square]]]}},
    ]
    path = write(tmp_path / "counties.geojsonl", "\n".join(json.dumps(f) for f in features) + "\n\n")
    table = str(tmp_path / "areas")
    areas.write_areas(areas.read_geojson_lines(spark, path, "county"), table)
    states = [{"properties": {"GEOID10": "01", "NAMELSAD10": "Alabama", "STUSPS10": "AL"}, "geometry": features[0]["geometry"]}]
    path = write(tmp_path / "states.geojsonl", json.dumps(states[0]))
    areas.write_areas(areas.read_geojson_lines(spark, path, "state", abbr="STUSPS10"), table)
    df = areas.read_areas(spark, table)
    got = {r.geoid: (r.level, r.abbr, r.a) for r in df.withColumn("a", geo.planar_area("geometry")).collect()}
    assert got == {"01001": ("county", None, 4.0), "01003": ("county", None, 8.0), "01": ("state", "AL", 4.0)}
    assert layers.state_names(df).first().state_abbr == "AL"
    named = layers.add_area_info(spark.createDataFrame([("01001000100",)], "tract_id_fips string"), "tract_id_fips",
                                 layers.state_names(df), layers.county_names(df)).first()
    assert (named.county_name, named.state_name, named.county_id_fips) == ("Autauga", "Alabama", "01001")


def test_gzip_csv_keeps_codes(spark, tmp_path):
    df = spark.createDataFrame([("00501", 'a "b", c', 1.5), ("1", None, None)], "`Zip Code` string, `Site Name` string, x double")
    path = str(tmp_path / "sites")
    sinks.write_csv_gz(df, path)
    assert any(p.name.endswith(".csv.gz") for p in (tmp_path / "sites").iterdir())
    back = delimited.read_brownfields(spark, path, partitions=3)
    assert {tuple(r) for r in back.collect()} == {("00501", 'a "b", c', "1.5"), ("1", None, None)}


def test_result_is_partitioned_by_rule(spark, tmp_path):
    df = spark.createDataFrame([("a", "coalmine"), ("b", "brownfield")], "geoid string, qualifying_criteria string")
    sinks.write_result(df, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {
        "qualifying_criteria=coalmine", "qualifying_criteria=brownfield"}


def test_scratch_folder_is_in_the_shared_directory(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    a, b = (sinks.scratch_folder(spark, "x") for _ in range(2))
    assert a.startswith(shared) and a != b
