"""Round trips of landed files and result files on small written inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberfield.operators.columns import with_absent_columns
from emberfield.sources import landed as L
from emberfield.sources import sinks as S


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return str(path)
    return write


PAGE = [
    {"incident_number": "1", "neighborhood_district": "mission", "alarm_dttm": "2020-01-01T00:00:00.000",
     "arrival_dttm": "2020-01-01T00:05:00.500", "incident_date": "2020-01-01T00:00:00.000",
     "suppression_units": "2", "ems_units": "x"},
    {"incident_number": "2", "neighborhood_district": None, "arrival_dttm": "2020-01-01T00:05:00.000"},
    {"incident_number": "3", "neighborhood_district": "soma"},
]


def test_incident_pages(spark, put, tmp_path):
    put("pages/p0.json", json.dumps(PAGE, indent=1))
    put("pages/p1.json", json.dumps([{**PAGE[0], "incident_number": "4", "alarm_dttm": "soon"}]))
    got = L.read_incident_pages(spark, str(tmp_path / "pages")).orderBy("incident_number").collect()
    assert [r["incident_number"] for r in got] == ["1", "4"]
    assert got[0]["arrival_dttm"] == dt.datetime(2020, 1, 1, 0, 5, 0, 500000) and got[1]["alarm_dttm"] is None
    assert (got[0]["suppression_units"], got[0]["ems_units"], got[0]["civilian_injuries"]) == (2, 0, 0)


def test_incident_lines(spark, put):
    path = put("lines.json", "\n".join(json.dumps(r) for r in PAGE))
    assert L.read_incident_pages(spark, path, lines=True).count() == 1


def test_crosswalk(spark, put, rows):
    path = put("cw.json", [{"geoid": "6075010100", "neighborhoods_analysis_boundaries": " north BEACH "},
                           {"geoid": "06075010200", "neighborhoods_analysis_boundaries": "russian hill"}])
    cw = L.read_crosswalk_pages(spark, path)
    assert rows(cw) == [("06075010100", "North Beach"), ("06075010200", "Russian Hill")]
    assert tuple(L.crosswalk_summary(cw).first()) == (2, 2)


def census(codes, *data):
    return [["NAME", *codes, "state", "county", "tract"], *[["T", *r[1:], "06", "075", r[0]] for r in data]]


def test_census_whole_table(spark, put):
    path = put("acs.json", census(["B01003_001E", "B19013_001E"], ["010100", "1000", "-666666666"],
                                  ["010200", "n/a", "50000"]))
    got = {r["geoid"]: r for r in L.read_census(spark, [path]).collect()}
    a, b = got["06075010100"], got["06075010200"]
    assert (a["total_population"], a["median_household_income"], a["poverty_below"]) == (1000, None, None)
    assert (b["total_population"], b["median_household_income"]) == (None, 50000)


def test_census_groups_merge_outer(spark, put):
    paths = [put("g1.json", census(["B01003_001E"], ["1", "10"], ["2", "20"])),
             put("g2.json", census(["B17001_001E", "B17001_002E"], ["2", "7", "3"], ["3", "9", "4"])),
             put("g3.json", census(["OTHER"], ["1", "5"]))]
    got = {r["geoid"]: (r["total_population"], r["poverty_universe_total"], r["poverty_below"])
           for r in L.read_census(spark, paths).collect()}
    assert got == {"060751": (10, None, None), "060752": (20, 7, 3), "060753": (None, 9, 4)}
    with pytest.raises(ValueError):
        L.read_census(spark, paths[2:])


def test_crime_and_parcels(spark, put):
    crime = put("crime.json", [
        {"by_month_incident_date": "2020-01", "analysis_neighborhood": "Mission", "incident_category": "Assault", "count": "3"},
        {"analysis_neighborhood": None, "incident_category": "Theft", "count": "9"},
        {"analysis_neighborhood": "Mission", "incident_category": "Theft", "count": "many"}])
    assert sorted(r["count"] for r in L.read_crime_pages(spark, crime).collect()) == [0, 3]
    parcels = put("parcels.json", [
        {"the_geom": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}, "blklot": "1",
         "yrbuilt": "1799", "landuse": "PDR", "resunits": "2", "st_area_sh": "10.5"},
        {"the_geom": None, "blklot": "2", "yrbuilt": "1950"},
        {"the_geom": {"type": "MultiPolygon", "coordinates": []}, "blklot": "3", "yrbuilt": "2025", "resunits": "?"}])
    got = {r["blklot"]: r for r in L.read_parcel_pages(spark, parcels).collect()}
    assert set(got) == {"1", "3"}
    assert (got["1"]["yrbuilt"], got["1"]["st_area_sh"]) == (None, 10.5)
    assert (got["3"]["yrbuilt"], got["3"]["resunits"]) == (2025, None)
    assert json.loads(got["1"]["the_geom"]["coordinates"]) == [[[0, 0], [1, 0], [0, 1], [0, 0]]]


def test_polygons(spark, put):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    path = put("hoods.geojson", {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"nhood": " bayview "}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"nhood": "SOMA"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]})
    got = {r["neighborhood"]: r["geometry"] for r in L.read_polygons(spark, path).collect()}
    assert {k: len(v) for k, v in got.items()} == {"Bayview": 1, "Soma": 2}


def test_keyed_csv_keeps_leading_zeros(spark, put, rows):
    path = put("t.csv", "geoid,total_population\n06075010100,12.0\n06075010200,\n")
    assert rows(L.read_keyed_csv(spark, path, "geoid string, total_population double")) == [
        ("06075010100", 12.0), ("06075010200", None)]


def test_missing_inputs_are_named(spark, put, tmp_path):
    with pytest.raises(FileNotFoundError, match="land it first"):
        L.read_table(spark, str(tmp_path / "none.parquet"), "land it first")
    with pytest.raises(FileNotFoundError):
        L.read_keyed_csv(spark, str(tmp_path / "none.csv"), "a string")
    path = str(tmp_path / "t.parquet")
    S.write_table(spark.range(3), path)
    with pytest.raises(ValueError, match="st_area_sh"):
        L.read_table(spark, path, columns=["id", "st_area_sh"])
    assert L.read_table(spark, path, columns=["id"]).count() == 3


def test_loose_csv(spark, put, rows):
    path = put("fires.csv", "incident_number,city,ems_units\n1,NA,2\n2,SF,few\n3,null,N/A\n4,,1.5\n")
    assert rows(L.read_loose_csv(spark, path, ["ems_units"])) == [
        ("1", None, 2.0), ("2", "SF", None), ("3", None, None), ("4", None, 1.5)]


def test_census_arrays_by_line(spark, put):
    tables = [census(["B01003_001E"], ["1", "10"]), census(["B01003_001E"], ["2", "20"], ["3", "30"])]
    got = L.read_census(spark, [put("acs.json", "\n".join(map(json.dumps, tables)))], lines=True)
    assert sorted(r["total_population"] for r in got.collect()) == [10.0, 20.0, 30.0]


def test_census_arrays_do_not_grow_with_the_table(spark, monkeypatch):
    from checks import landed
    from checks.registry import Tables

    monkeypatch.setattr(landed, "ARRAY_KEYS", 100, raising=False)
    t = Tables(spark, "/root/testdata/sf0.01")
    got = landed.census_files(t)
    assert got.count() == got.distinct().count() == t.customer.count()
    sizes = [len(json.loads(r["value"])) for r in spark.read.text(got.inputFiles()).collect()]
    assert len(sizes) > 2 and max(sizes) <= 101


def test_find_source_reads_all_parts(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as string) AS id", "id AS ems_units").repartition(4).write.csv(str(tmp_path / "parts"), header=True)
    got = L.find_source(spark, str(tmp_path / "parts"))
    assert sorted(r["ems_units"] for r in got.collect()) == [float(i) for i in range(40)]


def test_find_source_prefers_parquet(spark, put, tmp_path):
    with pytest.raises(FileNotFoundError):
        L.find_source(spark, str(tmp_path))
    put("b.csv", "city,ems_units\nB,1\n")
    put("a.csv", "city,ems_units\nA,2\n")
    assert [tuple(r) for r in L.find_source(spark, str(tmp_path)).collect()] == [("A", 2.0)]
    S.write_table(spark.range(4), str(tmp_path / "fire_incidents.parquet"))
    assert L.find_source(spark, str(tmp_path)).columns == ["id"]


def test_file_sizes(spark, put, tmp_path):
    put("d/a.csv", "12345")
    put("d/sub/b.csv", "123")
    put("d/c.txt", "1")
    assert sorted(r["length"] for r in L.file_sizes(spark, str(tmp_path / "d"), "*.csv").collect()) == [3, 5]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(250)], "k int, v string").repartition(4)
    S.write_csv(df, str(tmp_path / "out"), sep=";")
    assert spark.read.csv(str(tmp_path / "out"), header=True, sep=";").count() == 250
    S.write_sample(df, str(tmp_path / "sample"), ["k"])
    back = spark.read.schema("k int, v string").csv(str(tmp_path / "sample"), header=True)
    assert sorted(r["k"] for r in back.collect()) == list(range(100))
    S.write_table(df, str(tmp_path / "t"), partition_by=["v"])
    assert spark.read.parquet(str(tmp_path / "t")).where("v = 'v7'").count() == 1


def test_hash_sample_is_stable(spark, rows):
    df = spark.range(1000)
    first = rows(S.hash_sample(df, ["id"]))
    assert len(first) == 5 and first == rows(S.hash_sample(df.repartition(7), ["id"]))
    assert first != rows(S.hash_sample(df, ["id"], seed=7))


def test_absent_columns(spark):
    df = with_absent_columns(spark.range(1), ["id", "x"], "double")
    assert df.dtypes == [("id", "bigint"), ("x", "double")] and df.first()["x"] is None


def test_csv_with_quotes_commas_and_backslashes(spark, tmp_path):
    """As other tools write it, and back and forth through the own writer."""
    values = ['a ""b"" c, d'.replace('""', '"'), "back\\slash", 'ends with "', "plain", 'line\nend, "x"']
    text = "id,name\n" + "".join(f'{i},"{v.replace(chr(34), chr(34) * 2)}"\n' for i, v in enumerate(values))
    (tmp_path / "in.csv").write_text(text)
    path, schema = str(tmp_path / "in.csv"), "id int, name string"
    from emberfield.sources.landed import read_keyed_csv, read_loose_csv
    from emberfield.sources.sinks import write_csv

    keyed = read_keyed_csv(spark, path, schema, multi_line=True)
    assert [r["name"] for r in keyed.orderBy("id").collect()] == values
    assert [r["name"] for r in read_loose_csv(spark, path, multi_line=True).orderBy("id").collect()] == values
    write_csv(keyed, str(tmp_path / "out"))
    again = read_keyed_csv(spark, str(tmp_path / "out"), schema, multi_line=True)
    assert [r["name"] for r in again.orderBy("id").collect()] == values


def test_unicode_blanks_are_stripped(spark):
    from emberfield.functions.text import title_case

    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    names = [b + "mission bay" + b + " " for b in blanks]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0] for r in df.select(title_case(F.col("n"))).collect()} == {"Mission Bay"}
