"""End-to-end plans on hand-made inputs."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.plans import dispatch, incidents, report, statistics, study
from emberfield.session import materialize, work_dir
from emberfield.streaming.enrich import enrich, write_features

HOODS = ["Mission", "Soma", "Castro/Upper Market"]


def box(x, y, size=10.0):
    return [[[[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]]]


@pytest.fixture(scope="module")
def inputs(spark):
    rnd = random.Random(1)
    start = dt.datetime(2008, 1, 1)
    facts = []
    for i in range(600):
        alarm = start + dt.timedelta(minutes=rnd.randint(0, 17 * 365 * 1440))
        wait = rnd.choice([-60, 0, 125, 3600, 3601, 250, 431])
        facts.append((str(i), alarm, alarm, alarm + dt.timedelta(seconds=wait),
                      rnd.choice([" mission", "SOMA", "castro/upper market ", "nowhere"]),
                      rnd.choice(["111 - Building fire", "131 - Car fire", "311 - Medical", "321 - EMS", "735 - Alarm"])))
    out = {"incidents": spark.createDataFrame(
        facts, "incident_number string, incident_date timestamp_ntz, alarm_dttm timestamp_ntz, "
        "arrival_dttm timestamp_ntz, neighborhood_district string, primary_situation string")}
    tracts, n = [], 0
    for year in K.SNAPSHOT_YEARS:
        for g in range(9):
            v = [float(rnd.randint(10, 900)) for _ in K.CENSUS_COLUMNS]
            if year == 2009:
                v[5] = v[6] = None
            if g == 4:
                v[1] = None
            tracts.append((f"{g:011d}", year, *v))
    out["tracts"] = spark.createDataFrame(
        tracts, "geoid string, snapshot_year int, " + ", ".join(f"{c} double" for c in K.CENSUS_COLUMNS))
    out["crosswalk"] = spark.createDataFrame(
        [(f"{g:011d}", HOODS[g % 3] if g < 8 else None) for g in range(9)], "geoid string, neighborhood string")
    out["crime"] = spark.createDataFrame(
        [("2020-01", h.lower(), c, str(n)) for n, (h, c) in enumerate((h, c) for h in HOODS for c in (
            "Assault", "Theft", " Arson", "Other", "", None))],
        "by_month_incident_date string, analysis_neighborhood string, incident_category string, count string")
    parcels = []
    for i in range(200):
        x, y = rnd.uniform(-3, 33), rnd.uniform(1, 9)
        ring = [[x, y], [x + .2, y], [x + .2, y + .2], [x, y + .2], [x, y]]
        parcels.append((("Polygon", str([ring])), str(i), rnd.choice([None, 1920.0, 1950.0, 2000.0]),
                        rnd.choice(["RESIDENT", "MIXRES", "PDR", "VACANT", None]), float(rnd.randint(0, 4)),
                        rnd.choice([None, 100.5, 2000.25])))
    out["parcels"] = spark.createDataFrame(
        parcels, "the_geom struct<type:string,coordinates:string>, blklot string, yrbuilt double, landuse string, "
        "resunits double, st_area_sh double")
    out["polygons"] = spark.createDataFrame(
        [(h, box(10.0 * i, 0.0)) for i, h in enumerate(HOODS)],
        "neighborhood string, geometry array<array<array<array<double>>>>")
    return out


@pytest.fixture(scope="module")
def features(spark, inputs):
    return materialize(incidents.feature_table(incidents.base_table(**inputs)), "features")


def test_base_table_against_pandas(inputs, features):
    """The same steps with pandas merges and sums."""
    f = inputs["incidents"].toPandas()
    minutes = (f["arrival_dttm"] - f["alarm_dttm"]).dt.total_seconds() / 60
    f = f.assign(response_time_min=minutes)[(minutes >= 0) & (minutes <= 60)]
    f["neighborhood"] = f["neighborhood_district"].str.strip().str.title()
    f["year"] = f["incident_date"].dt.year
    f["acs_year"] = [min(K.SNAPSHOT_YEARS, key=lambda y: abs(y - v)) for v in f["year"]]

    t = inputs["tracts"].toPandas().merge(inputs["crosswalk"].toPandas().dropna(), on="geoid")
    pop = t["total_population"]
    t["wi"], t["wr"] = t["median_household_income"] * pop, t["median_gross_rent"] * pop
    g = t.groupby(["neighborhood", "snapshot_year"])[["total_population", "wi", "wr", *K.CENSUS_SUMS]].sum()
    g["median_household_income"] = (g["wi"] / g["total_population"]).round(0)
    g["median_gross_rent"] = (g["wr"] / g["total_population"]).round(0)
    want = f.merge(g.reset_index(), left_on=["neighborhood", "acs_year"], right_on=["neighborhood", "snapshot_year"], how="left")
    want["poverty_rate"] = (want["poverty_below"] / want["poverty_universe_total"] * 100).round(2)
    want["bachelor_rate"] = (want["bachelor_degree_count"] / want["education_universe_total"].where(
        want["education_universe_total"] > 0) * 100).round(2)

    got = features.toPandas().sort_values("incident_number").reset_index(drop=True)
    want = want.sort_values("incident_number").reset_index(drop=True)
    assert len(got) == len(want) > 300
    for c in ["response_time_min", "year", "acs_year", "neighborhood", "total_population", "median_household_income",
              "median_gross_rent", "poverty_rate", "bachelor_rate", *K.CENSUS_SUMS]:
        left, right = ([None if pd.isna(v) else v for v in s] for s in (got[c], want[c]))
        assert left == right, c


def test_crime_and_land_attach(inputs, features):
    by_hood = {r["neighborhood"]: r for r in features.dropDuplicates(["neighborhood"]).collect()}
    assert by_hood["Mission"]["total_crimes"] == 0 + 1 + 2 + 3
    assert by_hood["Mission"]["violent_crime_count"] == 0 and by_hood["Mission"]["property_crime_count"] == 3
    assert by_hood["Nowhere"]["total_crimes"] is None and by_hood["Nowhere"]["parcel_count"] is None
    p = inputs["parcels"].toPandas()
    x = [eval(g["coordinates"])[0][0][0] + 0.1 for g in p["the_geom"]]
    soma = p[[10 < v < 20 for v in x]]
    r = by_hood["Soma"]
    assert r["parcel_count"] == len(soma) and r["yrbuilt_count"] == soma["yrbuilt"].notna().sum()
    assert r["pre1940_count"] == (soma["yrbuilt"] < 1940).sum() and r["total_resunits"] == soma["resunits"].sum()
    assert r["residential_count"] == soma["landuse"].isin(["RESIDENT", "MIXRES"]).sum()
    assert r["total_area_sqft"] == pytest.approx(soma["st_area_sh"].sum())
    assert r["high_risk_commercial_area_sqft"] == pytest.approx(soma.loc[soma["landuse"] == "PDR", "st_area_sh"].sum())
    assert r["pct_residential"] == round(r["residential_count"] / r["parcel_count"] * 100, 2)


def test_feature_columns_and_types(features):
    types = dict(features.dtypes)
    assert set(K.RATES) <= set(types) and all(types[c] == "double" for c in K.RATES)
    assert all(types[c] == "bigint" for c in ("total_population", "poverty_below", "total_resunits"))
    assert "snapshot_year" not in types and not any(c.startswith("_") for c in types)


def test_incidents_are_not_shuffled(inputs):
    """Roll-ups are broadcast by their file size: the incident side has no exchange."""
    base = incidents.base_table(**inputs)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_missing_measures(features):
    got = {r["column"]: r["nulls"] for r in incidents.missing_measures(features).collect()}
    nowhere = features.where("neighborhood = 'Nowhere'").count()
    assert got["total_crimes"] == got["total_population"] == nowhere > 0


def test_all_null_group_sums_to_zero(spark):
    from emberfield.operators.rollup import weighted_rollup

    df = spark.createDataFrame([("a", 2.0, None, None), ("a", 3.0, None, None), ("b", None, 5.0, 1.0), ("c", 0.0, 1.0, 1.0)],
                               "g string, w double, v double, s double")
    got = {r["g"]: (r["w"], r["v"], r["s"]) for r in weighted_rollup(df, ["g"], "w", ["v"], ["s"]).collect()}
    assert got == {"a": (5, 0, 0), "b": (0, None, 1), "c": (0, None, 1)}
    strict = weighted_rollup(df, ["g"], "w", ["v"], ["s"], strict_weights=True).where("g = 'a'").first()
    assert strict["v"] is None


def test_study_runs_whole(spark, features):
    # The bachelor columns are missing before 2012, so those incidents drop out of the model.
    tables = study.run_study(features)
    full = {r["term"]: r for r in tables["full_model"].collect()}
    assert {"const", *K.SOCIO_COLUMNS, *K.CONTROL_COLUMNS} <= set(full)
    assert "cat_Feuer" not in full and full["cat_Service"]["coef"] == pytest.approx(0, abs=1e-9)
    n = full["const"]["n"]
    kept = features.where("response_time_min > 0 and response_time_min < 60").dropna(
        subset=[*K.SOCIO_COLUMNS]).count()
    assert n == kept > 100
    versus = tables["full_vs_base"].first()
    assert versus["delta"] == pytest.approx(versus["r2"] - versus["r2_base"]) and versus["delta"] >= 0
    fire = tables["fire_model"].collect()
    assert [r["term"] for r in fire] == ["const", *K.SOCIO_COLUMNS] and {r["stratum"] for r in fire} == {"fire"}
    rates = tables["fire_rates"].toPandas()
    assert sorted(rates["neighborhood"]) == sorted(HOODS)
    pdf = features.where("response_time_min > 0 and response_time_min < 60").dropna(subset=[*K.SOCIO_COLUMNS]).toPandas()
    for h, part in pdf.groupby("neighborhood"):
        r = rates[rates["neighborhood"] == h].iloc[0]
        hits = part["primary_situation"].str[:3].isin(["111", "131"]).sum()
        assert (r["total"], r["hits"]) == (len(part), hits) and r["rate_pct"] == round(hits / len(part) * 100, 3)
        first = part.sort_values(["acs_year", "alarm_dttm", "incident_number"]).iloc[0]
        assert r["poverty_rate"] == first["poverty_rate"]
    assert len(tables["fire_rate_top"].collect()) == 3
    assert study.clustered_model(
        features.dropna(subset=[*K.SOCIO_COLUMNS])).count() == 1 + len(K.SOCIO_COLUMNS) + len(K.CONTROL_COLUMNS)


def test_stream_gives_the_batch_rows(spark, inputs, tmp_path):
    from emberfield.operators.rollup import census_rollup, crime_rollup

    census = materialize(census_rollup(inputs["tracts"], inputs["crosswalk"], by=["snapshot_year"]), "census")
    crime = materialize(crime_rollup(inputs["crime"]), "crime")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    inputs["incidents"].repartition(3).write.parquet(source)
    stream = spark.readStream.schema(inputs["incidents"].schema).parquet(source)
    # A second call appends what has arrived since, without a progress folder being named.
    for _ in range(2):
        query = write_features(enrich(stream, census, [crime]), target)
        query.awaitTermination(120)
        got, want = spark.read.parquet(target), enrich(spark.read.parquet(source), census, [crime])
        assert got.count() == want.count() > 0
        assert got.exceptAll(want.select(got.columns)).count() == 0
        inputs["incidents"].limit(7).write.mode("append").parquet(source)


# Wide export -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def export(spark):
    rnd = random.Random(9)
    data = []
    for i in range(400):
        alarm = dt.datetime(2001, 6, 1) + dt.timedelta(minutes=rnd.randint(0, 5 * 365 * 1440))
        iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}"
        arrival = alarm + dt.timedelta(seconds=rnd.choice([-5, 61, 245, 500, 4000]), milliseconds=rnd.randint(0, 999))
        data.append((str(i % 390), iso(alarm), iso(alarm) if i % 50 else "bad", iso(arrival) if i % 9 else None,
                     iso(alarm + dt.timedelta(minutes=30)), rnd.choice(["111 fire", "311 ems", None]),
                     rnd.choice(["B01", "B02", None]), rnd.choice(["mission", "soma", None]),
                     rnd.choice([None, "1", "2", "junk"]), rnd.choice(["0", "0", "1"]), rnd.choice(["0", "1000", "50000.5"]),
                     rnd.choice(["alone", None])))
    return spark.createDataFrame(
        data, "incident_number string, incident_date string, alarm_dttm string, arrival_dttm string, close_dttm string, "
        "primary_situation string, battalion string, neighborhood_district string, suppression_units string, "
        "fire_fatalities string, estimated_property_loss string, fire_spread string")


def test_statistics_sections(export):
    tables = statistics.statistics_tables(export)
    assert set(tables) == {"schema", "shape", "missing", "categories", "numbers", "coverage", "response", "casualties"}
    pdf = export.toPandas()
    missing = {r["column"]: r["nulls"] for r in tables["missing"].collect()}
    assert missing["battalion"] == pdf["battalion"].isna().sum()
    units = pd.to_numeric(pdf["suppression_units"], errors="coerce")
    assert missing["suppression_units"] == units.isna().sum()
    top = tables["categories"].where("column = 'battalion' and rank = 1").first()
    counts = pdf["battalion"].value_counts()
    assert top["n"] == counts.max() and top["pct"] == pytest.approx(counts.max() / 4) and top["n_unique"] == 3
    n = tables["numbers"].where("column = 'suppression_units'").first()
    assert (n["count"], n["mean"]) == (units.notna().sum(), pytest.approx(units.mean()))
    covered = {r["column"]: r["first"] for r in tables["coverage"].collect()}
    assert covered["incident_date"] == pd.to_datetime(pdf["incident_date"]).min().to_pydatetime()
    seconds = (pd.to_datetime(pdf["arrival_dttm"], errors="coerce")
               - pd.to_datetime(pdf["alarm_dttm"], format="%Y-%m-%dT%H:%M:%S.%f", errors="coerce")).dt.total_seconds()
    minutes = (seconds.dropna() // 1).where(seconds >= 0).dropna() / 60
    minutes = minutes[minutes.between(0, 480)]
    r = tables["response"].where(F.col("label") == "Alarm → Arrival").first()
    assert (r["n"], r["mean"], r["median"], r["max"]) == pytest.approx(
        (len(minutes), minutes.mean(), minutes.median(), minutes.max()))
    ordered = sorted(minutes)
    assert r["p90"] == ordered[int(0.9 * (len(ordered) - 1) + 0.5)]
    c = tables["casualties"].first()
    assert c["total"] == c["rows_above_zero"] == (pdf["fire_fatalities"] == "1").sum()


def test_statistics_long(export, tmp_path):
    from emberfield.sources.sinks import write_statistics

    long = statistics.statistics_long(export)
    assert long.columns == ["section", "item", "metric", "value"]
    write_statistics(long, str(tmp_path / "stats"))
    back = export.sparkSession.read.csv(str(tmp_path / "stats"), header=True)
    assert back.where("section = 'shape' and metric = 'rows'").first()["value"] == "400"


def test_report_tables(export):
    prepared = report.prepare_export(export)
    tables = {k: v.toPandas() for k, v in report.report_tables(prepared).items()}
    pdf = export.toPandas()
    figures = tables["key_figures"].iloc[0]
    assert figures["total_records"] == 400 and figures["unique_incidents"] == 390
    assert figures["unique_neighborhoods"] == 3
    alarm = pd.to_datetime(pdf["alarm_dttm"], format="%Y-%m-%dT%H:%M:%S.%f", errors="coerce").dropna()
    assert tables["per_year"]["n"].sum() == (alarm.dt.year >= 2003).sum() and tables["per_year"]["year"].min() == 2003
    assert tables["per_month"]["label"].tolist() and tables["per_month"]["n"].sum() == len(alarm)
    assert tables["per_weekday"].sort_values("position")["n"].tolist() == [
        int((alarm.dt.weekday == d).sum()) for d in range(7)]
    assert tables["per_battalion"]["battalion"].isna().sum() == 1
    assert tables["response_histogram"]["n"].sum() == tables["response_percentiles"]["n"].iloc[0]
    assert len(tables["response_histogram"]) == 60 and len(tables["loss_histogram"]) == 40
    assert tables["values_suppression_units"]["suppression_units"].tolist() == [1, 2]
    assert report.TOP_VALUES["primary_situation"] == (20, 52)
    assert tables["top_primary_situation"]["label"].str.len().max() <= 52
    done = tables["completeness"]
    assert "year" not in done["column"].tolist() and done["null_pct"].is_monotonic_increasing
    assert set(done.loc[done["column"] == "fire_spread", "grade"]) <= {"partial", "sparse"}


@pytest.mark.parametrize("derive", [lambda df: report.report_tables(report.prepare_export(df)), statistics.statistics_tables])
def test_the_export_is_read_few_times(spark, export, tmp_path, derive):
    """All tables together scan the files of the export at most three times."""
    path = str(tmp_path / "export")
    export.write.parquet(path)
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        for table in derive(spark.read.parquet(path)).values():
            table.collect()
        plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    assert 1 <= sum(p.count(f"{path}]") for p in plans) <= 3


def test_dispatch_tables(spark):
    t0 = dt.datetime(2021, 3, 1, 7, 30)
    data = [(u, t0 + dt.timedelta(hours=h), t0 + dt.timedelta(hours=h, minutes=m), float(h))
            for u, h, m in [("E01", 0, 4), ("E01", 1, 6), ("T01", 30, 10), ("E01", 400, None or 8)]]
    df = spark.createDataFrame(data, "unit string, d timestamp_ntz, s timestamp_ntz, v double")
    assert {r["unit"]: (r["calls"], r["mean_minutes"]) for r in dispatch.unit_activity(df, "unit", "d", "s").collect()} == {
        "E01": (3, 6.0), "T01": (1, 10.0)}
    r = dispatch.response_summary(df, "d", "s").first()
    assert (r["calls"], r["n"], r["mean"], r["median"], r["p95"]) == pytest.approx((4, 4, 7, 7, 9.7))
    assert {(r["shift"], r["n"]) for r in dispatch.calls_per_shift(df, "d").collect()} == {
        (dt.date(2021, 2, 28), 1), (dt.date(2021, 3, 1), 1), (dt.date(2021, 3, 2), 1), (dt.date(2021, 3, 17), 1)}
    assert {(r["hour"], r["n"]) for r in dispatch.calls_per_hour_of_day(df, "d").collect()} == {(7, 1), (8, 1), (13, 1), (23, 1)}
    top = dispatch.top_ten(df, ["unit"]).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in top] == [("E01", 3), ("T01", 1)]


def test_work_dir_is_the_configured_one(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_work_dir_of_a_cluster_must_be_named():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default) if self.master else default

    class Session:
        conf = Conf()

    for Conf.master in (True, False):  # a cluster, and a session that hides its master
        with pytest.raises(ValueError):
            work_dir(Session())
