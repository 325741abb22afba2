"""The steps on folders, from landed pages to the study, and joins without broadcasting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.operators.quantiles import exact_quantiles
from emberfield.operators.spatial import join_within
from emberfield.plans import run
from tests.test_plans import HOODS, inputs  # noqa: F401
from tests.test_quantiles import PROBS, check


@pytest.fixture(scope="module")
def folders(spark, inputs, tmp_path_factory):  # noqa: F811
    """Landed pages written from the hand-made inputs, then landed and built."""
    root = tmp_path_factory.mktemp("run")
    landing, raw, results = root / "landing", root / "raw", root / "results"
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    facts = inputs["incidents"]
    times = {c: F.date_format(c, iso) for c in K.INCIDENT_TIMES}
    pages = {
        "incidents": [r.asDict() for r in facts.withColumns(times).collect()],
        "crosswalk": [{"geoid": r["geoid"].lstrip("0") or "0", "neighborhoods_analysis_boundaries": r["neighborhood"]}
                      for r in inputs["crosswalk"].collect()],
        "crime": [r.asDict() for r in inputs["crime"].collect()],
        "parcels": [{**r.asDict(), "the_geom": {"type": r["the_geom"]["type"], "coordinates": json.loads(r["the_geom"]["coordinates"])}}
                    for r in inputs["parcels"].collect()],
    }
    for name, content in pages.items():
        (landing / name).mkdir(parents=True)
        half = len(content) // 2
        for i, part in enumerate((content[:half], content[half:])):
            (landing / name / f"page{i}.json").write_text(json.dumps(part, indent=0))
    codes = {v: k for k, v in K.CENSUS_MEASURES.items()}
    for year in K.SNAPSHOT_YEARS:
        folder = landing / "tracts" / str(year)
        folder.mkdir(parents=True)
        rows = [r for r in inputs["tracts"].collect() if r["snapshot_year"] == year]
        groups = [K.CENSUS_COLUMNS] if year != 2009 else [K.CENSUS_COLUMNS[:5], K.CENSUS_COLUMNS[7:]]
        for i, group in enumerate(groups):
            head = ["NAME", *[codes[c] for c in group], "state", "county", "tract"]
            body = [["T", *[None if r[c] is None else str(r[c]) for c in group],
                     r["geoid"][:2], r["geoid"][2:5], r["geoid"][5:]] for r in rows]
            (folder / f"g{i}.json").write_text(json.dumps([head, *body]))
    raw.mkdir()
    (raw / "neighborhoods.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"nhood": r["neighborhood"].lower()},
         "geometry": {"type": "MultiPolygon", "coordinates": r["geometry"]}} for r in inputs["polygons"].collect()]}))
    run.land(spark, str(landing), str(raw))
    features = run.build(spark, str(raw), str(results))
    return str(raw), str(results), features, root


def test_features_from_files_equal_features_from_tables(inputs, folders):  # noqa: F811
    from emberfield.plans import incidents

    want = incidents.feature_table(incidents.base_table(**inputs))
    got = folders[2]
    assert got.count() == want.count() > 300
    shared = [c for c in want.columns if c in got.columns]
    assert set(want.columns) - set(got.columns) == set()
    assert got.select(shared).exceptAll(want.select(shared)).count() == 0


def test_overview(spark, folders):
    tables = run.overview(spark, folders[0], folders[1])
    inventory = {r["table"]: r["rows"] for r in tables["inventory"].collect()}
    assert inventory["neighborhoods.geojson"] == 3 and inventory["crosswalk.csv"] == 9
    assert inventory["crime_by_district.csv"] == 3 and inventory["census_by_district_2014.csv"] == 3
    assert tables["sample"].count() == 5 and tables["rates"].count() == len(K.RATES)
    assert tables["result_files"].count() > 5


def test_study_and_sample_steps(spark, folders):
    raw, results, _, root = folders
    run.study(spark, results, str(root / "study"))
    table = spark.read.csv(str(root / "study" / "fire_model"), header=True)
    assert table.count() == 1 + len(K.SOCIO_COLUMNS)
    run.export_sample(spark, results, str(root / "sample"))
    assert spark.read.csv(str(root / "sample"), header=True).count() == 100


def test_statistics_and_report_steps(spark, folders):
    raw, _, _, root = folders
    run.statistics(spark, raw, str(root / "stats"))
    assert spark.read.csv(str(root / "stats"), header=True).where("section = 'response'").count() > 0
    run.report(spark, raw, str(root / "report"))
    assert spark.read.csv(str(root / "report" / "per_weekday"), header=True).count() == 7


def test_missing_data_set_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Land the data set first"):
        run.read_raw(spark, str(tmp_path))


@pytest.fixture
def no_broadcast(spark):
    """As if every table were too big: all joins shuffle."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def test_quantiles_of_a_hot_group_without_broadcast(spark, no_broadcast):
    rnd = random.Random(8)
    data = [(0, rnd.gauss(0, 1)) for _ in range(6000)] + [(1 + i % 50, rnd.gauss(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(data, "g int, x double").repartition(6)
    check(exact_quantiles(df, "x", PROBS, by=["g"], accuracy=300), data, "linear")


def test_spatial_join_of_a_hot_cell_without_broadcast(spark, no_broadcast):
    square = [[[[0., 0.], [4., 0.], [4., 4.], [0., 4.], [0., 0.]]]]
    shapes = spark.createDataFrame([("s", square)], "name string, geometry array<array<array<array<double>>>>")
    points = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") % 7).cast("double").alias("x"),
                                      F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") % 5).cast("double").alias("y"))
    joined = join_within(points, shapes)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    want = points.where("x > 0 and x < 4 and y > 0 and y < 4").count()
    assert joined.count() == 3000 and joined.where("name is not null").count() == want


def test_one_hot_district_is_split(spark, inputs, no_broadcast):  # noqa: F811
    """The incidents take part in one join, which adaptive execution can split."""
    from emberfield.plans import incidents

    rollups = incidents.build_rollups(*[inputs[k] for k in ("tracts", "crosswalk", "crime", "parcels", "polygons")])
    hot = inputs["incidents"].where("alarm_dttm is not null").limit(1).withColumn(
        "arrival_dttm", F.expr("alarm_dttm + interval 5 minutes")).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.lit(20_001)))).drop("copy")
    facts = inputs["incidents"].union(hot).repartition(8)
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        out = incidents.attach_rollups(facts, rollups)
        out.foreachPartition(lambda rows: None)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k in small:
            spark.conf.unset(k)
    assert "skew=true" in plan and plan.count("SortMergeJoin") == 1 and len(rows) > 20_000


def test_base_table_without_broadcast(inputs, folders, no_broadcast):  # noqa: F811
    from emberfield.plans import incidents

    want = incidents.feature_table(incidents.base_table(**inputs))
    assert want.select("incident_number", *K.RATES).exceptAll(
        folders[2].select("incident_number", *K.RATES)).count() == 0
    assert {h for h, in want.select("neighborhood").distinct().collect()} == {*HOODS, "Nowhere"}


def test_shuffle_files_go_with_the_write(spark):
    """What ``materialize`` shuffles is not left on the disks until the driver collects its garbage."""
    import time

    from emberfield.session import SHUFFLE_CLEANUP, materialize

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
            if f.getName().startswith("shuffle_")}

    before, was = files(), spark.conf.get(SHUFFLE_CLEANUP)
    table = materialize(spark.range(5000).repartition(3).groupBy("id").count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and table.count() == 5000 and spark.conf.get(SHUFFLE_CLEANUP) == was
