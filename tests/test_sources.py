import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sightline.schema import RAW_OBSERVATION
from sightline.sources import api_pages, catalog, metrics_io, observations_csv
from sightline.operators import ingest
from sightline.operators import period_metrics as pm
from tests.fixtures import BOUNDARY, make_obs

HEADER = ("id,uuid,observed_on,time_observed_at,user_id,created_at,scientific_name,common_name,taxon_id,"
          "taxon_kingdom_name,taxon_species_name,latitude")


def _write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_csv_export_typed_with_bad_values(spark, tmp_dir):
    _write(tmp_dir, "a.csv", [
        HEADER,
        "1,u1,2019-04-26,2019-04-26 18:03:11 UTC,5,2019-04-26 19:00:00 UTC,Red Plate,plate,9,Plantae,Red Plate,51.0",
        "2,u2,,,6,2019-04-27T01:00:00-06:00,old rod,,10,Plantae,,51.1",
        "3,u3,garbage,nonsense,x7,,z,,11,,,",
    ])
    _write(tmp_dir, "b.csv", [HEADER, "1,u1,2019-04-26,,5,,Red Plate,plate,9,Plantae,Red Plate,51.0"])
    _write(tmp_dir, "notes.txt", ["not an export"])
    df = observations_csv.read_observations_csv(spark, tmp_dir)
    assert [f.name for f in df.schema.fields][:11] == [f.name for f in RAW_OBSERVATION.fields]
    rows = {(r.id, r.source_file): r for r in df.collect()}
    assert len(rows) == 4  # the same id in two files stays twice
    r1 = rows[(1, "a.csv")]
    assert r1.observed_on == dt.date(2019, 4, 26) and r1.time_observed_at == dt.datetime(2019, 4, 26, 18, 3, 11)
    assert rows[(2, "a.csv")].created_at == dt.datetime(2019, 4, 27, 7, 0, 0)  # offset -> UTC
    bad = rows[(3, "a.csv")]
    assert bad.observed_on is None and bad.time_observed_at is None and bad.user_id is None
    audit = {r.source_file: r for r in observations_csv.load_audit(df).collect()}
    assert audit["a.csv"].rows == 3 and audit["a.csv"].null_dates == 2
    assert audit[None].is_total and audit[None].rows == 4


def test_missing_columns_and_empty_folder(spark, tmp_dir):
    _write(tmp_dir, "a.csv", ["id,observed_on", "1,2019-01-01"])
    with pytest.raises(ValueError, match="Missing required columns: uuid, time_observed_at"):
        observations_csv.read_observations_csv(spark, tmp_dir)
    empty = os.path.join(tmp_dir, "empty")
    os.makedirs(empty)
    with pytest.raises(FileNotFoundError):
        observations_csv.read_observations_csv(spark, empty)


def test_csv_round_trip(spark, tmp_dir):
    obs = make_obs(spark, BOUNDARY)
    out = os.path.join(tmp_dir, "export")
    observations_csv.write_observations_csv(obs, out)
    for multi_line in (True, False, None):
        back = observations_csv.read_observations_csv(spark, out, multi_line=multi_line).drop("source_file")
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, obs.collect()), key=repr)


def test_quoted_line_break_in_free_text(spark, tmp_dir):
    _write(tmp_dir, "a.csv", [
        HEADER + ",description",
        '1,u1,2019-04-26,,5,,Red Plate,plate,9,Plantae,Red Plate,51.0,"first line',
        'second line"',
        "2,u2,2019-04-27,,6,,old rod,,10,Plantae,,51.1,plain",
    ])
    os.makedirs(os.path.join(tmp_dir, "sub dir"))
    plain = [f"{i},u,2019-04-27,,6,,\"old \"\"rod\"\", long\",,10,Plantae,,51.1" for i in range(3, 400)]
    _write(os.path.join(tmp_dir, "sub dir"), "b c.csv", [HEADER, *plain])
    files = [os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "sub dir", "b c.csv")]
    assert observations_csv.unbalanced_lines(spark, files) == {files[0]: 2}
    df = observations_csv.read_observations_csv(spark, tmp_dir, "{*.csv,*/*.csv}")
    assert sorted(r.id for r in df.collect()) == list(range(1, 400))
    # only the file with the break is read by one task
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        parts = df.select("id", F.spark_partition_id().alias("p"), "source_file").groupBy("source_file").agg(
            F.count_distinct("p").alias("tasks"))
        tasks = {r.source_file: r.tasks for r in parts.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks["a.csv"] == 1 and len(tasks) == 2 and max(tasks.values()) > 1


def test_files_are_read_by_their_own_headers(spark, tmp_dir):
    swapped = HEADER.replace("user_id", "X").replace("taxon_id", "user_id").replace("X", "taxon_id")
    _write(tmp_dir, "a.csv", [HEADER, "1,u1,2019-04-26,,5,,Red Plate,plate,9,Plantae,Red Plate,51.0"])
    _write(tmp_dir, "b.csv", [swapped, "2,u2,2019-04-26,,99,,Red Plate,plate,7,Plantae,Red Plate,51.0"])
    _write(tmp_dir, "c.csv", ["note," + HEADER, "extra,3,u3,2019-04-26,,6,,Red Plate,plate,8,Plantae,Red Plate,51.0"])
    rows = {r.id: r for r in observations_csv.read_observations_csv(spark, tmp_dir).collect()}
    assert [(rows[i].user_id, rows[i].taxon_id, rows[i].uuid) for i in (1, 2, 3)] == [
        (5, 9, "u1"), (7, 99, "u2"), (6, 8, "u3")]
    _write(tmp_dir, "d.csv", ["id,observed_on", "4,2019-04-26"])
    with pytest.raises(ValueError, match="Missing required columns: uuid.*d.csv"):
        observations_csv.read_observations_csv(spark, tmp_dir)


def test_doubled_quotes_blanks_and_fractions_survive(spark, tmp_dir):
    _write(tmp_dir, "a.csv", [
        HEADER, '1,u1,2019-04-26,,5,,"say ""hi"", ok",plate,9,Plantae,Red Plate,51.0'])
    row = observations_csv.read_observations_csv(spark, tmp_dir).first()
    assert row.scientific_name == 'say "hi", ok' and row.taxon_id == 9
    obs = make_obs(spark, [(1, "2020-01-01", 1, 5, ' two  blanks "q", ', "a", dt.datetime(2020, 1, 1, 1, 2, 3, 456789))])
    out = os.path.join(tmp_dir, "out")
    observations_csv.write_observations_csv(obs, out)
    back = observations_csv.read_observations_csv(spark, out).drop("source_file")
    assert list(map(tuple, back.collect())) == list(map(tuple, obs.collect()))


def test_audit_counts_dates_out_of_range_and_missing_ids(spark):
    obs = make_obs(spark, [(1, "0020-01-01", 1, 5, "a", "a"), (None, "2020-01-01", 1, 5, "a", "a"),
                           (2, "2031-01-01", 1, 5, "a", "a")]).selectExpr("*", "'f' as source_file")
    total = [r for r in observations_csv.load_audit(obs, latest=dt.date(2030, 1, 1)).collect() if r.is_total][0]
    assert (total.rows, total.null_ids, total.out_of_range_dates) == (3, 1, 2)


def test_union_is_strict(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(Exception):
        observations_csv.union_files([a, a.select("a")]).count()


def test_metric_tables_round_trip_csv_and_parquet(spark, tmp_dir):
    obs = make_obs(spark, BOUNDARY)
    users = pm.weekly_users(obs, as_of="2026-12-31", start="2018-01-01", end="2026-12-31")
    for fmt in ("csv", "parquet"):
        root = os.path.join(tmp_dir, fmt)
        metrics_io.write_metrics({"users": users}, root, "weekly", fmt=fmt)
        back = metrics_io.read_metrics(spark, root, "weekly", names=("users",), fmt=fmt)["users"]
        assert back.schema == metrics_io.METRIC_SCHEMAS[("week", "users")]
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, users.collect()))


def _page(page, results):
    return json.dumps({"total_results": len(results), "page": page, "per_page": 200, "results": results})


def test_api_pages_null_safe_flatten(spark, tmp_dir):
    full = {"id": 1, "uuid": "a", "observed_on": "2024-04-27", "time_observed_at": "2024-04-27T10:00:00-06:00",
            "created_at": "2024-04-27T16:01:00+00:00", "location": "51.0,-114.0",
            "geojson": {"type": "Point", "coordinates": [-114.0, 51.0]},
            "created_at_details": {"date": "2024-04-27", "week": 17}, "quality_grade": "research",
            "spam": False, "hidden": False, "user": {"id": 7},
            "taxon": {"id": 9, "name": "Red Plate", "preferred_common_name": "plate", "iconic_taxon_name": "Plantae",
                      "rank": "species", "wikipedia_url": "w", "conservation_status": {"status_name": "secure"}}}
    no_taxon = {"id": 2, "observed_on": "2024-04-28", "created_at": "2024-04-28T00:00:00Z", "user": {"id": 8}}
    null_taxon = {"id": 3, "observed_on": "2024-04-28", "taxon": None, "user": None}
    null_status = {"id": 4, "taxon": {"id": 10, "name": "x", "conservation_status": None}}
    _write(tmp_dir, "p1.json", [_page(0, [full, no_taxon]), _page(1, [null_taxon, null_status, full])])
    recs = api_pages.read_api_pages(spark, tmp_dir)
    flat = {r.id: r for r in api_pages.flatten_records(recs).collect()}
    assert flat[1].time_observed_at == dt.datetime(2024, 4, 27, 16, 0)
    assert flat[1].status_name == "secure" and json.loads(flat[1].geojson)["coordinates"] == [-114.0, 51.0]
    assert flat[1].created_at_details["week"] == "17"
    assert flat[2].taxon_id is None and flat[2].user_id == 8
    assert flat[3].taxon_id is None and flat[3].user_id is None
    assert flat[4].taxon_id == 10 and flat[4].status_name is None
    assert len(api_pages.flatten_records(recs).columns) == 2 + 21


def test_geometry_of_every_kind(spark):
    shapes = {
        "Point": [-114.0, 51.5],
        "LineString": [[0, 1], [2, -3], [1, 1]],
        "MultiPoint": [[5, 6, 700]],
        "Polygon": [[[0, 0], [4, 0], [4, 3], [0, 0]], [[1, 1], [2, 1], [1, 1]]],
        "MultiPolygon": [[[[0, 0], [1, 0], [0, 0]]], [[[-7, 8], [-6, 9], [-7, 8]]]],
        "GeometryCollection": None,
    }
    texts = [json.dumps({"type": k, "coordinates": c}) for k, c in shapes.items()]
    texts += [None, "", "{broken", "[]", '{"type": "Point"}', '{"type": "Point", "coordinates": "x"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, geojson string")
    got = [tuple(r)[2:] for r in api_pages.geometry_fields(rows).orderBy("id").collect()]
    assert got[:5] == [
        ("Point", -114.0, 51.5, -114.0, 51.5, 1),
        ("LineString", 0.0, -3.0, 2.0, 1.0, 3),
        ("MultiPoint", 5.0, 6.0, 5.0, 6.0, 1),
        ("Polygon", 0.0, 0.0, 4.0, 3.0, 7),
        ("MultiPolygon", -7.0, 0.0, 1.0, 9.0, 6),
    ]
    assert all(r[1:5] == (None,) * 4 for r in got[5:]) and got[5][0] == "GeometryCollection"


def test_bucketed_table_is_not_shuffled_by_an_anti_join(spark, tmp_dir):
    rows = spark.range(2000).selectExpr("id", "id % 7 AS user_id")
    catalog.save_table(rows, "bucketed_obs", os.path.join(tmp_dir, "t"), buckets=(8, "id"))
    more = spark.range(5000, 5100).selectExpr("id", "id % 7 AS user_id")
    catalog.save_table(more, "bucketed_obs", os.path.join(tmp_dir, "t"), mode="append", buckets=(8, "id"))
    batch = spark.range(1900, 5200, 3).selectExpr("id", "0 AS user_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = ingest.anti_new(batch, spark.table("bucketed_obs"))
        plan = new._jdf.queryExecution().executedPlan().toString()
        held = {r.id for r in spark.table("bucketed_obs").collect()}
        assert sorted(r.id for r in new.collect()) == [i for i in range(1900, 5200, 3) if i not in held]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_obs")
    # the one exchange is the batch's
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert len(held) == 2100


def test_landed_pages_are_compressed_and_whole(spark, tmp_dir):
    """Repeated ids, a null id and quotes survive; the files are gzipped and a
    fraction of their text."""
    records = spark.range(1000).select(
        F.when(F.col("id") != 7, F.col("id") % 900).alias("id"),
        F.concat(F.lit('Place "'), F.col("id").cast("string"), F.lit('", north')).alias("place_guess"),
        F.struct((F.col("id") % 5).alias("id")).alias("user"),
    )
    path = os.path.join(tmp_dir, "pages")
    api_pages.write_api_pages(records, path, files=2)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    pages = [json.loads(line) for f in files for line in gzip.open(f, "rt")]
    assert sum(map(os.path.getsize, files)) * 4 < sum(len(json.dumps(p)) for p in pages)
    assert all(list(p) == ["total_results", "page", "per_page", "results"] for p in pages if "page" in p)
    assert all(p["total_results"] == len(p["results"]) <= 200 == p["per_page"] for p in pages)
    assert [len(p["results"]) for p in pages if "page" not in p] == [1]
    back = api_pages.read_api_pages(spark, path).select("record.id", "record.place_guess", "record.user")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, records.collect()))


def test_landing_shuffles_only_what_records_are_made_from(spark, tmp_dir):
    """Fields made after the shuffle give the same pages, from narrower rows."""
    records = spark.range(3000).selectExpr("id % 2500 as id", "id as user_id")
    fields = [F.col("id"), F.concat(F.repeat(F.lit("wide "), 40), F.col("user_id").cast("string")).alias("place_guess")]
    back = []
    for name, given, made in (("wide", records.select(*fields), None), ("narrow", records, fields)):
        path = os.path.join(tmp_dir, name)
        api_pages.write_api_pages(given, path, files=2, fields=made)
        pages = api_pages.read_api_pages(spark, path)
        back.append(sorted(map(repr, pages.select("page", "record.id", "record.place_guess").collect())))
    assert back[0] == back[1] and len(back[0]) == 3000
