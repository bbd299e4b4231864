import json
import os

from sightline.operators import ingest
from sightline.schema import INGEST_COLUMNS
from sightline.session import path_exists
from sightline.sources import api_pages
from sightline.streaming import latest_stream as ls


def land(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(json.dumps({"page": 1, "results": records}) + "\n")


def record(i, day, place):
    return {"id": i, "created_at": None if day is None else f"2020-01-{day:02d}T00:00:00Z", "place_guess": place}


def rows(df):
    return sorted(map(repr, df.select("id", "created_at", "place_guess").collect()))


def test_copies_over_several_batches_are_the_batch_merge(spark, tmp_dir):
    """Better, worse, equal, undated and very old copies in four batches, in
    an order that the first copy would lose."""
    pages, table = os.path.join(tmp_dir, "pages"), os.path.join(tmp_dir, "table")
    land(pages, "a.json", [record(i, 5, "first") for i in range(30)])
    land(pages, "b.json", [record(i, 9, "better") for i in range(0, 30, 2)] + [record(40, None, "undated")])
    land(pages, "c.json", [record(i, 2, "worse") for i in range(0, 30, 3)] + [{"created_at": "2020-01-01T00:00:00Z"}])
    land(pages, "d.json", [record(7, 5, "later by place"), record(99, 1, "old"), record(40, None, "xx")])
    query = ls.run_latest_stream(spark, pages, table, os.path.join(tmp_dir, "ckpt"), max_files_per_trigger=1)
    flat = api_pages.flatten_records(api_pages.read_api_pages(spark, pages)).select(*INGEST_COLUMNS)
    assert rows(spark.read.parquet(table)) == rows(ingest.dedupe_by_id(flat))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4
    assert all(o["numRowsDroppedByWatermark"] == 0 for p in query.recentProgress for o in p["stateOperators"])
    # the same checkpoint again: nothing new; then a page with one new id and a copy of an old one
    ls.run_latest_stream(spark, pages, table, os.path.join(tmp_dir, "ckpt"), max_files_per_trigger=1)
    assert spark.read.parquet(table).count() == 32
    land(pages, "e.json", [record(7, 28, "too late: the row is in the table"), record(100, 1, "new")])
    ls.run_latest_stream(spark, pages, table, os.path.join(tmp_dir, "ckpt"), max_files_per_trigger=1)
    got = {r.id: r.place_guess for r in spark.read.parquet(table).collect()}
    assert len(got) == 33 and got[7] == "later by place" and got[100] == "new"


def test_state_is_bounded_by_the_hold(spark, tmp_dir):
    """Eight batches of fifty new ids each: closed sessions leave the state."""
    pages, table = os.path.join(tmp_dir, "pages"), os.path.join(tmp_dir, "table")
    for k in range(8):
        land(pages, f"{k}.json", [record(k * 50 + i, 1 + k, "x") for i in range(50)])
    query = ls.run_latest_stream(
        spark, pages, table, os.path.join(tmp_dir, "ckpt"), hold="1 millisecond", max_files_per_trigger=1, drain=False
    )
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert max(held) <= 100  # at most the batch that closes and the one that opens
    assert spark.read.parquet(table).count() >= 350
    ls.append_new(ls.held_copies(ls.record_stream(spark, pages), os.path.join(tmp_dir, "ckpt")), table)
    assert spark.read.parquet(table).select("id").distinct().count() == 400 == spark.read.parquet(table).count()


def test_batch_frame_and_empty_folder(spark, tmp_dir):
    flat = spark.createDataFrame([], "id bigint").selectExpr(
        "id", *[f"cast(null as string) as {c}" for c in INGEST_COLUMNS if c != "id"])
    assert ls.latest_copies(flat).columns == list(INGEST_COLUMNS) and ls.latest_copies(flat).count() == 0


def test_state_is_kept_on_disk(spark, tmp_dir):
    """The stream's state is RocksDB's; the session's own setting stays."""
    pages, table = os.path.join(tmp_dir, "pages"), os.path.join(tmp_dir, "table")
    land(pages, "a.json", [record(i, 5, "x") for i in range(10)])
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    query = ls.run_latest_stream(spark, pages, table, os.path.join(tmp_dir, "ckpt"))
    stored = [o["customMetrics"] for p in query.recentProgress for o in p["stateOperators"]]
    assert stored and all(any(k.startswith("rocksdb") for k in m) for m in stored)
    assert spark.conf.get(provider, None) == before
    assert spark.read.parquet(table).count() == 10


def test_held_rows_are_appended_without_a_copy(spark, tmp_dir, monkeypatch):
    """No shuffle or scratch copy of held records when no id repeats; a private
    checkpoint goes once it is drained; the state's changes are logged."""
    pages, table = os.path.join(tmp_dir, "pages"), os.path.join(tmp_dir, "table")
    land(pages, "a.json", [record(i, 5, "x") for i in range(20)] + [record(3, 9, "better")])
    copies, roots = [], []
    monkeypatch.setattr(ls, "new_rows_for_append", lambda *a, **k: copies.append(a) or ingest.new_rows_for_append(*a, **k))
    named = ls.scratch_path
    monkeypatch.setattr(ls, "scratch_path", lambda *a: roots.append(named(*a)) or roots[-1])
    query = ls.run_latest_stream(spark, pages, table)
    got = {r.id: r.place_guess for r in spark.read.parquet(table).collect()}
    assert not copies and len(got) == 20 and got[3] == "better"
    assert roots and not any(path_exists(spark, r) for r in roots)
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "100" and query is not None
    # ids of two sessions: the better copy of those held
    again = spark.createDataFrame([(1, "b"), (1, "a"), (50, "c")], "id bigint, place_guess string")
    again = again.selectExpr(*[c if c in ("id", "place_guess") else f"cast(null as {t}) as {c}"
                               for c, t in spark.read.parquet(table).select(*INGEST_COLUMNS).dtypes])
    monkeypatch.setattr(ls, "held_copies", lambda *a: again)
    ls.append_held(again, "", os.path.join(tmp_dir, "other"))
    assert rows(spark.read.parquet(os.path.join(tmp_dir, "other"))) == rows(ingest.dedupe_by_id(again))
