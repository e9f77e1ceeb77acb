"""Files in and out, and streams against their batch twins."""

import datetime
import os

import pytest
from hallspark.sources import institutions, tables
from hallspark.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('unitid,Instnm,CITY,StAbbr,INSTURL,UGDS,CONTROL,IALIAS,CURROPER\n1,"The ""Best"" College",X,ca,www.best.edu,1200.0,1,"TB, Best|B",1\n2,NULL,Y,NY,,,2,,1\n3,Other,Z,TX,PrivacySuppressed,NULL,3,,0\n')
    rows = institutions.read_institutions_csv(spark, str(tmp_path / "a.csv")).collect()
    assert len(rows) == 2
    assert (rows[0].name, rows[0].state, rows[0].region, rows[0].website_url, rows[0].population, rows[0].school_type, rows[0].aliases) == ('The "Best" College', "CA", "WEST", "https://www.best.edu", 1200, "PUBLIC", ["TB", "Best", "B"])
    assert rows[1].website_url is None and rows[1].population is None and rows[1].operating == 0


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"id": 5, "school.name": "J", "school.state": "MA", "school.ownership": 2, "latest.student.size": 10}, {"id": 6, "school.name": null, "school.state": "MA"}]}')
    rows = institutions.read_institutions_json(spark, str(tmp_path / "a.json")).collect()
    assert [(r.ipeds_id, r.region, r.school_type, r.population) for r in rows] == [(5, "NORTHEAST", "PRIVATE", 10)]


def test_comparison_csv(spark, tmp_path):
    tables.export_comparison_csv(spark.createDataFrame([(1, None), (2, "x")], "id long, v string").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text().split() == ["id,v", "1,", "2,x"]


def test_catalog(spark):
    assert tables.amenity_catalog(spark).count() == 14


def test_pages(spark):
    row = tables.read_pages(spark, "/root/testdata/sf0.001/pages.parquet").first()
    assert len(row.content_hash) == 32 and row.host


def run(spark, frame, name, mode="append"):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.read.schema(schema).parquet(str(tmp_path / "in"))

    return make


EVENTS = [("a", at(0), 1), ("a", at(10), 2), ("a", at(59), 3), ("a", at(60), 4), ("a", at(61), 5), ("b", at(30), 6), ("b", at(95), 7)]


def test_fixed_rate(spark, stream):
    live, batch = stream(EVENTS, "key string, ts timestamp, id long")
    assert {r.id for r in jobs.rate_fixed(batch, 2).where("NOT allowed").collect()} == {3}
    counts = {(r.key, r.window_start): (r.n, r.refused) for r in run(spark, jobs.rate_fixed_stream(live, 2), "fixed", "complete")}
    assert counts[("a", T0)] == (3, 1) and counts[("a", at(60))] == (2, 0)


def test_anchored_rate(spark, stream):
    live, batch = stream([*EVENTS, ("a", at(30), 8)], "key string, ts timestamp, id long")
    want = {(r.id, r.allowed) for r in jobs.rate_anchored(batch, 3, 3600).collect()}
    assert (3, False) in want and (4, True) in want
    assert {(r.id, r.allowed) for r in run(spark, jobs.rate_anchored_stream(live, 3, 3600), "anchored", "append") if not r.late} == want


def test_page_changes(spark, stream):
    rows = [("u", at(0), "x", 1), ("u", at(1), "x", 2), ("u", at(2), "y", 3), ("v", at(0), "x", 4), ("u", at(3), "x", 5)]
    live, batch = stream(rows, "url string, ts timestamp, hash string, id long")
    assert {r.id for r in jobs.page_changes(batch).collect()} == {1, 3, 4, 5} == {r.id for r in run(spark, jobs.page_changes_stream(live), "changes", "append")}


def test_conflicts(spark, stream):
    rows = [(1, "ac", "yes", 1, at(0), "ENTRY"), (1, "ac", "yes", 1, at(1), "ENTRY"), (1, "ac", "no", 2, at(2), "ENTRY"), (1, "ac", "", 0, at(3), "RESOLVED"), (2, "ac", "no", 2, at(0), "ENTRY")]
    live, _ = stream(rows, "dorm_id long, field string, value string, source_id long, ts timestamp, kind string")
    got = sorted(tuple(r)[:4] for r in run(spark, jobs.conflict_stream(live), "conflicts", "append"))
    assert got == [(1, "ac", "OPEN", 1), (1, "ac", "OPEN", 2), (1, "ac", "RESOLVED", 0), (2, "ac", "OPEN", 1)]


def test_counters_and_sessions(spark, stream):
    rows = [(1, "error", at(0), 1), (1, "info", at(5), 2), (1, "info", at(70), 3)]
    live, batch = stream(rows, "job_id long, level string, ts timestamp, id long")
    assert sorted(map(tuple, run(spark, jobs.crawl_counter_stream(live), "counters", "complete"))) == sorted(map(tuple, jobs.crawl_counter_stream(batch).collect())) == [(1, T0, 2, 1), (1, at(60), 1, 0)]
    assert [(r.n) for r in jobs.heartbeat_sessions(batch).orderBy("started").collect()] == [2, 1]
    gap = jobs.heartbeat_gaps(batch).first()
    assert (gap.id, gap.gap_minutes) == (3, 65)


@pytest.fixture
def batches(spark, tmp_path):
    """A stream of micro-batches, one a file, in the order given."""

    def make(parts, schema):
        for k, rows in enumerate(parts):
            folder = tmp_path / "parts" / f"part={k:03}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
            for f in folder.glob("*.parquet"):
                os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "parts/*"))

    return make


def states(spark, frame, name):
    """All rows that came out, and the number of rows of state after each micro-batch."""
    query = frame.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    return spark.table(name).collect(), sizes


def test_late_fixed_rate(spark, batches):
    parts = [[("a", at(0), 1), ("a", at(1), 2)], [("a", at(200), 3)], [("a", at(10), 4), ("b", at(5), 5), ("a", at(201), 6)], [("c", at(600), 7)], [("c", at(601), 8)]]
    rows, sizes = states(spark, jobs.rate_fixed_events_stream(batches(parts, "key string, ts timestamp, id long"), 1), "late_fixed")
    assert {(r.id, r.allowed, r.late) for r in rows} == {(1, True, False), (2, False, False), (3, True, False), (4, None, True), (5, None, True), (6, False, False), (7, True, False), (8, False, False)}
    assert {r.id: r.window_start for r in rows}[6] == at(180)
    counted = jobs.late_counts(spark.table("late_fixed"), "key").collect()
    assert {r.key: (r.n, r.n_late) for r in counted} == {"a": (5, 1), "b": (1, 1), "c": (2, 0)}
    on_time, late = jobs.split_late(spark.table("late_fixed"))
    assert on_time.count() == 6 and late.count() == 2


def test_late_anchored_rate_and_expiry(spark, batches):
    parts = [[("a", at(0), 1), ("b", at(1), 2)], [("a", at(30), 3), ("c", at(150), 4)], [("a", at(20), 5), ("a", at(140), 6)], [("d", at(900), 7)], [("d", at(901), 8)], [("e", at(2000), 9)], [("e", at(2001), 10)]]
    rows, sizes = states(spark, jobs.rate_anchored_stream(batches(parts, "key string, ts timestamp, id long"), 1, 3600), "late_anchored")
    assert {(r.id, r.allowed, r.late) for r in rows} == {(1, True, False), (2, True, False), (3, False, False), (4, True, False), (5, None, True), (6, True, False), (7, True, False), (8, False, False), (9, True, False), (10, False, False)}
    assert max(sizes[:4]) > sizes[-1]  # only the last key's window is open
    assert sizes[-1] <= sizes[0]


def test_late_page_changes(spark, batches):
    parts = [[("u", at(0), "x", 1)], [("u", at(200), "y", 2)], [("u", at(100), "x", 3), ("u", at(201), "y", 4), ("u", at(202), None, 5)]]
    rows, _ = states(spark, jobs.page_changes_stream(batches(parts, "url string, ts timestamp, hash string, id long")), "late_pages")
    assert {(r.id, r.hash, r.late) for r in rows} == {(1, "x", False), (2, "y", False), (3, "x", True), (5, None, False)}


def test_forgotten_pages(spark, batches):
    parts = [[("u", at(0), "x", 1)], [("v", at(500), "z", 2)], [("v", at(501), "z", 3)], [("u", at(502), "x", 4)]]
    rows, _ = states(spark, jobs.page_changes_stream(batches(parts, "url string, ts timestamp, hash string, id long"), forget=7200.0), "forgotten")
    assert {r.id for r in rows} == {1, 2, 4}


def test_late_conflicts(spark, batches):
    parts = [[(1, "ac", "yes", 1, at(0), "ENTRY")], [(1, "ac", "no", 2, at(200), "ENTRY"), (1, "ac", "yes", 1, at(201), "ENTRY")], [(1, "ac", "x", 3, at(50), "ENTRY"), (1, "ac", None, None, at(202), "ENTRY")], [(1, "ac", "", 0, at(203), "RESOLVED"), (1, "ac", "no", 2, at(204), "ENTRY")]]
    rows, sizes = states(spark, jobs.conflict_stream(batches(parts, "dorm_id long, field string, value string, source_id long, ts timestamp, kind string")), "late_conflicts")
    assert [(r.status, r.n_entries, r.late) for r in rows] == [("OPEN", 1, False), ("OPEN", 2, False), ("OPEN", 3, False), ("ENTRY", None, True), ("RESOLVED", 0, False), ("OPEN", 1, False)]
    assert sizes[-1] < max(sizes)  # closing leaves the entries after it only
