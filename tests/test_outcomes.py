"""Outcomes of requests and reader events on streams: waits, late files, restarts, replays."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from figshelf.plans.catalogue_queries import notifications
from figshelf.sources.snapshots import SnapshotTable
from figshelf.streaming import outcomes
from figshelf.streaming.annotate import reader_events
from figshelf.streaming.outcomes import Looks, outcome_stream, result_file_stream, save_stream

T = datetime(2024, 1, 1, 12, 0, 0)
S = timedelta(seconds=1)
REQUEST, FILE, TICK = "attachment_id long, attachment_key string, requested_at timestamp", "file_name string, n_figures long, at timestamp", "at timestamp"


class World:
    """Folders that streams of requests, files and a clock are read from, and what has been saved."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        for x, schema in (("asked", REQUEST), ("files", FILE), ("clock", TICK)):
            self.put(x, schema, [])
        self.table = SnapshotTable(spark, f"file://{path}/out", "attachment_id")

    def put(self, folder, schema, rows):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{self.path}/{folder}")

    def ask(self, *rows):
        self.put("asked", REQUEST, rows)

    def come(self, *rows):
        self.put("files", FILE, rows)

    def tick(self, at):
        self.put("clock", TICK, [(at,)])

    def run(self, **how):
        read = lambda x, schema: self.spark.readStream.schema(schema).parquet(f"file://{self.path}/{x}")
        made = outcome_stream(read("asked", REQUEST), read("files", FILE), (3,), clock=read("clock", TICK), lateness="0 seconds", **how)
        save_stream(made, self.table, f"file://{self.path}/state").awaitTermination()
        rows = self.table.read().collect() if self.table.version() else []
        return sorted((r["attachment_id"] or 0, r["outcome"], r["n_figures"], r["file_found"], r["looks"]) for r in rows)


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def test_looks():
    plan, t = Looks(3, 1.0), 1_000_000
    due = lambda *times: (plan.due(0, [("f", 1, x) for x in times]), *plan.decide(0, [(f"f{x}", 1, x) for x in times]))
    assert due() == (3 * t, "not_found", 0, None, 3)
    assert due(-5 * t) == (0, "parsed", 1, f"f{-5 * t}", 0)
    assert due(1) == (t, "parsed", 1, "f1", 1) and due(t) == (t, "parsed", 1, f"f{t}", 1) and due(t + 1) == (2 * t, "parsed", 1, f"f{t + 1}", 2)
    assert due(3 * t) == (3 * t, "parsed", 1, f"f{3 * t}", 3) and due(3 * t + 1) == (3 * t, "not_found", 0, None, 3)
    assert due(3 * t, 2 * t - 1)[3] == f"f{2 * t - 1}"  # the later file isn't there yet at the look that finds one


def test_late_files_and_restarts(world):
    """Every call of run is a restart from the checkpoint."""
    world.ask((1, "AAA", T), (2, "BBB", T), (3, "CCC", T), (4, "DDD", T), (5, None, T), (6, "FFF", None))
    world.come(("AAA.json", 2, T - 5 * S))
    none = (5, "not_found", 0, None, 3)
    assert world.run() == [none]  # no time has passed yet for the others
    world.come(("BBB.json", 0, T + 2 * S))
    done = [(1, "parsed", 2, "AAA.json", 0), none]
    assert world.run() == done
    world.tick(T + 4 * S)  # BBB's look, and the last of the others
    done += [(2, "empty", 0, "BBB.json", 2), (3, "not_found", 0, None, 3), (4, "not_found", 0, None, 3)]
    assert world.run() == sorted(done)
    world.come(("CCC.json", 4, T + 5 * S))  # after the wait: the outcome stays
    world.tick(T + 60 * S)
    assert world.run() == sorted(done)
    world.ask((3, "CCC", T + 100 * S))  # asked again
    world.tick(T + 200 * S)
    assert world.run() == sorted([*done, (3, "parsed", 4, "CCC.json", 0)])
    assert world.run() == sorted([*done, (3, "parsed", 4, "CCC.json", 0)])


def test_the_least_name_of_those_seen(world):
    world.ask((1, "AAA", T), (1, "AAA", T), (2, "AAA", T + S))  # asked twice; a second attachment of the key
    world.come(("AAA.json", 1, T + S), ("AAA-2.json", 3, T + S), ("AAA-1.json", 2, T + 2 * S), ("AA", 9, T), (None, 9, T), ("AAA0.json", 9, None))
    world.tick(T + 50 * S)
    assert world.run() == [(1, "parsed", 3, "AAA-2.json", 1), (2, "parsed", 3, "AAA-2.json", 0)]


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    got = []
    for turn in range(2):
        w = World(spark, tmp_path / str(turn))
        first = lambda: w.ask(*[(k, f"K{k:02}", T + k * S) for k in range(20)])  # noqa: B023, E731
        second = lambda: w.come(*[(f"K{k:02}.json", k % 3, T + 2 * k * S) for k in range(0, 20, 2)])  # noqa: B023, E731
        for step in (first, second) if turn else (second, first):
            step()
        w.tick(T + 500 * S)
        got.append(w.run())
    assert got[0] == got[1] and {x[1] for x in got[0]} == {"parsed", "empty", "not_found"} and len(got[0]) == 20


def test_keys_that_share_a_group(spark, tmp_path):
    """Groups by the first letters of keys give what keys by themselves give, over restarts; keys' files do not meet other keys of the group."""
    got = []
    for turn, how in enumerate(({}, {"shared": 1}, {"shared": 2})):
        w = World(spark, tmp_path / str(turn))
        w.ask(*[(k, f"K{k:02}", T + k * S) for k in range(12)], (50, None, T), (51, "K0", T), (52, "K031", T), (53, "K03", T + 2 * S))
        w.come(*[(f"K{k:02}.json", k % 3, T + (2 * k - 5) * S) for k in range(0, 12, 2)], ("K0", 1, T), ("K031.json", 7, T + 4 * S), ("K03", 0, T + 5 * S), ("K02.json", 9, T + 9 * S))
        steps = [w.run(**how)]
        for t in (6, 500):
            w.tick(T + t * S)
            steps.append(w.run(**how))
        w.ask((60, "K02", T + 600 * S))
        w.tick(T + 900 * S)
        got.append([*steps, w.run(**how)])
    assert got[0] == got[1] == got[2] and len(got[0][-1]) == 17 and len({x[1] for x in got[0][-1]}) == 3
    with pytest.raises(ValueError):
        w.run(shared=4)


def test_a_batch_is_worked_out_once(spark, tmp_path):
    spark.range(0, 50, 1, 2).write.parquet(f"file://{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in").select(counted("id").alias("id"))
    table = SnapshotTable(spark, f"file://{tmp_path}/out", "id")
    save_stream(rows, table, f"file://{tmp_path}/state").awaitTermination()
    assert table.read().count() == 50 and seen.value == 50


def test_many_files_are_looked_up_by_few_tasks(spark, tmp_path):
    """A stream of files asks for some tens of tasks to look them up, not one for each; what a session has set itself stays."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for have, want in (("10000", 64), ("7", 7)):
        spark.conf.set(key, have)
        result_file_stream(spark, f"file://{tmp_path}")
        assert int(spark.conf.get(key)) == want
    spark.conf.unset(key)


def test_a_stream_of_result_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    f = {"caption": "图", "name": "1", "page": 0, "renderURL": "u", "regionBoundary": {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}, "figType": "Figure"}
    for name, data in (("A.json", json.dumps([f, f]).encode()), ("B.json", json.dumps([f], ensure_ascii=False).encode("gbk")), ("C.json", b"[]"), ("D.json", b"{broken"), ("E.txt", b"[]")):
        (src / name).write_bytes(data)
    table = SnapshotTable(spark, f"file://{tmp_path}/out", "n_figures")
    save_stream(result_file_stream(spark, f"file://{src}"), table, f"file://{tmp_path}/state").awaitTermination()
    rows = {r["file_name"]: (r["n_figures"], abs((datetime.now() - r["at"]).total_seconds()) < 86_400) for r in table.read().collect()}
    assert rows == {"A.json": (2, True), "B.json": (1, True), "C.json": (0, True), "D.json": (0, True)}


@pytest.mark.parametrize("crash_after_commit", [True, False])
def test_events_survive_a_crash(spark, tmp_path, monkeypatch, crash_after_commit):
    """A batch whose commit was made, but not noted by the stream, is not added again; one that was not made is."""
    sf_dir, rows, state = "/root/testdata/sf0.001", f"file://{tmp_path}/rows", f"file://{tmp_path}/state"
    shaped = notifications(spark, sf_dir)
    shaped.repartition(4, "event_id").write.parquet(rows)
    table = SnapshotTable(spark, f"file://{tmp_path}/out", "event_id")
    append = SnapshotTable.append

    def killed(self, df, stream=None, batch=None):
        if not crash_after_commit and batch == 1:
            raise RuntimeError("killed")
        made = append(self, df, stream, batch)
        if batch == 1:
            raise RuntimeError("killed")
        return made

    def run():
        stream = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", 1).parquet(rows)
        save_stream(reader_events(stream).select("event_id", "event"), table, state).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(outcomes.SnapshotTable, "append", killed)
        with pytest.raises(Exception, match="killed"):
            run()
    assert table.version().number == (2 if crash_after_commit else 1)
    run()
    want = sorted(map(tuple, reader_events(shaped).select("event_id", "event").collect()))
    assert sorted(map(tuple, table.read().collect())) == want and table.version().number == 4
    run()
    assert table.version().number == 4
