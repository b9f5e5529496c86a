import datetime as dt
import time

from pyspark.sql import functions as F

from stowage import schemas
from stowage.streaming import cycles, workers


def write(spark, path, rows, schema, batch):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}")


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def t(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def sink(stream, name, mode, tmp_path):
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()


def test_dedup_and_windows(spark, tmp_path):
    schema = "peer long, status string, at timestamp_ntz"
    source = str(tmp_path / "in")
    write(spark, source, [(1, "pass", t(1)), (1, "pass", t(1)), (1, "fail", t(2)), (2, "ok", t(3))], schema, 0)
    write(spark, source, [(1, "pass", t(1)), (3, "pass", t(50))], schema, 1)
    stream = workers.zoned(workers.table_stream(spark, source, files_per_batch=1), "at")
    run(sink(workers.session_dedup(stream, ["peer", "status"], "at", "1 hour"), "dedup", "append", tmp_path))
    assert spark.table("dedup").count() == 4
    run(sink(workers.windowed_reputation(stream, "peer", "status", "at", "5 minutes", "10 minutes", "10 minutes"), "windows", "complete", tmp_path))
    got = {(r.peer, r.start.minute): (r.made, r.passed, r.attempts) for r in spark.table("windows").collect()}
    assert got == {(1, 0): (4, 3, 4), (2, 0): (1, 0, 0), (3, 50): (1, 1, 1)}


def test_adoption(spark, tmp_path):
    source = str(tmp_path / "events")
    write(spark, source, [(1, t(0), "start"), (1, t(1), "retrieved"), (2, t(0), "start"), (2, t(1), "missing"), (3, t(0), "retrieved")], "peer_id long, at timestamp_ntz, kind string", 0)
    write(spark, source, [(1, t(30), "retrieved"), (2, t(30), "retrieved")], "peer_id long, at timestamp_ntz, kind string", 1)
    stream = workers.zoned(workers.table_stream(spark, source), "at")
    run(sink(workers.adoption_states(stream, 600), "adoption", "update", tmp_path))
    assert {(r.peer_id, r.adoption_status) for r in spark.table("adoption").collect()} == {(1, "completed"), (2, "failed"), (3, "none")}


def test_adoption_of_a_silent_peer(spark, tmp_path):
    source, schema = str(tmp_path / "events"), "peer_id long, at timestamp_ntz, kind string"
    days = [dt.datetime(2024, 1, d) for d in (1, 3, 4)]
    for n, row in enumerate([(4, days[0], "start"), (5, days[1], "retrieved"), (5, days[2], "retrieved")]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = workers.zoned(workers.table_stream(spark, source, files_per_batch=1), "at")
    run(sink(workers.adoption_states(stream, 600), "silent", "update", tmp_path))
    assert [r.adoption_status for r in spark.table("silent").where("peer_id = 4").collect()] == ["testing", "completed"]


def test_in_flight_and_batches(spark, tmp_path):
    write(spark, str(tmp_path / "o"), [("a", t(0)), ("b", t(1))], "hash string, offered_at timestamp_ntz", 0)
    write(spark, str(tmp_path / "a"), [("a", t(2))], "hash string, arrived_at timestamp_ntz", 0)
    offers = workers.zoned(workers.table_stream(spark, str(tmp_path / "o")), "offered_at")
    arrivals = workers.zoned(workers.table_stream(spark, str(tmp_path / "a")), "arrived_at")
    out = str(tmp_path / "out")
    run(workers.run_worker(workers.in_flight(offers, arrivals, "10 minutes"), workers.batch_writer(out), str(tmp_path / "cp")))
    assert [(r["hash"], r.arrived_at.minute) for r in spark.read.parquet(out).where(F.col("arrived_at").isNotNull()).collect()] == [("a", 2)]


def catalog_tables(spark):
    some = {
        "shards": [("id", [1, 2]), ("status", ["sealed"] * 2), ("mirrored", [True, False]), ("size", [100] * 2)],
        "peers": [("id", [1, 2]), ("status", ["trusted"] * 2), ("last_seen", [t(0), dt.datetime(2024, 2, 1)]), ("first_seen", [t(0)] * 2), ("adoption_status", ["none", "completed"]), ("source", ["manual", "peer"])],
        "outbound_pieces": [("shard_id", [1, 2, 2]), ("piece_index", [0, 0, 1]), ("peer_id", [1, 2, 2]), ("status", ["uploaded"] * 3)],
        "blobs": [("hash", ["a", "b"]), ("size", [5, 5]), ("ref_count", [0, 1]), ("special", [False] * 2), ("deleted_at", [t(0), None])],
        "blob_locations": [("blob_hash", ["a", "b"]), ("shard_id", [1, 2]), ("length", [5, 5])],
        "piece_challenges": [("id", [7]), ("shard_id", [2]), ("piece_index", [1]), ("peer_id", [2])],
        "file_blobs": [("hash_encrypted", ["a"])],
    }

    def table(name):
        columns = some.get(name, [("created_at", [])])
        rows = list(zip(*(values for _, values in columns)))
        kinds = {f.name: f.dataType for f in schemas.schema(name).fields}
        names = [c for c, _ in columns if c in kinds] or [next(iter(kinds))]
        schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in names)
        return schemas.conform(spark.createDataFrame(rows, schema), name)

    return table


def test_every_cycle(spark, tmp_path):
    out, at = str(tmp_path / "out"), F.lit("2024-02-01 00:10:00").cast("timestamp_ntz")
    for name in cycles.CYCLES:
        cycles.run_cycle(spark, name, catalog_tables(spark), at, out, 1, cycles.Settings(data_pieces=2, parity_pieces=1))
    read = lambda table: spark.read.parquet(f"{out}/{table}")
    assert sorted((r.shard_id, r.status) for r in read("outbound_pieces").collect()) == [(1, "lost"), (2, "uploaded"), (2, "uploaded")]
    assert sorted(r.id for r in read("repairs").collect()) == [1, 2] and [r.shard_id for r in read("collections").collect()] == [1]
    assert [(r.id, r.peer_id) for r in read("next_challenge").collect()] == [(7, 2)] and read("refills").count() == 3
    assert {(r.shard_id, r.peer_id) for r in read("mirrors").collect()} == {(1, 2)} and read("completed").count() == 0
    assert {(r.id, r.kind) for r in read("listing").collect()} == {(1, "active"), (2, "pending")} and [r.id for r in read("contacts").collect()] == [1]
    assert {(r["hash"], r.ref_count) for r in read("blobs").collect()} == {("a", 0), ("b", 0)}


def test_a_cycle_on_a_timer(spark, tmp_path):
    query = cycles.start_cycle(spark, "eviction", catalog_tables(spark), str(tmp_path / "out"), str(tmp_path / "cp"), "1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            if list((tmp_path / "out/peers").glob("round=*/_SUCCESS")):
                break
        assert query.exception() is None
    finally:
        query.stop()
    assert {r.id for r in spark.read.parquet(str(min((tmp_path / "out/peers").glob("round=*")))).collect()} == {1, 2}
