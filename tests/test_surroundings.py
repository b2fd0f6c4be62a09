"""Files, configuration, codecs, builders, cursors and lifecycle."""

import datetime as dt
import json
from dataclasses import replace
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from vertexloom.functions.archive import NotArchivable, archive, try_archive, try_unarchive, unarchive
from vertexloom.lifecycle import AlreadyOpen, Bus, Opening, PreflightFailed
from vertexloom.migrations.ledger import Ledger, LedgerCorrupted
from vertexloom.migrations.log import MigrationLog
from vertexloom.operators import build, mutate, traverse
from vertexloom.sources import codec, files
from vertexloom.sources.config import StoreConfiguration, first_named
from vertexloom.sources.diagnostics import pending_groups, pending_values, traced
from vertexloom.sources.identity import record_ids
from vertexloom.sources.memory import MemoryStore
from vertexloom.sources.store import GraphStore, StoreBusy, open_or_local
from vertexloom.streaming.cursor import Cursor, Feed

from .test_tools import _log


def test_archive():
    value = {"d": dt.datetime(2020, 1, 2, 3), "b": b"\x00\xff", "u": urlparse("http://x/y"), "l": [1, 2.5, True, None, "é"]}
    assert unarchive(archive(value)) == value
    assert try_archive(object()) is None and try_unarchive(b"{") is None and try_unarchive(None) is None
    with pytest.raises(NotArchivable):
        archive({1: 2})


def test_files(spark, tmp_path):
    files.make_folder(str(tmp_path / "a/b"))
    one = files.write(str(tmp_path / "a"), "x.txt", "hi")
    two = files.save_payload(str(tmp_path / "a"), "y", b"hi", "png")
    assert files.read(one) == "hi" and files.equal(one, two) and files.writable(one) and files.exists(one)
    assert [files.kind_of(p) for p in files.contents(str(tmp_path / "a"))] == ["directory", "text", "image"]
    assert {r["kind"] for r in files.listing(spark, str(tmp_path / "a")).collect()} == {"text", "image"}
    files.remove(one)
    assert not files.exists(one)


def test_configuration(tmp_path):
    assert first_named(" ", None, " c ") == "c" and first_named() is None
    c = StoreConfiguration(str(tmp_path / "new"), legacy_routes=(str(tmp_path / "old"),))
    assert c.path() == c.canonical_path
    (tmp_path / "old/default").mkdir(parents=True)
    assert c.path() == str(tmp_path / "old/default")
    assert c.scope == "default||local|sqlite|1"
    with pytest.raises(ValueError):
        StoreConfiguration("x", backend="tape")


def test_builders_and_memory_store(spark):
    a, b = build.entity("Person", "a"), build.entity("Person", "b")
    made = build.rows(spark, a, b, build.relate(a, b), build.action("send", [a["id"], a["id"]], [b["id"]], "1"))
    store = MemoryStore(spark)
    assert store.transaction(lambda n: mutate.create(n, made)) == 1
    assert traverse.relationships(store.nodes()).first()["type"] == "Person"
    assert traverse.actions(store.nodes()).first()["subject_ids"] == [a["id"]]
    assert store.changes(0)[0].where("op = 'insert' and part = 'node'").count() == 4
    version, trace = traced(store, lambda n: n.where("node_class = 1"))
    assert version == 2 and trace.outcome == "committed" and [s for s, _ in trace.stages] == ["begin", "body", "save", "end"]
    groups, left = pending_groups(store.changes(1)[0], most=1)
    assert groups.count() == 1 and left >= 0 and pending_values(store.changes(1)[0]).count() > 0
    store.clear()
    assert store.nodes().count() == 0 and store.nodes(1).count() == 4


def test_record_ids_keep_order_and_repeats(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "x"), (2, "a")], "pos int, id string")
    got = record_ids(asked, spark.createDataFrame([("a", "r1")], "id string, record_id string")).orderBy("pos").collect()
    assert [r["record_id"] for r in got] == ["r1", None, "r1"]


def test_cursors(spark, tmp_path):
    rows = [(1, "r", "insert", "u1", "x"), (2, "me", "insert", "u2", "x")]
    processed, delivered, fail = [], [], [False]

    def deliver(df, gap):
        if fail[0]:
            raise RuntimeError
        delivered.append((sorted(r["object_uri"] for r in df.collect()), gap))

    f = Feed(lambda: _log(spark, rows), str(tmp_path), "s", "me", lambda df: processed.append(df.count()), deliver)
    f.drain()
    f.drain()
    assert processed == [1] and delivered == [(["u1"], False)]
    rows.append((3, None, "insert", "u3", "x"))
    fail[0] = True
    with pytest.raises(RuntimeError):
        f.drain()
    fail[0] = False
    f.drain()
    assert processed == [1, 1] and delivered[1:] == [(["u3"], False)]
    rows[:] = [(9, "r", "insert", "u9", "x")]
    f.drain()
    assert delivered[-1] == (["u9"], True)
    Cursor(str(tmp_path), "s", "processing").path.write_text("{")
    assert Cursor(str(tmp_path), "s", "processing").get() is None
    head = Feed(lambda: _log(spark, rows), str(tmp_path / "h"), "s", "me", processed.append, deliver, start="head")
    n = len(delivered)
    head.drain()
    assert len(delivered) == n


def test_lifecycle():
    seen, bus = [], Bus()
    opening = Opening("p", lambda: "store", bus=bus)
    bus.attach(lambda e: seen.append(e.name))
    told = []
    opening.when_ready(lambda store, error: told.append((store, error)))
    assert told == [("store", None)] and seen == ["ready"] and opening.state == "ready"
    assert isinstance(Opening("p", lambda: 1).ready.exception(), AlreadyOpen)
    opening.close()
    broken = Opening("p", lambda: 1, preflight=lambda: 1 / 0)
    assert isinstance(broken.ready.exception(), PreflightFailed) and broken.state == "failed"
    Opening("p", lambda: 1).close()


def test_migration_log(spark, tmp_path):
    path = tmp_path / "logs" / "migrations.jsonl"
    MigrationLog(path).log("started", migrationID="a")
    assert not path.exists()
    log = MigrationLog(path, enabled=True)
    log.log("started", migrationID="a", version=1, phase="postInit", reason=None)
    log.log("failed", migrationID="a", version=1, error="no\nway")
    lines = path.read_text().splitlines()
    assert len(lines) == 2 and all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)
    rows = log.read(spark).orderBy("at").collect()
    assert [(r["event"], r["error"]) for r in rows] == [("started", None), ("failed", "no\nway")] and rows[0]["at"] is not None


def test_ledger_publishes_and_is_superseded(tmp_path):
    ledger, shared = Ledger(tmp_path, "m", 1), []
    read = lambda: shared[-1] if shared else None
    assert not ledger.publish(read, shared.append)  # nothing to tell
    mine = ledger.record("done")
    assert ledger.publish(read, shared.append) and shared == [mine]
    assert ledger.publish(read, shared.append) and shared == [mine]  # known already
    shared.append(replace(mine, generation=9, deviceID="other"))
    assert not ledger.publish(read, shared.append) and ledger.latest() == shared[-1]
    tried = []
    ledger.record("reset")
    assert not ledger.publish(lambda: None, tried.append) and len(tried) == 3  # never seen again


def test_ledger_upgrades_files_without_a_schema_number(tmp_path):
    old = {"migrationID": "m", "version": 1, "state": "done", "generation": 4, "operationID": "o", "unknown": 1}
    (tmp_path / "m-v1.state.json").write_text(json.dumps(old))
    ledger = Ledger(tmp_path, "m", 1)
    assert (ledger.latest().state, ledger.latest().generation) == ("done", 4)
    assert ledger.record("reset").generation == 5 and json.loads((tmp_path / "m-v1.state.json").read_text())["schemaVersion"] == 1
    (tmp_path / "m-v1.state.json").write_text(json.dumps({"schemaVersion": 7}))
    with pytest.raises(LedgerCorrupted):
        ledger.latest()


def test_purge_refuses_writers_and_falls_back(spark, tmp_path):
    store = GraphStore.open(spark, f"file://{tmp_path}/local")
    seen = []

    def drop():
        seen.append(store.version)
        with pytest.raises(StoreBusy):
            store.clear()
        with pytest.raises(StoreBusy):
            store.purge(lambda: None)
        return "gone"

    assert store.purge(drop, pending=lambda nodes: nodes) == "gone" and seen == [1]
    with pytest.raises(ValueError):
        store.purge(lambda: int("x"))
    assert store.clear() == 2  # the gate is open again
    told = []
    _, mode = open_or_local(spark, "nowhere://x/y", f"file://{tmp_path}/local", warn=told.append)
    assert mode == "localFallback" and len(told) == 1
    assert open_or_local(spark, f"file://{tmp_path}/other", f"file://{tmp_path}/local")[1] == "remote"


def test_decoded_properties_of_odd_json(spark):
    texts = ['{"properties": {"a": null, "f": 1.25, "d": {"__codable_type": "date", "value": "soon"}, "b": {"__codable_type": "data", "value": "%%"}, "m": {"__codable_type": "other"}}}', "{", '{"type": "x"}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", codec.decode_properties(F.col("t")).alias("p")).orderBy("i").collect()
    found = {p["name"]: p for p in rows[0]["p"]}
    assert {n: p["kind"] for n, p in found.items()} == {"a": "null", "f": "double", "d": "date", "b": "data", "m": "dict"}
    assert found["f"]["n"] == 1.25 and found["d"]["d"] is None and found["b"]["b"] is None and json.loads(found["m"]["j"]) == {"__codable_type": "other"}
    assert all(r["p"] == [] for r in rows[1:])
