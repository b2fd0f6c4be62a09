"""Dedup, merge, validation, JSON, store, feed and migrations on small graphs."""

import pytest
from pyspark.sql import functions as F

from vertexloom.functions import json
from vertexloom.migrations.ledger import Ledger, LedgerCorrupted, compaction, newest, read_history
from vertexloom.migrations.manager import Manager, Migration, backup, find_backups, restore
from vertexloom.operators import dedup, merge, mutate, validate
from vertexloom.operators.predicate import type_
from vertexloom.schema import CHANGES, NodeClass
from vertexloom.sources.codec import decode, encode
from vertexloom.sources.ingest import nodes_of, properties, property_
from vertexloom.sources.store import GraphStore, StoreChanged
from vertexloom.streaming import feed

E, R, A = NodeClass.ENTITY, NodeClass.RELATIONSHIP, NodeClass.ACTION


def people(spark, rows):
    df = spark.createDataFrame(rows, "k string, uuid string, extra string")
    return nodes_of(df, E, "Person", F.col("k"), tags=F.array("k"), props=properties(("uuid", F.col("uuid"), "string"), ("extra", F.col("extra"), "string")))


def edges(spark, rows):
    pid = lambda c: F.concat(F.lit("1Personp"), c)
    df = spark.createDataFrame(rows, "k string, s string, o string")
    return nodes_of(df, R, "knows", F.col("k"), subject=pid(F.col("s")), object_=pid(F.col("o")))


def acts(spark, rows):
    pid = lambda c: F.concat(F.lit("1Personp"), c)
    df = spark.createDataFrame(rows, "k string, s array<string>, o array<string>")
    return nodes_of(df, A, "send", F.col("k"), subjects=F.transform("s", pid), objects=F.transform("o", pid))


KEY = {"Person": "uuid"}


@pytest.fixture(scope="module")
def doubled(spark):
    e = people(spark, [("a", "u", None), ("b", "u", "second"), ("c", "u", "third"), ("z", "v", None), ("n", None, None)])
    r = edges(spark, [("in", "z", "b"), ("out", "c", "z"), ("out2", "a", "z")])
    m = acts(spark, [("1", ["a"], ["z"]), ("2", ["b"], ["z"])])
    return e.unionByName(r).unionByName(m)


def test_dedup(spark, doubled):
    key = dedup.field_key(KEY)
    out = dedup.deduplicate(doubled, key)
    got = {r["id"]: r for r in out.collect()}
    assert sorted(got) == ["1Personpa", "1Personpn", "1Personpz", "2knowspin", "2knowspout", "3sendp1"]
    assert got["2knowspin"]["object_id"] == "1Personpa"
    assert sorted(got["1Personpa"]["tags"]) == ["a", "b", "c"]
    assert [p["s"] for p in got["1Personpa"]["props"] if p["name"] == "extra"] == ["second"]
    told = dedup.report(doubled, key).first()
    assert (told["duplicate_groups"], told["merged_entities"], told["deleted_entities"], told["unkeyed_entities"], told["copied_properties"]) == (1, 2, 2, 1, 1)
    assert dedup.report(out, key).first()["merged_entities"] == 0  # a second run changes nothing


def test_dedup_policies(spark, doubled):
    key = dedup.field_key(KEY)
    with pytest.raises(dedup.UnresolvedLink):
        dedup.deduplicate(doubled, key, policy="fail")
    with pytest.raises(dedup.UnkeyedEntities):
        dedup.deduplicate(doubled, key, unkeyed="fail")
    assert dedup.deduplicate(doubled, key, policy="skip").where("type = 'Person'").count() == 5
    only = dedup.deduplicate(doubled, key, policy="rewire_only")
    assert only.where("node_class = 2").count() == 3 and only.where("node_class = 3").count() == 2


def test_merge(spark):
    second = people(spark, [("a", "x", None), ("b", "y", None), ("c", None, None)]).unionByName(edges(spark, [("1", "a", "b"), ("2", "a", "c"), ("3", "c", "a")])).unionByName(acts(spark, [("1", ["a", "b"], ["b", "c"])]))
    made = merge.merge(people(spark, [("p", "q", None)]), second, KEY, "tag")
    told = made.report.first().asDict()
    assert told == {"imported_entities": 3, "mapped_entities": 2, "unmapped_entities": 1, "recreated_relationships": 1, "skipped_relationships": 2, "recreated_actions": 2, "skipped_actions": 2}
    assert made.relationships.count() == 1 and made.actions.count() == 2


def test_validation_states(spark):
    nodes = people(spark, [("a", "x", None)]).unionByName(edges(spark, [("1", "a", None), ("2", "a", "gone")])).unionByName(acts(spark, [("1", [], [])]))
    got = {r["root"]: r["valid"] for r in validate.verdicts(validate.references(nodes, nodes.select("id"))).collect()}
    assert got == {"1Personpa": False, "2knowsp1": True, "2knowsp2": False, "3sendp1": True}
    lost = validate.references(nodes, spark.createDataFrame([("nope",)], "id string")).collect()
    assert [(r["state"], r["destination"]) for r in lost] == [("unresolved", "nope")]


def test_validation_is_bounded(spark):
    nodes = people(spark, [("a", "x", None), ("b", "y", None), ("c", "z", None)]).unionByName(edges(spark, [("1", "a", "a"), ("2", "a", "b"), ("3", "b", "c"), ("4", "c", "a")]))
    refs = validate.references(nodes, nodes.where("id = '1Personpa'").select("id"))
    assert refs.count() < 60


def test_json(spark):
    v = lambda text: json.parse(F.lit(text))
    row = spark.range(1).select(
        json.stringify(json.item(v('[1, true, "third"]'), 2)), json.stringify(json.item(v("[1]"), 3)), json.stringify(json.item(v("[1]"), -1)), json.stringify(json.member(v('{"count": 2}'), "none")),
        json.typed(json.member(v('{"count": 2}'), "count"), "int"), json.serialize(v('{"a": [1]}')), json.serialize(v("3")), json.stringify(v("not-json")), json.equal(v("1"), v('"1"')),
    ).first()
    assert tuple(row) == ("third", "null", "null", "null", 2, '{"a":[1]}', None, "null", True)
    two = spark.range(1).select(json.set_item(F.array(F.lit(1), F.lit(2)), 1, F.lit(9)), json.set_item(F.array(F.lit(1)), 5, F.lit(9)), json.set_member(F.create_map(F.lit("a"), F.lit(1)), "a", F.lit(2))).first()
    assert tuple(two) == ([1, 9], [1], {"a": 2})


def test_codec_round_trip(spark):
    nodes = people(spark, [('q"uote', "u", "é\n")])
    got = decode(nodes.select(encode().alias("j")), "j").first()
    assert (got["type"], got["tags"], got["properties"]) == ("Person", ['q"uote'], {"uuid": "u", "extra": "é\n"})
    bare = decode(spark.createDataFrame([('{"type": "X"}',)], "j string"), "j").first()
    assert bare["tags"] == [] and bare["created_date"] is not None


def test_store(spark, tmp_path):
    store = GraphStore.open(spark, str(tmp_path / "s"))
    assert store.nodes().count() == 0
    first = people(spark, [("a", "x", None), ("b", "y", None)])
    assert store.transaction(lambda n: mutate.create(n, first)) == 1
    store.transaction(lambda n: mutate.set_property(n, property_("extra", F.lit("new"), "string"), F.col("id") == "1Personpa"))
    store.transaction(lambda n: mutate.delete(n, n.where("id = '1Personpb'").select("id")))
    assert store.nodes().count() == 1 and store.nodes(1).count() == 2
    ops = {(r["tx"], r["op"], r["part"]) for r in store.changes().collect()}
    assert {(1, "insert", "node"), (2, "insert", "property"), (3, "delete", "node"), (3, "delete", "tag")} <= ops and (3, "insert", "node") not in ops

    def racing(nodes):
        GraphStore.open(spark, str(tmp_path / "s"), author="other").transaction(lambda n: n)
        return nodes

    with pytest.raises(StoreChanged):
        store.transaction(racing)
    with pytest.raises(ZeroDivisionError):
        store.transaction(lambda n: 1 / 0)
    assert store.version == 4
    store.set_value("k", 1)
    assert store.value("k") == 1 and store.keys() == ["k"]
    store.set_value("k", None)
    assert store.value("k") is None
    assert GraphStore.needs_upgrade((None, 2), (1, 2)) and not GraphStore.needs_upgrade((1, 2), (1, None))
    assert store.read_snapshot(lambda n: n.count()) == 1
    store.clear()
    assert store.nodes().count() == 0
    store.reset(lambda path: None)


def _log(spark, rows):
    return spark.createDataFrame([(tx, None, author, op, 1, "node", uri, owner, None, None, i) for i, (tx, author, op, uri, owner) in enumerate(rows)], CHANGES)


def test_supersession(spark):
    log = _log(spark, [(1, "r", "insert", "a", "a"), (2, "r", "delete", "a", "a"), (2, "r", "insert", "b", "b"), (3, "me", "delete", "b", "b"), (3, None, "insert", "c", "c")])
    assert sorted((r["object_uri"], r["op"]) for r in feed.surviving(log, "me").collect()) == [("a", "delete"), ("c", "insert")]
    assert feed.missing_transactions(log, -1) and not feed.missing_transactions(log, 0)
    assert feed.newest(log) == 3


def test_watch_streams_what_the_batch_gives(spark, tmp_path):
    log = str(tmp_path / "log")
    nodes = people(spark, [("a", "x", None)])
    _log(spark, [(1, "r", "insert", "u1", "1Personpa"), (1, "r", "update", "u1", "1Personpa")]).write.parquet(log)
    got = []
    watch = feed.Watch(spark, log, str(tmp_path / "ck"), lambda df, n: got.extend(df.collect()), "me", nodes=nodes, predicate=type_("person"))
    watch.drain().pause()
    _log(spark, [(2, "me", "delete", "u1", "1Personpa")]).write.mode("append").parquet(log)
    watch.resume().drain().pause()
    assert [(r["event_kind"], r["source"]) for r in got] == [("insertedEntity", "cloud"), ("deletedEntity", "local")]


def test_watch_sees_old_and_new_states(spark, tmp_path):
    log, got = str(tmp_path / "log"), []
    old, new = people(spark, [("a", "x", None), ("b", "y", None)]), people(spark, [("b", "y", None)])
    _log(spark, [(1, "r", "delete", "u1", "1Personpa"), (1, "r", "update", "u2", "1Personpb"), (1, "r", "insert", "u3", "1Personpb"), (2, "r", "delete", "u3", "1Personpb"), (2, "r", "update", "u4", "1Otherp1")]).write.parquet(log)
    watch = feed.Watch(spark, log, str(tmp_path / "ck"), lambda df, n: got.extend((r["op"], r["owner_id"]) for r in df.collect()), "me", nodes=lambda: new, before=lambda: old, superseded=True, predicate=type_("person"))
    watch.drain().pause()
    assert sorted(got) == [("delete", "1Personpa"), ("delete", "1Personpb")]
    # without an old state a deletion of what is gone is not withheld, and nothing else of it comes
    rows = feed.events(_log(spark, [(1, "r", "delete", "u1", "1Personpa"), (1, "r", "insert", "u5", "1Personpa"), (1, "r", "insert", "u2", "1Personpb"), (1, "r", "delete", "u9", None)]))
    assert sorted((r["op"], r["owner_id"] or "") for r in feed.matching(rows, new, type_("person")).collect()) == [("delete", ""), ("delete", "1Personpa"), ("insert", "1Personpb")]


def test_report_gate_withholds_a_batch(spark, tmp_path):
    log, got, valid = str(tmp_path / "log"), [], [False]
    nodes = people(spark, [("a", "x", None), ("b", "y", None)])
    _log(spark, [(1, "r", "insert", "u1", "1Personpa"), (2, "me", "insert", "u2", "1Personpb")]).write.parquet(log)
    verdicts = lambda owners: owners.select(F.col("id").alias("root"), ((F.col("id") != "1Personpa") | F.lit(valid[0])).alias("valid"))
    watch = feed.Watch(spark, log, str(tmp_path / "ck"), lambda df, n: got.extend(df.collect()), "me", nodes=nodes, valid=verdicts)
    with pytest.raises(Exception, match="batch 0"):
        watch.drain()
    assert got == []
    valid[0] = True
    watch.resume().drain().pause()
    assert len(got) == 2
    missing = feed.resolved(feed.with_source(feed.events(_log(spark, [(1, "r", "insert", "u", "gone"), (1, "r", "insert", "v", "1Personpa"), (2, "me", "insert", "w", "gone"), (2, "me", "insert", "w2", "1Personpb")])), "me"), nodes)
    told = sorted((r["object_uri"], r["gate"]) for r in feed.gated(missing, nodes.select(F.col("id").alias("root"), F.lit(True).alias("valid"))).collect())
    assert told == [("u", "withheld"), ("v", "withheld"), ("w", "dropped"), ("w2", "delivered")]


def test_orders_of_a_bulk_transaction(spark, sf):
    from vertexloom.sources import ingest
    from vertexloom.sources.lineage import numbered

    log = ingest.changes(spark, sf, tx_rows=400)
    for order in (feed.change_order, lambda c, **k: feed.ordered(feed.events(c), **k)):
        plain, dealt = (sorted((r["tx"], r["change_index"], r["position"]) for r in order(log, most_rows=n).collect()) for n in (10**6, 100))
        assert plain == dealt and len(plain) > 500
    placed = numbered(spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k")).repartition(5), ["k"], "at").collect()
    assert all(r["k"] == r["at"] for r in placed)


def test_a_version_and_its_changes_are_one(spark, tmp_path, monkeypatch):
    store = GraphStore.open(spark, str(tmp_path / "s"))
    first = people(spark, [("a", "x", None)])
    monkeypatch.setattr("vertexloom.sources.store.diff", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.transaction(lambda n: mutate.create(n, first))
    assert store.version == 0 and store.nodes().count() == 0 and store.changes().count() == 0
    monkeypatch.undo()
    store.transaction(lambda n: mutate.create(n, first))
    assert store.version == 1 and store.changes().where("part = 'node'").count() == 1 and store.changes(1).count() == 0
    from vertexloom.sources.store import StoreBusy

    with pytest.raises(StoreBusy):
        store.read_snapshot(lambda n: store.read_snapshot(lambda m: 0))


def test_chooser_must_choose_a_member(spark, doubled):
    key = dedup.field_key(KEY)
    last = dedup.chosen(doubled, key, {}, lambda a, b: b)
    assert sorted(tuple(r) for r in last.collect()) == [("1Personpa", "1Personpc"), ("1Personpb", "1Personpc")]
    with pytest.raises(Exception, match="InvalidSurvivor"):
        dedup.chosen(doubled, key, {}, lambda a, b: None).collect()


def test_feed_calls_that_come_late_are_run(spark, tmp_path):
    from vertexloom.streaming.cursor import Feed

    rows, seen = [(1, "r", "insert", "a", "a")], []

    def deliver(df, gap):
        seen.append(df.count())
        if len(seen) == 1:
            rows.append((2, "r", "insert", "b", "b"))
            watch.drain()  # while it runs: only noted

    watch = Feed(lambda: _log(spark, rows), str(tmp_path), "s", "me", lambda df: None, deliver)
    watch.drain()
    assert seen == [1, 1] and not watch._running


def test_failed_delivery_is_repeated(spark, tmp_path):
    log, got, fail = str(tmp_path / "log"), [], [True]
    _log(spark, [(1, "r", "insert", "u1", "x")]).write.parquet(log)

    def deliver(df, n):
        if fail[0]:
            raise RuntimeError("not yet")
        got.extend(df.collect())

    watch = feed.Watch(spark, log, str(tmp_path / "ck"), deliver, "me")
    with pytest.raises(Exception):
        watch.drain()
    fail[0] = False
    watch.resume().drain().pause()
    assert len(got) == 1


def test_ledger(spark, tmp_path):
    ledger = Ledger(tmp_path, "m/1", 1)
    ledger.record("started")
    assert ledger.interrupted()
    ledger.record("done")
    ledger.record("done")
    assert [e.state for e in ledger.history()] == ["started", "done"] and ledger.latest().generation == 3
    ledger.set_metadata("k", [1])
    assert ledger.metadata("k") == [1]
    with pytest.raises(ValueError):
        ledger.set_metadata("x" * 300, 1)
    entries = read_history(spark, str(tmp_path))
    assert newest(entries).first()["state"] == "done"
    assert {r["state"]: r["n"] for r in compaction(entries).collect()} == {"started": 1, "done": 1}
    with (tmp_path / "m_1-v1.history.jsonl").open("a") as f:
        f.write("{")
    with pytest.raises(LedgerCorrupted):
        ledger.history()


def test_ledger_replays_its_journal(tmp_path):
    import json as j
    from dataclasses import asdict

    from vertexloom.migrations.ledger import Entry

    ledger = Ledger(tmp_path, "m", 1)
    entry = asdict(Entry("m", 1, "started", generation=1))
    (tmp_path / "m-v1.txn.json").write_text(j.dumps({"entry": entry, "state": {"schemaVersion": 1, "entry": entry, "metadata": {}, "forced": None}}))
    assert ledger.latest().state == "started" and len(ledger.history()) == 1 and not (tmp_path / "m-v1.txn.json").exists()


def test_migrations(tmp_path):
    ran = []

    class One(Migration):
        id = "one"

        def run(self, context):
            ran.append("one")

    class Two(Migration):
        id, phase = "two", "ready"

        def run(self, context):
            raise RuntimeError("broken")

    manager = Manager(str(tmp_path))
    manager.register(One(), One(), Two())
    assert len(manager.migrations) == 2
    with pytest.raises(RuntimeError):
        manager.open()
    manager.handle("postInit")
    assert ran == ["one"] and manager.ledger(manager.migrations[1]).latest().state == "failed"
    manager.ledger(manager.migrations[0]).force("again")
    manager.handle("postInit")
    assert ran == ["one", "one"]


def test_backups(tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    (store / "x").write_text("1")
    first = backup(str(store), "m", str(tmp_path / "b"))
    backup(str(store), "m", str(tmp_path / "b"))
    assert len(find_backups(str(store), "m", str(tmp_path / "b"))) == 2
    (store / "x").write_text("2")
    restore(first)
    assert (store / "x").read_text() == "1"
