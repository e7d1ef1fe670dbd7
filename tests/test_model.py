"""Small fixtures, and random logs against the plain model."""

import random

import pytest
from pyspark.sql import functions as F
from reference_model import Model

from tidelog.engine import Engine, LogOptions
from tidelog.model import BLOB, INT, STR, Aggregate, BatchInsert, Delete, Get, Insert, InsertFast, Link, Range, Scan, check_u32, merged_families
from tidelog.operators import archive, facade, history, state, textindex
from tidelog.plans import batch
from tidelog.plans.positions import Cuts, bucket_of, quantile_cuts, unit, with_running
from tidelog.sources import codec, storage
from tidelog.sources.log import commands_frame, from_commands
from tidelog.streaming.ingest import StateTable, follow, ingest


def two_entities(spark):
    return from_commands(commands_frame(spark, [Insert(0, {"score": 42, "name": "alice", "data": b"\1\2\3"}), Insert(1, {"score": 100, "name": "bob", "data": b"\4\5\6"})]))


def results(log, *nodes):
    out = {i: [] for i in range(len(nodes))}
    for r in batch.execute(log, nodes).orderBy("node_idx", "pos").collect():
        value = next((v for v in (r.v_int, r.v_dbl, r.v_str, r.v_blob) if v is not None), None)
        out[r.node_idx].append((r.tag, bytes(value) if isinstance(value, bytearray) else value))
    return [out[i] for i in range(len(nodes))]


def test_gets_and_aggregates(spark):
    log = two_entities(spark)
    got = results(log, Get(0, "score"), Get(1, "name"), Get(2, "score"), Get(0, "nope"), Get(1, "data"), *[Aggregate("score", f) for f in ("sum", "count", "min", "max", "avg")], Aggregate("nope", "count"), Aggregate("name", "count"))
    assert got == [[("Int", 42)], [("Str", "bob")], [("None", None)], [("None", None)], [("Blob", b"\4\5\6")], [("IntSum", 142)], [("Count", 2)], [("IntMin", 42)], [("IntMax", 100)], [("IntAvg", 71.0)], [("None", None)], [("None", None)]]
    assert [r.v for r in history.column(log, "score").orderBy("pos").collect()] == [42, 100]
    assert history.sum_range(log, "score", 0, 2).first()[0] == 142 and history.sum_range(log, "score", 0, 1).first()[0] == 42
    assert history.sum_range(log, "nope", 0, 1).first()[0] is None
    assert sorted(r[0] for r in state.entities(log).collect()) == [0, 1]
    assert state.get(log, "score", STR).count() == 0


def test_scan_range_link(spark):
    log = from_commands(commands_frame(spark, [Insert(0, {"score": 42, "link": 1}), Insert(1, {"score": 7, "name": "bob"}), Insert(5, {"link": 99})]))
    got = results(log, Scan("score"), Scan("name"), Scan("nope"), Range(0, "score", 2), Range(1, "score", 9), Range(5, "score", 2), Range(0, "name", 2), Link(0, "link", "name"), Link(5, "link", "name"), Link(0, "score", "name"), Link(9, "link", "name"))
    assert got == [[("IntList", 42), ("IntList", 7)], [("StrList", "bob")], [("None", None)], [("IntRange", 42), ("IntRange", 7)], [("IntRange", 7)], [("None", None)], [("None", None)], [("Str", "bob")], [("None", None)], [("None", None)], [("None", None)]]


def test_an_empty_column_has_a_result(spark):
    log = from_commands(commands_frame(spark, [Insert(1, {"a": 5})]), {"a": INT, "none": INT, "text": STR})
    assert results(log, Scan("none"), Scan("text"), Scan("a"), Scan("nope")) == [[("IntList", None)], [("StrList", None)], [("IntList", 5)], [("None", None)]]


def test_two_sources_in_one_state(spark):
    """Deltas of two checkpoints, a replay after a fold, and a restart with a new checkpoint."""
    frame = commands_frame(spark, [Insert(i % 40, {"a": i}) for i in range(120)])
    landings = []
    for k in range(2):
        landings.append(storage_path())
        frame.where(F.col("entity_id") % 2 == k).repartition(3).write.mode("overwrite").parquet(landings[k])
    found = StateTable(spark, storage_path(), frame.schema, fold_after=2)
    state_of = lambda: {r.entity_id: r.attrs_int["a"] for r in found.current().collect()}
    ingest(landings[0], found, storage_path(), 1)
    assert state_of() == {i: 80 + i for i in range(0, 40, 2)}
    ingest(landings[1], found, storage_path(), 1)
    want = {i: 80 + i for i in range(40)}
    assert state_of() == want
    before = found.current()
    found.fold()
    assert {r.entity_id: r.attrs_int["a"] for r in before.collect()} == want  # what a reader has is still there
    found.merge(frame.where("seq < 60"), 0, "again")
    found.merge(frame.where("seq < 0"), 0, "again")  # known by source and number
    ingest(landings[0], found, storage_path(), 1)
    assert state_of() == want and found.vacuum() and state_of() == want
    more = commands_frame(spark, [Insert(50, {"a": 1})], 1000)
    query = follow(landings[0], found, storage_path(), LogOptions(flush_micros=20_000).trigger)
    try:
        more.write.mode("append").parquet(landings[0])
        query.processAllAvailable()
    finally:
        query.stop()
    assert state_of() == want | {50: 1}


def test_ranges_of_more_than_1000_lengths(spark):
    n = 1_300
    log = from_commands(commands_frame(spark, [Insert(i, {"score": 3 * i}) for i in range(n)]))
    asked = [(i, i % 50, i) for i in range(n)] + [(n, 7, (1 << 63) - 1), (n + 1, 3, -1), (n + 2, n + 5, 4), (n + 3, 2, None)]
    got = {}
    for r in history.ranges(log, spark.createDataFrame(asked, "req int, entity_id bigint, length bigint"), "score").collect():
        got.setdefault(r.req, []).append((r.pos, r.v))
    want = {q: [(p, 3 * p) for p in range(e, min(n, e + size))] for q, e, size in asked if size and size > 0 and e < n}
    assert {q: sorted(rows) for q, rows in got.items()} == want


def test_replace_delete_and_history(spark):
    log = from_commands(commands_frame(spark, [Insert(1, {"a": 5}), Insert(1, {"b": "x"}), Delete(1), InsertFast(3, 5, 2, b"\x0a"), BatchInsert((Insert(1, {"a": 6}), Insert(2, {"a": 7})))]))
    assert state.get(log, "a", INT).orderBy("entity_id").collect() == [(1, 6), (2, 7)]
    assert state.get(log, "b", STR).count() == 0
    assert history.aggregate(log, "a", ["sum"]).first()[0] == 18  # the deleted 5 too
    assert [r.v_int for r in history.scan(log, "a", live_only=True).orderBy("pos").collect()] == [6, 7]
    assert [(r.entity_id, bytes(r.payload), r.epoch, r.type) for r in state.signed_records(log).collect()] == [(3, b"\x0a", 5, 2)]


def test_column_slots(spark):
    cells = history.slots(spark.createDataFrame([(0, 10), (1, 20), (2, 30)], "pos bigint, v bigint"))
    off = history.set_valid(cells, F.col("pos") == 1, False)
    assert [r.v for r in history.iterate(off).orderBy("pos").collect()] == [10, None, 30]
    assert [r.v for r in history.iterate(history.set_valid(off, F.col("pos") == 1, True)).orderBy("pos").collect()] == [10, 20, 30]
    assert history.lengths(off).first() == (3, 2)
    none = spark.createDataFrame([], "pos bigint, v bigint, valid boolean")
    grown = history.set_values(none, spark.createDataFrame([(5, 42)], "pos bigint, v bigint"))
    assert [r.v for r in history.iterate(grown).orderBy("pos").collect()] == [None] * 5 + [42]
    again = history.set_values(grown, spark.createDataFrame([(5, 99)], "pos bigint, v bigint"))
    assert [r.v for r in history.iterate(again).orderBy("pos").collect()] == [None] * 5 + [99]
    assert history.lengths(none).first() == (0, 0)


def random_commands(rng):
    ids, commands = range(rng.randint(1, 50)), []
    for _ in range(rng.randint(0, 300)):
        e, kind = rng.choice(ids), rng.random()
        attrs = {**{f"i{k}": rng.randrange(100) for k in range(2) if rng.random() < 0.6}, **{f"s{k}": rng.choice("abc") for k in range(2) if rng.random() < 0.4}, **({"b0": bytes([rng.randrange(256)])} if rng.random() < 0.3 else {})}
        if kind < 0.6:
            commands.append(Insert(e, attrs))
        elif kind < 0.7:
            commands.append(BatchInsert((Insert(e, attrs), Insert(rng.choice(ids), {"i0": 1}))))
        elif kind < 0.8:
            commands.append(InsertFast(e, rng.randrange(1000), rng.randrange(5), b"p"))
        else:
            commands.append(Delete(e))
    return commands


FAMILIES = {"i0": INT, "i1": INT, "s0": STR, "s1": STR, "b0": BLOB, "epoch": INT, "type": INT, "payload": BLOB}


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    commands = random_commands(random.Random(seed))
    model = Model()
    for c in commands:
        for row in c.rows():
            model.apply(*row)
    frame = commands_frame(spark, commands)
    log = from_commands(frame, FAMILIES)
    for attr, family in FAMILIES.items():
        got = {r[0]: bytes(r[1]) if family == BLOB else r[1] for r in state.get(log, attr, family).collect()}
        assert got == {e: model.get(e, attr, family) for e in model.pointers if model.get(e, attr, family) is not None}
        assert [bytes(r.v) if family == BLOB else r.v for r in history.column(log, attr).orderBy("pos").collect()] == model.columns.get((attr, family), [])
    got = {}
    for r in history.range_from(log, "i0", 3).orderBy("pos").collect():
        got.setdefault(r.entity_id, []).append(r.v)
    assert got == {e: model.range(e, "i0", 3) for e in model.pointers if model.range(e, "i0", 3) is not None}
    assert {(r.entity_id, r.attr): r.pos for r in history.snapshot(log).collect()} == {(e, a): p for e, own in model.pointers.items() for a, p in own.items()}
    assert sorted(r[0] for r in state.entities(log).collect()) == sorted(e for e, own in model.pointers.items() if own)
    assert state.size(log).first()[0] == len(model.pointers)
    # Streamed in shuffled pieces, with one piece twice, the state is the same.
    found = StateTable(spark, storage_path(), frame.schema, fold_after=2)
    order = list(range(4))
    random.Random(seed).shuffle(order)
    for i, part in enumerate([*order, order[0]]):
        found.merge(frame.where(F.col("seq") % 4 == part), i)
    streamed = from_commands(found.current(), FAMILIES)
    assert sorted(map(repr, state.state(streamed).collect())) == sorted(map(repr, state.state(log).collect()))


def storage_path():
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="tidelog-test-")


def test_values_are_checked(spark):
    for bad in (-1, 1 << 32, True, 1.5):
        with pytest.raises(ValueError):
            check_u32(bad)
    with pytest.raises(ValueError):
        merged_families([{"a": INT}, {"a": STR}])
    with pytest.raises(ValueError):
        from_commands(commands_frame(spark, [Insert(1, {"a": 1}), Insert(2, {"a": "x"})]))
    log = commands_frame(spark, [Insert(1, {"a": 1})])
    with pytest.raises(ValueError):
        from_commands(log.unionAll(log)).checked()
    with pytest.raises(ValueError):
        LogOptions(flush_micros=10)
    assert LogOptions(flush_micros=10, expert=True).trigger


def test_codec_rejects_malformed():
    for c in (Insert(42, {"name": "foo", "age": 42, "data": b"\1\2\3"}), BatchInsert((Insert(5, {"k": "v", "num": 100, "b": b"\xff"}),)), Delete(123), InsertFast(1, 2, 3, b"\1\2\3")):
        data = codec.encode(c)
        assert codec.decode(data) == c
        assert codec.decode(data[:-1]) is None
    assert codec.decode(b"") is None and codec.decode(b"\4") is None
    assert codec.decode_entity(b"\1") is None
    whole = codec.framed([codec.encode(Delete(1)), codec.encode(Delete(2))])
    assert len(list(codec.unframed(whole + b"\0" * 8))) == 2
    assert len(list(codec.unframed(whole[:-1]))) == 1
    assert list(codec.unframed(b"\xff\0\0\0\1\2\3")) == []


def test_old_log_files(spark, tmp_path):
    commands = [Insert(1, {"a": 5, "s": "x"}), BatchInsert((Insert(2, {"a": 6}), Insert(3, {"a": 7}))), Delete(1)]
    records = [codec.encode(c) for c in commands]
    (tmp_path / "a.wal").write_bytes(codec.framed([records[0], b"\4", records[1]]))
    (tmp_path / "b.wal").write_bytes(codec.framed([records[2]]) + b"\x10")
    rows = codec.read_log_files(spark.read.format("binaryFile").load(str(tmp_path)))
    got = [(r.op, r.entity_id, r.attrs_int, r.attrs_str) for r in rows.orderBy("seq").collect()]
    assert got == [("insert", 1, {"a": 5}, {"s": "x"}), ("insert", 2, {"a": 6}, {}), ("insert", 3, {"a": 7}, {}), ("delete", 1, {}, {})]


def test_store(spark):
    store = storage.Store(spark, storage_path())
    store.append(spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 10, "c")], "seq bigint, entity_id bigint, v string"))
    assert store.read_entity(10).first().v == "c"
    with pytest.raises(KeyError):
        store.read_entity(999)
    assert [r.entity_id for r in store.read_block(10, 5).orderBy("entity_id").collect()] == [10, 11]
    assert store.read_block(999, 5).count() == 0
    store.sign()
    assert store.verify_integrity()
    assert store.compact() == 1
    assert store.records().count() == 2 and store.read_entity(10).first().v == "c"
    assert not store.verify_integrity()
    assert storage.reverse_search(spark.createDataFrame([(1, b"\1\2"), (2, b"\3")], "entity_id bigint, b binary"), F.col("b"), b"\2").collect() == [(1,)]


def test_facades(spark):
    kv = facade.SimpleKvStore(spark)
    kv.put(42, b"\1\2\3")
    assert kv.get(42) == b"\1\2\3"
    kv.delete(42)
    assert kv.get(42) is None
    p = facade.Partition(facade.CommandLog(spark))
    p.write_str(1, "name", "alice")
    assert p.read_str(1, "name") == "alice" and p.read_int(1, "name") is None and p.with_value(1, "name", STR, len) == 5
    p.write_int(1, "age", 30)
    assert p.read_str(1, "name") is None and p.read_int(1, "age") == 30
    assert p.log_.try_send(Delete(9)) and not p.log_.try_send(Delete(9), capacity=1)
    cache = facade.TypedCache(spark)
    cache.insert("k", {"x": [1, 2]})
    assert cache.get("k") == {"x": [1, 2]} and cache.get("other") is None


def test_engine(spark):
    engine = Engine(spark)
    p = engine.register_partition("a.b")
    assert engine.path("a.b").endswith("/a/b.data") and engine.get_partition("none") is None
    p.write_int(7, "v", 3)
    assert engine.execute_batch("a.b", [Get(7, "v")], lambda r: r.v_int) == 3
    assert engine.execute_batch("none", [Get(7, "v")], lambda r: 1 / 0) is None
    assert engine.register_partition("a.b").read_int(7, "v") == 3
    assert engine.metrics().collect() == [("a.b", 0, 1)]
    assert engine.prewarm_partition("a.b", [7]).count() == 1
    with pytest.raises(KeyError):
        engine.prewarm_partition("none", [1])
    engine.cool("a.b")
    engine.sleep("a.b")
    assert engine.is_sleeping("a.b")
    engine.wake("a.b")
    assert not engine.is_sleeping("a.b")
    assert engine.store("a.b").count() == 1 and engine.compact("a.b") == 1
    p.write_int(9, "v", 5)
    assert engine.store("a.b").count() == 2 and engine.store("a.b").count() == 2
    assert engine._routes["a.b"].store.records().count() == 2  # each command once
    assert engine.vacuum("a.b") == ["v000000"]
    assert engine.inspect_metadata().collect() == [("a.b", 2, 2)]
    again = Engine(spark, engine.base).register_partition("a.b")  # what the folder has
    again.write_int(8, "v", 4)
    assert again.read_int(7, "v") == 3 and again.read_int(8, "v") == 4


def test_memory_log(spark):
    engine = Engine(spark)
    p = engine.register_partition("m", LogOptions(durable=False, batch=1))
    assert not storage.Files(spark, engine.path("m")).exists() and engine.store("m").count() == 0 and engine.compact("m") is None
    p.write_int(1, "v", 5)
    assert p.read_int(1, "v") == 5
    p.log_.append(commands_frame(spark, [Delete(1), Insert(2, {"v": 6})], 10))
    p.write_int(3, "v", 7)
    assert p.read_int(1, "v") is None and p.read_int(2, "v") == 6 and p.read_int(3, "v") == 7


def test_point_reads_scan_once_with_a_pushed_filter(spark):
    log = facade.CommandLog(spark)
    log.send(Insert(1, {"a": 5}), Insert(2, {"a": "x"}))
    plan = state.get(log.of_entity(1, {"a": INT}), "a", INT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(entity_id,1)" in plan
    read = facade.PartitionReader(log)
    assert read.get_int(1, "a") == 5 and read.get_str(1, "a") is None and read.get_str(2, "a") == "x"


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tidelog.sources import tables

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        tables.shared_dir(SimpleNamespace(sparkContext=context))


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    from tidelog.sources import tables

    kept, gone = (tables.written(spark.range(3), what) for what in ("kept", "gone"))
    tables.discard(gone)
    assert kept.count() == 3 and not storage.Files(spark, gone._tidelog_path).exists()
    monkeypatch.setattr(spark.sparkContext, "_tidelog_scratch", {kept._tidelog_path})
    assert tables.clean(spark) == 1 and not storage.Files(spark, kept._tidelog_path).exists()
    (tmp_path / "v").write_bytes(b"abc")
    assert tables.file_to_send(str(tmp_path / "v")) == b"abc"
    monkeypatch.setattr(tables, "MAX_FILE", 2)
    with pytest.raises(ValueError):
        tables.file_to_send(str(tmp_path / "v"))


def test_text_index(spark):
    docs = spark.createDataFrame([(1, "Foo-bar, baz"), (2, "foobar  qux\n"), (3, None), (4, "!!! ...")], "id bigint, t string")
    index = textindex.TextIndex.build(docs, "id", "t")
    found = lambda df: sorted(r[0] for r in df.collect())
    assert found(index.search_and("FOOBAR")) == [1, 2] and found(index.search_and("foobar baz")) == [1]
    assert found(index.search_and("foobar unknown")) == [1, 2] and found(index.search_and("unknown")) == [] and found(index.search_and("")) == []
    assert found(index.search_or("baz qux")) == [1, 2]
    gone = index.remove(docs.where("id = 1"), "id", "t")
    assert found(gone.search_and("baz foobar")) == []  # baz is still known
    assert found(gone.search_or("baz foobar")) == [2]
    assert found(gone.insert(spark.createDataFrame([(9, "baz")], "id bigint, t string"), "id", "t").search_or("baz")) == [9]


def test_archive(spark):
    import hashlib

    rows = spark.createDataFrame([(0, "insert", 1, 0), (1, "delete", 2, 0), (2, "batch_insert", 0, 3)], "seq bigint, op string, entity_id bigint, count bigint")
    body = [b"INSERT:" + (1).to_bytes(8, "little"), b"DELETE:" + (2).to_bytes(8, "little"), b"BATCH_INSERT:" + (3).to_bytes(4, "little")]
    want = hashlib.sha256((9).to_bytes(8, "little") + b"me" + b"".join(body)).hexdigest()
    assert archive.digests(rows, F.lit(0), F.lit(9), "me").first().hash == want
    block = bytes(archive.text_blocks(rows, F.lit(0), F.lit(9), "me").first().block)
    assert f"Hash: {want}\n".encode() + b"".join(b + b"\n" for b in body) in block


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_positions(spark, per_bucket):
    rng = random.Random(3)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.randrange(5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k bigint, g string, v bigint")
    got = with_running(df, "k", ["g"], ["v"], rows_per_bucket=per_bucket).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own)))
        keys = [(r.k is None, r.k or 0, r.v) for r in own]
        assert keys == sorted(keys)
    sums = with_running(df.where("k is not null").dropDuplicates(["k"]), "k", value=F.col("v"), name="before", rows_per_bucket=per_bucket).orderBy("k").collect()
    total = 0
    for r in sums:
        assert r.before == total
        total += r.v
    assert with_running(df.where("false"), "k").count() == 0


def test_bucket_of(spark):
    bounds = [3, 7, 7, 20]
    got = spark.range(30).select("id", bucket_of(F.col("id"), Cuts(bounds)).alias("b")).collect()
    assert all(r.b == sum(b < r.id for b in bounds) for r in got)
    cuts = Cuts([3, 6, 7, 20], {2: 5, 4: 2, 5: 3})
    ids = spark.range(300).select(F.when(F.col("id") % 9 > 0, F.col("id") % 30).alias("k"), unit(F.xxhash64("id")).alias("u"))
    rows = sorted(ids.select("k", "u", bucket_of(F.col("k"), cuts, F.col("u")).alias("b")).collect(), key=lambda r: (r.k is None, r.k or 0, r.u))
    assert (cuts.of_keys, cuts.count) == (10, 13) and {r.b for r in rows} == set(range(13))
    wide = [(sum(b < r.k for b in cuts.bounds) if r.k is not None else 5, r) for r in rows]
    for base, n, first in ((0, 1, 0), (1, 1, 1), (2, 5, 2), (3, 1, 7), (4, 2, 8), (5, 3, 10)):
        assert all(r.b == first + min(n - 1, int(r.u * n)) for b, r in wide if b == base)


@pytest.mark.parametrize("hot", [None, 7])
def test_positions_of_a_hot_key(spark, hot):
    """One key, or null, on nine rows in ten: its cells are bounded, and positions are right."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(hot)).cast("bigint").alias("k"), unit(F.xxhash64("id")).alias("u"), "id")
    cuts = quantile_cuts(df, "k", 500)
    sizes = [r["count"] for r in df.groupBy(bucket_of(F.col("k"), cuts, F.col("u")).alias("b")).count().collect()]
    assert max(sizes) < 1_500 and sum(sizes) == 20_000
    got = with_running(df, "k", second=F.col("u"), rows_per_bucket=500).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(20_000))
    order = [(r.k is None, r.k or 0, r.u) for r in got]
    assert order == sorted(order)
