"""The registered queries for the engine's own operators, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.engine import metrics
from tidelog.functions import scalars
from tidelog.model import BLOB, DELETE, FAST, INSERT, INT, LOG_SCHEMA, STR, Aggregate, Get, Link, Range, Scan
from tidelog.operators import archive, facade, history, ops_records, state, textindex
from tidelog.plans import batch
from tidelog.sources import codec, storage
from tidelog.sources import log as logs
from tidelog.sources.log import Log
from tidelog.sources.tables import scratch, table
from tidelog.streaming.ingest import StateTable, ingest, run_stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# events as a command log: view and purchase insert, click inserts without k, signup is a fast insert, error deletes.

FAMILIES = {"event_type": STR, "k": INT, "epoch": INT, "type": INT, "payload": BLOB}


def event_log(spark: SparkSession, sf_dir: str) -> Log:
    e = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(e == "error", DELETE).when(e == "signup", FAST).otherwise(INSERT).alias("op"),
        F.col("user_id").alias("entity_id"),
        F.when(e.isin("view", "purchase", "click"), e).alias("event_type"),
        F.when(e.isin("view", "purchase"), k).alias("k"),
        F.when(e == "signup", F.col("event_id")).alias("epoch"),
        F.when(e == "signup", k).alias("type"),
        F.when(e == "signup", F.col("props")).cast("binary").alias("payload"),
    )
    return Log(df, FAMILIES)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.to_commands(event_log(spark, sf_dir))


LOG = """L as (
  select event_id as seq, user_id as entity_id,
    case event_type when 'error' then 'delete' when 'signup' then 'insert_fast' else 'insert' end as op,
    case when event_type in ('view', 'purchase', 'click') then event_type end as event_type,
    case when event_type in ('view', 'purchase') then cast(json_extract_string(props, '$.k') as bigint) end as k,
    case when event_type = 'signup' then event_id end as epoch,
    case when event_type = 'signup' then cast(json_extract_string(props, '$.k') as bigint) end as type,
    case when event_type = 'signup' then props end as payload
  from events)"""
STATE = f"""{LOG},
S as (select * exclude (rn) from (select *, row_number() over (partition by entity_id order by seq desc) as rn from L) where rn = 1),
A as (select * from S where op <> 'delete')"""


def cells_sql(attr: str) -> str:
    return f"H_{attr} as (select row_number() over (order by seq) - 1 as pos, seq, entity_id, {attr} as v from L where op <> 'delete' and {attr} is not null)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dynamic_get(event_log(spark, sf_dir), "event_type")


def hexed():
    return F.hex("v_blob").alias("v_blob")


# Query nodes


@query(
    f"with {STATE}, ids as (select distinct entity_id from L) "
    + " union all ".join(
        f"select ids.entity_id, '{a}' as attr, case when {c} is null then 'None' else '{t}' end as tag, {c if t == 'Int' else 'cast(null as bigint)'} as v_int, {c if t == 'Str' else 'cast(null as varchar)'} as v_str, {f'hex(encode({c}))' if t == 'Blob' else 'cast(null as varchar)'} as v_blob from ids left join A using (entity_id)"
        for a, c, t in (("k", "A.k", "Int"), ("event_type", "A.event_type", "Str"), ("payload", "A.payload", "Blob"))
    )
)
def q01_get(spark, sf_dir):
    log = event_log(spark, sf_dir)
    parts = [state.dynamic_get(log, a).select("entity_id", F.lit(a).alias("attr"), "tag", "v_int", "v_str", hexed()) for a in ("k", "event_type", "payload")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {STATE} select entity_id, k from A where k is not null")
def q02_get_int(spark, sf_dir):
    return state.get(event_log(spark, sf_dir), "k", INT)


@query(f"with {STATE} select entity_id, event_type from A where event_type is not null")
def q03_get_str(spark, sf_dir):
    return state.get(event_log(spark, sf_dir), "event_type", STR)


@query(f"with {STATE} select entity_id, hex(encode(payload)) as payload from A where payload is not null")
def q04_get_blob(spark, sf_dir):
    return state.get(event_log(spark, sf_dir), "payload", BLOB).select("entity_id", F.hex("payload").alias("payload"))


def self_links(spark, sf_dir, shift: int) -> Log:
    df = table(spark, sf_dir, "events").withColumn("target", F.col("user_id") + shift)
    return logs.from_table(df, "event_id", {"user_id": INT, "target": INT, "event_type": STR})


@query("select a.event_id as entity_id, case when b.event_id is null then 'None' else 'Str' end as tag, b.event_type as v_str from events a left join events b on a.user_id + 9900 = b.event_id")
def q05_link(spark, sf_dir):
    return state.link(self_links(spark, sf_dir, 9900), "target", "event_type").select("entity_id", "tag", "v_str")


@query("select a.event_id as entity_id, case when b.event_id is null then 'None' else 'Str' end as tag, b.event_type as v_str from events a left join events b on a.user_id = b.event_id")
def q05_link_all_found(spark, sf_dir):
    return state.link(self_links(spark, sf_dir, 0), "user_id", "event_type").select("entity_id", "tag", "v_str")


@query(f"with {STATE}, {cells_sql('k')}, P as (select A.entity_id, H_k.pos as p from A join H_k using (seq)) select P.entity_id, H_k.pos, H_k.v from P join H_k on H_k.pos >= P.p and H_k.pos < P.p + 5")
def q06_range(spark, sf_dir):
    return history.range_from(event_log(spark, sf_dir), "k", 5)


@query(f"with {STATE}, {cells_sql('k')}, P as (select A.entity_id, 1 + A.entity_id * 7919 % 3001 as n, H_k.pos as p from A join H_k using (seq)) select P.entity_id as req, H_k.pos, H_k.v from P join H_k on H_k.pos >= P.p and H_k.pos < P.p + P.n")
def q06_range_many(spark, sf_dir):
    """A range from every entity, with lengths of 1 to 3,001."""
    log = event_log(spark, sf_dir)
    asked = log.df.select("entity_id").distinct().select(F.col("entity_id").alias("req"), "entity_id", (F.col("entity_id") * 7919 % 3001 + 1).alias("length"))
    return history.ranges(log, asked, "k")


@query(f"with {LOG}, {cells_sql('k')} select 'IntList' as tag, pos, v as v_int from H_k")
def q07_scan_int(spark, sf_dir):
    return history.scan(event_log(spark, sf_dir), "k").select("tag", "pos", "v_int")


@query(f"with {LOG}, {cells_sql('event_type')} select 'StrList' as tag, pos, v as v_str from H_event_type")
def q08_scan_str(spark, sf_dir):
    return history.scan(event_log(spark, sf_dir), "event_type").select("tag", "pos", "v_str")


@query(f"with {LOG}, {cells_sql('payload')} select 'BlobList' as tag, pos, hex(encode(v)) as v_blob from H_payload")
def q09_scan_blob(spark, sf_dir):
    return history.scan(event_log(spark, sf_dir), "payload").select("tag", "pos", hexed())


@query("select 'None' as tag, cast(null as bigint) as pos, cast(null as bigint) as v_int")
def q10_scan_missing(spark, sf_dir):
    return history.scan(event_log(spark, sf_dir), "nope").select("tag", "pos", "v_int")


@query(f"with {STATE}, {cells_sql('k')} select H_k.pos, H_k.v as v_int from H_k join A using (seq)")
def q07_scan_live_only(spark, sf_dir):
    """An extension: without overwritten and deleted values."""
    return history.scan(event_log(spark, sf_dir), "k", live_only=True).select("pos", "v_int")


def _aggregate(name: str, f: str, sql: str):
    def run(spark, sf_dir):
        return history.aggregate(event_log(spark, sf_dir), "k", [f])

    run.__name__ = name
    query(f"with {LOG} select {sql} as {f} from L where op <> 'delete'")(run)


_aggregate("q11_sum", "sum", "cast(coalesce(sum(k), 0) as bigint)")
_aggregate("q12_count", "count", "count(k)")
_aggregate("q13_min", "min", "coalesce(min(k), 0)")
_aggregate("q14_max", "max", "coalesce(max(k), 0)")
_aggregate("q15_avg", "avg", "avg(k)")


@query("select cast(null as bigint) as sum, cast(null as bigint) as count, cast(null as bigint) as min, cast(null as bigint) as max, cast(null as double) as avg union all select null, null, null, null, null")
def q16_aggregate_missing(spark, sf_dir):
    log = event_log(spark, sf_dir)
    every = ["sum", "count", "min", "max", "avg"]
    return history.aggregate(log, "nope", every).unionByName(history.aggregate(log, "event_type", every))


@query("select cast(0 as bigint) as sum, cast(0 as bigint) as count, cast(0 as bigint) as min, cast(0 as bigint) as max, cast(null as double) as avg")
def q11_aggregates_of_empty(spark, sf_dir):
    log = event_log(spark, sf_dir)
    empty = Log(log.df.withColumn("empty", F.lit(None).cast("bigint")), log.families | {"empty": INT})
    return history.aggregate(empty, "empty", ["sum", "count", "min", "max", "avg"])


@query(f"with {LOG} select cast(sum(k) as bigint) as sum from L where op <> 'delete'")
def q11_sum_exact(spark, sf_dir):
    return history.exact_sum(event_log(spark, sf_dir), "k").select(F.col("sum").cast("bigint").alias("sum"))


@query(f"with {LOG}, {cells_sql('k')} select cast(coalesce(sum(v), 0) as bigint) as sum from H_k where pos >= 100 and pos < 350")
def q17_sum_int_range(spark, sf_dir):
    return history.sum_range(event_log(spark, sf_dir), "k", 100, 250)


@query(f"with {STATE} select entity_id, hex(encode(payload)) as payload, epoch, type from A where payload is not null and epoch is not null and type is not null")
def q18_signed_record(spark, sf_dir):
    return state.signed_records(event_log(spark, sf_dir)).select("entity_id", F.hex("payload").alias("payload"), "epoch", "type")


@query(f"with {STATE} select entity_id from A where event_type is not null or k is not null or epoch is not null or type is not null or payload is not null")
def q19_entities(spark, sf_dir):
    return state.entities(event_log(spark, sf_dir))


@query("select count(distinct user_id) as entities from events")
def q20_len(spark, sf_dir):
    return state.size(event_log(spark, sf_dir))


@query(f"with {STATE}, " + ", ".join(cells_sql(a) for a in FAMILIES) + " " + " union all ".join(f"select A.entity_id, '{a}' as attr, h.pos from A join H_{a} h using (seq)" for a in FAMILIES))
def q21_snapshot(spark, sf_dir):
    return history.snapshot(event_log(spark, sf_dir))


NODES = (
    Get(3, "k"),
    Get(7, "event_type"),
    Get(1, "payload"),
    Get(10**9, "k"),
    Get(3, "nope"),
    Aggregate("k", "sum"),
    Aggregate("k", "avg"),
    Aggregate("event_type", "count"),
    Range(3, "k", 4),
    Range(3, "event_type", 4),
    Scan("epoch"),
    Scan("nope"),
    Link(1, "type", "event_type"),
    Link(1, "nope", "event_type"),
)


def _got(i: int, entity: int, attr: str, tag: str, kind: str) -> str:
    v = f"hex(encode({attr}))" if kind == "v_blob" else attr
    cells = ", ".join(f"{v if c == kind else 'null'} as {c}" for c in ("v_int", "v_str", "v_blob"))
    return f"select {i} as node_idx, case when {attr} is null then 'None' else '{tag}' end as tag, null as pos, null as v_dbl, {cells} from (select 1) left join A on A.entity_id = {entity}"


def _none(i: int) -> str:
    return f"select {i}, 'None', null, null, null, null, null"


@query(
    f"with {STATE}, {cells_sql('k')}, {cells_sql('epoch')}, U as ("
    + " union all ".join(
        [
            "select cast(null as int) as node_idx, cast(null as varchar) as tag, cast(null as bigint) as pos, cast(null as double) as v_dbl, cast(null as bigint) as v_int, cast(null as varchar) as v_str, cast(null as varchar) as v_blob where false",
            _got(0, 3, "k", "Int", "v_int"),
            _got(1, 7, "event_type", "Str", "v_str"),
            _got(2, 1, "payload", "Blob", "v_blob"),
            _none(3),
            _none(4),
            "select 5, 'IntSum', null, null, cast(coalesce(sum(k), 0) as bigint), null, null from L where op <> 'delete'",
            "select 6, case when count(k) = 0 then 'None' else 'IntAvg' end, null, avg(k), null, null, null from L where op <> 'delete'",
            _none(7),
            "select 8, case when p.p is null then 'None' else 'IntRange' end, h.pos, null, h.v, null, null from (select 1) left join (select H_k.pos as p from A join H_k using (seq) where A.entity_id = 3) p on true left join H_k h on h.pos >= p.p and h.pos < p.p + 4",
            _none(9),
            "select 10, 'IntList', h.pos, null, h.v, null, null from (select 1) left join H_epoch h on true",
            _none(11),
            "select 12, case when t.event_type is null then 'None' else 'Str' end, null, null, null, t.event_type, null from (select 1) left join A s on s.entity_id = 1 left join A t on t.entity_id = s.type",
            _none(13),
        ]
    )
    + ") select * from U"
)
def q22_batch(spark, sf_dir):
    return batch.execute(event_log(spark, sf_dir), NODES).select("node_idx", "tag", "pos", "v_dbl", "v_int", "v_str", hexed())


@query(f"select cast(count(*) as int) as results from ({ORACLES['q22_batch']})")
def q23_batch_async(spark, sf_dir):
    counted = []
    last = batch.execute_async(event_log(spark, sf_dir), NODES, lambda row: counted.append(row.node_idx) or len(counted)).result()
    return spark.createDataFrame([(last,)], "results int")


@query("select count(*) as n from customer where c_nationkey = 1 and c_custkey >= 18")
def q25_active_adults(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_nationkey = 1 and c_custkey >= 18").agg(F.count(F.lit(1)).alias("n"))


# Columns


def k_slots(spark, sf_dir):
    return history.slots(history.column(event_log(spark, sf_dir), "k"))


_K = f"with {LOG}, {cells_sql('k')}"


@query(f"{_K} select pos, v, true as valid from H_k")
def c01_get(spark, sf_dir):
    return k_slots(spark, sf_dir)


@query(f"{_K} select pos, case when pos % 7 <> 0 or pos % 14 = 0 then v end as v from H_k")
def c02_set_valid(spark, sf_dir):
    off = history.set_valid(k_slots(spark, sf_dir), F.col("pos") % 7 == 0, False)
    return history.iterate(history.set_valid(off, F.col("pos") % 14 == 0, True))


@query(f"{_K} select r.pos, h.v, h.v is not null as valid from (select unnest(range(0, (select max(pos) * 3 + 1 from H_k))) as pos) r left join (select pos * 3 as pos, v from H_k) h using (pos)")
def c04_set_with_gaps(spark, sf_dir):
    """Each value goes to three times its position."""
    cells = history.column(event_log(spark, sf_dir), "k").select((F.col("pos") * 3).alias("pos"), "v")
    none = spark.createDataFrame([], "pos bigint, v bigint, valid boolean")
    return history.set_values(none, cells)


@query(f"{_K} select count(*) as slots, count(case when pos % 7 <> 0 then 1 end) as valid from H_k")
def c05_len(spark, sf_dir):
    return history.lengths(history.set_valid(k_slots(spark, sf_dir), F.col("pos") % 7 == 0, False))


@query(f"{_K} select e.event_id as pos, v from events e left join H_k h on h.pos = e.event_id")
def c06_get_element(spark, sf_dir):
    """The element at every event's id; beyond the column's end there is none."""
    return history.elements(k_slots(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("event_id").alias("pos")))


@query(f"{_K} select count(*) as data_len from H_k")
def c07_snapshot_len(spark, sf_dir):
    return k_slots(spark, sf_dir).agg(F.count(F.lit(1)).alias("data_len"))


# Writes

_STATE_COLS = "entity_id, seq, op, event_type, k, epoch, type"
_STATE_SQL = f"select {_STATE_COLS}, hex(encode(payload)) as payload"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*_STATE_COLS.split(", "), F.hex("payload").alias("payload"))


@query(f"with {STATE} {_STATE_SQL} from S")
def w01_insert_state(spark, sf_dir):
    return _flat(state.state(event_log(spark, sf_dir)))


@query(f"with {LOG} select (row_number() over (partition by seq // 10 order by seq) - 1) + (seq // 10) * 100 as seq, op, entity_id, k from L where op <> 'delete'")
def w02_batch_insert(spark, sf_dir):
    """Every ten sequence numbers are one batch of inserts, which is taken apart again."""
    writes = stored_events(spark, sf_dir).where(F.col("op") != DELETE)
    items = logs.exploded(logs.batches(writes, 10), 100)
    return items.select("seq", "op", "entity_id", F.col("attrs_int")["k"].alias("k"))


@query(f"with {STATE} select entity_id, seq from S where op = 'delete'")
def w03_delete(spark, sf_dir):
    return state.state(event_log(spark, sf_dir), []).where(F.col("op") == DELETE).select("entity_id", "seq")


@query(f"with {LOG} select seq, entity_id, epoch, type, hex(encode(payload)) as payload from L where op = 'insert_fast'")
def w04_insert_fast(spark, sf_dir):
    log = stored_events(spark, sf_dir).where(F.col("op") == FAST)
    return log.select("seq", "entity_id", F.col("attrs_int")["epoch"].alias("epoch"), F.col("attrs_int")["type"].alias("type"), F.hex(F.col("attrs_blob")["payload"]).alias("payload"))


@query("select c_custkey as entity_id, 1 as n_int, 2 as n_str, 1 as n_blob, cast(c_nationkey as bigint) as nation, c_mktsegment as segment, hex(encode(c_name)) as name from customer")
def w05_route_by_type(spark, sf_dir):
    """A map of tagged values, split by tag into three typed maps."""
    c = table(spark, sf_dir, "customer")
    null = F.lit(None)

    def cell(tag, i, s, b):
        return F.struct(F.lit(tag).alias("tag"), i.cast("bigint").alias("i"), s.cast("string").alias("s"), b.cast("binary").alias("b"))

    def routed_to(tag, kind):
        return F.transform_values(F.map_filter(tagged, lambda _, v: v["tag"] == tag), lambda _, v: v[kind]).alias(f"attrs_{tag}")

    cells = {"nation": cell(INT, F.col("c_nationkey"), null, null), "segment": cell(STR, null, F.col("c_mktsegment"), null), "label": cell(STR, null, F.col("c_name"), null), "name": cell(BLOB, null, null, F.col("c_name"))}
    tagged = F.create_map(*[x for name, value in cells.items() for x in (F.lit(name), value)])
    routed = c.select(F.col("c_custkey").alias("entity_id"), routed_to(INT, "i"), routed_to(STR, "s"), routed_to(BLOB, "b"))
    return routed.select("entity_id", *[F.size(f"attrs_{t}").alias(f"n_{t}") for t in (INT, STR, BLOB)], F.col("attrs_int")["nation"].alias("nation"), F.col("attrs_str")["segment"].alias("segment"), F.hex(F.col("attrs_blob")["name"]).alias("name"))


@query(f"with {LOG} select seq, 2 as n, 7 as k, 'x' as added, false as empty from L where k is not null")
def w06_attributes(spark, sf_dir):
    """Inserting into attributes (the last value wins), size, lookup and emptiness."""
    log = stored_events(spark, sf_dir).where(F.map_contains_key("attrs_int", "k"))
    ints = F.transform_values(F.col("attrs_int"), lambda _, v: v * 0 + 7)
    strs = F.map_from_entries(F.concat(F.filter(F.map_entries("attrs_str"), lambda e: e["key"] != "added"), F.array(F.struct(F.lit("added").alias("key"), F.lit("x").alias("value")))))
    return log.select("seq", F.size(strs).alias("n"), ints["k"].cast("int").alias("k"), strs["added"].alias("added"), (F.size("attrs_int") == 0).alias("empty"))


_NO_DIFFERENCE = f"with {LOG} select count(*) as commands, cast(0 as bigint) as differences from L where op <> 'delete'"


@query(_NO_DIFFERENCE)
def w07_codec(spark, sf_dir):
    """Commands to bytes and back; 0 differences."""
    return _codec_differences(spark, sf_dir, lambda c: codec.decode(codec.encode(c)) == c)


@query(_NO_DIFFERENCE)
def w08_entity_codec(spark, sf_dir):
    return _codec_differences(spark, sf_dir, lambda c: codec.decode_entity(codec.encode_entity(c)) == c)


def _codec_differences(spark, sf_dir, same) -> DataFrame:
    from tidelog.model import Insert

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            commands = [Insert(i, {**({"k": k} if k is not None else {}), **({"event_type": e} if e else {}), **({"payload": p} if p else {})}) for i, k, e, p in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(not same(c) for c in commands)])], names=["commands", "differences"])

    log = event_log(spark, sf_dir).writes().select("entity_id", "k", "event_type", "payload")
    return log.mapInArrow(run, "commands bigint, differences bigint").agg(F.sum("commands").alias("commands"), F.sum("differences").alias("differences"))


@query(
    f"with {LOG}, "
    + ", ".join(cells_sql(a) for a in FAMILIES)
    + " "
    + " union all ".join(f"select '{a}' as attr, '{f}' as family, pos, seq, entity_id, {'v' if f == INT else 'cast(null as bigint)'} as v_int, {'v' if f == STR else 'cast(null as varchar)'} as v_str, {'hex(encode(v))' if f == BLOB else 'cast(null as varchar)'} as v_blob from H_{a}" for a, f in FAMILIES.items())
)
def w10_history(spark, sf_dir):
    return history.history(event_log(spark, sf_dir)).select("attr", "family", "pos", "seq", "entity_id", "v_int", "v_str", hexed())


@query(f"with {STATE} {_STATE_SQL} from S")
def w12_replay(spark, sf_dir):
    """The state from the log as it is stored, with attributes as maps."""
    path = scratch(spark, "replay")
    stored_events(spark, sf_dir).write.parquet(path)
    return _flat(state.state(logs.from_commands(spark.read.parquet(path), FAMILIES)))


# Storage

_LAST = f"with {LOG}, W as (select * exclude (rn) from (select *, row_number() over (partition by entity_id order by seq desc) as rn from L where op <> 'delete') where rn = 1)"


@query(f"{_LAST} {_STATE_SQL} from W")
def s02_read_entity(spark, sf_dir):
    return _flat(storage.latest(event_log(spark, sf_dir).writes()))


@query(f"{_LAST} {_STATE_SQL} from W where entity_id >= 64 and entity_id < 128")
def s03_read_block(spark, sf_dir):
    return _flat(storage.latest(storage.in_block(event_log(spark, sf_dir).writes(), 70)))


@query("select c_custkey as entity_id from customer where c_custkey in (select user_id from events where event_type <> 'error')")
def s04_contains(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    return ids.join(event_log(spark, sf_dir).writes().select("entity_id").distinct(), "entity_id", "left_semi")


@query(f"with {LOG} select entity_id, max(seq) as seq, count(*) as records from L where op <> 'delete' group by entity_id")
def s05_disk_index(spark, sf_dir):
    return storage.disk_index(event_log(spark, sf_dir).writes())


@query(f"{_LAST} {_STATE_SQL} from W")
def s06_compact(spark, sf_dir):
    store = storage.Store(spark, scratch(spark, "store"))
    store.append(event_log(spark, sf_dir).writes())
    store.compact()
    return _flat(store.records())


@query(f"{_LAST} {_STATE_SQL} from W where entity_id in (select c_custkey from customer)")
def s09_promote(spark, sf_dir):
    store = storage.Store(spark, scratch(spark, "store"))
    store.append(event_log(spark, sf_dir).writes())
    return _flat(store.promote(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))))


_LE8 = lambda x: "concat(" + ", ".join(f"substr(lpad(hex({x}), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + ")"
_KIND = "case op when 'insert' then hex(encode('INSERT:')) when 'insert_fast' then hex(encode('INSERT_FAST:')) else hex(encode('DELETE:')) end"


@query(f"with {LOG} select seq // 100 as batch, count(*) as n, sha256(unhex({_LE8('(seq // 100) + 1700000000')} || hex(encode('signer')) || string_agg({_KIND} || {_LE8('entity_id')}, '' order by seq))) as hash from L group by seq // 100")
def s12_archive(spark, sf_dir):
    b = F.floor(F.col("seq") / 100)
    return archive.digests(event_log(spark, sf_dir).df, b, b + 1_700_000_000, "signer")


@query("select true as intact")
def s13_verify_integrity(spark, sf_dir):
    store = storage.Store(spark, scratch(spark, "store"))
    store.append(event_log(spark, sf_dir).writes())
    store.sign()
    return spark.createDataFrame([(store.verify_integrity(),)], "intact boolean")


@query("select 'customer' as name, count(distinct c_custkey) as entities, count(*) as commands from customer union all select 'events', count(distinct user_id), count(*) from events")
def s14_inspect_metadata(spark, sf_dir):
    return storage.metadata({"events": event_log(spark, sf_dir).df, "customer": customer_log(spark, sf_dir).df})


def customer_log(spark, sf_dir) -> Log:
    df = table(spark, sf_dir, "customer").withColumn("name_bytes", F.col("c_name").cast("binary"))
    return logs.from_table(df, "c_custkey", {"c_nationkey": INT, "c_name": STR, "c_mktsegment": STR, "name_bytes": BLOB})


@query("select c_custkey as entity_id from customer where contains(c_name, '99')")
def s15_reverse_search(spark, sf_dir):
    return storage.reverse_search(customer_log(spark, sf_dir).df, F.col("name_bytes"), b"99")


@query(f"with {STATE} {_STATE_SQL} from S where entity_id in (select c_custkey from customer)")
def b05_prewarm(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    return _flat(storage.prewarm(state.state(event_log(spark, sf_dir)), ids))


# Text

_TOKENS = "T as (select doc_id as entity_id, lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')) as token from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) as w from documents))"


@query(f"with {_TOKENS} select token, count(*) as n, count(distinct entity_id) as docs from T where token <> '' group by token")
def t01_tokenize(spark, sf_dir):
    found = textindex.tokenized(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("docs"))


@query(f"with {_TOKENS} select distinct token, entity_id from T where token <> ''")
def t02_insert_document(spark, sf_dir):
    return textindex.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text").postings


def _index(spark, sf_dir) -> textindex.TextIndex:
    return textindex.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"with {_TOKENS} select entity_id from T where token in ('the', 'of') group by entity_id having count(distinct token) = 2")
def t03_search_and(spark, sf_dir):
    return _index(spark, sf_dir).search_and("The, OF no-such-token-anywhere")


@query(f"with {_TOKENS} select distinct entity_id from T where token in ('idiot', 'que')")
def t04_search_or(spark, sf_dir):
    return _index(spark, sf_dir).search_or("idiot Que no-such-token-anywhere")


@query(f"with {_TOKENS} select entity_id from T where token in ('the', 'of') and entity_id not in (select doc_id from documents where source = 'src0') group by entity_id having count(distinct token) = 2")
def t05_remove_document(spark, sf_dir):
    """A source's documents leave the index."""
    leaving = table(spark, sf_dir, "documents").where("source = 'src0'")
    return _index(spark, sf_dir).remove(leaving, "doc_id", "text").search_and("the of")


# Operations records and scalar functions


def ops_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    level = F.create_map(*[F.lit(x) for x in ("view", "DEBUG", "click", "info", "signup", "Info", "purchase", "warn", "error", "error")])
    rows = e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("entity_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("timestamp"),
        F.col("event_type").alias("service"),
        F.concat(F.lit("n"), F.col("user_id") % 4).alias("node"),
        level[F.col("event_type")].alias("level"),
        F.col("props").alias("message"),
        (F.col("value") / 1000).cast("float").alias("cpu_usage"),
        (k / 100).cast("float").alias("mem_usage"),
        k.alias("response_time_ms"),
    )
    edge = spark.createDataFrame([(-1, -1, 4294967295, "s", "n", "Fatal", "m", float("nan"), -0.5, 0), (-2, -2, 4294967296, "s", "n", "Info", "m", 0.5, 1e30, 4294967295)], rows.schema)
    return rows.unionByName(edge)


_U32 = lambda x: f"case when isnan({x}) or {x} < 0 then 0 when {x} >= 4294967295 then 4294967295 else cast(trunc({x}) as bigint) end"
_OPS = f"""with R as (
  select event_id as seq, user_id as entity_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as ts, event_type as service, 'n' || (user_id % 4) as node,
    case event_type when 'view' then 'Debug' when 'click' then 'Info' when 'signup' then 'Info' when 'purchase' then 'Warn' else 'Error' end as level,
    props as message, cast(value / 1000 as float) as cpu, cast(cast(json_extract_string(props, '$.k') as bigint) / 100 as float) as mem, cast(json_extract_string(props, '$.k') as bigint) as rt
  from events
  union all select -1, -1, 4294967295, 's', 'n', 'Fatal', 'm', cast('nan' as float), cast(-0.5 as float), 0
  union all select -2, -2, 4294967296, 's', 'n', 'Info', 'm', cast(0.5 as float), cast(1e30 as float), 4294967295),
P as (select *, cpu * cast(1000 as float) as c, mem * cast(1000 as float) as m from R)
select seq, entity_id, service, node, level, message, ts % 4294967295 as timestamp, {_U32('c')} as cpu_milli, {_U32('m')} as mem_milli, rt as response_time from P"""


@query(_OPS)
def f01_ops_attributes(spark, sf_dir):
    return ops_records.attributes(ops_rows(spark, sf_dir))


@query(_OPS.replace("select seq, entity_id, service", "select seq, 'insert' as op, 0 as blobs, entity_id, service"))
def f02_insert_ops_record(spark, sf_dir):
    rows = ops_records.inserts(ops_rows(spark, sf_dir))
    return rows.select("seq", "op", F.size("attrs_blob").alias("blobs"), "entity_id", *[F.col("attrs_str")[a].alias(a) for a in ("service", "node", "level", "message")], *[F.col("attrs_int")[a].alias(a) for a in ("timestamp", "cpu_milli", "mem_milli", "response_time")])


@query("select event_id, case event_type when 'view' then 'Debug' when 'click' then 'Info' when 'error' then 'Error' end as level from events")
def f03_level_name(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", scalars.level_name(F.when(e == "view", "debug").when(e == "click", "INFO").when(e == "error", "Error").otherwise(e)).alias("level"))


@query(f"select event_id, {_LE8('event_id * 1000003')} as le from events")
def f04_u64_le(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.hex(scalars.u64_le(F.col("event_id") * 1000003)).alias("le"))


@query("select c_custkey, sha256(c_name) as hash from customer")
def f05_sha256(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("hash"))


@query()
def f06_key_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.key_id(F.col("c_name")).alias("entity_id"))


# Facades


@query(f"with {STATE} select entity_id, k from A where k is not null union all select -1, 41 union all select -4, 44")
def a01_write_read_int(spark, sf_dir):
    log = facade.CommandLog(spark)
    log.append(stored_events(spark, sf_dir))
    p = facade.Partition(log)
    p.write_int(-1, "k", 41)
    p.write_int(-2, "k", 42)
    p.write_str(-2, "event_type", "replaces k")
    p.write_blob(-3, "payload", b"\x01")
    p.write_int(-4, "k", 44)
    p.write_epoch_snapshot(-5, 1, 2, b"\x03")
    return state.get(log.log(), "k", INT)


@query(f"with {STATE} select entity_id, event_type from A where event_type is not null and entity_id <> 3 union all select -2, 'kept'")
def a02_read_str_delete(spark, sf_dir):
    log = facade.CommandLog(spark)
    log.append(stored_events(spark, sf_dir))
    p = facade.Partition(log)
    p.write_str(-1, "event_type", "gone")
    p.delete(-1)
    p.write_str(-2, "event_type", "kept")
    p.delete(3)
    return state.get(log.log(), "event_type", STR)


@query("select 1 as id, 'alice' as str, '010203' as blob union all select 2, null, null")
def a03_stores(spark, sf_dir):
    strs, blobs = facade.StrStore(facade.Partition(facade.CommandLog(spark)), "name"), facade.BlobStore(facade.Partition(facade.CommandLog(spark)), "data")
    for i in (1, 2):
        strs.put(i, "alice")
        blobs.put(i, b"\x01\x02\x03")
    strs.delete(2)
    blobs.delete(2)
    return spark.createDataFrame([(i, strs.get(i), (blobs.get(i) or b"").hex() or None) for i in (1, 2)], "id int, str string, blob string")


@query("select user_id as key, hex(encode(arg_max(props, event_id))) as data from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def a04_kv(spark, sf_dir):
    puts = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("props").cast("binary").alias("data"), (F.col("event_type") == "error").alias("gone"))
    return facade.bulk_kv(puts, "event_id", "user_id", "data", "gone").select("key", F.hex("data").alias("data"))


@query("select event_id as key, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def a05_typed_cache(spark, sf_dir):
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("props").alias("json"))
    return facade.typed_values(values, "key", T.StructType([T.StructField("k", T.LongType())]), "json").select("key", "value.k")


@query("select event_id as entity_id, user_id, event_type from events")
def a06_partition_reader(spark, sf_dir):
    log = self_links(spark, sf_dir, 0)
    return state.get(log, "user_id", INT).join(state.get(log, "event_type", STR), "entity_id")


_READ = ", ".join(f"({i})" for i in (1, 2, 3, 7, 10**9))


@query(f"with {STATE} select i as entity_id, k, event_type, hex(encode(payload)) as payload, null as of_another_family from (values {_READ}) t(i) left join A on entity_id = i")
def a06_point_reads(spark, sf_dir):
    """Typed reads of single entities from a stored log, one scan with a pushed filter each."""
    log = facade.CommandLog(spark)
    log.append(stored_events(spark, sf_dir))
    read = facade.PartitionReader(log)
    rows = [(i, read.get_int(i, "k"), read.get_str(i, "event_type"), (read.get_blob(i, "payload") or b"").hex().upper() or None, read.get_str(i, "k")) for i in (1, 2, 3, 7, 10**9)]
    return spark.createDataFrame(rows, "entity_id bigint, k bigint, event_type string, payload string, of_another_family string")


@query("select 'events' as name, 0 as partition_id, count(distinct user_id) as memory_entities from events")
def a08_metrics(spark, sf_dir):
    return metrics(event_log(spark, sf_dir).df, "events", 0)


@query("select c_custkey as entity_id, cast(length(c_name) as bigint) as result from customer")
def u01_scalar_closure(spark, sf_dir):
    return state.with_value(customer_log(spark, sf_dir), "c_name", STR, lambda v: F.length(v).cast("bigint"))


@query("select c_custkey as entity_id, c_nationkey * 2 + 1 as result from customer")
def u01_scalar_pandas(spark, sf_dir):
    twice = F.pandas_udf(lambda s: s * 2 + 1, T.LongType())
    return state.with_value(customer_log(spark, sf_dir), "c_nationkey", INT, twice)


@query("select cast(sum(c_nationkey * c_nationkey) as bigint) as result from customer")
def u02_column_closure(spark, sf_dir):
    return history.with_data(customer_log(spark, sf_dir), "c_nationkey", lambda v: F.sum(v * v))


# Streaming


#: Commands in one file of a landing folder, at most (as the range partitioner samples them).
ROWS_A_FILE = 250_000


def _land(spark, log: Log, batches: int) -> tuple[str, int]:
    """A landing folder with the commands of a log for so many micro-batches, and how many files each takes: two, or as
    many times two as keep a file below ROWS_A_FILE, so files grow in number and not in size."""
    files = 2 * max(1, -(-log.df.count() // (batches * 2 * ROWS_A_FILE)))
    landing = scratch(spark, "landing")
    logs.to_commands(Log(log.df.repartitionByRange(batches * files, "seq"), log.families)).write.parquet(landing)
    return landing, files


def _state_table(spark) -> StateTable:
    return StateTable(spark, scratch(spark, "state"), LOG_SCHEMA, fold_after=3)


def _stream_state(found: StateTable) -> DataFrame:
    return _flat(logs.from_commands(found.current(), FAMILIES).df)


@query(f"with {STATE} {_STATE_SQL} from S")
def st01_micro_batches(spark, sf_dir):
    (landing, files), found = _land(spark, event_log(spark, sf_dir), 3), _state_table(spark)
    ingest(landing, found, scratch(spark, "offsets"), files_per_batch=files)
    names = sorted(f for f in storage.Files(spark, landing).names() if f.endswith(".parquet"))
    for old in filter(None, (names[: files // 2], names[files // 2 : files])):
        found.merge(spark.read.schema(found.schema).parquet(*[f"{landing}/{f}" for f in old]), 10**6, old[0])  # old batches come again, late
    return _stream_state(found)


@query(f"with {STATE} {_STATE_SQL} from S")
def st01_two_sources(spark, sf_dir):
    """Two landing folders with checkpoints of their own, the second with the older commands, in one table."""
    log = event_log(spark, sf_dir)
    found = _state_table(spark)
    for half in (1, 0):
        landing, files = _land(spark, Log(log.df.where(F.col("seq") % 2 == half), log.families), 2)
        ingest(landing, found, scratch(spark, "offsets"), files_per_batch=files)
    found.fold()
    found.vacuum()
    return _stream_state(found)


@query(f"with {STATE} {_STATE_SQL} from S")
def st02_stateful_latest(spark, sf_dir):
    (landing, files), found = _land(spark, event_log(spark, sf_dir), 2), _state_table(spark)
    run_stateful(landing, found, scratch(spark, "offsets"), files_per_batch=files)
    return _stream_state(found)
