"""The stateful operator, and landing folders that grow."""

import tempfile

from oracle import SF, assert_same, connection

from tidelog import catalog_queries as cq
from tidelog.model import LOG_SCHEMA, Delete, Insert
from tidelog.sources import storage
from tidelog.sources.log import commands_frame
from tidelog.streaming.ingest import latest_by_state


def folder():
    return "file://" + tempfile.mkdtemp(prefix="tidelog-test-")


def test_the_stateful_operator_gives_what_changed(spark):
    """A row for an entity whenever its last command changes, and no more; reduced before the shuffle, without Python."""
    landing, checkpoint, given = folder(), folder(), []

    def run(frame):
        """Another start of the same stream with one more batch."""
        frame.coalesce(1).write.mode("append").parquet(landing)
        batches = []
        stream = latest_by_state(spark.readStream.schema(LOG_SCHEMA).parquet(landing), LOG_SCHEMA)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: batches.append(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        given.append(sorted((r.entity_id, r.seq, r.op, r.attrs_int) for rows in batches for r in rows))
        return query

    query = run(commands_frame(spark, [Insert(1, {"a": n}) for n in range(50)] + [Insert(2, {"a": 1}), Delete(3)], 100))
    run(commands_frame(spark, [Insert(1, {"a": 7}), Delete(2), Insert(3, {"a": 9}), Insert(4, {"a": 4})], 10))  # older, but for 4
    run(commands_frame(spark, [Insert(1, {"a": 3})], 149))  # the seq that is kept comes again
    run(commands_frame(spark, [Delete(1), Insert(3, {"a": 5})], 200))
    assert given == [
        [(1, 149, "insert", {"a": 49}), (2, 150, "insert", {"a": 1}), (3, 151, "delete", {})],
        [(4, 13, "insert", {"a": 4})],
        [],
        [(1, 200, "delete", {}), (3, 201, "insert", {"a": 5})],
    ]
    plan = query._jsq.explainInternal(False)
    assert "partial_max_by" in plan and "Pandas" not in plan and "Python" not in plan


def test_landing_files_grow_in_number(spark, monkeypatch):
    """More commands are more files of the same size, in as many micro-batches, and the state is the same."""
    seen = []
    land, merge = cq._land, cq.StateTable.merge

    def landed(*args):
        landing, files = land(*args)
        seen.append((files, [f for f in storage.Files(spark, landing).names() if f.endswith(".parquet")], landing))
        return landing, files

    merged = []
    monkeypatch.setattr(cq, "_land", landed)
    monkeypatch.setattr(cq, "ROWS_A_FILE", 60)
    monkeypatch.setattr(cq.StateTable, "merge", lambda self, batch, i, source="": (merged.append(i), merge(self, batch, i, source))[1])
    con, rows = connection(SF), spark.read.parquet(f"{SF}/events.parquet").count()
    for name, batches, folders, again in (("st02_stateful_latest", 2, 1, 0), ("st01_micro_batches", 3, 1, 2), ("st01_two_sources", 2, 2, 0)):
        seen.clear()
        merged.clear()
        assert_same(con, cq.QUERIES[name](spark, SF), cq.ORACLES[name])
        assert len(merged) == batches * folders + again
        for files, names, landing in seen:
            assert len(names) == files * batches and files * batches * 60 >= rows // folders
            most = max(spark.read.parquet(f"{landing}/{n}").count() for n in names)
            assert most < 120
        assert len(seen) == folders
