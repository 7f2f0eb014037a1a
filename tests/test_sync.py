import pandas as pd

from lectern.operators import sync


def plan(old, new):
    o = pd.DataFrame(old, columns=["chunk_index", "hash", "deleted"]).astype({"deleted": bool})
    return sync.plan_chunks(o, pd.DataFrame(new, columns=["chunk_index", "hash"]))


def test_unchanged_update_restore_create():
    got = plan([(0, "a", False), (1, "b", False), (2, "c", True)], [(0, "a"), (1, "x"), (2, "c"), (3, "d")])
    assert [a for _, _, a in got] == ["unchanged", "update", "restore", "create"]


def test_an_insertion_in_front_moves_the_rest():
    got = plan([(0, "a", False), (1, "b", False), (2, "c", False)], [(0, "n"), (1, "a"), (2, "b"), (3, "c")])
    assert [(i, a) for _, i, a in got] == [(0, "create"), (1, "move"), (2, "move"), (3, "move")]


def test_document_plan(spark):
    stored = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "d", False), (5, "e", True)], "external_id long, hash string, deleted boolean")
    incoming = spark.createDataFrame([(1, "a"), (2, "z"), (3, "c"), (9, "n")], "external_id long, hash string")
    got = {r.external_id: r.action for r in sync.document_plan(stored, incoming).collect()}
    assert got == {1: "unchanged", 2: "update", 3: "restore", 4: "delete", 9: "create"}
    assert {r.external_id: r.action for r in sync.document_plan(stored, incoming, complete=False).collect()}[4] == "missing"


def test_streaming_sync_is_incremental_and_monotonic(spark, tmp_path):
    from lectern.streaming import cursor

    schema = "k long, at long"
    run = lambda: {r.k: r.at for r in cursor.sync(spark, f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c", schema, "k", "at").collect()}
    spark.createDataFrame([(1, 5), (2, 5)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {1: 5, 2: 5}
    spark.createDataFrame([(1, 3), (2, 8), (3, 1)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {1: 5, 2: 8, 3: 1} == run()


def test_deltas_are_merged_into_bases(spark, tmp_path):
    from lectern.streaming import cursor

    schema = "k long, at long"
    want = {}
    for i in range(5):
        rows = [(k, (i * 7 + k * 3) % 11) for k in range(i, i + 3)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        for k, at in rows:
            want[k] = max(want.get(k, -1), at)
        got = {r.k: r.at for r in cursor.sync(spark, f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c", schema, "k", "at", deltas=2).collect()}
        assert got == want
    assert cursor.finished(spark, f"{tmp_path}/t", "base") == [1, 3] and len(cursor.finished(spark, f"{tmp_path}/t", "delta")) == 5


def test_keyed_state_takes_the_newest_row_only(spark, tmp_path):
    from lectern.streaming import cursor

    schema = "k long, at long, b string, a string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: {r.k: tuple(r)[1:] for r in cursor.keyed_sync(spark, f"{tmp_path}/in", f"{tmp_path}/c", schema, "k", "at").collect()}
    put([(1, 5, "x", "a"), (2, 5, "x", None), (None, 1, "n", "n")])
    assert run() == {1: (5, "x", "a"), 2: (5, "x", None), None: (1, "n", "n")} == run()
    put([(1, 3, "z", "z"), (2, 8, "y", "q"), (3, 1, "w", "w")])
    put([(1, 5, "x", "a"), (1, 5, "a", "b"), (1, 5, "c", "b")])  # again, and ties: the greatest a, then b
    want = {1: (5, "c", "b"), 2: (8, "y", "q"), 3: (1, "w", "w"), None: (1, "n", "n")}
    assert run() == want == run()
    every = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert {r.k: tuple(r)[1:] for r in cursor.newest(every, "k", "at").collect()} == want


def test_chunk_plan_takes_batches_of_documents_and_no_group_each(spark):
    import random

    rng = random.Random(7)
    stored = [(d, i, rng.choice("abcd"), rng.random() < 0.3) for d in range(60) for i in rng.sample(range(9), rng.randrange(7))]
    incoming = [(d, i, rng.choice("abcd")) for d in range(5, 65) for i in rng.sample(range(9), rng.randrange(7))]
    made = sync.chunk_plan(spark.createDataFrame(stored, "document_id long, chunk_index long, hash string, deleted boolean"), spark.createDataFrame(incoming, "document_id long, chunk_index long, hash string"))
    assert "CoGroup" not in made._jdf.queryExecution().toString()
    want = [(d, a, b, action, action in ("create", "update")) for d in range(65) for a, b, action in plan([c[1:] for c in stored if c[0] == d], [c[1:] for c in incoming if c[0] == d])]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)
