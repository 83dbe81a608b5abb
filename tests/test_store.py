import hashlib
import random

import pytest
from pyspark.sql import functions as F

from honeyframe import errors as E
from honeyframe.operators import analytics, snapshot
from honeyframe.sources.jsonio import export_array, read_cells
from honeyframe.sources.store import Store
from honeyframe.streaming.changefeed import event_windows, read_since, stream
from honeyframe.streaming.superhex import SuperhexSync


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def test_commits_and_snapshots(store):
    with store.update() as tx:
        tx.put_cell(0, 0, "one", tags=("a",))
        tx.put_cell(1, 0, "two")
        assert tx.get_cell(0, 0)["raw_content"] == "one" and tx.read_sequence == 0
    store.tag_snapshot("first")
    with store.update() as tx:
        tx.put_cell(0, 0, "changed")
        tx.put_embedding(0, 0, [1.0, 0.0])
        tx.link_cells((0, 0), (1, 0), "next")
        tx.link_cells((1, 0), (0, 0), "prev")
        tx.put_facet(0, 0, 2, "derived")
        tx.put_seam("s1", (0, 0), (1, 0), "mark_conflict")
    assert {x.raw_content for x in store.view().collect()} == {"changed", "two"}
    assert {x.raw_content for x in store.view_at_tag("first").collect()} == {"one", "two"}
    assert store.view_at_time(0).count() == 0
    with pytest.raises(E.FutureSequence):
        store.snapshot("cells", 9)
    with pytest.raises(E.HistoricalDataUnavailable):
        store.snapshot("edges", 1)
    with store.update() as tx:
        assert tx.delete_cell(0, 0) and not tx.delete_cell(5, 5)
    assert store.view().count() == 1 and store.snapshot("facets").count() == 0 and store.current("vectors").count() == 0
    assert [x.relation for x in store.current("edges").collect()] == ["prev"] and store.snapshot("seams").count() == 1
    assert [tuple(x) for x in store.diff(1, 3).select("kind", "commit_seq", "op").collect()] == [("cell", 2, "put"), ("cell", 3, "delete"), ("seam", 2, "put")]
    assert store.prune(3, 10) == 2 and store.oldest_snapshot_seq() == 3 and store.view().count() == 1
    with pytest.raises(E.SnapshotExpired):
        store.snapshot("cells", 1)
    store.compact()
    assert store.view().count() == 1 and store.list_snapshot_tags() == [("first", 1)]
    with pytest.raises(E.UnknownSnapshotTag):
        store.delete_snapshot_tag("none")


def test_failed_commit_leaves_nothing(store):
    with pytest.raises(RuntimeError), store.update() as tx:
        tx.put_cell(0, 0, "x")
        raise RuntimeError
    assert store.meta["head"] == 0 and store.view().count() == 0
    refusing = Store(store.spark, store.path, validator=lambda row: "no" if "bad" in row["raw_content"] else None)
    stored, refused = refusing.batch_put_cells([{"q": i, "r": 0, "raw_content": "bad" if i == 3 else "good"} for i in range(130)], continue_on_error=True)
    assert stored == 129 and [i for i, _ in refused] == [3] and store.meta["head"] == 2


def test_seams_and_facets(store):
    with store.update() as tx:
        tx.put_cell(0, 0, "text")
        tx.put_seam("s", (0, 0), (1, 0), "mark_conflict")
        tx.put_seam("s", (1, 0), (0, 0), "mark_conflict")
        with pytest.raises(E.SeamConflict):
            tx.put_seam("s", (0, 0), (2, 0), "mark_conflict")
        with pytest.raises(E.SeamNotFound):
            tx.resolve_seam("t", "resolved")
        with pytest.raises(E.DerivationMismatch):
            tx.update_facet(0, 0, 1, "x", "0" * 64)
        tx.update_facet(0, 0, 1, "x", hashlib.sha256(b"text").hexdigest())
    with store.update() as tx:
        tx.resolve_seam("s", "resolved", "done")
    row = store.snapshot("seams").first()
    assert (row.resolution_status, row.resolution_note) == ("resolved", "done")
    assert [x.op for x in store.changelog().orderBy("seq").collect()] == [1, 2, 2, 4, 3]


def test_kv_and_consumers(store):
    with store.update() as tx:
        for i in range(6):
            tx.put_cell(i, 0, str(i))
        tx.put(b"app/a", b"1")
        tx.put(b"app/b", b"2")
        with pytest.raises(E.InvalidArgument):
            tx.put(b"cell/x", b"")
    assert store.get(b"app/a") == b"1" and store.get(b"none") is None and store.range(None, b"app/b").count() == 2
    store.advance_consumer("c", 0, 0)
    store.advance_consumer("c", 0, 5)
    for expected, then in ((0, 6), (5, 4), (5, 7)):
        with pytest.raises(E.CursorConflict):
            store.advance_consumer("c", expected, then)
    assert store.consumers() == [("c", 5)] and store.retention_floor() == 5 and store.has_changefeed()
    store.delete_consumer("c", 5)
    store.reset_changelog()
    assert not store.has_changefeed()


def test_json_round_trip(spark, store, tmp_path):
    with store.update() as tx:
        for i in range(3):
            tx.put_cell(i, 0, f"n{i}", tags=("t",), confidence=0.5)
    (tmp_path / "cells.json").write_text(export_array(store.view(), (0, 0), 1))
    assert [x.raw_content for x in read_cells(spark, f"file://{tmp_path}/cells.json").orderBy("q").collect()] == ["n0", "n1"]
    (tmp_path / "bad.json").write_text('[{"q": "x"}]')
    with pytest.raises(Exception):  # noqa: B017
        read_cells(spark, f"file://{tmp_path}/bad.json").collect()


def test_superhex_soak(spark):
    rng, live, seq, feed = random.Random(3), {}, 0, []
    sync = SuperhexSync(spark, 1)
    for _ in range(3):
        for _ in range(24):
            seq += 1
            c = rng.randint(-6, 6), rng.randint(-6, 6)
            op = 1 if rng.random() < 0.7 else 6
            feed.append((seq, op, c[0] * 1000 + c[1], *c))
            if op == 1:
                live[c] = seq
            else:
                live.pop(c, None)
        df = spark.createDataFrame(feed, "seq long, op int, key long, q int, r int")
        assert sync.sync(df, 24) == 24 and sync.sync(df, 24) == 0
    want = analytics.superhex_summary(spark.createDataFrame([(*c, s) for c, s in live.items()], "q int, r int, commit_seq long"), 1)
    got = sync.summaries().select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_stream_of_commits(spark, store, tmp_path):
    for i in range(3):
        with store.update() as tx:
            tx.put_cell(i, 0, str(i))
    sync = SuperhexSync(spark, 1)
    sync.start(stream(spark, store.path), f"{tmp_path}/checkpoint").awaitTermination()
    assert sync.state.count() == 3
    assert read_since(store.changelog(), 0, 2).count() == 2 and read_since(store.changelog(), 0, 0).count() == 0


def test_event_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert event_windows(events).agg(F.sum("n")).first()[0] == events.count()


def test_snapshot_functions(spark):
    assert snapshot.suggested_prune_seq(10, 20) == 0


def test_bulk_commit_has_a_record_for_each_cell(spark, store):
    """600 cells in one commit: dense sequences, a sync in batches of 256 that loses none, the last put of a cell in force."""
    with store.update() as tx:
        tx.put_cell(0, 0, "before")
        tx.put_cells(spark.range(600).selectExpr("cast(id % 30 as int) q", "cast(id div 30 as int) r", "concat('n', id) raw_content"))
        tx.put_cell(1, 0, "after")
    feed = store.changelog()
    assert [x.seq for x in feed.orderBy("seq").collect()] == list(range(1, 603))
    assert [x.raw_content for x in store.view().filter("r = 0 and q < 2").orderBy("q").collect()] == ["n0", "after"]
    assert store.view().count() == 600 and store.meta["head"] == 1
    sync = SuperhexSync(spark, 1)
    assert [sync.sync(feed, 256) for _ in range(4)] == [256, 256, 90, 0] and sync.state.count() == 600
    assert sync.summary_for((0, 0)).first().occupied >= 1
    after, row = 0, []
    while got := read_since(feed, after, 250).collect():
        row += got
        after = got[-1].seq
    assert len(row) == 602
    with store.update() as tx:
        tx.put_cells(spark.createDataFrame([(0, 0, "x" * 5000)], "q int, r int, raw_content string"))
    last = store.changelog().orderBy(F.col("seq").desc()).first()
    assert (last.seq, last.payload, last.encoded_len, last.hash) == (603, None, 5000, hashlib.sha256(b"x" * 5000).hexdigest())


def test_bulk_writes_meet_validators_and_hooks(spark, store):
    told = []
    strict = Store(spark, store.path, validator=lambda row: "no" if "bad" in row["raw_content"] else None, after_put_cell=lambda row: told.append(row["raw_content"]))
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(["a", "bad", "c"])], "q int, r int, raw_content string")
    with pytest.raises(E.RejectedCell), strict.update() as tx:
        tx.put_cells(rows)
    with pytest.raises(E.RejectedCell), strict.update() as tx:
        tx.put_cells(rows.withColumn("confidence", F.lit(float("nan"))).filter("q = 0"))
    assert strict.meta["head"] == 0 and told == []
    with strict.update() as tx:
        tx.put_cells(rows.filter("q <> 1"))
    assert sorted(told) == ["a", "c"] and strict.view().count() == 2


def test_import_in_commits_of_128(spark, store, tmp_path):
    cells = spark.range(300).selectExpr("cast(id as int) q", "0 r", "concat('n', id) raw_content")
    assert store.import_cells(cells, ("q",)) == 300 and store.meta["head"] == 3
    assert [(x.commit_seq, x["count"]) for x in store.versions("cells").groupBy("commit_seq").count().orderBy("commit_seq").collect()] == [(1, 128), (2, 128), (3, 44)]
    assert store.snapshot("cells", 1).agg(F.max("q")).first()[0] == 127 and store.snapshot("cells", 2).count() == 256
    assert [(x.seq, x.q) for x in read_since(store.changelog(), 127, 2).collect()] == [(128, 127), (129, 128)]
    assert store.import_cells(cells.limit(0)) == 0 and store.meta["head"] == 3
    with store.update() as tx:
        tx.put_cell(0, 0, "new")
    assert store.prune_by_profile(0) == 0 and store.prune_by_profile(1) == 0 and store.prune_by_profile(0 or 4) == 0
    assert store.prune(4, 10) == 1
    other = store.copy_to(f"file://{tmp_path}/copy")
    assert other.view().count() == 300 and other.storage()["cells"] > 0 and other.meta["records"] == 301
    with store.read() as tx:
        assert not tx.writable and tx.read_sequence == 4 and tx.get_cell(0, 0)["raw_content"] == "new" and tx.get_seam("x") is None


def test_vectors_of_a_store(spark, store):
    assert store.get_embedding(0, 0) is None and store.metric() == "cosine"
    with store.update() as tx:
        for i in range(40):
            tx.put_embedding(i, 0, [float(i), 1.0])
        assert tx.get_embedding(3, 0) == [3.0, 1.0]
        with pytest.raises(E.DimensionMismatch):
            tx.put_embedding(0, 1, [1.0])
    assert store.get_embedding(3, 0) == [3.0, 1.0] and store.get_embedding(99, 0) is None and store.dimension() == 2
    found, how = store.search_by_embedding([1.0, 0.0], 3)
    assert how["path"] == "flat" and [x.q for x in found.collect()] == [39, 38, 37]
    with pytest.raises(E.InvalidArgument):
        store.rebuild_embedding_index(10)
    store.rebuild_embedding_index()
    found, how = store.search_by_embedding([1.0, 0.0], 3)
    assert how["path"] == "index" and [x.q for x in found.collect()] == [39, 38, 37]
    with store.update() as tx:
        tx.delete_embedding(39, 0)
        tx.put_embedding(50, 0, [50.0, 1.0], deferred=True)
    assert store.index_state() == {"revision": 2, "indexed": 1, "dirty": True}
    found, how = store.search_by_embedding([1.0, 0.0], 2)
    assert how["path"] == "flat" and [x.q for x in found.collect()] == [50, 38]
    store.rebuild_embedding_index()
    assert store.index_state() == {"revision": 2, "indexed": 2, "dirty": False}


def test_listings(store):
    from honeyframe.operators import facets, listing

    with store.update() as tx:
        tx.put_cell(0, 0, "first note", tags=("a",), source_id="s")
        tx.put_cell(1, 0, "second note", tags=("b",), confidence=0.126)
        tx.link_cells((0, 0), (1, 0), "next")
        tx.put(b"app/\x01", b"v")
    names = [x.name for x in listing.identities(store).collect()]
    assert names == ["app/.", "cell/0/0", "cell/1/0", "edge/0/0/1/0/next"]
    assert [x.name for x in listing.identities(store, "cell/1").collect()] == ["cell/1/0"] and listing.identities(store, most=2).count() == 2
    assert [(x.q, x.confidence) for x in listing.cells(store, tag="b").collect()] == [(1, 0.13)]
    assert listing.cells(store, "note", most=0).count() == 2 and listing.cells(store, source="s").first().content == "first note"
    made = facets.derived(store.view(), 2, F.upper("raw_content"), 5)
    assert facets.stale_facets(made, store.view()).isEmpty() and {x.derived_content for x in made.collect()} == {"FIRST NOTE", "SECOND NOTE"}
    with pytest.raises(E.InvalidArgument):
        facets.derived(store.view(), 6, F.lit(""), 0)


def test_a_failed_batch_is_applied_again(spark, store, tmp_path):
    """Records are published with their commit, and a consumer that fails meets them again; what it has applied twice counts once."""
    def commit(q):
        with store.update() as tx:
            tx.put_cell(q, 0, str(q))
            if q == 2:
                tx.delete_cell(0, 0)

    sync, fails = SuperhexSync(spark, 1), [True]
    apply = sync.apply

    def flaky(records, batch_id=None):
        apply(records, batch_id)
        if fails:
            fails.pop()
            raise RuntimeError("after the work, before it is known")

    sync.apply = flaky
    for q in range(3):
        commit(q)
    with pytest.raises(Exception):  # noqa: B017
        sync.start(stream(spark, store.path), f"{tmp_path}/checkpoint").awaitTermination()
    sync.last_seq = 0  # the next process knows nothing of it
    sync.start(stream(spark, store.path), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(x.q for x in sync.state.collect()) == [1, 2]
    commit(3)
    sync.start(stream(spark, store.path), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(x.q for x in sync.state.collect()) == [1, 2, 3] and sync.last_seq == 5


def test_pruning_writes_only_what_goes(store, tmp_path):
    """Passes name the versions they delete and rewrite no others; a fork prunes without touching the store; compaction drops the rows."""
    cells = store.spark.range(300).selectExpr("cast(id as int) q", "0 r", "concat('n', id) raw_content")
    for _ in range(3):
        with store.update() as tx:
            tx.put_cells(cells)
    before, folders = store.versions("cells").count(), store.meta["families"]["cells"]
    other = store.fork(f"file://{tmp_path}/fork")
    assert other.storage() == store.storage()
    assert [other.prune(3, 100), other.prune(3, 100), other.prune(3, None), other.prune(3, None)] == [100, 100, 400, 0]
    left = other.versions("cells").select("commit_seq", "raw_content").collect()
    assert before == 900 and len(left) == 300 and {x.commit_seq for x in left} == {3}
    assert other.storage()["cells"] == store.storage()["cells"] and not (tmp_path / "fork" / "cells").exists()
    assert other.oldest_snapshot_seq() == 3 and other.view().count() == 300 and other.diff(0, 3).count() == 300
    with other.update() as tx:
        tx.put_cell(0, 0, "later")
    again = other.fork(f"file://{tmp_path}/again")
    assert again.prune(4, 10) == 1 and other.versions("cells").count() == 301
    other.compact()
    assert other.versions("cells").count() == 301 and other.snapshot("cells", 3).filter("q = 0").first().raw_content == "n0"
    assert again.versions("cells").count() == 300 and again.copy_to(f"file://{tmp_path}/copy").versions("cells").count() == 300
    assert store.versions("cells").count() == 900 and store.meta["families"]["cells"] == folders and store.snapshot("cells", 1).count() == 300
