import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions.bounds import UNBOUNDED, excluded, included
from tidemark.sources.manifest import Manifest
from tidemark.table import MAX_TS, Options, Table


@pytest.fixture
def make(spark, tmp_path):
    def make(name="t", keys="k string", values="v string", **options):
        return Table.create(spark, str(tmp_path / name), keys, values, Options(**options))

    return make


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_put_delete_get_scan_before_and_after_flush(make):
    t = make()
    for i in range(10):
        t.put(f"key{i}", f"value{i}")
    for i in range(5):
        t.delete(f"key{i}")
    for _ in range(2):
        assert all(t.get(f"key{i}") is None for i in range(5))
        assert all(t.get(f"key{i}").v == f"value{i}" for i in range(5, 10))
        assert pairs(t.scan("key3", "key7")) == [("key5", "value5"), ("key6", "value6")]
        t.flush()


def test_deletes_hide_older_runs(make):
    t = make()
    t.put("a", "1")
    t.put("b", "1")
    t.flush()
    t.delete("a")
    assert pairs(t.scan()) == [("b", "1")]
    t.flush()
    assert t.get("a") is None and pairs(t.scan()) == [("b", "1")]
    assert pairs(t.scan(read_ts=1)) == [("a", "1"), ("b", "1")]
    assert t.get("a", read_ts=1).v == "1"
    assert [(r.ts, r.is_tombstone) for r in t.history("a").collect()] == [(2, True), (1, False)]


def test_bulk_write_compaction_and_reopen(make, spark):
    t = make()
    t.write(spark.range(2000).select(F.format_string("key%04d", "id").alias("k"), F.concat(F.lit("value"), "id").alias("v")), unique=True)
    t.compact(full=True)
    u = Table.open(spark, t.path)
    assert all(u.get(f"key{i:04d}").v == f"value{i}" for i in range(0, 2000, 500))
    assert u.scan().count() == 2000
    u.write(spark.createDataFrame([("key0001",)], "k string"), tombstone=F.lit(True))
    assert u.get("key0001") is None and u.scan().count() == 1999
    u.compact(full=True)
    assert Table.open(spark, t.path).scan().count() == 1999


def test_keys_of_every_kind(make):
    t = make("binary", "k binary", "v binary")
    keys = [b"\x00", b"\x00\x01", b"a", b"a-key-longer-than-eight-bytes", b"a-key-longer-than-eight-byte", b"\xff", b"\xff\xff"]
    for k in keys:
        t.put(k, b"")
    t.flush()
    assert [bytes(r.k) for r in t.scan().collect()] == sorted(keys)
    assert bytes(t.get(b"a-key-longer-than-eight-bytes").v) == b""
    assert [bytes(r.k) for r in t.scan(excluded(b"a"), included(b"\xff")).collect()] == [b"a-key-longer-than-eight-byte", b"a-key-longer-than-eight-bytes", b"\xff"]
    assert pairs(t.scan(b"zz", b"zzz")) == []
    with pytest.raises(ValueError):
        t.put(b"", b"x")
    with pytest.raises(ValueError):
        t.put(None, b"x")
    c = make("composite", "a int, b string", "v int")
    for a in range(3):
        for b in "xyz":
            c.put(a, b, a)
    c.flush()
    assert [(r.a, r.b) for r in c.scan((1, "y"), (2, "y")).collect()] == [(1, "y"), (1, "z"), (2, "x")]
    assert c.get(2, "z").v == 2
    assert c.scan((1,), included((1,))).count() == 3


def test_runs_are_pruned(make):
    t = make("n", "k int", "v int")
    for lo in (0, 100, 200):
        for k in range(lo, lo + 10):
            t.put(k, k)
        t.flush()
    assert len(t.versions_df(105, 120).inputFiles()) == 1
    assert len(t.versions_df(included(209)).inputFiles()) == 1
    assert len(t.versions_df(excluded(209)).inputFiles()) == 0
    assert len(t.versions_df(read_ts=2).inputFiles()) == 2


def test_explicit_timestamps_and_ties(make, spark):
    t = make()
    t.write(spark.createDataFrame([("a", "x", 10), ("a", "y", 20)], "k string, v string, at long"), ts=F.col("at"))
    assert t.latest_ts == 20 and t.get("a", read_ts=15).v == "x"
    t.write(spark.createDataFrame([("a", "late", 10)], "k string, v string, at long"), ts=F.col("at"))
    assert t.get("a", read_ts=15).v == "late" and t.get("a").v == "y"
    t.put("b", "1")
    t.flush()
    assert t.latest_ts == 21
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([("a", "x", -1)], "k string, v string, at long"), ts=F.col("at"))
    assert MAX_TS == 2**63 - 1


def test_lookup_changes_and_diff(make, spark):
    t = make("n", "k int", "v int")
    for ts in range(1, 5):
        t.put(1, ts)
        t.put(ts + 10, ts)
        t.flush()
    probe = spark.createDataFrame([(1, 2), (1, 9), (13, 2), (14, 4)], "k int, at long")
    assert sorted(pairs(t.lookup(probe, "at"))) == [(1, 2, 2), (1, 9, 4), (14, 4, 4)]
    assert sorted(pairs(t.changes(1, 3)))[0] == (1, 2, 3, 2)
    assert sorted(r.k for r in t.diff(2, 3, "v").collect()) == [1, 13]
    assert t.cache(read_ts=2).count() == 3
    assert tuple(t.first_last()) == (1, 14, 5)
    t.close()


def test_filters_at_compaction(make):
    t = make()
    for k in ("tmp1", "tmp2", "keep"):
        t.put(k, k)
    t.flush()
    t.add_filter("tmp")
    assert t.scan().count() == 3
    t.compact(full=True)
    assert pairs(t.scan()) == [("keep", "keep")]


def test_garbage_collection_respects_readers(make):
    t = make()
    for i in range(1, 4):
        for k in "abcde":
            t.put(k, f"v{i}")
        t.flush()
    with t.reading(1) as ts:
        assert t.garbage_collect() == 0
        assert t.get("a", read_ts=ts).v == "v1"
    assert t.low_water() == 3
    assert sum(r.n_obsolete for r in t.obsolete().collect()) == 10
    assert t.garbage_collect() == 10
    assert pairs(t.scan()) == [(k, "v3") for k in "abcde"]
    with pytest.raises(ValueError):
        t.scan(read_ts=1)
    assert t.vacuum() > 0
    assert pairs(t.scan()) == [(k, "v3") for k in "abcde"]


def test_tombstones_stay_while_older_data_lies_outside(make):
    t = make("l", strategy_options={"level0_runs": 2})
    for k, v in (("a", "1"), ("b", "1")):
        t.put(k, v)
    t.flush()
    t.put("c", "1")
    t.flush()
    assert t.compact() is not None and t.state().levels == [1]
    t.delete("a")
    t.flush()
    t.put("z", "1")
    t.flush()
    t.compact()
    assert t.get("a") is None and [r.k for r in t.scan().collect()] == ["b", "c", "z"]
    assert not any(r.has_tombstones for r in t.state().runs)


@pytest.mark.parametrize("strategy", ["none", "leveled", "simple", "tiered"])
def test_strategies_keep_the_contents(make, strategy):
    small = {"leveled": {"level0_runs": 2}, "simple": {"level0_runs": 2}, "tiered": {"num_tiers": 3}}.get(strategy, {})
    t = make(strategy, strategy=strategy, strategy_options=small)
    want = {}
    for i in range(6):
        for k in range(i, i + 4):
            t.put(f"k{k}", f"{i}")
            want[f"k{k}"] = f"{i}"
        t.flush()
        t.compact()
        assert dict(pairs(t.scan())) == want
    assert (len(t.state().runs) < 6) == (strategy != "none")


def test_concurrent_writers_lose_no_commit(make, spark):
    t = make()

    def work(n):
        mine = Table.open(spark, t.path)
        for i in range(3):
            mine.put(f"key_{n}_{i}", f"value_{n}_{i}")
            mine.flush()

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert pairs(t.scan()) == sorted((f"key_{n}_{i}", f"value_{n}_{i}") for n in range(4) for i in range(3))
    assert t.state().version == 11 and t.latest_ts == 12


def test_manifest_checkpoint_and_time_travel_by_version(make):
    t = make("n", "k int", "v int")
    first = t.state()
    for i in range(3):
        t.put(i, i)
        t.flush()
    assert t.state(0).ts == 1 and first.runs == ()
    assert Manifest(t.store).latest().to_json() == t.state().to_json()
    with pytest.raises(FileExistsError):
        Table.create(t.spark, t.path, "k int", "v int")


def test_bad_definitions(spark, tmp_path):
    for keys, values in (("k double", "v int"), ("k int", "k int"), ("k int", "_ts int")):
        with pytest.raises(ValueError):
            Table.create(spark, str(tmp_path / "bad"), keys, values)


def test_random_operations_against_a_model(make, spark):
    rnd = random.Random(7)
    t = make("model", "k int", "v int", strategy_options={"level0_runs": 3}, retain_versions=4)
    model: dict[int, list[tuple[int, int | None]]] = {}

    def at(ts):
        found = {k: [v for s, v in h if s <= ts][-1:] for k, h in model.items()}
        return sorted((k, v[0]) for k, v in found.items() if v and v[0] is not None)

    for step in range(14):
        writes = {rnd.randrange(12): rnd.choice([None, rnd.randrange(100)]) for _ in range(5)}
        if rnd.random() < 0.5:
            for k, v in writes.items():
                t.delete(k) if v is None else t.put(k, v)
            t.flush()
            ok = True
        else:
            txn = t.begin(rnd.choice(["snapshot", "serializable"]))
            for k, v in writes.items():
                txn.delete(k) if v is None else txn.put(k, v)
            ok = txn.commit() if rnd.random() < 0.8 else bool(txn.abort())
        if ok:
            for k, v in writes.items():
                model.setdefault(k, []).append((t.latest_ts, v))
        action = rnd.random()
        if action < 0.3:
            t.compact()
        elif action < 0.4:
            t.garbage_collect()
        elif action < 0.5:
            t = Table.open(spark, t.path)
        for ts in {t.latest_ts, max(t.state().watermark, t.latest_ts - 2)}:
            assert pairs(t.scan(read_ts=ts)) == at(ts), step
        lo = rnd.randrange(12)
        assert pairs(t.scan(lo, UNBOUNDED)) == [r for r in at(t.latest_ts) if r[0] >= lo]


def files_of(t):
    return {f"runs/{d}/{f}" for d in t.store.names("runs") for f in t.store.names(f"runs/{d}") if f.endswith(".parquet")}


def test_vacuum_spares_writers_at_work(make, spark, monkeypatch):
    """Vacuum between a writer's files and its commit, from the same handle and from another driver's."""
    t = make()
    t.write(spark.createDataFrame([("a", "1")], "k string, v string"))
    t.compact(full=True)
    real, vacuumed = Manifest.publish, []

    def publish(self, commit, state):
        if commit.kind in {"append", "compact"}:
            vacuumed.append((t.vacuum(), Table.open(spark, t.path).vacuum()))
        return real(self, commit, state)

    monkeypatch.setattr(Manifest, "publish", publish)
    t.write(spark.createDataFrame([("b", "2")], "k string, v string"))
    t.compact(full=True)
    monkeypatch.undo()
    assert len(vacuumed) == 2 and pairs(t.scan()) == pairs(Table.open(spark, t.path).scan()) == [("a", "1"), ("b", "2")]
    assert t.vacuum() > 0 and files_of(t) == {r.path for r in t.state().runs}
    assert t.store.names("_writing") == []


def test_vacuum_takes_what_dead_writers_left_and_spares_young_files(make, spark):
    t = make()
    t.write(spark.createDataFrame([("a", "1")], "k string, v string"))
    with pytest.raises(RuntimeError, match="lost"), t._writing() as folder:
        t._write_runs(spark.createDataFrame([("z", 1, False, 9, 0, "9")], t._frame([]).schema), folder, 0, 9)
        t.store.put(f"_writing/{folder[5:]}-copy", "{}")
        assert t.vacuum() == 0
        raise RuntimeError("lost")
    assert t.vacuum(older_than=3600) == 0 and t.vacuum() > 0 and files_of(t) == {r.path for r in t.state().runs}


def test_vacuum_trims_the_log(make):
    t = make()
    for i in range(40):
        t.put(f"k{i}", "v")
        t.flush()
    before = len(t.store.names("_commits"))
    t.vacuum()
    assert len(t.store.names("_commits")) < before - 30
    u = Table.open(t.spark, t.path)
    assert u.scan().count() == 40 and u.state().version == 39
    u.put("x", "y")
    u.flush()
    assert t.scan().count() == 41


def test_filters_do_not_bring_old_versions_back(make, spark):
    """A filtered key's newest version leaves level 0 while an older one lies below."""
    t = make(strategy="simple", strategy_options={"level0_runs": 2, "ratio_percent": 1})
    old = spark.createDataFrame([("keep", "1"), *((f"tmp{i}", "old") for i in range(200))], "k string, v string")
    t.write(old)
    t.compact(full=True)
    for v in ("new", "newer"):
        t.write(spark.createDataFrame([("tmp1", v)], "k string, v string"))
    t.add_filter("tmp")
    u = Table.open(spark, t.path)
    assert u.filters == ("tmp",)
    with u.reading():
        u._compact()
        assert u.get("tmp1").v == "newer"  # somebody reads
    u.write(spark.createDataFrame([("x", "1")], "k string, v string"))
    u.write(spark.createDataFrame([("tmp1", "newest")], "k string, v string"))
    while u.compact() is not None:
        assert u.get("tmp1") is None or u.get("tmp1").v == "newest"
    u.compact(full=True)
    assert pairs(u.scan()) == [("keep", "1"), ("x", "1")] and u.versions_df().count() == 2


def test_equal_keys_of_one_batch(make, spark):
    t = make()
    rows = spark.range(1000).select(F.lit("k").alias("k"), F.concat(F.lit("v"), "id").alias("v"), "id", (F.col("id") == 999).alias("gone"))
    t.write(rows.where("id < 999").repartition(7), order_by=F.col("id"))
    assert pairs(t.scan()) == [("k", "v998")]
    t.write(rows.repartition(5), tombstone=F.col("gone"), order_by=[F.lit(0), F.col("id")])
    assert pairs(t.scan()) == []
    found = set()
    for n in (1, 3, 8):  # without an order: the same row however the batch is dealt
        t.write(rows.where("id < 999").repartition(n))
        found.add(tuple(pairs(t.scan())))
    assert len(found) == 1
    t.write(rows.where("id > 990"), ts=F.lit(50), tombstone=F.col("gone"), order_by=-F.col("id"))
    assert pairs(t.scan()) == [("k", "v991")]


def test_commits_compact_by_themselves(make):
    t = make(strategy_options={"level0_runs": 2}, auto_compact=True)
    for i in range(5):
        t.put("k", str(i))
        t.flush()
    assert len(t.state().level(0)) < 2 and t.get("k").v == "4"
    txn = t.begin()
    txn.put("j", "1")
    assert txn.commit() and Table.open(t.spark, t.path).options.auto_compact


def test_first_and_last_of_composite_keys(make):
    t = make(keys="a string, b int")
    for row in (("x", 2), ("x", 1), ("w", 9), ("w", 10)):
        t.put(*row, "v")
    assert [tuple(x) if isinstance(x, tuple) else x for x in t.first_last()] == [("w", 9), ("x", 2), 4]


def test_lookup_spreads_hot_keys_by_the_runs_statistics(make, spark, monkeypatch):
    from tidemark import table

    monkeypatch.setattr(table, "ROWS_PER_RANGE", 10)
    t = make()
    t.write(spark.range(1, 101).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"), "id"), ts=F.col("id"))
    probe = spark.range(0, 120, 7).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    assert sorted((r.at, r.v) for r in t.lookup(probe, "at").collect()) == [(i, str(min(i, 100))) for i in range(7, 120, 7)]
