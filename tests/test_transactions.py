import threading

import pytest

from tidemark.table import Conflict, Table


@pytest.fixture
def t(spark, tmp_path):
    return Table.create(spark, str(tmp_path / "t"), "k string", "v string")


def put(t, *rows):
    txn = t.begin()
    for k, v in rows:
        assert txn.put(k, v)
    assert txn.commit()


def test_reads_its_own_writes_and_stays_isolated(t):
    put(t, ("key", "value1"))
    reader, writer = t.begin(), t.begin()
    assert writer.put("key", "value2") and writer.get("key").v == "value2"
    assert reader.get("key").v == "value1"
    assert writer.commit()
    assert reader.get("key").v == "value1" and t.begin().get("key").v == "value2"
    reader.abort()


def test_uncommitted_and_aborted_writes_are_invisible(t):
    put(t, ("a", "1"))
    txn = t.begin()
    txn.put("a", "2")
    txn.put("b", "2")
    assert t.get("b") is None and t.get("a").v == "1"
    txn.abort()
    assert t.get("b") is None and t.get("a").v == "1"


def test_delete_shows_after_commit_only(t):
    put(t, ("a", "1"), ("b", "1"))
    txn = t.begin()
    txn.delete("a")
    assert txn.get("a") is None and t.get("a").v == "1"
    assert txn.commit() and t.get("a") is None
    later = t.begin()
    assert [r.k for r in later.scan().collect()] == ["b"]
    later.abort()


def test_scan_overlays_writes(t):
    put(t, *((f"key{i}", f"value{i}") for i in range(10)))
    txn = t.begin()
    assert [r.k for r in txn.scan("key3", "key7").collect()] == ["key3", "key4", "key5", "key6"]
    txn.delete("key4")
    txn.put("key5", "mine")
    txn.put("key55", "mine")
    txn.put("key9", "mine")
    assert [(r.k, r.v) for r in txn.scan("key3", "key7").collect()] == [("key3", "value3"), ("key5", "mine"), ("key55", "mine"), ("key6", "value6")]
    txn.abort()


def test_finished_transactions_refuse(t):
    txn = t.begin()
    txn.put("a", "1")
    assert txn.commit() and not txn.commit() and not txn.put("a", "2") and not txn.delete("a") and txn.get("a") is None
    with pytest.raises(RuntimeError):
        txn.scan()
    aborted = t.begin()
    aborted.abort()
    assert not aborted.put("a", "1") and not aborted.commit()


def test_all_writes_share_one_timestamp(t):
    put(t, *((f"k{i}", "x") for i in range(5)))
    assert {r.ts for i in range(5) for r in t.history(f"k{i}").collect()} == {1}


def test_first_committer_wins(t):
    put(t, ("key", "0"))
    a, b = t.begin("serializable"), t.begin("serializable")
    assert a.get("key").v == "0"
    b.put("key", "b")
    assert b.commit()
    a.put("key", "a")
    assert not a.commit() and t.get("key").v == "b"


def test_disjoint_writers_both_commit_unless_reads_are_validated(t):
    put(t, ("key1", "0"), ("key2", "0"))

    def two(**options):
        a, b = t.begin("serializable", **options), t.begin("serializable", **options)
        for x in (a, b):
            x.get("key1"), x.get("key2")
        a.put("key1", "a")
        b.put("key2", "b")
        return a.commit(), b.commit()

    assert two() == (True, True)
    assert two(validate_reads=True) == (True, False)


def test_validated_ranges(t):
    put(t, ("a", "0"))
    x, y = t.begin("serializable", validate_reads=True), t.begin("serializable", validate_reads=True)
    assert x.scan("a", "c").count() == 1 and y.scan("x", "z").count() == 0
    put(t, ("b", "phantom"))
    x.put("q", "1")
    y.put("r", "1")
    assert not x.commit() and y.commit()


def test_snapshot_isolation_lets_the_last_committer_win(t):
    a, b = t.begin(), t.begin()
    assert a.get("key") is None
    b.put("key", "b")
    assert b.commit()
    a.put("key", "a")
    assert a.commit() and t.get("key").v == "a"


def test_overwrites_in_reverse_order(t):
    put(t, *((f"k{i}", "first") for i in range(10)))
    put(t, *((f"k{i}", f"updated_{i}") for i in reversed(range(10))))
    assert [r.v for r in t.scan().collect()] == [f"updated_{i}" for i in range(10)]


def test_readers_survive_collection(t):
    put(t, ("k", "initial"))
    reader = t.begin()
    put(t, ("k", "newer"))
    t.garbage_collect()
    assert reader.get("k").v == "initial" and t.begin().get("k").v == "newer"
    with pytest.raises(RuntimeError):
        t.vacuum()
    reader.abort()


def test_concurrent_conflicting_commits(t, spark):
    won = []

    def work(n):
        txn = Table.open(spark, t.path).begin("serializable")
        txn.put("hot", str(n))
        ready.wait()
        if txn.commit():
            won.append(n)

    ready = threading.Barrier(4)
    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(won) == 1 and t.get("hot").v == str(won[0])


def test_context_manager(t):
    with t.begin() as txn:
        txn.put("a", "1")
    assert t.get("a").v == "1"
    with pytest.raises(KeyError), t.begin() as txn:
        txn.put("a", "2")
        raise KeyError
    assert t.get("a").v == "1"
    first = t.begin("serializable")
    first.put("a", "x")
    with pytest.raises(Conflict), t.begin("serializable") as second:
        second.put("a", "y")
        first.commit()


def test_an_older_read_timestamp_sees_every_later_commit(t):
    put(t, ("k", "1"))
    put(t, ("k", "2"))
    txn = t.begin("serializable", read_ts=1)
    assert txn.get("k").v == "1" and txn.put("k", "mine")
    assert not txn.commit() and t.get("k").v == "2"
    other = t.begin("serializable", read_ts=1)
    other.put("j", "mine")
    assert other.commit()


def test_commits_at_explicit_timestamps_neither_show_nor_slip_past(t, spark):
    from pyspark.sql import functions as F

    put(t, ("a", "1"))
    put(t, ("b", "1"))
    txn = t.begin("serializable", validate_reads=True)
    assert txn.get("c") is None and txn.scan().count() == 2
    t.write(spark.createDataFrame([("c", "back")], "k string, v string"), ts=F.lit(1))
    assert txn.get("c") is None and txn.scan().count() == 2  # its snapshot
    txn.put("d", "1")
    assert not txn.commit()
    blind = t.begin("serializable")
    t.write(spark.createDataFrame([("e", "back")], "k string, v string"), ts=F.lit(1))
    blind.put("e", "mine")
    assert not blind.commit()
    t.compact(full=True)  # rewritten rows are no new commits
    after = t.begin("serializable")
    t.compact(full=True)
    after.put("a", "2")
    assert after.commit() and t.get("a").v == "2"
