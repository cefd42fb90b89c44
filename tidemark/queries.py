"""One query per operator of the engine, over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.bounds import excluded, included, passes_filters
from tidemark.operators import conflicts, versions
from tidemark.operators.versions import Versions
from tidemark.sources import log, runs
from tidemark.sources.scratch import shared_path
from tidemark.streaming.ingest import ingest
from tidemark.table import Options, Table

Query = Callable[[SparkSession, str], DataFrame]

LOG = Versions(keys=("k",))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: the user is the key, the event its version, an error a delete."""
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), F.col("event_id").alias("ts"), (F.col("event_type") == "error").alias("is_tombstone"), "value"
    )


def _scan(lower=None, upper=None, read_ts: int | None = None) -> Query:
    ends = {n: b for n, b in (("lower", lower), ("upper", upper)) if b is not None}
    return lambda spark, d: versions.scan(change_log(spark, d), LOG, read_ts=read_ts, **ends).select("k", "ts", "value")


def point_get(spark, d):
    return versions.point_get(change_log(spark, d), LOG, 17).select("k", "ts", "value")


def point_asof_deleted(spark, d):
    return versions.point_get(change_log(spark, d), LOG, 17, read_ts=2500).select("k", "ts", "value")


def history(spark, d):
    return versions.history(change_log(spark, d), LOG, 17)


def _top_orders(spark, d, status: str) -> DataFrame:
    orders = _read(spark, d, "orders").where(F.col("o_orderstatus") == status)
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"))


def merge_k(spark, d):
    return versions.merge([_top_orders(spark, d, s) for s in "FOP"], ["k"])


def merge_two(spark, d):
    return versions.overlay(_top_orders(spark, d, "O"), _top_orders(spark, d, "F"), ["k"])


def live_count(spark, d):
    return versions.as_of(change_log(spark, d), LOG).agg(F.count(F.lit(1)).alias("n"))


def changes_between(spark, d):
    return versions.changes(change_log(spark, d), LOG, 2500, 5000)


def txn_overlay(spark, d):
    rows = change_log(spark, d)
    writes = versions.newest(rows.where(F.col("ts") > 9900), LOG)
    return versions.apply_writes(versions.as_of(rows, LOG, 5000), writes, LOG).select("k", "ts", "value")


def snapshot_diff(spark, d):
    rows = change_log(spark, d)
    return versions.diff(versions.as_of(rows, LOG, 2500), versions.as_of(rows, LOG, 5000), ["k"], "value")


def gc_keep(spark, d):
    return versions.gc_keep(change_log(spark, d), LOG, 5000)


def gc_keep_bottom(spark, d):
    return versions.gc_keep(change_log(spark, d), LOG, 5000, bottom=True)


def gc_obsolete_count(spark, d):
    return versions.gc_obsolete(change_log(spark, d), LOG, 5000)


def _run(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def run_stats(spark, d):
    return runs.run_stats(change_log(spark, d), _run("ts", 1000), "k", "ts")


def run_overlap(spark, d):
    return runs.overlap_pairs(runs.run_stats(_read(spark, d, "orders"), _run("o_orderkey", 500), "o_custkey", "o_orderkey"))


def bloom_runs(spark, d):
    """Runs of 50 events, and which of all users' keys their Bloom filters let through."""
    rows = change_log(spark, d)
    filters = runs.bloom(rows, _run("ts", 50), "k")
    return runs.may_hold(filters, rows, "k")


def prune_runs(spark, d):
    stats = runs.run_stats(_read(spark, d, "orders"), _run("o_orderkey", 500), "o_orderkey", "o_custkey")
    return runs.prune_stats(stats, 1200, 3400).select("run_id", "min_key", "max_key")


def prefix_filter(spark, d):
    return _read(spark, d, "customer").where(passes_filters("c_name", ["Customer#0000000"])).select("c_custkey", "c_name")


def low_water(spark, d):
    """Every user reads since their latest view; the oldest of these."""
    active = _read(spark, d, "events").where(F.col("event_type") == "view").groupBy("user_id").agg(F.max("event_id").alias("read_ts"))
    return conflicts.low_water(active)


def _transactions(spark, d) -> DataFrame:
    return _read(spark, d, "events").withColumn("txn", _run("event_id", 100))


def _written(spark, d) -> DataFrame:
    rows = _transactions(spark, d)
    times = rows.groupBy("txn").agg(F.min("event_id").alias("read_ts"), F.max("event_id").alias("commit_ts"))
    return rows.where(F.col("event_type") == "purchase").select("txn", F.col("user_id").alias("k")).distinct().join(times, "txn")


def ww_conflict(spark, d):
    found = conflicts.write_write(_written(spark, d), ["k"], slack=150, width=128)
    return found.groupBy("txn", "winner").agg(F.count(F.lit(1)).alias("n_keys"))


def ww_losers(spark, d):
    """The same transactions, had each read 150 events earlier."""
    early = _written(spark, d).withColumn("read_ts", F.col("read_ts") - 150)
    return conflicts.losers(early, ["k"]).groupBy("txn").agg(F.count(F.lit(1)).alias("n_keys"))


def rw_conflict(spark, d):
    rows = _transactions(spark, d).withColumn("k", F.col("user_id"))
    reads, writes = rows.where(F.col("event_type") == "view"), rows.where(F.col("event_type") == "purchase")
    found = conflicts.read_write(reads, writes, ["k"], F.col("writer") == F.col("txn") - 1)
    return found.groupBy("txn", "writer").agg(F.count(F.lit(1)).alias("n_keys"))


def log_replay_prefix(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", "value")
    good = log.valid_prefix(rows, "user_id", "event_id", F.coalesce(F.col("value") <= 300, F.lit(True)))
    return good.groupBy("user_id").agg(F.max("event_id").alias("last_good"), F.count(F.lit(1)).alias("n"))


def asof_lookup(spark, d):
    probe = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 60).alias("t"))
    return versions.as_of_lookup(probe, change_log(spark, d), LOG, "t", width=2000).select("k", "t", "ts", "value")


def composite_key(spark, d):
    v = Versions(keys=("l_orderkey", "l_linenumber"), ts="l_shipdate", ties=("l_partkey", "l_suppkey", "l_extendedprice"))
    found = versions.newest(_read(spark, d, "lineitem"), v)
    return found.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "l_partkey", "l_suppkey", "l_extendedprice")


def first_last(spark, d):
    return versions.first_last(versions.as_of(change_log(spark, d), LOG), ["k"])


def first_last_composite(spark, d):
    found = versions.first_last(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return found.select(*(F.col(f"{e}_key.{c}").alias(f"{e}_{c}") for e in ("min", "max") for c in ("l_orderkey", "l_linenumber")), "n")


def _stored_log(spark, d, **options) -> Table:
    """The change log written into a table in four commits, each event at its own timestamp."""
    table = Table.create(spark, shared_path(spark, "table"), "k long", "value double", Options(**options))
    rows = change_log(spark, d)
    for part in range(4):
        mine = rows.where(F.floor(F.col("ts") / 2500) % 4 == part)
        table.write(mine, tombstone=F.col("is_tombstone"), ts=F.col("ts"), unique=True)
    return table


def table_asof(spark, d):
    return _stored_log(spark, d).scan(read_ts=5000)


def table_compacted(spark, d):
    """Compaction by plan, with all versions above 5000 kept: the scan as of 6000 stays what it was."""
    newest = int(change_log(spark, d).agg(F.max("ts")).collect()[0][0] or 0)
    table = _stored_log(spark, d, strategy="simple", strategy_options={"level0_runs": 2}, retain_versions=max(0, newest - 5000))
    table.compact()
    return table.scan(included(30), excluded(120), read_ts=6000)


def table_transaction(spark, d):
    """A committed transaction: deletes, overwrites and a new key over the stored log."""
    table = _stored_log(spark, d)
    with table.begin("serializable") as txn:
        for k in range(10, 20):
            txn.delete(k)
        for k in range(20, 30):
            txn.put(k, float(k))
        txn.put(-1, 0.5)
    return table.scan(upper=40)


def table_history(spark, d):
    return _stored_log(spark, d).history(17)


def _newest(spark, d) -> int:
    return int(change_log(spark, d).agg(F.max("ts")).collect()[0][0] or 0)


def _versions(table: Table) -> DataFrame:
    """All that a table holds, in the change log's columns."""
    return table.versions_df().select("k", F.col("_ts").alias("ts"), F.col("_tombstone").alias("is_tombstone"), "value")


def table_stream(spark, d):
    """The log as a stream, a user's latest event being their row: one run for each micro-batch."""
    table = Table.create(spark, shared_path(spark, "table"), "user_id long", "event_id long, event_type string")
    events = _read(spark, d, "events")
    stream = spark.readStream.schema(events.schema)
    if events.inputFiles()[0].endswith("/events.parquet"):  # one file: a stream reads folders
        source = stream.option("pathGlobFilter", "events.parquet").parquet(d)
    else:
        source = stream.parquet(f"{d}/events.parquet")
    gone = F.col("event_type") == "error"
    query = ingest(source, table, f"events-{table.path[-8:]}", shared_path(spark, "stream"), tombstone=gone, order_by=F.col("event_id"), availableNow=True)
    query.awaitTermination()
    return table.scan()


def table_buffered(spark, d):
    """Buffered writes over the stored log, seen before any flush."""
    table = _stored_log(spark, d)
    for k in range(10, 20):
        table.put(k, float(k))
    for k in range(20, 30):
        table.delete(k)
    return table.scan()


def table_reopened(spark, d):
    """The same writes: flushed, closed, and read by another handle of the table."""
    table = _stored_log(spark, d)
    for k in range(10, 20):
        table.put(k, float(k))
    table.sync()
    for k in range(20, 30):
        table.delete(k)
    table.close()
    return Table.open(spark, table.path).scan()


def table_get(spark, d):
    """Point reads through the table: stored, deleted, missing, buffered, and as of 5000."""
    table = _stored_log(spark, d)
    table.put(-5, 0.25)
    found = [("now", k, table.get(k)) for k in (*range(0, 12), -5, -6)] + [("5000", k, table.get(k, read_ts=5000)) for k in range(0, 12)]
    return spark.createDataFrame([(at, k, r["value"]) for at, k, r in found if r is not None], "at string, k long, value double")


def table_aborted(spark, d):
    table = _stored_log(spark, d)
    txn = table.begin("serializable")
    txn.put(-1, 1.0)
    txn.delete(17)
    txn.abort()
    return table.scan()


def table_snapshot(spark, d):
    """What a transaction sees after others have committed: its snapshot, and its own writes."""
    table = _stored_log(spark, d)
    txn = table.begin("snapshot")
    txn.put(-1, 1.0)
    table.write(table.scan(ordered=False).select("k", F.lit(0.0).alias("value")), unique=True)
    seen = txn.scan()
    txn.abort()
    return seen


def table_first_committer(spark, d):
    """Transactions on one key or another, and from an older timestamp: who may commit."""
    table = _stored_log(spark, d)

    def outcome(name: str, key: int, other: int, read_ts: int | None = None, isolation: str = "serializable") -> tuple[str, bool]:
        if read_ts is None:
            txn = table.begin(isolation)
        table.put(other, 1.0)
        table.flush()
        if read_ts is not None:
            txn = table.begin(isolation, read_ts=read_ts)
        txn.put(key, 2.0)
        return name, txn.commit()

    newest = table.latest_ts
    rows = [outcome("same key", 1, 1), outcome("another key", 1, 2), outcome("last one wins", 1, 1, isolation="snapshot")]
    rows += [outcome("older read, same key", 3, 3, newest), outcome("older read, another key", 4, 5, newest)]
    return spark.createDataFrame(rows, "name string, committed boolean")


def table_compact_bottom(spark, d):
    """What a full compaction leaves when nobody reads: the newest live version of every key, and nothing else."""
    table = _stored_log(spark, d)
    table.compact(full=True)
    return _versions(table)


def table_garbage_collected(spark, d):
    """The versions left when all since 5000 are retained."""
    table = _stored_log(spark, d, retain_versions=max(0, _newest(spark, d) - 5000))
    table.garbage_collect()
    return _versions(table)


def table_obsolete(spark, d):
    return _stored_log(spark, d, retain_versions=max(0, _newest(spark, d) - 5000)).obsolete()


def _compacted_by(strategy: str, **options) -> Query:
    def query(spark, d):
        table = _stored_log(spark, d, strategy=strategy, strategy_options=options, retain_versions=1 << 40, auto_compact=True)
        return table.scan(included(30), excluded(120), read_ts=6000)

    return query


def table_filtered(spark, d):
    """A prefix filter: kept with the table, at work in the compaction that the filter's other handle runs, old versions included."""
    table = Table.create(spark, shared_path(spark, "table"), "name string", "custkey long", Options(strategy="simple", strategy_options={"level0_runs": 2}))
    rows = _read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("custkey"))
    table.write(rows, unique=True)
    table.compact(full=True)
    for part in range(3):
        table.write(rows.withColumn("custkey", F.col("custkey") + 1 + part), unique=True)
    table.add_filter("Customer#00000001")
    other = Table.open(spark, table.path)
    other.compact()
    return other.scan()


def table_vacuumed(spark, d):
    table = _stored_log(spark, d)
    table.compact(full=True)
    table.vacuum()
    return Table.open(spark, table.path).scan()


def table_version(spark, d):
    """Time travel by version of the table: what its first two commits hold."""
    table = _stored_log(spark, d)
    return table.scan(state=table.state(version=1))


def table_changes(spark, d):
    return _stored_log(spark, d).changes(2500, 5000)


def table_diff(spark, d):
    return _stored_log(spark, d).diff(2500, 5000, "value")


def table_lookup(spark, d):
    probe = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 60).alias("t"))
    return _stored_log(spark, d).lookup(probe, "t")


def table_first_last(spark, d):
    return spark.createDataFrame([tuple(_stored_log(spark, d).first_last(read_ts=5000))], "min_key long, max_key long, n long")


def _log_records(spark, d) -> DataFrame:
    """The change log as a log of writes, 1000 to a segment."""
    rows = change_log(spark, d)
    op = F.when(F.col("is_tombstone"), "delete").otherwise("put")
    return rows.select(log.segment_of(F.col("ts"), 1000).alias("segment"), F.col("ts").alias("offset"), op.alias("op"), F.col("k").alias("key"), "ts", "value")


def _stored_records(spark, d) -> str:
    path = shared_path(spark, "log")
    log.append(_log_records(spark, d), path)
    return path


def _damaged(rows: DataFrame) -> DataFrame:
    """Ten records of every third segment no longer fit their checksums."""
    bad = (F.col("segment") % 3 == 1) & (F.col("offset") % 1000).between(700, 709)
    return rows.withColumn("crc", F.when(bad, F.col("crc") + 1).otherwise(F.col("crc")))


def log_replay(spark, d):
    """Stored, damaged in places, and replayed: of every segment what lies before the damage."""
    return log.replay(_damaged(log.read(spark, _stored_records(spark, d))))


def log_replay_versions(spark, d):
    """The same with the other checksum."""
    path = shared_path(spark, "log")
    log.append(_log_records(spark, d), path, "crc32c")
    return log.replay_versions(_damaged(log.read(spark, path)), "crc32c")


def log_segments(spark, d):
    """The records left when all but the newest three segments have been deleted."""
    path = _stored_records(spark, d)
    log.remove_segments(spark, path, 3)
    return log.read(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


QUERIES: dict[str, Query] = {
    "point_get": point_get,
    "scan_incl_excl": _scan(included(30), excluded(70)),
    "scan_excl_incl": _scan(excluded(30), included(70)),
    "scan_unbounded": _scan(),
    "point_asof_deleted": point_asof_deleted,
    "scan_asof": _scan(read_ts=5000),
    "history": history,
    "merge_k": merge_k,
    "merge_two": merge_two,
    "live_count": live_count,
    "changes_between": changes_between,
    "txn_overlay": txn_overlay,
    "snapshot_diff": snapshot_diff,
    "gc_keep": gc_keep,
    "gc_keep_bottom": gc_keep_bottom,
    "gc_obsolete_count": gc_obsolete_count,
    "run_stats": run_stats,
    "run_overlap": run_overlap,
    "prune_runs": prune_runs,
    "bloom_runs": bloom_runs,
    "prefix_filter": prefix_filter,
    "low_water": low_water,
    "ww_conflict": ww_conflict,
    "ww_losers": ww_losers,
    "rw_conflict": rw_conflict,
    "log_replay_prefix": log_replay_prefix,
    "asof_lookup": asof_lookup,
    "composite_key": composite_key,
    "first_last": first_last,
    "first_last_composite": first_last_composite,
    "table_asof": table_asof,
    "table_compacted": table_compacted,
    "table_transaction": table_transaction,
    "table_history": table_history,
    "table_stream": table_stream,
    "table_buffered": table_buffered,
    "table_reopened": table_reopened,
    "table_get": table_get,
    "table_aborted": table_aborted,
    "table_snapshot": table_snapshot,
    "table_first_committer": table_first_committer,
    "table_compact_bottom": table_compact_bottom,
    "table_garbage_collected": table_garbage_collected,
    "table_obsolete": table_obsolete,
    "table_leveled": _compacted_by("leveled", level0_runs=2),
    "table_tiered": _compacted_by("tiered", num_tiers=2),
    "table_uncompacted": _compacted_by("none"),
    "table_filtered": table_filtered,
    "table_vacuumed": table_vacuumed,
    "table_version": table_version,
    "table_changes": table_changes,
    "table_diff": table_diff,
    "table_lookup": table_lookup,
    "table_first_last": table_first_last,
    "log_replay": log_replay,
    "log_replay_versions": log_replay_versions,
    "log_segments": log_segments,
}


def _sql_newest(where: str = "TRUE") -> str:
    return f"""SELECT * EXCLUDE (n) FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS n FROM log WHERE {where}) WHERE n = 1"""


def _sql_live(where: str = "TRUE", columns: str = "k, ts, value") -> str:
    return f"SELECT {columns} FROM ({_sql_newest(where)}) WHERE NOT is_tombstone"


_LOG = "WITH log AS (SELECT user_id AS k, event_id AS ts, event_type = 'error' AS is_tombstone, value FROM events) "
_TOP = "SELECT o_custkey AS k, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = '{}' GROUP BY ALL"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY k, ts <= 5000 ORDER BY ts DESC) AS n FROM log"
_BUFFERED = f"SELECT * FROM ({_sql_live(columns='k, value')}) WHERE k < 10 OR k >= 30 UNION ALL SELECT k, k::DOUBLE FROM range(10, 20) AS r(k)"
_INTACT = "NOT (ts // 1000 % 3 = 1 AND ts % 1000 >= 700)"

SQL: dict[str, str] = {
    "point_get": _LOG + _sql_live("k = 17"),
    "scan_incl_excl": _LOG + _sql_live("k >= 30 AND k < 70"),
    "scan_excl_incl": _LOG + _sql_live("k > 30 AND k <= 70"),
    "scan_unbounded": _LOG + _sql_live(),
    "point_asof_deleted": _LOG + _sql_live("k = 17 AND ts <= 2500"),
    "scan_asof": _LOG + _sql_live("ts <= 5000"),
    "history": _LOG + "SELECT * FROM log WHERE k = 17",
    "merge_k": f"""SELECT k, price, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source) AS n FROM (
        SELECT *, 0::INT AS source FROM ({_TOP.format("F")}) UNION ALL SELECT *, 1::INT FROM ({_TOP.format("O")})
        UNION ALL SELECT *, 2::INT FROM ({_TOP.format("P")}))) WHERE n = 1""",
    "merge_two": f"""WITH f AS ({_TOP.format("F")}), o AS ({_TOP.format("O")})
        SELECT * FROM f UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM f)""",
    "live_count": _LOG + _sql_live(columns="count(*) AS n"),
    "changes_between": _LOG + "SELECT k, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n FROM log WHERE ts > 2500 AND ts <= 5000 GROUP BY k",
    "txn_overlay": _LOG + f""", base AS ({_sql_live("ts <= 5000")}), writes AS ({_sql_newest("ts > 9900")})
        SELECT k, ts, value FROM writes WHERE NOT is_tombstone
        UNION ALL SELECT * FROM base WHERE k NOT IN (SELECT k FROM writes)""",
    "snapshot_diff": _LOG + f""", a AS ({_sql_live("ts <= 2500")}), b AS ({_sql_live("ts <= 5000")})
        SELECT coalesce(a.k, b.k) AS k, a.value AS old_value, b.value AS new_value,
          CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind
        FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.value IS DISTINCT FROM b.value""",
    "gc_keep": _LOG + f"SELECT * EXCLUDE (n) FROM ({_RANKED}) WHERE ts > 5000 OR n = 1",
    "gc_keep_bottom": _LOG + f"SELECT * EXCLUDE (n) FROM ({_RANKED}) WHERE ts > 5000 OR (n = 1 AND NOT is_tombstone)",
    "gc_obsolete_count": _LOG + "SELECT k, count(*) - 1 AS n_obsolete FROM log WHERE ts <= 5000 GROUP BY k HAVING count(*) > 1",
    "run_stats": _LOG + """SELECT (ts // 1000)::BIGINT AS run_id, count(*) AS n_rows, min(k) AS min_key, max(k) AS max_key,
        min(ts) AS min_ts, max(ts) AS max_ts FROM log GROUP BY 1""",
    "run_overlap": """WITH r AS (SELECT (o_orderkey // 500)::BIGINT AS id, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1)
        SELECT x.id AS a, y.id AS b FROM r x, r y WHERE x.id < y.id AND x.lo <= y.hi AND y.lo <= x.hi""",
    "bloom_runs": _LOG + """, h AS (SELECT k, ts, md5(k::VARCHAR) AS m FROM log),
        b AS (SELECT k, ts, unnest([('0x' || substr(m, 1, 8))::BIGINT % 1024, ('0x' || substr(m, 9, 8))::BIGINT % 1024]) AS bit FROM h),
        f AS (SELECT DISTINCT (ts // 50)::BIGINT AS run_id, bit FROM b), asked AS (SELECT DISTINCT k, bit FROM b),
        needed AS (SELECT k, count(*) AS n FROM asked GROUP BY k)
        SELECT run_id, k FROM asked JOIN f USING (bit) JOIN needed USING (k) GROUP BY run_id, k, n HAVING count(*) = n""",
    "prune_runs": """SELECT (o_orderkey // 500)::BIGINT AS run_id, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
        FROM orders GROUP BY 1 HAVING max(o_orderkey) >= 1200 AND min(o_orderkey) <= 3400""",
    "prefix_filter": "SELECT c_custkey, c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#0000000')",
    "low_water": "SELECT min(t) AS low_water FROM (SELECT max(event_id) AS t FROM events WHERE event_type = 'view' GROUP BY user_id)",
    "ww_losers": """WITH t AS (SELECT event_id // 100 AS txn, min(event_id) - 150 AS r, max(event_id) AS c FROM events GROUP BY 1),
        w AS (SELECT DISTINCT event_id // 100 AS txn, user_id AS k FROM events WHERE event_type = 'purchase')
        SELECT txn::BIGINT AS txn, count(*) AS n_keys FROM w JOIN t USING (txn)
        WHERE EXISTS (SELECT 1 FROM w x JOIN t y USING (txn) WHERE x.k = w.k AND y.c < t.c AND y.c > t.r) GROUP BY 1""",
    "ww_conflict": """WITH t AS (SELECT event_id // 100 AS txn, min(event_id) AS r, max(event_id) AS c FROM events GROUP BY 1),
        w AS (SELECT DISTINCT event_id // 100 AS txn, user_id AS k FROM events WHERE event_type = 'purchase')
        SELECT a.txn::BIGINT AS txn, b.txn::BIGINT AS winner, count(*) AS n_keys FROM w a JOIN w b ON a.k = b.k AND b.txn < a.txn
        JOIN t ta ON ta.txn = a.txn JOIN t tb ON tb.txn = b.txn WHERE tb.c > ta.r - 150 GROUP BY 1, 2""",
    "rw_conflict": """SELECT (a.event_id // 100)::BIGINT AS txn, (b.event_id // 100)::BIGINT AS writer, count(DISTINCT a.user_id) AS n_keys
        FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id // 100 = a.event_id // 100 - 1
        WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY 1, 2""",
    "log_replay_prefix": """WITH bad AS (SELECT user_id, min(event_id) FILTER (value > 300) AS b FROM events GROUP BY 1)
        SELECT user_id, max(event_id) AS last_good, count(*) AS n FROM events JOIN bad USING (user_id)
        WHERE b IS NULL OR event_id < b GROUP BY 1""",
    "asof_lookup": _LOG + """, p AS (SELECT c_custkey AS k, c_custkey * 60 AS t FROM customer)
        SELECT k, t, ts, value FROM (
          SELECT p.k, t, ts, value, is_tombstone, row_number() OVER (PARTITION BY p.k ORDER BY ts DESC) AS n
          FROM p JOIN log ON p.k = log.k AND ts <= t) WHERE n = 1 AND NOT is_tombstone""",
    "composite_key": """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_partkey, l_suppkey, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1""",
    "first_last": _LOG + _sql_live(columns="min(k) AS min_key, max(k) AS max_key, count(*) AS n"),
    "table_asof": _LOG + _sql_live("ts <= 5000", "k, value"),
    "table_compacted": _LOG + _sql_live("ts <= 6000 AND k >= 30 AND k < 120", "k, value"),
    "table_transaction": _LOG + f"""SELECT * FROM ({_sql_live("k < 40", "k, value")}) WHERE k < 10 OR k >= 30
        UNION ALL SELECT k, k::DOUBLE FROM range(20, 30) AS r(k) UNION ALL SELECT -1, 0.5""",
    "table_history": _LOG + "SELECT k, ts, is_tombstone, CASE WHEN NOT is_tombstone THEN value END AS value FROM log WHERE k = 17",
    "first_last_composite": """SELECT a.l_orderkey AS min_l_orderkey, a.l_linenumber AS min_l_linenumber, z.l_orderkey AS max_l_orderkey, z.l_linenumber AS max_l_linenumber,
        (SELECT count(*) FROM lineitem) AS n FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1) a, (SELECT * FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1) z""",
    "table_stream": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    "table_buffered": _LOG + _BUFFERED,
    "table_reopened": _LOG + _BUFFERED,
    "table_get": _LOG + f"""SELECT 'now' AS at, * FROM ({_sql_live("k BETWEEN 0 AND 11", "k, value")}) UNION ALL SELECT 'now', -5, 0.25
        UNION ALL SELECT '5000', * FROM ({_sql_live("k BETWEEN 0 AND 11 AND ts <= 5000", "k, value")})""",
    "table_aborted": _LOG + _sql_live(columns="k, value"),
    "table_snapshot": _LOG + f"SELECT * FROM ({_sql_live(columns='k, value')}) UNION ALL SELECT -1, 1.0",
    "table_first_committer": """SELECT * FROM (VALUES ('same key', FALSE), ('another key', TRUE), ('last one wins', TRUE),
        ('older read, same key', FALSE), ('older read, another key', TRUE)) AS t(name, committed)""",
    "table_compact_bottom": _LOG + _sql_live(columns="k, ts, is_tombstone, value"),
    "table_garbage_collected": _LOG + f"SELECT k, ts, is_tombstone, CASE WHEN NOT is_tombstone THEN value END AS value FROM ({_RANKED}) WHERE ts > 5000 OR (n = 1 AND NOT is_tombstone)",
    "table_obsolete": _LOG + "SELECT k, count(*) - 1 AS n_obsolete FROM log WHERE ts <= 5000 GROUP BY k HAVING count(*) > 1",
    **dict.fromkeys(("table_leveled", "table_tiered", "table_uncompacted"), _LOG + _sql_live("ts <= 6000 AND k >= 30 AND k < 120", "k, value")),
    "table_filtered": "SELECT c_name AS name, c_custkey + 3 AS custkey FROM customer WHERE NOT starts_with(c_name, 'Customer#00000001')",
    "table_vacuumed": _LOG + _sql_live(columns="k, value"),
    "table_version": _LOG + _sql_live("ts // 2500 % 4 < 2", "k, value"),
    "table_changes": _LOG + "SELECT k, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n FROM log WHERE ts > 2500 AND ts <= 5000 GROUP BY k",
    "table_diff": _LOG + f"""SELECT k, a.value AS old_value, b.value AS new_value,
          CASE WHEN a.ts IS NULL THEN 'added' WHEN b.ts IS NULL THEN 'removed' ELSE 'changed' END AS kind
        FROM ({_sql_live("ts <= 2500")}) a FULL JOIN ({_sql_live("ts <= 5000")}) b USING (k) WHERE a.ts IS NULL OR b.ts IS NULL OR a.value IS DISTINCT FROM b.value""",
    "table_lookup": _LOG + """, p AS (SELECT c_custkey AS k, c_custkey * 60 AS t FROM customer)
        SELECT k, t, value FROM (SELECT p.k, t, value, is_tombstone, row_number() OVER (PARTITION BY p.k ORDER BY ts DESC) AS n
          FROM p JOIN log ON p.k = log.k AND ts <= t) WHERE n = 1 AND NOT is_tombstone""",
    "table_first_last": _LOG + _sql_live("ts <= 5000", "min(k) AS min_key, max(k) AS max_key, count(*) AS n"),
    "log_replay": _LOG + f"SELECT k AS key, ts, value FROM ({_sql_newest(_INTACT)}) WHERE NOT is_tombstone",
    "log_replay_versions": _LOG + f"SELECT k AS key, ts, is_tombstone, value FROM log WHERE {_INTACT}",
    "log_segments": """SELECT (event_id // 1000)::BIGINT AS segment, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events
        GROUP BY 1 QUALIFY row_number() OVER (ORDER BY segment DESC) <= 3""",
}
