"""Registered queries of the engine's core, and the same in DuckDB SQL.

The change-log is made from `events`: key = user_id/event_type, value = props, seq = event_id, and a change with
value < 5 is a deletion. Runs with many rows come from `orders`, keyed by o_orderkey as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import encoding
from tidelog.operators import lookup, resolve, segments
from tidelog.plans import leveling
from tidelog.schema import op_of

SEGMENT_EVENTS = 2500
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    return _table(spark, sf_dir, "events").select(key.alias("key"), F.col("props").alias("value"), op_of(F.col("value") < 5).alias("op"), F.col("event_id").alias("seq"))


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into runs by time, each resolved: (segment_id, key, value, op, seq)."""
    log = events_log(spark, sf_dir).withColumn("segment_id", F.floor(F.col("seq") / SEGMENT_EVENTS))
    payload = F.struct(F.when(F.col("op") == 0, F.col("value")).alias("value"), "op", "seq")
    return log.groupBy("segment_id", "key").agg(F.max_by(payload, "seq").alias("m")).select("segment_id", "key", "m.value", "m.op", "m.seq")


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select((F.col("o_orderkey") % 4).alias("segment_id"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"), F.lit(0).cast("byte").alias("op"))


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest made from all of events, four to a file: it is added and removed in turn. Of every second file the last
    event adds another instead, so that one in two is there in the end and the live set grows with the table."""
    name, nth = F.floor(F.col("event_id") / 4), F.col("event_id") % 4
    other = (name % 2 == 1) & (nth == 3)
    user = F.col("user_id").cast("string")
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"), (F.floor(name / 2) % 4).cast("int").alias("level"), F.concat(F.lit("sst_"), name.cast("string"), F.when(other, "b").otherwise("")).alias("filename"),
        F.concat_ws("/", user, "event_type").alias("start_key"), F.concat(user, F.lit("~")).alias("end_key"),
        (F.col("user_id") * 1000 + F.length("props")).cast("long").alias("bytes"), ((nth % 2 == 1) & ~other).alias("deleted"),
    )


LOG = "SELECT user_id::VARCHAR || '/' || event_type AS key, props AS value, CASE WHEN value < 5 THEN 1 ELSE 0 END AS op, event_id AS seq FROM events"
LATEST = f"SELECT key, CASE WHEN op = 0 THEN value END AS value, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({LOG})) WHERE rn = 1"
LIVE = f"SELECT key, value, seq FROM ({LATEST}) WHERE op = 0"
RUNS = f"SELECT segment_id, key, CASE WHEN op = 0 THEN value END AS value, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, key ORDER BY seq DESC) AS rn FROM (SELECT *, seq // {SEGMENT_EVENTS} AS segment_id FROM ({LOG}))) WHERE rn = 1"
ORDERS = "SELECT o_orderkey % 4 AS segment_id, o_orderkey::VARCHAR AS key, o_orderpriority AS value, 0 AS op FROM orders"
BYTES = "octet_length(encode({}))"
SIZE = f"CASE WHEN op = 0 THEN 17 + {BYTES.format('key')} + coalesce({BYTES.format('value')}, 0) ELSE 13 + {BYTES.format('key')} END"
ENTRIES = """SELECT event_id AS ordinal, (event_id // 8 % 4)::INT AS level, 'sst_' || (event_id // 4)::VARCHAR || CASE WHEN event_id % 8 = 7 THEN 'b' ELSE '' END AS filename,
  user_id::VARCHAR || '/' || event_type AS start_key, user_id::VARCHAR || '~' AS end_key, (user_id * 1000 + length(props))::BIGINT AS bytes, event_id % 8 IN (1, 3, 5) AS deleted FROM events"""
LIVE_ENTRIES = f"SELECT * EXCLUDE (rn, deleted) FROM (SELECT *, row_number() OVER (PARTITION BY level, filename ORDER BY ordinal DESC) AS rn FROM ({ENTRIES})) WHERE rn = 1 AND NOT deleted"
OFFSETS = f"SELECT *, row_number() OVER w - 1 AS record, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM (SELECT *, ({SIZE})::BIGINT AS length FROM ({ORDERS})) WINDOW w AS (PARTITION BY segment_id ORDER BY key)"
INDEX = f"SELECT segment_id, key, start_byte, length FROM ({OFFSETS}) WHERE record % 1000 = 0"


@_query(LIVE)
def latest_snapshot(spark, sf_dir):
    """Newest visible version of every key."""
    return resolve.snapshot(events_log(spark, sf_dir))


@_query(f"SELECT * FROM ({LIVE}) WHERE key = '17/click'")
def point_get(spark, sf_dir):
    return lookup.get(events_log(spark, sf_dir), "17/click")


@_query(f"SELECT * FROM ({LIVE}) WHERE key IN (SELECT c_custkey::VARCHAR || '/click' FROM customer)")
def multi_get(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("/click")).alias("key"))
    return lookup.multi_get(events_log(spark, sf_dir), keys)


@_query(f"SELECT key, seq FROM ({LATEST}) WHERE op = 1")
def tombstones(spark, sf_dir):
    return resolve.tombstones(events_log(spark, sf_dir))


@_query(f"SELECT key, seq, coalesce(before, 1) = 0 AS was_present FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM ({LOG})) WHERE op = 1")
def delete_was_present(spark, sf_dir):
    return resolve.deletions(events_log(spark, sf_dir))


@_query(f"SELECT user_id, key, value, row_number() OVER (PARTITION BY user_id ORDER BY key) AS place FROM (SELECT *, split_part(key, '/', 1) AS user_id FROM ({LIVE}))")
def ordered_scan(spark, sf_dir):
    """The snapshot in key order, numbered within each user."""
    live = resolve.snapshot(events_log(spark, sf_dir)).withColumn("user_id", F.split_part("key", F.lit("/"), F.lit(1)))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("key")).cast("long")
    return live.select("user_id", "key", "value", place.alias("place"))


@_query(f"SELECT coalesce(sum({BYTES.format('key')} + {BYTES.format('value')}), 0)::BIGINT AS bytes FROM ({LIVE})")
def tail_size(spark, sf_dir):
    return resolve.live_bytes(events_log(spark, sf_dir))


@_query(f"SELECT sum({SIZE})::BIGINT AS bytes, count(*)::BIGINT AS records FROM ({LOG})")
def log_size(spark, sf_dir):
    log = events_log(spark, sf_dir)
    size = encoding.record_size(F.col("key"), F.col("value"), F.col("op"))
    return log.agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("records"))


def _hex(n: str, digits: int = 8) -> str:
    return f"upper(printf('%0{digits}x', {n}))"


@_query(f"""SELECT seq, {_hex(BYTES.format('key'))} || hex(encode(key)) || CASE WHEN op = 0 THEN '00' || {_hex(BYTES.format('value'))} || hex(encode(value)) ELSE '01' END AS body FROM ({LOG})""")
def record_encode(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.select("seq", F.hex(encoding.record_body(F.col("key"), F.col("value"), F.col("op"))).alias("body"))


@_query(f"SELECT seq, key, CASE WHEN op = 0 THEN value END AS value, op FROM ({LOG})")
def record_round_trip(spark, sf_dir):
    """Every change encoded with its checksum, decoded and verified."""
    log = events_log(spark, sf_dir)
    coded = log.select("seq", encoding.encode_record(F.col("key"), F.col("value"), F.col("op")).alias("r"))
    rows = coded.select("seq", encoding.verified(encoding.decode_record(F.col("r"))).alias("d"))
    return rows.select("seq", F.col("d.key").cast("string").alias("key"), F.col("d.value").cast("string").alias("value"), F.col("d.op").cast("int").alias("op"))


@_query()
def record_checksum(spark, sf_dir):
    """CRC-32 of every encoded change (DuckDB has no such function)."""
    log = events_log(spark, sf_dir)
    return log.select("seq", F.crc32(encoding.record_body(F.col("key"), F.col("value"), F.col("op"))).alias("crc"))


@_query(f"SELECT segment_id, min(key) AS start_key, max(key) AS end_key, count(*) AS records, sum({SIZE})::BIGINT AS bytes FROM ({RUNS}) GROUP BY 1")
def segment_metadata(spark, sf_dir):
    return segments.bounds(_event_runs(spark, sf_dir))


@_query(INDEX)
def sparse_index(spark, sf_dir):
    return segments.sparse_index(order_runs(spark, sf_dir))


@_query(f"SELECT segment_id, sum(length)::BIGINT AS index_start_byte, 12 + min_by({BYTES.format('key')}, key) AS length, ceil(count(*) / 1000.0)::BIGINT AS index_entries FROM ({OFFSETS}) GROUP BY 1")
def segment_footer(spark, sf_dir):
    return segments.footers(order_runs(spark, sf_dir))


@_query(f"SELECT o.segment_id, o.key, i.start_byte FROM (SELECT o_orderkey % 4 AS segment_id, (o_orderkey + 1)::VARCHAR AS key FROM orders) o ASOF LEFT JOIN ({INDEX}) i ON o.segment_id = i.segment_id AND o.key >= i.key")
def index_seek(spark, sf_dir):
    """For a probe by every order, the index block it would be read from."""
    orders = _table(spark, sf_dir, "orders")
    probes = orders.select((F.col("o_orderkey") % 4).alias("segment_id"), (F.col("o_orderkey") + 1).cast("string").alias("key"))
    return lookup.seek(probes, segments.sparse_index(order_runs(spark, sf_dir)))


@_query(f"SELECT k.key, segment_id FROM (SELECT DISTINCT user_id::VARCHAR || '/view' AS key FROM events) k JOIN (SELECT segment_id, min(key) AS low, max(key) AS high FROM ({RUNS}) GROUP BY 1) s ON k.key BETWEEN low AND high")
def segment_prune(spark, sf_dir):
    keys = _table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/view")).alias("key")).distinct()
    return lookup.prune(keys, segments.bounds(_event_runs(spark, sf_dir)))


@_query(f"SELECT key, value FROM ({LIVE})")
def layered_get(spark, sf_dir):
    """Resolution by position, newest layer first, as single reads do; it must agree with the sequence numbers."""
    runs = _event_runs(spark, sf_dir)
    layer = F.struct(F.col("value"), F.col("op"))
    newest = runs.groupBy("key").agg(F.max_by(layer, "segment_id").alias("m"))
    return newest.where("m.op = 0").select("key", "m.value")


@_query(f"SELECT key, value, op, seq FROM ({LATEST})")
def kway_merge(spark, sf_dir):
    """All runs merged into one, deletions kept."""
    return resolve.latest(_event_runs(spark, sf_dir)).withColumn("op", F.col("op").cast("int"))


@_query(f"""WITH RECURSIVE sized AS (SELECT key, length, row_number() OVER (ORDER BY key) AS r FROM ({OFFSETS})),
parts(r, key, part, used) AS (
  SELECT r, key, 0::BIGINT, length FROM sized WHERE r = 1
  UNION ALL SELECT s.r, s.key, CASE WHEN p.used > 100000 THEN p.part + 1 ELSE p.part END, CASE WHEN p.used > 100000 THEN s.length ELSE p.used + s.length END FROM parts p JOIN sized s ON s.r = p.r + 1
) SELECT part, min(key) AS start_key, max(key) AS end_key, count(*) AS records FROM parts GROUP BY 1""")
def merge_split(spark, sf_dir):
    """One run cut where a file has more than 100 000 bytes, as one stream would."""
    rows = segments.split_greedily(order_runs(spark, sf_dir).select("key", "value", "op"), limit=100_000)
    return rows.groupBy("part").agg(F.min("key").alias("start_key"), F.max("key").alias("end_key"), F.count("*").alias("records"))


@_query(LIVE_ENTRIES)
def manifest_live(spark, sf_dir):
    return leveling.live(manifest_entries(spark, sf_dir))


@_query(f"SELECT count(DISTINCT level) AS levels FROM ({ENTRIES}) WHERE NOT deleted")
def manifest_levels(spark, sf_dir):
    return leveling.levels_seen(manifest_entries(spark, sf_dir))


STATS = f"SELECT level, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM ({LIVE_ENTRIES}) GROUP BY 1"


@_query(STATS)
def level_stats(spark, sf_dir):
    return leveling.level_stats(leveling.live(manifest_entries(spark, sf_dir)))


@_query(f"SELECT *, CASE WHEN level = 0 THEN files >= 4 ELSE bytes > pow(10, level) * 1000000 END AS due FROM ({STATS})")
def compaction_due(spark, sf_dir):
    return leveling.due(leveling.level_stats(leveling.live(manifest_entries(spark, sf_dir))))


PICKS = f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY ordinal) AS place FROM ({LIVE_ENTRIES})) WHERE level = 0 OR place = 1"


@_query(PICKS)
def compaction_pick(spark, sf_dir):
    return leveling.picks(leveling.live(manifest_entries(spark, sf_dir)))


@_query(f"""WITH own AS (SELECT * FROM ({PICKS}) WHERE level = 1)
SELECT * FROM own UNION ALL SELECT b.* FROM ({LIVE_ENTRIES}) b WHERE level = 2 AND EXISTS (SELECT 1 FROM (SELECT min(start_key) AS low, max(end_key) AS high FROM own) WHERE b.start_key <= high AND low <= b.end_key)""")
def merge_candidates(spark, sf_dir):
    return leveling.candidates(leveling.live(manifest_entries(spark, sf_dir)), 1)


@_query(f"""SELECT bucket, min(seq) AS seq, min_by(bytes, seq)::BIGINT AS bytes FROM (
  SELECT 0 AS bucket, seq, sum({BYTES.format('key')} + CASE WHEN op = 0 THEN {BYTES.format('value')} ELSE 0 END) OVER (ORDER BY seq) AS bytes FROM ({LOG})) WHERE bytes > 50000 GROUP BY 1""")
def flush_due(spark, sf_dir):
    return resolve.flush_points(events_log(spark, sf_dir), 50_000)


@_query(f"SELECT * FROM ({LIVE}) WHERE key BETWEEN '10' AND '2'")
def range_scan(spark, sf_dir):
    return lookup.range_scan(events_log(spark, sf_dir), "10", "2")


@_query(f"SELECT * FROM ({LIVE}) WHERE starts_with(key, '12')")
def prefix_scan(spark, sf_dir):
    return lookup.prefix_scan(events_log(spark, sf_dir), "12")


@_query(f"SELECT key, CASE WHEN op = 0 THEN value END AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({LOG}) WHERE seq <= 5000) WHERE rn = 1 AND op = 0")
def as_of_snapshot(spark, sf_dir):
    return resolve.as_of(events_log(spark, sf_dir), 5000)


@_query(f"""SELECT n_name, count(*) AS keys, sum(seq)::BIGINT AS seqs FROM ({LIVE}) s JOIN customer ON c_custkey = split_part(key, '/', 1)::BIGINT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def snapshot_join(spark, sf_dir):
    """A snapshot is a table like any other: visible keys by the nation of their user."""
    live = resolve.snapshot(events_log(spark, sf_dir)).withColumn("user_id", F.split_part("key", F.lit("/"), F.lit(1)).cast("long"))
    customer, nation = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    rows = live.join(customer, live.user_id == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.groupBy("n_name").agg(F.count("*").alias("keys"), F.sum("seq").alias("seqs"))
