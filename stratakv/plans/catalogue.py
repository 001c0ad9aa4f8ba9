"""Registered queries of the engine and the DuckDB SQL that must give the same rows.

Keys leave as strings or lower-case hex, and every computed column has an explicit type and name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, keycodec
from ..operators import files, metadata, mvcc
from ..sources.adapters import BATCHES_PER_FILE, FIRST_FILE, events_log, orders_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """WITH log AS (
  SELECT cast(floor(event_id / 8) AS bigint) + 1 AS seq, cast(event_id % 8 AS bigint) AS op_index,
    cast(floor(cast(floor(event_id / 8) AS bigint) / 50) AS bigint) + 2 AS wal_number,
    cast(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS bigint) AS kind, 'user:' || lpad(cast(user_id AS varchar), 8, '0') AS key,
    CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type = 'signup' THEN epoch_ms(ts) + 86400000 END AS expires
  FROM events),
rec AS (SELECT key, seq, kind, value, expires, wal_number AS file_number FROM (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY op_index DESC) AS r FROM log) WHERE r = 1)"""
PROPS = "props AS (SELECT file_number, count(*) AS entries, min(key) AS smallest, max(key) AS largest, max(seq) AS largest_seq FROM rec GROUP BY 1)"


def registered(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _text(c: str = "key") -> Column:
    return F.decode(F.col(c), "UTF-8")


def _long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded records with the file that a flush of every 50 batches puts them in."""
    return mvcc.fold(events_log(spark, sf_dir)).withColumn("file_number", F.floor((F.col("seq") - 1) / BATCHES_PER_FILE).cast("long") + FIRST_FILE)


def _newest_sql(where: str = "", final: str = "kind = 1", columns: str = "key, seq, value") -> str:
    return f"{LOG} SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM rec {where}) WHERE r = 1 AND {final}"


def _visible(df: DataFrame) -> DataFrame:
    return df.select(_text().alias("key"), "seq", "value")


@registered(f"{LOG} SELECT key, seq, kind, value FROM rec")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.fold(events_log(spark, sf_dir)).select(_text().alias("key"), "seq", _long("kind"), "value")


@registered(_newest_sql())
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.state(_records(spark, sf_dir)))


@registered(_newest_sql("WHERE seq <= 600"))
def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.state(_records(spark, sf_dir), 600))


@registered(_newest_sql("WHERE seq <= 600"))
def one_pass_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.state_of_log(events_log(spark, sf_dir), 600))


@registered(_newest_sql(final="kind = 0", columns="key, seq"))
def live_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.newest(_records(spark, sf_dir)).where("kind = 0").select(_text().alias("key"), "seq")


@registered(_newest_sql(columns="key, seq, value", where="WHERE key = 'user:00000007'"))
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.get(_records(spark, sf_dir), b"user:00000007"))


@registered(_newest_sql(where="WHERE key = 'user:00000007' AND seq <= 300"))
def snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.get(_records(spark, sf_dir), b"user:00000007", 300))


@registered(
    f"""{LOG}, snap(snapshot_seq) AS (VALUES (100), (600), (1200)), best AS (
  SELECT key, cast(snapshot_seq AS bigint) AS snapshot_seq, seq, kind, value, row_number() OVER (PARTITION BY key, snapshot_seq ORDER BY seq DESC) AS r
  FROM rec JOIN snap ON seq <= snapshot_seq)
SELECT key, snapshot_seq, seq, value FROM best WHERE r = 1 AND kind = 1"""
)
def asof_multi_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    lookups = records.select("key").distinct().select("key", F.explode(F.array(*[F.lit(s).cast("long") for s in (100, 600, 1200)])).alias("snapshot_seq"))
    return mvcc.as_of(records, lookups).where("kind = 1").select(_text().alias("key"), "snapshot_seq", "seq", "value")


@registered(f"{LOG} SELECT key, seq, kind, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS age FROM rec")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.history(_records(spark, sf_dir)).select(_text().alias("key"), "seq", _long("kind"), _long("age"))


@registered(f"""{LOG}, probe(key) AS (VALUES ('user:00000001'), ('user:00000002'), ('user:99999999')), best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM rec)
SELECT probe.key AS key, seq, value FROM probe LEFT JOIN (SELECT * FROM best WHERE r = 1 AND kind = 1) b ON probe.key = b.key""")  # fmt: skip
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(b"user:00000001",), (b"user:00000002",), (b"user:99999999",)], "key binary")
    return _visible(mvcc.multi_get(_records(spark, sf_dir), keys))


@registered(f"{LOG}, {PROPS} SELECT file_number, entries, smallest, largest, largest_seq FROM props")
def file_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_properties(_records(spark, sf_dir)).select("file_number", "entries", _text("smallest").alias("smallest"), _text("largest").alias("largest"), "largest_seq")


@registered(f"{LOG} SELECT key, seq, kind, file_number, row_number() OVER (PARTITION BY file_number ORDER BY key, seq DESC) AS place FROM rec")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    run = _records(spark, sf_dir).withColumn("internal_key", keycodec.internal_key(F.col("key"), F.col("seq"), F.col("kind")))
    return run.withColumn("place", F.row_number().over(Window.partitionBy("file_number").orderBy("internal_key"))).select(_text().alias("key"), "seq", _long("kind"), "file_number", _long("place"))


_PROBES_SQL = f"""{LOG}, {PROPS}, hits AS (SELECT key, max(file_number) AS hit_file FROM rec GROUP BY 1),
probed AS (SELECT h.key AS key, cast(sum(CASE WHEN p.file_number >= h.hit_file THEN 1 ELSE 0 END) AS bigint) AS probes
  FROM hits h JOIN props p ON h.key BETWEEN p.smallest AND p.largest GROUP BY 1)"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    hits = records.groupBy("key").agg(F.max("file_number").alias("hit_file"))
    return files.probes(hits.select("key"), files.file_properties(records), hits)


@registered(f"{_PROBES_SQL} SELECT key, probes FROM probed")
def table_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select(_text().alias("key"), "probes")


@registered(f"{_PROBES_SQL} SELECT count(*) AS point_reads, cast(sum(probes) AS bigint) AS sstable_probes, cast(sum(probes) AS double) / count(*) AS read_amplification FROM probed")
def read_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = F.count("*")
    return _probes(spark, sf_dir).agg(reads.alias("point_reads"), F.sum("probes").cast("long").alias("sstable_probes"), F.when(reads == 0, 0.0).otherwise(F.sum("probes").cast("double") / reads).alias("read_amplification"))


@registered(f"{LOG} SELECT cast(count(*) AS bigint) AS gaps FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS before FROM (SELECT DISTINCT seq FROM log)) WHERE before <> seq - 1")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.sequence_gaps(events_log(spark, sf_dir)).agg(F.count("*").alias("gaps"))


@registered(f"{LOG} SELECT seq FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS before FROM (SELECT DISTINCT seq FROM log WHERE seq % 7 <> 3)) WHERE before <> seq - 1")
def broken_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that lost every seventh batch: the sequences recovery must refuse."""
    return mvcc.sequence_gaps(events_log(spark, sf_dir).where("seq % 7 <> 3"))


@registered(f"""{LOG} SELECT seq, hex(key) AS key_hex, lower(regexp_replace(hex(key), '', '') || '0000' || lpad(hex(cast(18446744073709551615 - seq AS ubigint)), 16, '0') || lpad(cast(kind AS varchar), 2, '0')) AS internal_key,
  row_number() OVER (PARTITION BY file_number ORDER BY key, seq DESC) AS place FROM rec""")  # fmt: skip
def internal_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    run = _records(spark, sf_dir).withColumn("k", keycodec.internal_key(F.col("key"), F.col("seq"), F.col("kind")))
    return run.select("seq", F.hex("key").alias("key_hex"), F.lower(F.hex("k")).alias("internal_key"), F.row_number().over(Window.partitionBy("file_number").orderBy("k")).cast("long").alias("place"))


@registered(f"{LOG} SELECT count(*) AS n, cast(0 AS bigint) AS violations FROM rec")
def key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with zero bytes put between their letters, encoded and decoded."""
    odd = F.unhex(F.regexp_replace(F.hex("key"), "(3.)", "00$1"))
    k = _records(spark, sf_dir).select(odd.alias("key"), "seq", "kind").withColumn("k", keycodec.internal_key(F.col("key"), F.col("seq"), F.col("kind")))
    same = (keycodec.decode_user_key(F.col("k")) == F.col("key")) & (keycodec.decode_sequence(F.col("k")) == F.col("seq")) & (keycodec.decode_kind(F.col("k")) == F.col("kind"))
    return k.agg(F.count("*").alias("n"), F.count_if(~same).alias("violations"))


@registered(f"""{LOG}, t(target) AS (VALUES ('user:00000003'), ('user:0000000'), ('user:00000010x'), ('user:zz')), k AS (SELECT DISTINCT key FROM rec)
SELECT target, (SELECT min(key) FROM k WHERE key >= target) AS key FROM t""")  # fmt: skip
def lower_bound_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(b"user:00000003",), (b"user:0000000",), (b"user:00000010x",), (b"user:zz",)], "target binary")
    return files.lower_bound(_records(spark, sf_dir), targets).select(_text("target").alias("target"), _text().alias("key"))


@registered(f"{LOG}, {PROPS} SELECT a.file_number AS file_a, b.file_number AS file_b FROM props a JOIN props b ON a.file_number < b.file_number AND a.smallest <= b.largest AND b.smallest <= a.largest")
def l0_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.overlap_pairs(files.file_properties(_records(spark, sf_dir)))


@registered(f"""{LOG}, p AS (SELECT cast(1 + file_number % 3 AS bigint) AS level, file_number, min(key) AS smallest, max(key) AS largest FROM rec GROUP BY 1, 2),
o AS (SELECT *, lag(largest) OVER (PARTITION BY level ORDER BY smallest, file_number) AS before FROM p) SELECT level, file_number FROM o WHERE before >= smallest""")  # fmt: skip
def level_overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of level 0 put into sorted levels as they are: what a version must refuse."""
    p = files.file_properties(_records(spark, sf_dir)).withColumn("level", 1 + F.col("file_number") % 3)
    return files.level_violations(p).select("level", "file_number")


@registered(f"""{LOG}, r AS (SELECT *, cast(substr(key, 6) AS bigint) // 20 AS bucket FROM rec), p AS (SELECT bucket, min(key) AS smallest, max(key) AS largest FROM r GROUP BY 1), k AS (SELECT DISTINCT key FROM rec)
SELECT key, cast(1 AS bigint) AS level, bucket AS file_number FROM k JOIN p ON key BETWEEN smallest AND largest""")  # fmt: skip
def level_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint files of twenty users each at level 1: one candidate for each key."""
    r = _records(spark, sf_dir).withColumn("file_number", F.floor(F.substring(_text(), 6, 20).cast("long") / 20).cast("long"))
    level1 = files.file_properties(r).withColumn("level", F.lit(1))
    return files.candidates_by_level(r.select("key").distinct(), level1).select(_text().alias("key"), _long("level"), "file_number")


#: FNV-1a and double hashing in DuckDB over ASCII keys.
_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split(key, ''), lambda c: ascii(c)::uhugeint)), lambda h, b: (xor(h::ubigint, b::ubigint)::uhugeint * 1099511628211) % 18446744073709551616)"
_BITS = """lo_step AS (SELECT *, (h % 4294967296)::bigint AS lo, (h // 4294967296)::bigint AS hi FROM hashed),
stepped AS (SELECT *, (((hi >> 17) | ((hi & 131071) << 15)) & 4294967295) | 1 AS step FROM lo_step)"""


@registered(f"""WITH keys AS (SELECT 'user:' || lpad(cast(i AS varchar), 8, '0') AS key, i % 2 AS odd FROM range(1000) t(i)), hashed AS (SELECT *, {_FNV} AS h FROM keys), {_BITS},
spread AS (SELECT key, odd, ((lo + j * step) & 4294967295) % 5000 AS bit FROM stepped, range(6) r(j)), present AS (SELECT DISTINCT bit FROM spread WHERE odd = 0),
seen AS (SELECT key, odd, count(*) = count(p.bit) AS maybe FROM spread s LEFT JOIN present p ON s.bit = p.bit GROUP BY 1, 2)
SELECT odd, count(*) AS n, count(*) FILTER (maybe) AS maybe FROM seen GROUP BY 1""")  # fmt: skip
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(1000).select(F.format_string("user:%08d", "id").cast("binary").alias("key"), (F.col("id") % 2).alias("odd"), F.lit(1).cast("long").alias("file_number"))
    filters = files.filter_bits(keys.where("odd = 0"), 10)
    return files.filter_check(keys, filters, 10).groupBy("odd").agg(F.count("*").alias("n"), F.count_if("maybe").alias("maybe"))


@registered(f"""{LOG}, sizes AS (SELECT file_number, ((greatest(64, count(*) * 10) + 7) // 8) * 8 AS bits FROM rec GROUP BY 1), k AS (SELECT DISTINCT key FROM rec),
hashed AS (SELECT key, {_FNV} AS h FROM k), {_BITS}, spread AS (SELECT key, file_number, ((lo + j * step) & 4294967295) % bits AS bit FROM stepped, sizes, range(6) r(j)),
own AS (SELECT DISTINCT key, file_number FROM rec), present AS (SELECT DISTINCT file_number, bit FROM spread JOIN own USING (key, file_number)), {PROPS},
seen AS (SELECT s.key AS key, s.file_number AS file_number, count(DISTINCT s.bit) = count(DISTINCT p.bit) AS maybe FROM spread s JOIN props o ON s.file_number = o.file_number AND s.key BETWEEN o.smallest AND o.largest LEFT JOIN present p ON s.file_number = p.file_number AND s.bit = p.bit GROUP BY 1, 2)
SELECT s.file_number AS file_number, count(*) AS checks, count(*) FILTER (NOT maybe) AS useful_negatives, count(*) FILTER (o.key IS NOT NULL AND NOT maybe) AS false_negatives
FROM seen s LEFT JOIN own o ON s.key = o.key AND s.file_number = o.file_number GROUP BY 1""")  # fmt: skip
def bloom_useful_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key asked of the filters of the files whose range holds it: how often they save a read, and that they never hide a key."""
    records = _records(spark, sf_dir)
    filters = files.filter_bits(records, 10)
    own = files.filter_check(records.select("file_number", "key").distinct(), filters, 10).groupBy("file_number").agg(F.count_if(~F.col("maybe")).alias("false_negatives"))
    return files.filter_negatives(records.select("key"), files.file_properties(records), filters, 10).join(own, "file_number").select("file_number", "checks", "useful_negatives", "false_negatives")


@registered(f"{LOG} SELECT seq, count(*) AS ops, cast(sum(octet_length(encode(key))) AS bigint) AS payload_bytes FROM log GROUP BY 1")
def batch_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.payload_bytes(events_log(spark, sf_dir).withColumn("value", F.lit(None).cast("string")))


@registered("SELECT doc_id // 8 AS seq, count(*) AS ops, cast(sum(octet_length(encode(text)) + octet_length(encode('doc:' || doc_id))) AS bigint) AS payload_bytes FROM documents GROUP BY 1 HAVING sum(octet_length(encode(text)) + octet_length(encode('doc:' || doc_id))) > 32768")
def oversized_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight documents whose payload exceeds a limit of 32 KiB."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log = d.select(F.floor(F.col("doc_id") / 8).cast("long").alias("seq"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).cast("binary").alias("key"), F.col("text").alias("value"))
    return mvcc.payload_bytes(log).where("payload_bytes > 32768")


@registered("SELECT doc_id, cast(octet_length(encode(text)) AS bigint) AS bytes FROM documents WHERE octet_length(encode(text)) > 16384")
def oversized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return d.where("bytes > 16384")


@registered("SELECT c_custkey, cast(octet_length(encode(c_name || '/' || c_mktsegment)) AS bigint) AS bytes FROM customer WHERE octet_length(encode(c_name || '/' || c_mktsegment)) > 28")
def oversized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys beyond a limit of 28 bytes, which a write refuses."""
    key = F.concat_ws("/", "c_name", "c_mktsegment")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.octet_length(key).cast("long").alias("bytes")).where("bytes > 28")


@registered(f"{LOG} SELECT key, seq, kind, value FROM rec WHERE (key, seq, kind) IN (SELECT (key, max(seq), kind) FROM rec WHERE key IN ('user:00000001', 'user:00000002') GROUP BY key, kind)")
def exact_record_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest put and the newest delete of two keys, looked up by key, sequence and kind."""
    records = _records(spark, sf_dir)
    named = records.where(F.col("key").isin(b"user:00000001", b"user:00000002")).groupBy("key", "kind").agg(F.max("seq").alias("seq")).collect()
    found = [mvcc.exact(records, bytes(r.key), r.seq, r.kind) for r in named] or [records.where("false")]
    return reduce(DataFrame.unionByName, found).select(_text().alias("key"), "seq", _long("kind"), "value")


@registered(f"""{LOG}, sizes AS (SELECT file_number, ((greatest(64, count(*) * 10) + 7) // 8) * 8 AS bits FROM rec GROUP BY 1), k AS (SELECT DISTINCT key FROM rec UNION ALL SELECT 'user:' || lpad(cast(i AS varchar), 8, '0') FROM range(900000, 900200) t(i)),
hashed AS (SELECT key, {_FNV} AS h FROM k), {_BITS}, spread AS (SELECT key, ((lo + j * step) & 4294967295) % bits AS bit FROM stepped, range(6) r(j), sizes WHERE file_number = 2),
present AS (SELECT DISTINCT bit FROM spread WHERE key IN (SELECT key FROM rec WHERE file_number = 2)), seen AS (SELECT key, count(*) = count(p.bit) AS maybe FROM spread s LEFT JOIN present p ON s.bit = p.bit GROUP BY 1)
SELECT count(*) AS asked, count(*) FILTER (maybe) AS maybe FROM seen""")  # fmt: skip
def table_may_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table's filter asked for all keys of the log and for 200 that no table has."""
    records = _records(spark, sf_dir)
    absent = spark.range(900_000, 900_200).select(F.format_string("user:%08d", "id").cast("binary").alias("key"))
    asked = records.select("key").distinct().unionByName(absent).withColumn("file_number", F.lit(FIRST_FILE).cast("long"))
    checked = files.filter_check(asked, files.filter_bits(records.where(F.col("file_number") == FIRST_FILE), 10), 10)
    return checked.agg(F.count("*").alias("asked"), F.count_if("maybe").alias("maybe"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.derived_edits(files.file_properties(_records(spark, sf_dir)))


@registered(f"{LOG}, {PROPS}, e AS (SELECT file_number - 1 AS edit_no, largest_seq, lag(largest_seq) OVER (ORDER BY file_number) AS before FROM props) SELECT count(*) AS violations FROM e WHERE before > largest_seq")
def manifest_counter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.counter_violations(_edits(spark, sf_dir)).agg(F.count("*").alias("violations"))


@registered(f"{LOG}, {PROPS} SELECT file_number // 2 AS file_number, count(*) AS times FROM props GROUP BY 1 HAVING count(*) > 1")
def file_number_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose numbers were halved, so that most are used twice."""
    return metadata.reused_numbers(_edits(spark, sf_dir).select(F.floor(F.col("added") / 2).cast("long").alias("file_number")))


@registered(f"{LOG} SELECT wal_number, max(seq) AS last_seq FROM log GROUP BY 1 HAVING max(seq) <= 950")
def wal_retirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.retired_wals(events_log(spark, sf_dir), 950)


@registered(f"{LOG} SELECT min(wal_number) AS oldest_wal FROM log WHERE seq > 950")
def oldest_required_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.oldest_required_wal(events_log(spark, sf_dir), 950)


@registered(f"{LOG}, {PROPS}, l(file_number) AS (VALUES (2), (26), (99)) SELECT cast(file_number AS bigint) AS file_number FROM l WHERE file_number NOT IN (SELECT file_number FROM props)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = spark.createDataFrame([(2,), (26,), (99,)], "file_number long")
    return metadata.orphans(listing, files.file_properties(_records(spark, sf_dir)).select("file_number"))


@registered(f"{LOG}, {PROPS} SELECT file_number FROM props WHERE file_number % 3 <> 0")
def live_file_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a later edit deletes every third file."""
    added = _edits(spark, sf_dir).select("edit_no", F.lit("add").alias("op"), F.col("added").alias("file_number"))
    gone = added.where("file_number % 3 = 0").select((F.col("edit_no") + 1000).alias("edit_no"), F.lit("delete").alias("op"), "file_number")
    return metadata.live_files(added.unionByName(gone))


@registered("SELECT * FROM (VALUES (1::bigint, 10::bigint), (2, 10), (3, 20), (4, NULL)) t(event_no, oldest_active)")
def oldest_active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 10, -1), (4, 20, -1)], "event_no long, seq long, delta int")
    return metadata.oldest_active(events)


@registered(_newest_sql("WHERE key >= 'user:00000010' AND key < 'user:00000030'"))
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.range_scan(_records(spark, sf_dir), b"user:00000010", b"user:00000030"))


@registered(_newest_sql("WHERE starts_with(key, 'user:0000001')"))
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.prefix_scan(_records(spark, sf_dir), b"user:0000001"))


@registered(_newest_sql(final="kind = 1 AND (expires IS NULL OR expires > epoch_ms(TIMESTAMP '2024-01-31'))"))
def ttl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.unexpired(_records(spark, sf_dir), 1_706_659_200_000))


@registered(f"""{LOG}, v AS (SELECT key, seq, kind, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nxt FROM rec)
SELECT key, seq, kind FROM v WHERE nxt IS NULL OR (seq <= 300 AND 300 < nxt) OR (seq <= 900 AND 900 < nxt)""")  # fmt: skip
def compaction_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.compact(_records(spark, sf_dir), [300, 900]).select(_text().alias("key"), "seq", _long("kind"))


@registered(
    """WITH log AS (SELECT cast(floor(o_orderkey / 8) AS bigint) + 1 AS seq, o_orderkey % 8 AS op_index, 'cust:' || lpad(cast(o_custkey AS varchar), 8, '0') AS key, o_orderstatus, o_totalprice FROM orders),
best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op_index DESC) AS r FROM log) SELECT key, seq, o_totalprice AS value FROM best WHERE r = 1 AND o_orderstatus <> 'F'"""
)
def orders_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(mvcc.state_of_log(orders_log(spark, sf_dir)))


@registered(f"{LOG} SELECT count(*) AS checked, count(*) FILTER (kind = 1) AS live FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM rec) WHERE r = 1")
def filter_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that pass their own file's filter, counted with the live ones: none may be lost."""
    records = _records(spark, sf_dir)
    newest = mvcc.newest(records).select("key", "kind", (F.floor((F.col("seq") - 1) / BATCHES_PER_FILE).cast("long") + FIRST_FILE).alias("file_number"))
    passed = files.filter_check(newest, files.filter_bits(records, 10), 10).where("maybe")
    return passed.agg(F.count("*").alias("checked"), F.count_if(F.col("kind") == 1).alias("live"))


__all__ = ["ORACLES", "QUERIES", "bloom", "orders_log"]
