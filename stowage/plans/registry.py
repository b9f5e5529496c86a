"""Every query over the relational tables, with the SQL it is checked against.

The tables stand in for the catalogs: documents for files and blobs, orders and
lineitem for versions, shards and locations, customers for clients, suppliers
for peers, events for challenge results. Times are relative to the latest
event, never to the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, paths, sealing
from ..functions.blake3 import blake3
from ..operators import catalog, chunking, erasure, health, packing, placement, state
from ..sources.blobs import hosted_items
from ..sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHUNK_CHARS = 4096
SHARD_BYTES, SHARD_PIECES = 200_000, 4


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def blobs_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct text: hash, ord (first doc_id), size in bytes."""
    docs = read(spark, folder, "documents").select("doc_id", paths.content_hash(F.col("text").cast("binary")).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("ord"), F.max("size").alias("size"))


def packed_sql(name: str, blobs: str) -> str:
    """Common table expression ``name``: the locations of ``blobs`` (hash, ord, size)."""
    piece = SHARD_BYTES // SHARD_PIECES
    return f"""
  {name}_placed AS (SELECT hash, size, coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {blobs}),
  {name}_cuts AS (SELECT hash, start, start + size AS stop, unnest(range(start // {piece}, (start + size - 1) // {piece} + 1)) AS slot FROM {name}_placed WHERE size > 0),
  {name} AS (SELECT hash, (slot // {SHARD_PIECES})::BIGINT AS shard_id, (slot % {SHARD_PIECES})::INT AS piece_index, (greatest(start, slot * {piece}) - slot * {piece})::BIGINT AS "offset",
    (least(stop, (slot + 1) * {piece}) - greatest(start, slot * {piece}))::BIGINT AS length, (slot - start // {piece})::INT AS sequence FROM {name}_cuts)"""


PACKED = f"""
  blobs AS (SELECT sha256(text) AS hash, min(doc_id) AS ord, max(strlen(text))::BIGINT AS size FROM documents GROUP BY 1), {packed_sql("packed", "blobs")}
"""


@query(f"WITH {PACKED} SELECT * FROM packed")
def shard_packing(spark, folder):
    return packing.pack(blobs_of_documents(spark, folder), "ord", SHARD_BYTES // SHARD_PIECES, SHARD_PIECES)


@query(f"""WITH {PACKED} SELECT shard_id, sum(length)::BIGINT AS bytes, count(DISTINCT hash) AS blobs,
  sum(length) = {SHARD_BYTES} AND shard_id < (SELECT max(shard_id) FROM packed) AS sealed FROM packed GROUP BY shard_id""")
def shard_summary(spark, folder):
    return packing.summarise(shard_packing(spark, folder), SHARD_BYTES)


@query("""SELECT user_id, count(*) AS made, count(*) FILTER (event_type IN ('click', 'view', 'error')) AS ok,
  count(*) FILTER (event_type = 'click') AS passed, count(*) FILTER (event_type IN ('click', 'error')) AS attempts,
  round(100.0 * count(*) FILTER (event_type IN ('click', 'view', 'error')) / count(*), 6)::DOUBLE AS uptime,
  round(coalesce(100.0 * count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'error')), 0), 0), 6)::DOUBLE AS integrity
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id""")
def reputation_7d(spark, folder):
    events = read(spark, folder, "events").select("user_id", "ts", F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "ok").alias("result"))
    as_of = events.agg(F.max("ts")).scalar()
    out = health.reputation(events, "user_id", "result", "ts", as_of)
    return out.select("user_id", "made", "ok", "passed", "attempts", F.round("uptime", 6).alias("uptime"), F.round("integrity", 6).alias("integrity"))


@query("""WITH daily AS (SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'click') AS passed FROM events GROUP BY 1, 2)
SELECT user_id, day, (sum(n) OVER w)::BIGINT AS made, (sum(passed) OVER w)::BIGINT AS passed FROM daily
WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def reputation_rolling(spark, folder):
    daily = read(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("p"))
    week = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select("user_id", "day", F.sum("n").over(week).alias("made"), F.sum("p").over(week).alias("passed"))


@query(f"""WITH c AS (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // {CHUNK_CHARS} + 1)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, s::INT AS sequence, sha256(text[s * {CHUNK_CHARS} + 1 : (s + 1) * {CHUNK_CHARS}]) AS hash, length(text[s * {CHUNK_CHARS} + 1 : (s + 1) * {CHUNK_CHARS}])::BIGINT AS length FROM c""")
def chunk_manifest(spark, folder):
    return chunking.manifest(chunking.chunk(read(spark, folder, "documents"), ["doc_id"], "text", CHUNK_CHARS), ["doc_id"])


@query()
def chunk_manifest_blake3(spark, folder):
    """The manifest under the hash that names chunks and blobs in the modelled system; no SQL function has it."""
    return chunking.manifest(chunking.chunk(read(spark, folder, "documents"), ["doc_id"], "text", CHUNK_CHARS), ["doc_id"], blake3)


@query("SELECT doc_id, strlen(text)::BIGINT AS size, strlen(text)::BIGINT + 40 AS sealed_bytes, true AS same FROM documents WHERE text IS NOT NULL")
def sealed_blobs(spark, folder):
    """Texts sealed by convergent encryption and opened again: sizes, and whether the bytes came back."""
    key = bytes(range(32))
    docs = read(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("plain"))
    sealed = docs.withColumn("sealed", sealing.encrypt(F.col("plain"), key))
    opened = F.coalesce(sealing.decrypt(F.col("sealed"), key) == F.col("plain"), F.lit(False))
    return sealed.select("doc_id", F.octet_length("plain").cast("long").alias("size"), F.octet_length("sealed").cast("long").alias("sealed_bytes"), opened.alias("same"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc_id, count(*) AS refs, max(strlen(text))::BIGINT AS size FROM documents GROUP BY 1")
def dedup_blobs(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return chunking.dedup(docs, "hash", "doc_id", "size")


@query("""WITH b AS (SELECT source, sha256(text) AS h, count(*) AS n, max(strlen(text)) AS s FROM documents GROUP BY 1, 2)
SELECT source, sum(n * s)::BIGINT AS total_bytes, sum(s)::BIGINT AS unique_bytes, round(sum(s)::DOUBLE / nullif(sum(n * s)::DOUBLE, 0), 6) AS ratio FROM b GROUP BY source""")
def dedup_savings(spark, folder):
    docs = read(spark, folder, "documents").select("source", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return chunking.savings(docs, "source", "hash", "size")


@query("""WITH m AS (SELECT max(doc_id) // 2 AS h FROM documents), s AS (SELECT sha256(text) AS hash FROM documents WHERE doc_id < (SELECT h FROM m))
SELECT doc_id AS position, sha256(text) AS hash FROM documents WHERE doc_id >= (SELECT h FROM m) AND sha256(text) NOT IN (SELECT hash FROM s)""")
def needed_items(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("position"), F.sha2("text", 256).alias("hash"))
    half = F.floor(docs.agg(F.max("position")).scalar() / 2)
    return chunking.needed(docs.where(F.col("position") >= half), docs.where(F.col("position") < half))


@query("""WITH o AS (SELECT source AS batch, doc_id AS position, sha256(text) AS hash FROM documents)
SELECT batch, position, hash, position > min(position) OVER (PARTITION BY batch, hash) AS duplicate FROM o""")
def batch_duplicates(spark, folder):
    offer = read(spark, folder, "documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("position"), F.sha2("text", 256).alias("hash"))
    return chunking.batch_duplicates(offer).select("batch", "position", "hash", "duplicate")


@query("""SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS valid FROM documents""")
def hash_validation(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("data"), F.sha2("text", 256).alias("claimed"))
    good, bad = chunking.valid(docs, F.col("data"), F.col("claimed"))
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid")))


@query("SELECT doc_id, sha256(text) AS hash, true AS same FROM documents WHERE length(text) > 0")
def restore_reassemble(spark, folder):
    docs = read(spark, folder, "documents")
    parts = chunking.chunk(docs, ["doc_id"], "text", CHUNK_CHARS)
    whole = chunking.reassemble(parts, ["doc_id"]).select("doc_id", F.sha2("content", 256).alias("hash"))
    return whole.join(docs.select("doc_id", F.sha2("text", 256).alias("original")), "doc_id").select("doc_id", "hash", (F.col("hash") == F.col("original")).alias("same"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def orphans(spark, folder):
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.lit(0).alias("owner"), F.lit(False).alias("special"), "o_orderkey", "o_custkey")
    used = read(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("hash"), F.lit(0).alias("owner"))
    return catalog.orphans(orders, used).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def not_also_peer(spark, folder):
    clients = read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("public_key"), F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("last_seen"), "c_custkey", "c_name")
    peers = read(spark, folder, "events").select(F.col("user_id").cast("string").alias("public_key"))
    return health.list_clients(clients, peers).select("c_custkey", "c_name")


LAST_ORDER = "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders{}) WHERE n = 1"
AS_OF = "1995-06-30"


@query(LAST_ORDER.format(""))
def latest_version(spark, folder):
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return catalog.version_as_of(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@query(LAST_ORDER.format(f" WHERE o_orderdate <= TIMESTAMP '{AS_OF}'"))
def version_asof(spark, folder):
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return catalog.version_as_of(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderdate") <= F.lit(AS_OF).cast("timestamp_ntz"))


@query("""SELECT o_custkey AS file_id, o_orderkey AS version_id, c_nationkey::BIGINT AS backup_id, TIMESTAMP '2020-01-01' + to_days(c_nationkey) AS start_time, n_name AS status,
  o_orderdate AS mtime, o_totalprice AS size, o_orderpriority AS hash_plain FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def history(spark, folder):
    owner = read(spark, folder, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").cast("long").alias("backup_id"))
    orders = read(spark, folder, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("hash_plain"))
    start = F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("n_nationkey"))
    backups = read(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("id"), start.alias("start_time"), F.col("n_name").alias("status"))
    return catalog.history(orders.join(owner, "file_id"), backups)


@query("""SELECT n_name AS dir_path, c_name AS filename, max(o_orderdate) AS mtime FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE c_acctbal >= 0 GROUP BY c_custkey, c_name, n_name""")
def directory_state(spark, folder):
    directories = read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_path"))
    files = read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dir_id"), F.col("c_name").alias("filename"), (F.col("c_acctbal") < 0).alias("deleted"))
    versions = read(spark, folder, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderdate").alias("mtime"), F.struct("o_orderdate", "o_orderkey").alias("id"))
    return catalog.directory_state(directories, files, versions)


SNAPSHOT = "SELECT o_custkey, max(o_orderdate) AS m FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY 1 HAVING arg_max(o_orderpriority, {{'d': o_orderdate, 'k': o_orderkey}}) NOT LIKE '{}%'"


@query(f"""WITH a AS ({SNAPSHOT.format("1995-01-01", 1)}), b AS ({SNAPSHOT.format("1996-01-01", 2)})
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.m IS NULL THEN 'new' WHEN b.m IS NULL THEN 'deleted' WHEN b.m > a.m THEN 'modified' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def snapshot_diff(spark, folder):
    """Customers' newest orders at two times; one whose newest order has a certain priority has been deleted by then."""
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")

    def snapshot(end: str, deleted: str) -> DataFrame:
        newest = catalog.version_as_of(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
        return newest.where(~F.col("o_orderpriority").startswith(deleted)).select("o_custkey", F.col("o_orderdate").alias("mtime"))

    return catalog.changes(snapshot("1995-01-01", "1"), snapshot("1996-01-01", "2"), ["o_custkey"])


@query("SELECT page_id, url FROM pages WHERE ends_with(lower(url), lower('#TOP'))")
def path_suffix(spark, folder):
    return read(spark, folder, "pages").where(paths.ends_with(F.col("url"), F.lit("#TOP"))).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), lower('EXAMPLE.NET/en'))")
def path_contains(spark, folder):
    return read(spark, folder, "pages").where(paths.contains(F.col("url"), F.lit("EXAMPLE.NET/en"))).select("page_id", "url")


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '/[^/]*$', '') AS dir_path, regexp_extract(url, '[^/]*$') AS filename,
  '/restore/' || regexp_replace(regexp_replace(url, '^https?:/', ''), '^/+', '') AS target FROM pages""")
def path_parts(spark, folder):
    path = F.regexp_replace("url", "^https?:/", "")
    parts = catalog.split_path(read(spark, folder, "pages").select("page_id", path.alias("path")), "path")
    return parts.select("page_id", "dir_path", "filename", paths.restore_path(F.col("path"), F.lit("/nowhere"), F.lit("/restore")).alias("target"))


@query("""SELECT page_id, url FROM pages WHERE NOT (regexp_replace(url, '^https?:/', '') = '/m.ththth.example.net/en' OR starts_with(regexp_replace(url, '^https?:/', ''), '/m.ththth.example.net/en/')
  OR starts_with(regexp_replace(url, '^https?:/', ''), '/ththre.example.com/'))""")
def crawl_excludes(spark, folder):
    from ..sources.files import exclude

    pages = read(spark, folder, "pages").select("page_id", "url", F.regexp_replace("url", "^https?:/", "").alias("path"))
    excludes = spark.createDataFrame([("/m.ththth.example.net/en",), ("/ththre.example.com",)], "prefix string")
    return exclude(pages, excludes).select("page_id", "url")


GC_STATE = """CASE WHEN o_orderstatus = 'O' THEN 'live' WHEN o_orderpriority LIKE '5%' THEN 'limbo'
  WHEN o_orderdate < TIMESTAMP '1998-01-01' - (CASE WHEN o_orderpriority LIKE '1%' THEN INTERVAL 1440 DAY ELSE INTERVAL 720 DAY END) THEN 'wasted' ELSE 'live' END"""


def blobs_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as blobs: open ones are referenced, priority 5 was never deleted, priority 1 is special."""
    priority = F.col("o_orderpriority")
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("ref_count"),
        F.when(~priority.startswith("5"), F.col("o_orderdate")).alias("deleted_at"), priority.startswith("1").alias("special"),
    )


GC_TIME, GC_MINUTES = "1998-01-01", (720 * 1440, 1440 * 1440)


@query(f"""SELECT l_partkey AS shard_id, p_partkey * 1000 AS shard_size, sum(l_quantity::BIGINT)::BIGINT AS total, coalesce(sum(l_quantity::BIGINT) FILTER (state = 'wasted'), 0)::BIGINT AS wasted,
  round(coalesce(sum(l_quantity::BIGINT) FILTER (state = 'wasted'), 0)::DOUBLE / sum(l_quantity::BIGINT), 6) AS ratio
FROM lineitem JOIN (SELECT o_orderkey, {GC_STATE} AS state FROM orders) ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey AND p_size >= 10
GROUP BY 1, 2 HAVING coalesce(sum(l_quantity::BIGINT) FILTER (state = 'wasted'), 0)::DOUBLE / sum(l_quantity::BIGINT) >= 0.2""")
def gc_waste(spark, folder):
    locations = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("blob_hash"), F.col("l_partkey").alias("shard_id"), F.col("l_quantity").cast("long").alias("length"))
    shards = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 10, "sealed").otherwise("open").alias("status"), (F.col("p_partkey") * 1000).alias("size"))
    found = health.waste(locations, blobs_of_orders(spark, folder), shards, F.lit(GC_TIME).cast("timestamp_ntz"), *GC_MINUTES, 0.2)
    return found.withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {PACKED}, state AS (SELECT hash, size, ord, ord % 6 = 0 AS wasted FROM blobs),
candidates AS (SELECT shard_id FROM packed JOIN state USING (hash) GROUP BY 1
  HAVING sum(length) = {SHARD_BYTES} AND shard_id < (SELECT max(shard_id) FROM packed) AND coalesce(sum(length) FILTER (wasted), 0)::DOUBLE / sum(length) >= 0.15),
doomed AS (SELECT DISTINCT hash FROM packed WHERE shard_id IN (FROM candidates)),
keepers AS (SELECT hash, size, ('0x' || md5(hash)[1:15])::BIGINT AS ord FROM state WHERE hash IN (FROM doomed) AND NOT wasted), {packed_sql("moved", "keepers")}
SELECT hash AS blob_hash, shard_id, piece_index, "offset", length, sequence FROM packed WHERE hash NOT IN (FROM doomed)
UNION ALL SELECT hash, shard_id + (SELECT max(shard_id) + 1 FROM packed), piece_index, "offset", length, sequence FROM moved""")
def gc_repack(spark, folder):
    """Locations after the shards with much waste are packed anew; every sixth blob is long deleted, every third without references."""
    locations = shard_packing(spark, folder).withColumnRenamed("hash", "blob_hash")
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    blobs = blobs_of_documents(spark, folder).select(
        "hash", "size", F.when(F.col("ord") % 3 == 0, 0).otherwise(1).alias("ref_count"), F.when(F.col("ord") % 6 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("deleted_at"), F.lit(False).alias("special"),
    )
    shards = shard_summary(spark, folder).select(F.col("shard_id").alias("id"), F.when(F.col("sealed"), "sealed").otherwise("open").alias("status"), F.lit(SHARD_BYTES).alias("size"))
    candidates = health.waste(locations, blobs, shards, as_of, 0, 0, 0.15)
    return health.repack(locations, blobs, candidates, as_of, 0, 0, SHARD_BYTES // SHARD_PIECES, SHARD_PIECES)[0]


@query(f"SELECT o_orderkey, {GC_STATE} AS state FROM orders")
def gc_live(spark, folder):
    state = health.liveness(F.col("ref_count"), F.col("deleted_at"), F.col("special"), F.lit(GC_TIME).cast("timestamp_ntz"), *GC_MINUTES)
    return blobs_of_orders(spark, folder).select(F.col("hash").alias("o_orderkey"), state.alias("state"))


@query("""WITH s AS (SELECT o.o_orderkey, o.o_orderpriority LIKE '1%' AS mirrored, count(DISTINCT l_linenumber) AS pieces, count(DISTINCT l_suppkey) AS peers
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F' GROUP BY 1, 2)
SELECT o_orderkey AS id, mirrored, pieces, peers, CASE WHEN (mirrored AND peers >= 2) OR (NOT mirrored AND pieces >= 4) THEN 'full' WHEN peers > 0 THEN 'partial' ELSE 'none' END AS replication FROM s""")
def replication_status(spark, folder):
    return health.replication(*shards_of_orders(spark, folder), 3, 1)


def shards_of_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as sealed shards, their lines as pieces on suppliers."""
    shards = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").startswith("1").alias("mirrored"), F.lit("sealed").alias("status"))
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("shard_id"), F.col("l_linenumber").alias("piece_index"), F.col("l_suppkey").alias("peer_id"), F.when(F.col("l_linestatus") == "F", "uploaded").otherwise("pending").alias("status"))
    return shards, lines


@query("""WITH s AS (SELECT o.o_orderkey, o.o_orderpriority LIKE '1%' AS mirrored, count(DISTINCT l_linenumber) AS pieces, count(DISTINCT l_suppkey) AS peers
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F' GROUP BY 1, 2)
SELECT count(*) AS shards, count(*) FILTER (full_) AS "full", count(*) FILTER (NOT full_ AND peers > 0) AS partial,
  (SELECT count(DISTINCT text) FROM documents) AS blobs, (SELECT sum(size)::BIGINT FROM (SELECT max(strlen(text)) AS size FROM documents GROUP BY text)) AS own_bytes,
  (SELECT coalesce(sum(p_size), 0)::BIGINT FROM part) AS hosted_bytes
FROM (SELECT *, (mirrored AND peers >= 2) OR (NOT mirrored AND pieces >= 4) AS full_ FROM s)""")
def status_report(spark, folder):
    hosted = read(spark, folder, "part").select(F.col("p_size").cast("long").alias("size"))
    return health.status_report(*shards_of_orders(spark, folder), blobs_of_documents(spark, folder), hosted, 3, 1)


@query("""WITH dead AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000 AND s_nationkey <> 3),
s AS (SELECT o.o_orderkey AS id, o.o_orderpriority LIKE '1%' AS mirrored, count(DISTINCT l_linenumber) AS pieces, count(DISTINCT l_suppkey) AS peers
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F' AND l.l_suppkey NOT IN (SELECT s_suppkey FROM dead) GROUP BY 1, 2)
SELECT * FROM s WHERE CASE WHEN mirrored THEN peers < 2 ELSE pieces < 4 END""")
def repair_candidates(spark, folder):
    shards, _ = shards_of_orders(spark, folder)
    return health.repair_candidates(shards, lost_pieces(spark, folder), 3, 1)


@query("""SELECT l_orderkey AS shard_id, l_linenumber AS piece_index, l_suppkey AS peer_id, CASE WHEN l_linestatus <> 'F' THEN 'pending' WHEN s_acctbal < 2000 AND s_nationkey <> 3 THEN 'lost' ELSE 'uploaded' END AS status
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def lost_pieces(spark, folder):
    """Pieces after those of peers unseen for a week are marked; blocked peers are exempt."""
    _, lines = shards_of_orders(spark, folder)
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    seen = as_of - F.make_dt_interval(F.when(F.col("s_acctbal") < 2000, 10).otherwise(1))
    peers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), seen.alias("last_seen"), F.when(F.col("s_nationkey") == 3, "blocked").otherwise("trusted").alias("status"))
    return health.mark_lost(lines, peers, as_of, 168)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS shard_id, l_linenumber AS piece_index, l_suppkey AS peer_id FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT user_id, event_id % 7 AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT p.*, coalesce(c.n, 0) AS remaining FROM p LEFT JOIN c ON c.user_id = p.shard_id AND c.k = p.piece_index WHERE coalesce(c.n, 0) < 3""")
def challenge_refill(spark, folder):
    _, lines = shards_of_orders(spark, folder)
    # challenges are left for (user, event number modulo 7), whoever the peer is
    left = read(spark, folder, "events").select(F.col("user_id").alias("shard_id"), (F.col("event_id") % 7).cast("int").alias("piece_index"))
    per_peer = lines.where("status = 'uploaded'").select("shard_id", "piece_index", "peer_id").distinct().join(left, ["shard_id", "piece_index"])
    return health.refill(lines, per_peer)


@query("""SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256(event_id::VARCHAR || '|42'), event_id) AS n FROM events) WHERE n = 1""")
def challenge_pick(spark, folder):
    return health.pick(read(spark, folder, "events").select("event_type", "event_id", "user_id"), ["event_id"], 42, ["event_type"])


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unavailable' WHEN doc_id % 3 = 0 AND substr(text, 11, 32) <> upper(substr(text, 11, 32)) THEN 'fail' ELSE 'pass' END AS result
FROM documents WHERE 10 + 32 <= n_chars""")
def challenge_judge(spark, folder):
    docs = health.in_bounds(read(spark, folder, "documents").withColumn("offset", F.lit(10)), "offset", "n_chars")
    expected = F.when(F.col("doc_id") % 3 == 0, F.upper(F.substring("text", 11, 32))).otherwise(F.substring("text", 11, 32))
    return docs.select("doc_id", health.judge(expected, F.when(F.col("doc_id") % 5 != 0, F.col("text")), F.col("offset")).alias("result"))


@query("""WITH used AS (SELECT o_custkey, sum(o_totalprice) AS used FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
inc AS (SELECT o_custkey, sum(o_totalprice) AS inc FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT c_custkey, round(coalesce(i.inc, 0), 2) AS incoming, c_mktsegment <> 'MACHINERY' AND (c_acctbal < 0 OR round(coalesce(u.used, 0), 2) + round(coalesce(i.inc, 0), 2) <= c_acctbal * 200) AS accepted
FROM customer LEFT JOIN used u ON u.o_custkey = c_custkey LEFT JOIN inc i ON i.o_custkey = c_custkey""")
def quota_check(spark, folder):
    orders, end = read(spark, folder, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    used = orders.where(F.col("o_orderdate") < end).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("used"))
    incoming = orders.where(F.col("o_orderdate") >= end).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("incoming"))
    customers = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").cast("string").alias("public_key"), F.when(F.col("c_mktsegment") == "MACHINERY", "pending").otherwise("trusted").alias("status"),
        F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.when(F.col("c_acctbal") == 0, -1.0).otherwise(F.col("c_acctbal") * 200)).alias("max_storage_size"),
    )
    clients = customers.join(used, "o_custkey", "left").withColumn("current_storage_size", F.coalesce("used", F.lit(0.0)))
    offers = customers.join(incoming, "o_custkey", "left").select("public_key", F.coalesce("incoming", F.lit(0.0)).alias("incoming"))
    return health.client_quota(offers, clients).select(F.col("public_key").cast("long").alias("c_custkey"), "incoming", "accepted")


@query("""WITH mine AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), theirs AS (SELECT l_suppkey, sum(l_quantity)::BIGINT AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey AS peer_id, (s_nationkey * 100)::BIGINT AS incoming, (coalesce(m.n, 0) + 1) * 10 AS allowance,
  CASE WHEN s_acctbal >= 5000 THEN coalesce(t.b, 0) + s_nationkey * 100 <= 5000 WHEN s_acctbal >= 0 THEN coalesce(t.b, 0) + s_nationkey * 100 <= (coalesce(m.n, 0) + 1) * 10 ELSE false END AS accepted
FROM supplier LEFT JOIN mine m ON m.l_suppkey = s_suppkey LEFT JOIN theirs t ON t.l_suppkey = s_suppkey""")
def reciprocity(spark, folder):
    suppliers, lines = read(spark, folder, "supplier"), read(spark, folder, "lineitem")
    peers = suppliers.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") >= 5000, "trusted").when(F.col("s_acctbal") >= 0, "untrusted").otherwise("blocked").alias("status"), F.lit(5000).cast("long").alias("max_storage_size"))
    outbound = lines.select(F.col("l_suppkey").alias("peer_id"), F.when(F.col("l_linestatus") == "F", "uploaded").alias("status"))
    hosted = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("peer_id"), F.col("l_quantity").cast("long").alias("size"))
    offers = suppliers.select(F.col("s_suppkey").alias("peer_id"), (F.col("s_nationkey") * 100).cast("long").alias("incoming"))
    return health.peer_quota(offers, peers, outbound, hosted, 10)


@query("""SELECT *, hosted_bytes + own_bytes AS total FROM (SELECT (SELECT coalesce(sum(l_quantity), 0)::BIGINT FROM lineitem) AS hosted_bytes, (SELECT count(*) FROM orders) AS own_blobs,
  (SELECT coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT FROM orders) AS own_bytes)""")
def storage_totals(spark, folder):
    hosted = read(spark, folder, "lineitem").agg(F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)))
    own = read(spark, folder, "orders").agg(F.count("*").alias("own_blobs"), F.coalesce(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), F.lit(0)).alias("own_bytes"))
    return own.withColumn("hosted_bytes", hosted.scalar()).withColumn("total", F.col("hosted_bytes") + F.col("own_bytes"))


@query("""WITH used AS (SELECT l_suppkey, sum(l_quantity)::BIGINT AS used FROM lineitem GROUP BY 1), held AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey = 1 AND l_linestatus = 'O')
SELECT s_suppkey FROM supplier LEFT JOIN used ON l_suppkey = s_suppkey WHERE s_suppkey NOT IN (SELECT l_suppkey FROM held) AND s_nationkey <> 3 AND
 ((s_acctbal < 5000 AND s_nationkey % 2 = 0 AND coalesce(used, 0) + 100 <= 15000) OR (s_acctbal >= 5000 AND coalesce(used, 0) + 100 <= 15000))""")
def eligible_peers(spark, folder):
    lines = read(spark, folder, "lineitem")
    used = lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("outbound_storage_size"))
    peers = read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit(1).cast("long").alias("shard_id"), F.when(F.col("s_nationkey") == 3, "blocked").when(F.col("s_acctbal") < 5000, "untrusted").otherwise("trusted").alias("status"),
        F.when(F.col("s_nationkey") % 2 == 0, "none").otherwise("testing").alias("adoption_status"), F.lit(15000).alias("max_storage_size"),
    )
    peers = peers.join(used, "id", "left").fillna(0, ["outbound_storage_size"])
    outbound = lines.where("l_orderkey = 1 AND l_linestatus = 'O'").select(F.col("l_orderkey").alias("shard_id"), F.col("l_suppkey").alias("peer_id"), F.lit("pending").alias("status"))
    fit = placement.eligible(F.lit(False), F.lit(100))
    return placement.lacking(peers.where(fit), outbound).select(F.col("id").alias("s_suppkey"))


@query("""WITH held AS (SELECT c_nationkey AS shard_id, c_custkey % 101 AS peer_id, c_acctbal < 0 AS lost FROM customer),
d AS (SELECT n_nationkey AS shard_id, s_suppkey AS peer_id FROM nation, supplier WHERE n_regionkey <> 1 AND s_nationkey <> 3)
SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.shard_id = d.shard_id AND h.peer_id = d.peer_id)
  OR EXISTS (SELECT 1 FROM held h WHERE h.shard_id = d.shard_id AND h.peer_id = d.peer_id AND lost)""")
def mirror_fan_out(spark, folder):
    shards = read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") != 1).alias("mirrored"))
    peers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") == 3, "blocked").otherwise("trusted").alias("status"))
    outbound = read(spark, folder, "customer").select(F.col("c_nationkey").alias("shard_id"), (F.col("c_custkey") % 101).alias("peer_id"), F.when(F.col("c_acctbal") < 0, "lost").otherwise("uploaded").alias("status"))
    return placement.mirror_fan_out(shards, peers, outbound)


@query("""WITH d AS (SELECT user_id, event_type, event_id, CASE WHEN value >= 50 THEN 1 ELSE -1 END AS delta FROM events),
g AS (SELECT user_id, event_type, list(delta ORDER BY event_id) AS ds FROM d GROUP BY 1, 2)
SELECT user_id, event_type, list_reduce(list_prepend(0, ds), lambda n, x: greatest(n + x, 0))::BIGINT AS refs FROM g""")
def refcount_release(spark, folder):
    log = read(spark, folder, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") >= 50, 1).otherwise(-1).cast("long").alias("delta"))
    return state.clamped_total(log, ["user_id", "event_type"], ["event_id"], "delta", "refs")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id".replace("(ts, event_id)", "{'a': ts, 'b': event_id}"))
def latest_wins_upsert(spark, folder):
    return state.latest_wins(read(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY user_id")
def first_wins_insert(spark, folder):
    return state.first_wins(read(spark, folder, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT event_type, max({'v': value, 'e': event_id}).e AS event_id, max(value) AS value FROM events GROUP BY event_type")
def newest_special(spark, folder):
    return state.latest_wins(read(spark, folder, "events").select("event_type", "value", "event_id"), ["event_type"], ["value", "event_id"]).select("event_type", "event_id", "value")


@query("""SELECT c_custkey, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '1997-01-01' - INTERVAL 180 DAY""")
def stale_peers(spark, folder):
    as_of = F.lit("1997-01-01").cast("timestamp_ntz")
    last = read(spark, folder, "orders").where(F.col("o_orderdate") < as_of).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    customers = read(spark, folder, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return customers.where(health.never_or_stale(F.col("last_seen"), as_of, days=180))


@query("SELECT l_orderkey, bit_xor(l_partkey) AS parity, count(*) AS pieces FROM lineitem GROUP BY 1")
def xor_parity(spark, folder):
    return erasure.xor_parity(read(spark, folder, "lineitem"), "l_orderkey", "l_partkey")


@query("""SELECT p_partkey, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', round(b / 1073741824.0, 2)) WHEN b >= 1048576 THEN printf('%.2f MB', round(b / 1048576.0, 2)) WHEN b >= 1024 THEN printf('%.2f KB', round(b / 1024.0, 2)) ELSE b::VARCHAR || ' B' END AS size,
  CASE WHEN p_name = '' THEN '(empty file)' ELSE sha256(p_name)[1:32] || '...' END AS shown, (p_size * 64) & 511 AS mode
FROM (SELECT *, floor(p_retailprice)::BIGINT * p_size * p_size * p_size AS b FROM part)""")
def display_formats(spark, folder):
    size = F.floor("p_retailprice").cast("long") * F.col("p_size") * F.col("p_size") * F.col("p_size")
    shown = F.when(F.col("p_name") == "", F.lit("")).otherwise(F.sha2("p_name", 256))
    return read(spark, folder, "part").select("p_partkey", paths.format_bytes(size).alias("size"), paths.short_hash(shown).alias("shown"), paths.permissions(F.col("p_size") * 64).alias("mode"))


@query("""SELECT source, sum(strlen(text))::BIGINT AS bytes, count(*) AS files, round(sum(strlen(text)) / CASE WHEN count(*) % 5 = 0 THEN 0.001 ELSE count(*) % 5 END, 3)::DOUBLE AS bytes_per_second FROM documents GROUP BY 1""")
def transfer_rates(spark, folder):
    """Rates of 0 to 4 seconds, by the number of files."""
    sums = read(spark, folder, "documents").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("files"))
    return sums.withColumn("bytes_per_second", F.round(paths.rate_per_second(F.col("bytes"), F.col("files") % 5), 3))


@query()
def placement_greedy(spark, folder):
    """Every order line as a piece on a supplier; sequential, so checked against a simulation."""
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("shard_id"), F.col("l_linenumber").alias("piece_index"), "l_quantity")
    # dealt by shard, which placement needs as well, so lines are shuffled once
    queue = lines.repartition("shard_id").groupBy("shard_id", "piece_index").agg(F.max("l_quantity").cast("long").alias("size"))
    queue = queue.select((F.col("shard_id") * 10 + F.col("piece_index")).alias("ord"), "shard_id", "piece_index", "size", F.lit(False).alias("mirrored"))
    peers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("trusted").alias("status"), F.lit("none").alias("adoption_status"), F.col("s_acctbal").alias("last_seen"), F.lit(20_000).alias("max_storage_size"), F.lit(0).alias("outbound_storage_size"))
    return placement.place(queue, peers, spark.createDataFrame([], "shard_id long, peer_id long, status string"))


def parts_of_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes of every location that ``shard_packing`` gives: shard_id, piece_index, offset, data."""
    texts = read(spark, folder, "documents").select(F.col("text").cast("binary").alias("bytes")).where("bytes IS NOT NULL").groupBy(paths.content_hash(F.col("bytes")).alias("hash")).agg(F.first("bytes").alias("bytes"))
    before = Window.partitionBy("hash").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    located = shard_packing(spark, folder).withColumn("begin", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int"))
    data = F.substring("bytes", F.col("begin") + 1, F.col("length").cast("int"))
    return located.join(texts, "hash").select("shard_id", "piece_index", "offset", data.alias("data"))


@query(f"""WITH {PACKED} SELECT DISTINCT shard_id, unnest([shard_id % 4, (shard_id + 1) % 4])::INT AS piece_index, true AS recovered FROM packed""")
def erasure_recovery(spark, folder):
    """Pieces of the packed whole documents, encoded 4 + 2, recovered after two data pieces of each shard are lost, against the hashes of the packed bytes."""
    size, parts = SHARD_BYTES // SHARD_PIECES, parts_of_pieces(spark, folder)
    coded = erasure.encode(parts, SHARD_PIECES, 2, size)
    gone = (F.col("piece_index") == F.col("shard_id") % 4) | (F.col("piece_index") == (F.col("shard_id") + 1) % 4)
    found = erasure.reconstruct(coded.where(~gone), SHARD_PIECES, 2)
    packed = chunking.reassemble(parts.where(gone), ["shard_id", "piece_index"], "offset")
    hashes = packed.select("shard_id", "piece_index", F.sha2(F.rpad("content", F.lit(size), F.lit(b"\0")), 256).alias("hash"))
    both = found.join(hashes, ["shard_id", "piece_index"], "left")
    # a piece beyond the last byte is all zeros
    hash_ = F.coalesce("hash", F.sha2(F.rpad(F.lit(b""), F.lit(size), F.lit(b"\0")), 256))
    return both.select("shard_id", "piece_index", (F.sha2("data", 256) == hash_).alias("recovered"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, true AS same FROM documents")
def compressed_roundtrip(spark, folder):
    """Whether the texts come back from zstd, with their sizes."""
    docs = read(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    back = docs.select("doc_id", "data", codecs.decompress(codecs.compress(F.col("data"))).alias("back"))
    return back.select("doc_id", F.length("back").cast("long").alias("bytes"), (F.col("back") == F.col("data")).alias("same"))


@query("SELECT c_custkey, upper((sha256(c_custkey::VARCHAR || ':0') || sha256(c_custkey::VARCHAR || ':1') || sha256(c_custkey::VARCHAR || ':2') || sha256(c_custkey::VARCHAR || ':3'))[1:200]) AS hex FROM customer")
def generated_bytes(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", F.hex(codecs.test_bytes(F.col("c_custkey"), 100)).alias("hex"))


# lookups, restore and download


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def lookup_keys(spark, folder):
    wanted = read(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.lookup(read(spark, folder, "orders"), wanted, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT e.event_id, c.c_custkey AS peer_id FROM events e JOIN customer c ON c.c_name = 'Customer#' || lpad(e.user_id::VARCHAR, 9, '0')")
def by_public_key(spark, folder):
    offers = read(spark, folder, "events").select("event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("public_key"))
    return catalog.by_public_key(offers, read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("public_key")))


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT user_id FROM events")
def common_keys(spark, folder):
    return state.common(read(spark, folder, "events").select(F.col("user_id").alias("key")), read(spark, folder, "customer").select(F.col("c_custkey").alias("key")), ["key"])


@query("SELECT c_custkey AS file_id, n_name || '/' || c_name AS path, c_acctbal < 0 AS deleted FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(n_name || '/' || c_name) LIKE '%/customer#000%7_'")
def find_files(spark, folder):
    """Files by a pattern; what is deleted is found as well."""
    directories, files = directories_and_files(spark, folder)
    return catalog.find_files(directories, files, "/CUSTOMER#000%7_", include_deleted=True)


def directories_and_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations as directories of customers."""
    directories = read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_path"))
    files = read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dir_id"), F.col("c_name").alias("filename"), (F.col("c_acctbal") < 0).alias("deleted"))
    return directories, files


@query("""WITH last AS (SELECT o_custkey, max(o_orderkey) AS version FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
content AS (SELECT l_orderkey, string_agg(p_name, '' ORDER BY l_linenumber, p_name) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT '/restored/' || n_name || '/' || c_name AS path, sha256(coalesce(text, '')) AS hash, year(o_orderdate) AS mtime, 420 AS mode
FROM last JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_orderkey = version LEFT JOIN content ON l_orderkey = version WHERE c_acctbal >= 0""")
def restore_files(spark, folder):
    """Every customer's newest order of a backup before 1997, restored from its parts."""
    directories, files = directories_and_files(spark, folder)
    orders = read(spark, folder, "orders")
    versions = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.year("o_orderdate").alias("backup_id"), F.year("o_orderdate").alias("mtime"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(0o644).alias("mode"),
    )
    parts = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("hash_encrypted"))
    blobs = read(spark, folder, "part").select(F.col("p_partkey").alias("hash_encrypted"), F.col("p_name").cast("binary").alias("data"))
    found = catalog.find_files(directories, files, "/", "contains")
    restored = catalog.restore(found, versions, parts, blobs, "/nowhere", "/restored", backup_id=1996)
    return restored.select("path", F.sha2("content", 256).alias("hash"), "mtime", "mode")


@query("SELECT DISTINCT sha256(text) AS hash, true AS whole FROM documents WHERE length(text) > 0")
def download_ranges(spark, folder):
    """Every text from its byte ranges in the packed pieces."""
    pieces = chunking.reassemble(parts_of_pieces(spark, folder), ["shard_id", "piece_index"], "offset").withColumnRenamed("content", "data")
    requested = blobs_of_documents(spark, folder).where("size > 0")
    found, missing = chunking.download(requested, shard_packing(spark, folder).withColumnRenamed("hash", "blob_hash"), pieces)
    return found.select("hash", (F.sha2("content", 256) == F.col("hash")).alias("whole")).unionByName(missing.select("hash", F.lit(False).alias("whole")))


@query("SELECT DISTINCT sha256(text) AS hash, strlen(text)::BIGINT AS bytes FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')")
def hosted_download(spark, folder):
    """Requested texts that are hosted for a peer: French ones."""
    docs = read(spark, folder, "documents").where("text IS NOT NULL")
    stored = docs.where("lang = 'fr'").select(F.concat(F.lit("peer_"), F.sha2("text", 256)).alias("key"), F.col("text").cast("binary").alias("data")).dropDuplicates(["key"])
    found, _ = hosted_items(docs.select(F.sha2("text", 256).alias("hash")), stored)
    return found.select("hash", F.length("data").cast("long").alias("bytes"))


@query("""SELECT source || ':' || (doc_id // 500) AS batch, coalesce(string_agg(position::VARCHAR, ',' ORDER BY position) FILTER (NOT known), '') AS needed
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, doc_id // 500 ORDER BY doc_id) - 1 AS position, sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') AS known FROM documents) GROUP BY 1""")
def needed_indices(spark, folder):
    """Positions of hashes in offers of up to 500 documents of a source that English ones don't cover."""
    docs = read(spark, folder, "documents").select("source", "doc_id", "lang", F.sha2("text", 256).alias("hash"))
    batch = F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 500).cast("string"))
    offers = docs.groupBy(batch.alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "hash"))), lambda x: x["hash"]).alias("hashes"))
    found = chunking.needed_indices(offers, docs.where("lang = 'en'"))
    return found.select("batch", F.array_join(F.transform("needed", lambda i: i.cast("string")), ",").alias("needed"))


# the catalogs' other changes


@query("SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN o_totalprice END AS o_totalprice FROM orders")
def append_versions(spark, folder):
    orders, cut = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), F.lit("1996-01-01").cast("timestamp_ntz")
    return catalog.append_versions(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut).drop("o_totalprice"))


@query("SELECT c_name, 0::BIGINT AS mtime FROM customer")
def reset_snapshot(spark, folder):
    return catalog.reset(read(spark, folder, "customer").select("c_name", F.col("c_custkey").alias("mtime")))


@query("SELECT s_suppkey, s_acctbal >= 5000 AND s_nationkey % 2 = 0 AS swapped, CASE WHEN s_acctbal >= 5000 AND s_nationkey % 2 = 0 THEN 'testing' WHEN s_nationkey % 2 = 0 THEN 'none' ELSE 'failed' END AS adoption_status FROM supplier")
def compare_and_swap(spark, folder):
    peers = read(spark, folder, "supplier").select("s_suppkey", "s_acctbal", F.when(F.col("s_nationkey") % 2 == 0, "none").otherwise("failed").alias("adoption_status"))
    return state.compare_and_swap(peers, "adoption_status", "none", "testing", F.col("s_acctbal") >= 5000).drop("s_acctbal")


@query("""SELECT o_orderkey, CASE WHEN gone THEN 0 ELSE 1 END AS ref_count, CASE WHEN gone AND o_orderstatus <> 'F' THEN TIMESTAMP '1999-01-01' WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at
FROM (SELECT *, o_orderpriority NOT LIKE '1%' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AS gone FROM orders)""")
def prune_blobs(spark, folder):
    """Orders as blobs, softly deleted where no filled line refers to them."""
    orders, owner = read(spark, folder, "orders"), F.lit(0).alias("owner")
    stored = orders.select(F.col("o_orderkey").alias("hash"), owner, F.col("o_orderpriority").startswith("1").alias("special"))
    used = read(spark, folder, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("hash"), owner)
    blobs = orders.select(F.col("o_orderkey").alias("hash"), F.lit(1).alias("ref_count"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return catalog.prune(blobs, catalog.orphans(stored, used), F.lit("1999-01-01").cast("timestamp_ntz")).withColumnRenamed("hash", "o_orderkey")


@query("""SELECT c_custkey AS id, CASE WHEN m IS NULL THEN 'running' ELSE 'completed' END AS status, m AS end_time, n AS offered_files, f AS uploaded_files
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def close_backups(spark, folder):
    done = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("backup_id")).agg(F.max("o_orderdate").alias("end_time"), F.count("*").alias("offered"), F.count_if(F.col("o_orderstatus") == "F").alias("uploaded"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("end_time", "timestamp_ntz"), ("offered_files", "long"), ("uploaded_files", "long"))]
    return catalog.close_backups(read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit("running").alias("status"), *nothing), done)


@query("SELECT '/queue/shard_' || l_orderkey || '_piece_' || l_linenumber AS path, l_orderkey AS shard_id, l_linenumber AS piece_index FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def queue_orphans(spark, folder):
    """Queued pieces of shards that are gone, beside files that are no pieces."""
    from ..sources.files import queue_entries, queue_orphans

    pieces = read(spark, folder, "lineitem").select(F.concat(F.lit("shard_"), "l_orderkey", F.lit("_piece_"), "l_linenumber").alias("filename"))
    names = pieces.unionByName(read(spark, folder, "customer").select(F.col("c_name").alias("filename"))).withColumn("path", F.concat(F.lit("/queue/"), "filename"))
    return queue_orphans(queue_entries(names), read(spark, folder, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")))


# peers and challenges


@query("""SELECT s_suppkey AS id, s_acctbal AS last_seen, CASE WHEN s_nationkey < 10 THEN 'active' ELSE 'pending' END AS kind, coalesce(made, 0) AS made, coalesce(ok, 0) AS ok, coalesce(passed, 0) AS passed,
  coalesce(attempts, 0) AS attempts, round(coalesce(100.0 * ok / made, 0), 6)::DOUBLE AS uptime, round(coalesce(100.0 * passed / nullif(attempts, 0), 0), 6)::DOUBLE AS integrity
FROM supplier LEFT JOIN (SELECT user_id, count(*) AS made, count(*) FILTER (event_type IN ('click', 'view', 'error')) AS ok, count(*) FILTER (event_type = 'click') AS passed,
  count(*) FILTER (event_type IN ('click', 'error')) AS attempts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1) ON user_id = s_suppkey""")
def list_peers(spark, folder):
    events = read(spark, folder, "events")
    status = F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "ok")
    results = events.select(F.col("user_id").alias("peer_id"), status.alias("status"), F.col("ts").alias("timestamp"))
    peers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("last_seen"), F.when(F.col("s_nationkey") < 10, "manual").otherwise("peer").alias("source"))
    listed = health.list_peers(peers, results, events.agg(F.max("ts")).scalar())
    return listed.select("id", "last_seen", "kind", "made", "ok", "passed", "attempts", F.round("uptime", 6).alias("uptime"), F.round("integrity", 6).alias("integrity"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) OR NOT TIMESTAMP '1997-01-01' - to_days(c_nationkey) < TIMESTAMP '1997-01-01' - INTERVAL 240 HOUR""")
def evict_peers(spark, folder):
    as_of = F.lit("1997-01-01").cast("timestamp_ntz")
    last = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_seen"))
    peers = read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (as_of - F.make_dt_interval(F.col("c_nationkey"))).alias("first_seen")).join(last, "id", "left")
    return health.evict(peers, as_of, 240).select("id")


@query("""SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE m IS NULL OR m < TIMESTAMP '1998-06-01' - INTERVAL 15 MINUTE""")
def due_for_contact(spark, folder):
    last = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_seen"))
    peers = read(spark, folder, "customer").select(F.col("c_custkey").alias("id")).join(last, "id", "left")
    return health.due_for_contact(peers, F.lit("1998-06-01").cast("timestamp_ntz")).select("id")


@query("""WITH t AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 2),
a AS (SELECT t.s, bool_and(h.p IS NOT NULL) AS ok FROM t LEFT JOIN h ON h.p = t.p AND h.s = t.s GROUP BY 1)
SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 'testing' WHEN s_nationkey % 3 = 1 AND due THEN CASE WHEN ok THEN 'completed' ELSE 'failed' END WHEN s_nationkey % 3 = 1 THEN 'testing' ELSE 'completed' END AS adoption_status,
  CASE WHEN s_nationkey % 3 = 1 AND due THEN CASE WHEN ok THEN 'trusted' ELSE 'discovered' END ELSE 'untrusted' END AS status
FROM (SELECT *, s_acctbal >= 3000 AS due, coalesce(a.ok, false) AS ok FROM supplier LEFT JOIN a ON a.s = s_suppkey)""")
def adoption_cycle(spark, folder):
    lines, as_of = read(spark, folder, "lineitem"), F.lit("2024-01-31").cast("timestamp_ntz")
    keys = [F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("peer_id")]
    kind = F.col("s_nationkey") % 3
    peers = read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(kind == 0, "none").when(kind == 1, "testing").otherwise("completed").alias("adoption_status"), (kind == 0).alias("adoption_requested"), F.lit("untrusted").alias("status"),
        (as_of - F.make_dt_interval(mins=F.when(F.col("s_acctbal") >= 3000, 60).otherwise(59))).alias("adoption_start_at"),
    )
    return health.adopt(peers, lines.where("l_returnflag = 'R'").select(*keys), lines.where("l_quantity > 2").select(*keys), as_of, 60).select("id", "adoption_status", "status")


@query("""SELECT DISTINCT l.l_orderkey AS shard_id, l.l_linenumber AS piece_index, l.l_suppkey AS peer_id, s_name AS public_key FROM lineitem l JOIN supplier ON s_suppkey = l.l_suppkey AND s_nationkey <> 3
WHERE l.l_quantity > 25 AND EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber AND o.l_suppkey = l.l_suppkey AND o.l_linestatus = 'F')""")
def open_challenges(spark, folder):
    _, outbound = shards_of_orders(spark, folder)
    made = read(spark, folder, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("shard_id"), F.col("l_linenumber").alias("piece_index"), F.col("l_suppkey").alias("peer_id")).distinct()
    peers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") == 3, "blocked").otherwise("trusted").alias("status"), F.lit(None).cast("string").alias("ip_address"), F.col("s_name").alias("public_key"))
    return health.open_challenges(made, outbound, peers).select("shard_id", "piece_index", "peer_id", "public_key")


@query("""SELECT DISTINCT doc_id AS shard_id, o AS "offset", hex(encode(text))[2 * o + 1 : 2 * o + 64] AS expected, sha256(text) AS piece_hash
FROM (SELECT doc_id, text, ('0x' || md5(doc_id || '|0|7|' || i || '|3')[1:15])::BIGINT % (strlen(text) - 31) AS o FROM documents, range(1, 9) r(i) WHERE strlen(text) >= 32)""")
def challenge_windows(spark, folder):
    """Eight windows of 32 bytes of every text, at hashed offsets."""
    pieces = read(spark, folder, "documents").select(F.col("doc_id").alias("shard_id"), F.lit(0).alias("piece_index"), F.lit(7).alias("peer_id"), F.col("text").cast("binary").alias("data"))
    return health.sample_challenges(pieces, 8, seed=3).select("shard_id", "offset", F.hex("expected_data").alias("expected"), "piece_hash")


@query("SELECT l_suppkey AS peer_id, count(*) AS jobs, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY 1")
def jobs_per_peer(spark, folder):
    return placement.jobs_per_peer(read(spark, folder, "lineitem").select(F.col("l_suppkey").alias("peer_id"), F.col("l_quantity").cast("long").alias("size")))


@query("SELECT l_orderkey AS shard_id FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 4")
def completed_shards(spark, folder):
    return health.completed_shards(shards_of_orders(spark, folder)[1], 4)
