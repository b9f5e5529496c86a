"""The server's periodic work as queries: garbage collection, repair, replication, challenges, reputation, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import hashed_number, percentage
from .packing import pack


def older(column: Column, as_of: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """Earlier than so long before ``as_of``; null isn't."""
    return column < as_of - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def never_or_stale(column: Column, as_of: Column, **age: int) -> Column:
    """Never seen, or not for so long."""
    return column.isNull() | older(column, as_of, **age)


# garbage collection


def liveness(ref_count: Column, deleted_at: Column, special: Column, as_of: Column, retention_minutes: int, special_minutes: int) -> Column:
    """live, wasted, or limbo: without references, but never deleted."""
    expired = F.when(special, older(deleted_at, as_of, minutes=special_minutes)).otherwise(older(deleted_at, as_of, minutes=retention_minutes))
    return F.when(ref_count > 0, "live").when(deleted_at.isNull(), "limbo").when(expired, "wasted").otherwise("live")


def waste(locations: DataFrame, blobs: DataFrame, shards: DataFrame, as_of: Column, retention_minutes: int, special_minutes: int, threshold: float) -> DataFrame:
    """Sealed shards (shard_id, size, total, wasted, ratio) whose wasted share reaches the threshold, worst first."""
    state = liveness(F.col("ref_count"), F.col("deleted_at"), F.col("special"), as_of, retention_minutes, special_minutes)
    sealed = shards.where("status = 'sealed'").select(F.col("id").alias("shard_id"), F.col("size").alias("shard_size"))
    marked = blobs.select(F.col("hash").alias("blob_hash"), state.alias("state"))
    joined = locations.join(marked, "blob_hash").join(sealed, "shard_id")
    sums = joined.groupBy("shard_id", "shard_size").agg(F.sum("length").alias("total"), F.coalesce(F.sum(F.when(F.col("state") == "wasted", F.col("length"))), F.lit(0)).alias("wasted"))
    rated = sums.withColumn("ratio", F.try_divide(F.col("wasted").cast("double"), F.col("total")))
    return rated.where(F.col("ratio") >= threshold).orderBy(F.desc("ratio"), "shard_id")


def repack(locations: DataFrame, blobs: DataFrame, candidates: DataFrame, as_of: Column, retention_minutes: int, special_minutes: int, piece_size: int, pieces: int) -> tuple[DataFrame, DataFrame]:
    """Locations after collection of the candidate shards, and the hashes that are gone.

    What isn't wasted in the candidates is packed anew into shards after the last one; a blob keeps
    one location list, so blobs that lie in other shards too are left there.
    """
    state = liveness(F.col("ref_count"), F.col("deleted_at"), F.col("special"), as_of, retention_minutes, special_minutes)
    doomed = locations.join(candidates.select("shard_id"), "shard_id", "left_semi").select("blob_hash").distinct()
    affected = blobs.join(doomed.withColumnRenamed("blob_hash", "hash"), "hash", "left_semi").withColumn("state", state)
    keepers = affected.where("state <> 'wasted'").select("hash", "size", hashed_number(F.col("hash")).alias("_ord"))
    base = locations.agg(F.coalesce(F.max("shard_id") + 1, F.lit(0))).scalar()
    moved = pack(keepers, "_ord", piece_size, pieces).withColumn("shard_id", F.col("shard_id") + base).withColumnRenamed("hash", "blob_hash")
    rest = locations.join(doomed, "blob_hash", "left_anti")
    columns = ["blob_hash", "shard_id", "piece_index", "offset", "length", "sequence"]
    return rest.select(*columns).unionByName(moved.select(*columns)), affected.where("state = 'wasted'").select("hash")


# repair and replication


def mark_lost(outbound: DataFrame, peers: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Outbound pieces with the uploaded ones of dead peers lost; a peer never seen isn't dead, a blocked one is exempt."""
    dead = peers.where(older(F.col("last_seen"), as_of, hours=hours) & (F.col("status") != "blocked")).select(F.col("id").alias("peer_id"), F.lit(True).alias("_dead"))
    joined = outbound.join(dead, "peer_id", "left")
    return joined.withColumn("status", F.when(F.col("_dead") & (F.col("status") == "uploaded"), "lost").otherwise(F.col("status"))).drop("_dead")


def uploaded_pieces(shards: DataFrame, outbound: DataFrame) -> DataFrame:
    """Shards with distinct uploaded pieces and peers; shards without any have zeros."""
    good = outbound.where("status = 'uploaded'").select(F.col("shard_id").alias("id"), "piece_index", "peer_id")
    # a shard has a bounded number of pieces, so the sets are small and combined before the shuffle
    sets = good.groupBy("id").agg(F.size(F.collect_set("piece_index")).cast("long").alias("pieces"), F.size(F.collect_set("peer_id")).cast("long").alias("peers"))
    return shards.select("id", "mirrored").join(sets, "id", "left").fillna(0, ["pieces", "peers"])


def repair_candidates(shards: DataFrame, outbound: DataFrame, n: int, k: int, mirrors: int = 2) -> DataFrame:
    """Sealed shards with fewer distinct uploaded pieces than N + K (mirrored: fewer peers than ``mirrors``)."""
    state = uploaded_pieces(shards.where("status = 'sealed'"), outbound)
    return state.where(F.when(F.col("mirrored"), F.col("peers") < mirrors).otherwise(F.col("pieces") < n + k))


def replication(shards: DataFrame, outbound: DataFrame, n: int, k: int, mirrors: int = 2) -> DataFrame:
    """Shards with replication full, partial or none."""
    full = F.when(F.col("mirrored"), F.col("peers") >= mirrors).otherwise(F.col("pieces") >= n + k)
    return uploaded_pieces(shards, outbound).withColumn("replication", F.when(full, "full").when(F.col("peers") > 0, "partial").otherwise("none"))


def status_report(shards: DataFrame, outbound: DataFrame, blobs: DataFrame, hosted: DataFrame, n: int, k: int) -> DataFrame:
    """One row: shards, fully and partially replicated ones, blobs, bytes stored for oneself and for others."""
    state = replication(shards, outbound, n, k).agg(F.count("*").alias("shards"), F.count_if(F.col("replication") == "full").alias("full"), F.count_if(F.col("replication") == "partial").alias("partial"))
    return state.select(
        "*",
        blobs.agg(F.count("*")).scalar().alias("blobs"),
        blobs.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar().alias("own_bytes"),
        hosted.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar().alias("hosted_bytes"),
    )


def completed_shards(outbound: DataFrame, total: int) -> DataFrame:
    """Shards all of whose distinct pieces are uploaded, so that local copies may go."""
    return outbound.where("status = 'uploaded'").groupBy("shard_id").agg(F.countDistinct("piece_index").alias("pieces")).where(F.col("pieces") >= total).select("shard_id")


# challenges


def pick(rows: DataFrame, key: list[str], seed: int, groups: list[str] | None = None) -> DataFrame:
    """One row, or one of each group, at random but decided by the seed."""
    order = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))), 256)
    if not groups:
        return rows.orderBy(order, *key).limit(1)
    rest = [c for c in rows.columns if c not in groups]
    return rows.groupBy(*groups).agg(F.min_by(F.struct(*rest), F.struct(order, *key)).alias("_s")).select(*groups, "_s.*")


def open_challenges(challenges: DataFrame, outbound: DataFrame, peers: DataFrame) -> DataFrame:
    """Challenges (shard_id, piece_index, peer_id, …) of uploaded pieces on peers that aren't blocked, with the peer's address and key."""
    keys = ["shard_id", "piece_index", "peer_id"]
    stored = outbound.where("status = 'uploaded'").select(*keys).distinct()
    reachable = peers.where("status <> 'blocked'").select(F.col("id").alias("peer_id"), "ip_address", "public_key")
    return challenges.join(stored, keys, "left_semi").join(reachable, "peer_id")


def judge(expected: Column, data: Column, offset: Column, length: int = 32) -> Column:
    """pass, fail, or unavailable (no data) for bytes of a piece against those remembered."""
    found = F.substring(data, (offset + 1).cast("int"), F.lit(length))
    return F.when(data.isNull(), "unavailable").when(found == expected, "pass").otherwise("fail")


def in_bounds(rows: DataFrame, offset: str = "offset", size: str = "size", length: int = 32) -> DataFrame:
    """Windows that end within their piece."""
    return rows.where(F.col(offset) + length <= F.col(size))


def refill(pieces: DataFrame, challenges: DataFrame, least: int = 3) -> DataFrame:
    """Uploaded pieces with fewer than ``least`` challenges left, and how many they have."""
    keys = ["shard_id", "piece_index", "peer_id"]
    left = challenges.groupBy(*keys).agg(F.count("*").alias("remaining"))
    joined = pieces.where("status = 'uploaded'").select(*keys).distinct().join(left, keys, "left")
    return joined.select(*keys, F.coalesce("remaining", F.lit(0)).alias("remaining")).where(F.col("remaining") < least)


def sample_challenges(pieces: DataFrame, per_piece: int = 8, seed: int = 0, length: int = 32) -> DataFrame:
    """``per_piece`` windows of each piece (shard_id, piece_index, peer_id, data) at hashed offsets, with their bytes.

    Pieces shorter than a window have none; equal offsets stand once.
    """
    room = F.length("data") - length + 1
    drawn = pieces.where(F.length("data") >= length).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(per_piece))))
    offset = F.pmod(hashed_number(F.concat_ws("|", "shard_id", "piece_index", "peer_id", "_i", F.lit(str(seed)))), room)
    cut = drawn.withColumn("offset", offset)
    return cut.select("shard_id", "piece_index", "peer_id", F.sha2("data", 256).alias("piece_hash"), "offset", F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.lit(length)).alias("expected_data")).distinct()


# peers


def reputation(results: DataFrame, peer: str, status: str, at: str, as_of: Column, days: int = 7) -> DataFrame:
    """Per peer over the last days: attempts made, reached, passed, and the percentages, 0 without attempts."""
    kind = F.col(status)
    recent = results.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
    made, ok = F.count("*"), F.count_if(kind.isin("ok", "pass", "fail"))
    passed, tried = F.count_if(kind == "pass"), F.count_if(kind.isin("pass", "fail"))
    return recent.groupBy(peer).agg(made.alias("made"), ok.alias("ok"), passed.alias("passed"), tried.alias("attempts")).withColumns(
        {"uptime": percentage(F.col("ok"), F.col("made")), "integrity": percentage(F.col("passed"), F.col("attempts"))}
    )


def list_peers(peers: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Peers with reputation, seen last first; manual ones are active, others pending."""
    scores = reputation(results, "peer_id", "status", "timestamp", as_of).withColumnRenamed("peer_id", "id")
    kind = F.when(F.col("source") == "manual", "active").otherwise("pending").alias("kind")
    joined = peers.join(scores, "id", "left").fillna(0, ["made", "ok", "passed", "attempts", "uptime", "integrity"])
    return joined.select("*", kind).orderBy(F.desc_nulls_last("last_seen"), "id")


def list_clients(clients: DataFrame, peers: DataFrame) -> DataFrame:
    """Clients that aren't peers too, seen last first."""
    return clients.join(peers.select("public_key"), "public_key", "left_anti").orderBy(F.desc_nulls_last("last_seen"), "id")


def evict(peers: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """Peers that stay: reached at least once, or first seen within so many hours."""
    return peers.where(~(F.col("last_seen").isNull() & older(F.col("first_seen"), as_of, hours=hours)))


def due_for_contact(peers: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Peers never reached, or not for so long."""
    return peers.where(never_or_stale(F.col("last_seen"), as_of, minutes=minutes))


def client_quota(offers: DataFrame, clients: DataFrame) -> DataFrame:
    """Offers (public_key, incoming) with whether the client, known and trusted, stays within its quota (0: none)."""
    joined = offers.join(clients.select("public_key", "status", "current_storage_size", "max_storage_size"), "public_key", "left")
    fits = (F.col("max_storage_size") == 0) | (F.col("current_storage_size") + F.col("incoming") <= F.col("max_storage_size"))
    return joined.select("public_key", "incoming", F.coalesce((F.col("status") == "trusted") & fits, F.lit(False)).alias("accepted"))


def peer_quota(offers: DataFrame, peers: DataFrame, outbound: DataFrame, hosted: DataFrame, piece_size: int, buffer: int = 1, global_cap: int = 0) -> DataFrame:
    """Offers (peer_id, incoming) with whether they are accepted.

    A trusted peer is bound by its own maximum (0: none); an untrusted one may
    store as much here as it stores for us, ``buffer`` pieces more. All hosted
    bytes stay under ``global_cap`` (0: none). Blocked and unknown peers are refused.
    """
    mine = outbound.where("status = 'uploaded'").groupBy("peer_id").agg(F.count("*").alias("pieces_there"))
    theirs = hosted.groupBy("peer_id").agg(F.sum("size").alias("hosted_bytes"))
    total = hosted.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    known = peers.select(F.col("id").alias("peer_id"), "status", "max_storage_size")
    joined = offers.join(known, "peer_id", "left").join(mine, "peer_id", "left").join(theirs, "peer_id", "left").fillna(0, ["pieces_there", "hosted_bytes"])
    after = F.col("hosted_bytes") + F.col("incoming")
    allowance = (F.col("pieces_there") + buffer) * piece_size
    fits = F.when(F.col("status") == "trusted", (F.col("max_storage_size") == 0) | (after <= F.col("max_storage_size"))).when(F.col("status").isin("untrusted", "discovered"), after <= allowance).otherwise(F.lit(False))
    room = F.lit(True) if not global_cap else total + F.col("incoming") <= global_cap
    return joined.select("peer_id", "incoming", allowance.alias("allowance"), F.coalesce(fits & room, F.lit(False)).alias("accepted"))


def adopt(peers: DataFrame, tests: DataFrame, held: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Peers with the next adoption status, and the status that follows from it.

    none (asked for: adoption_requested) starts testing. Once testing has lasted ``minutes``, a peer has
    completed if every test piece of it can be retrieved, and is trusted; else it has failed, and is discovered.
    """
    had = tests.join(held.select("hash", "peer_id", F.lit(True).alias("_have")).distinct(), ["hash", "peer_id"], "left")
    state = had.groupBy(F.col("peer_id").alias("id")).agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("_all"))
    over = F.col("adoption_start_at") <= as_of - F.make_dt_interval(mins=F.lit(minutes))
    starts = (F.col("adoption_status") == "none") & F.col("adoption_requested")
    ends = (F.col("adoption_status") == "testing") & over
    passed = F.coalesce("_all", F.lit(False))
    joined = peers.join(state, "id", "left").withColumn("_ends", F.when(ends, passed)).withColumn("_starts", F.coalesce(starts, F.lit(False)))
    return joined.withColumns(
        {
            "adoption_start_at": F.when(F.col("_starts"), as_of).otherwise(F.col("adoption_start_at")),
            "adoption_status": F.when(F.col("_starts"), "testing").when(F.col("_ends"), "completed").when(~F.col("_ends"), "failed").otherwise(F.col("adoption_status")),
            "status": F.when(F.col("_ends"), "trusted").when(~F.col("_ends"), "discovered").otherwise(F.col("status")),
        }
    ).drop("_all", "_ends", "_starts")
