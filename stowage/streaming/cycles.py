"""The server's periodic workers: what each computes from the catalog's tables, once or on a timer.

A cycle gets ``tables`` (a table's name to its DataFrame) and the time it runs at, and returns the tables it
writes anew by name. Rounds are independent: one that is tried again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, health, placement
from .workers import run_worker

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Settings:
    """What the cycles are bound by: pieces of a shard, ages, and shares."""

    data_pieces: int = 10
    parity_pieces: int = 4
    eviction_hours: int = 72
    retention_minutes: int = 7 * 1440
    special_minutes: int = 30 * 1440
    waste: float = 0.5
    adoption_minutes: int = 1440
    contact_minutes: int = 15
    seed: int = 0


def repair(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Marks the pieces of dead peers and names the shards to repair."""
    pieces = health.mark_lost(tables("outbound_pieces"), tables("peers"), at, use.eviction_hours)
    return {"outbound_pieces": pieces, "repairs": health.repair_candidates(tables("shards"), pieces, use.data_pieces, use.parity_pieces)}


def collection(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Shards whose waste is worth packing anew."""
    found = health.waste(tables("blob_locations"), tables("blobs"), tables("shards"), at, use.retention_minutes, use.special_minutes, use.waste)
    return {"collections": found}


def challenge(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """One challenge, drawn from all that are open, and the pieces that lack challenges."""
    made, pieces = tables("piece_challenges"), tables("outbound_pieces")
    drawn = health.pick(health.open_challenges(made, pieces, tables("peers")), ["id"], use.seed)
    return {"next_challenge": drawn, "refills": health.refill(pieces, made)}


def outbound(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Mirrored shards for the peers that lack them, and shards whose local copy may go."""
    pieces = tables("outbound_pieces")
    total = use.data_pieces + use.parity_pieces
    return {"mirrors": placement.mirror_fan_out(tables("shards"), tables("peers"), pieces), "completed": health.completed_shards(pieces, total)}


def adoption(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Peers with adoption tests started and ended."""
    peers = tables("peers").withColumn("adoption_requested", F.col("adoption_status") == "none")
    held = tables("hosted_shards").select("hash", "peer_id")
    return {"peers": health.adopt(peers, tables("adoption_tests"), held, at, use.adoption_minutes).drop("adoption_requested")}


def contact(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Peers to be contacted, and the listing with their reputation."""
    return {"contacts": health.due_for_contact(tables("peers"), at, use.contact_minutes), "listing": health.list_peers(tables("peers"), tables("challenge_results"), at)}


def eviction(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Peers without those that were never reached."""
    return {"peers": health.evict(tables("peers"), at, use.eviction_hours)}


def pruning(tables: Tables, at: Column, use: Settings) -> dict[str, DataFrame]:
    """Blobs with those deleted that no version's file refers to."""
    none = F.lit(0).alias("owner")
    used = tables("file_blobs").select(F.col("hash_encrypted").alias("hash"), none)
    return {"blobs": catalog.prune(tables("blobs"), catalog.orphans(tables("blobs").select("hash", none, "special"), used), at)}


CYCLES: dict[str, Callable[[Tables, Column, Settings], dict[str, DataFrame]]] = {
    "repair": repair, "collection": collection, "challenge": challenge, "outbound": outbound, "adoption": adoption, "contact": contact, "eviction": eviction, "pruning": pruning,
}


def run_cycle(spark: SparkSession, name: str, tables: Tables, at: Column, out: str, number: int, settings: Settings = Settings()) -> None:
    """One round of a worker: each of its tables goes to ``out/table/round=number``."""
    for table, rows in CYCLES[name](tables, at, settings).items():
        rows.write.mode("overwrite").parquet(f"{out}/{table}/round={number}")


def start_cycle(spark: SparkSession, name: str, tables: Tables, out: str, checkpoint: str, every: str, settings: Settings = Settings()):
    """The worker as a streaming query that runs a round ``every`` so often, at the time of its tick."""

    def work(batch: DataFrame, number: int) -> None:
        tick = batch.agg(F.max("timestamp")).first()[0]
        if tick is not None:
            run_cycle(spark, name, tables, F.lit(tick).cast("timestamp").cast("timestamp_ntz"), out, number, settings)

    return run_worker(spark.readStream.format("rate").option("rowsPerSecond", 1).load(), work, checkpoint, every)
