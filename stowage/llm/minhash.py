"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2**20 make all coordinates: the first
scatters the shingles, the second is shifted circularly by one for each
coordinate. Stored one after the other, the values of an element under all
shifts are consecutive, so a signature is the element-wise minimum of slices.

Documents with equal shingle sets are one class, a node of the graph of links, before anything is
compared; the rest of this module calls nodes rep. Classes that agree in a
band form a bucket, which is cut into blocks of bounded size. First each block
proposes a spanning forest of its likeliest pairs by signature, and bridges to others,
so a bucket of n near copies costs some n verifications. Then, in buckets that still
hold several components, all other pairs across components whose signatures
could mean the similarity are verified, so no pair of a bucket is left out. Links
are confirmed on whole shingle sets, recomputed from the texts of the documents concerned.

With 40 bands of 5 a pair of similarity 0.8 shares a bucket except with a
probability of 1.3e-7; a pair of one bucket is verified unless 27 fewer of the 200
coordinates agree than expected at the limit (4.8 standard deviations).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import star_components
from .words import mix, shared_hashes, shingle_set, split_words
from .workspace import join_groups, keep

UNIVERSE = 1 << 20
BANDS, ROWS = 40, 5
#: Standard deviations by which the agreement of two signatures may fall short of the limit.
SLACK = 4.8
#: Rows of a bucket that meet in one task when its other pairs are compared.
BLOCK = 512
#: Members of a star that are verified in one task.
STAR = 256


@lru_cache(maxsize=1)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and every slice of ``coordinates`` shifts of the circulant one."""
    random = np.random.Generator(np.random.PCG64(20240607))
    scatter = random.permutation(UNIVERSE).astype(np.int32)
    circle = random.permutation(UNIVERSE).astype(np.uint32)
    circle = np.concatenate((circle, circle[:coordinates]))
    return scatter, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Minimum of each shift of the circulant permutation over the scattered shingles."""
    scatter, slices = permutations(coordinates)
    at = scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = slices[at[0]].copy()
    for begin in range(0, len(at), 1024):
        np.minimum(out, slices[at[begin : begin + 1024]].min(0), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash of each band's coordinates and its number."""
    parts = sig.reshape(bands, -1).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64)
    for column in parts.T:
        total = mix(total ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return total.view(np.int64)


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set; 0 if it is empty."""
    mixed = mix(shingles)
    return int(mixed.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed).view(np.int64)) if len(mixed) else 0


FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"


def features(docs: DataFrame, size: int) -> DataFrame:
    """Set size, 128-bit hash of the set, band hashes and low bytes of the signature of every row."""

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_hashes()
        for frame in frames:
            cache.trim()
            ids, counts, h1, h2, bands, sigs = frame.column(0).to_pylist(), [], [], [], [], []
            for text in frame.column(1):
                shingles = shingle_set(split_words(text.as_py(), lower=True), size, cache)
                counts.append(len(shingles))
                if len(shingles):
                    sig = signature(shingles)
                    one, two = set_hashes(shingles)
                    h1.append(one), h2.append(two)
                    bands.append(band_hashes(sig))
                    sigs.append((sig & 0xFF).astype(np.uint8).tobytes())
                else:
                    h1.append(0), h2.append(0), bands.append(None), sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, FEATURES)


def node_of(h1: str = "h1", h2: str = "h2", n: str = "n_shingles") -> Column:
    """A 64-bit name of a shingle set."""
    return F.xxhash64(h1, h2, n)


def shingle_table(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, shingles): whole sets of the classes (rep, doc_id) wanted, from the text of that document.

    The join is by shuffle whatever the number of classes, so that its cost follows the input.
    """

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_hashes()
        for frame in frames:
            cache.trim()
            found = [shingle_set(split_words(t.as_py(), lower=True), size, cache) for t in frame.column(0)]
            h1, h2 = zip(*map(set_hashes, found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["h1", "h2", "n_shingles", "shingles"]
            )

    ids = wanted.select("doc_id").distinct().hint("shuffle_merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("text")
    computed = texts.mapInArrow(sets, "h1 long, h2 long, n_shingles long, shingles binary")
    # a document may have other texts, of other classes
    return keep(computed.select(node_of().alias("rep"), "shingles").join(wanted.select("rep"), "rep", "left_semi"), "shingles")[0]


def verify(known: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have 100 |intersection| >= percent |union|.

    Pairs of one b are compared against one set in memory, STAR of them to a task.
    """
    tasks = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(tasks, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    members = dealt.join(known.withColumnRenamed("rep", "a"), "a").select("b", "part", "a", "shingles")
    hubs = dealt.select("b", "part").distinct().join(known.withColumnRenamed("rep", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "shingles")
    stars = members.unionByName(hubs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, hub_sets = None, {}
        for frame in frames:
            out_a, out_b = [], []
            for b, part, a, shingles in zip(*(frame.column(i) for i in range(4))):
                b, part, a, data = b.as_py(), part.as_py(), a.as_py(), shingles.as_py()
                if (b, part) != star:
                    star, hub_sets = (b, part), {}
                mine = np.frombuffer(data, np.uint64)
                if a is None:
                    hub_sets[data] = mine  # repeated rows of one document are one set
                    continue
                for other in hub_sets.values():
                    if similar(mine, other, percent):
                        out_a.append(a), out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return stars.mapInArrow(compare, "a long, b long").distinct()


def least_agreement(percent: int) -> int:
    """How many coordinates two signatures must share for the similarity to be possible."""
    coordinates, share = BANDS * ROWS, percent / 100
    return int(coordinates * share - SLACK * np.sqrt(coordinates * share * (1 - share)))


def agreement(sigs: np.ndarray) -> np.ndarray:
    """Number of equal coordinates of each two of the signatures."""
    if len(sigs) <= 32:
        return (sigs[:, None] == sigs).sum(2).astype(np.int16)
    total = np.zeros((len(sigs), len(sigs)), np.int16)
    for column in np.ascontiguousarray(sigs.T):
        total += column[:, None] == column
    return total


def forest(score: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that score ``least`` or more, likeliest first (Boruvka); -1 marks pairs that are none."""
    labels = np.arange(len(score))
    while True:
        best = score.argmax(1)
        value = score[np.arange(len(score)), best]
        order = np.lexsort((-value, labels))
        first = order[np.concatenate(([True], labels[order][1:] != labels[order][:-1]))]
        first = first[value[first] >= least]
        if not len(first):
            return
        for i in first:
            x, y = labels[i], labels[best[i]]
            if x != y:
                labels[labels == max(x, y)] = min(x, y)
                yield int(i), int(best[i])
        score[labels[:, None] == labels] = -1


def bridges(score: np.ndarray, inside: np.ndarray, least: int, sure: int) -> Iterator[tuple[int, int]]:
    """The likeliest pair between two blocks, and the likeliest of each row that has no ``sure`` and no likelier one inside."""
    best = score.argmax(1)
    value = score[np.arange(len(score)), best]
    need = (value >= least) & (inside < sure) & (value > inside)
    top = int(value.argmax())
    need[top] |= value[top] >= least
    for i in np.flatnonzero(need):
        yield int(i), int(best[i])


def dealt_blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members of buckets for each two blocks (p, q) of their bucket, sorted by these."""
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "component", *columns)
    return rows.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")


def pairs_by_block(rows: DataFrame, pairs_of: Callable[[list, bool], Iterator[tuple[int, int]]]) -> DataFrame:
    """Distinct pairs (a, b), a > b, that ``pairs_of`` names by row number in the rows of each two blocks."""

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], set()

        def finish() -> None:
            if len(group) > 1:
                for i, j in pairs_of(group, key[1] != key[2]):
                    a, b = group[i][1], group[j][1]
                    found.add((max(a, b), min(a, b)))

        for frame in frames:
            for band, p, q, *row in zip(*(column.to_pylist() for column in frame.columns)):
                if (band, p, q) != key:
                    finish()
                    key, group = (band, p, q), []
                group.append(row)
            if len(found) > 100_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], SCHEMA)
                found = set()
        finish()
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], SCHEMA)

    return rows.mapInArrow(emit, "a long, b long").distinct()


def scores(group: list, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Agreement of the rows of different components: of those compared here (-1: not), and of those of one block."""
    block, _, component = (np.array([g[i] for g in group], np.int64) for i in range(3))
    score = agreement(np.frombuffer(b"".join(g[3] for g in group), np.uint8).reshape(len(group), -1))
    score[component[:, None] == component] = -1
    inside = score.copy()
    if across:
        inside[block[:, None] != block] = -1
        score[block[:, None] == block] = -1
    return score, inside


def likely_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of one bucket and different components whose signatures allow the similarity:
    a spanning forest of each block of a bucket, and bridges between its blocks.

    ``members`` has band, rep, n and component. Any member of such a pair is in one of those given out.
    """
    least, sure = least_agreement(percent), BANDS * ROWS * percent // 100

    def pairs_of(group: list, across: bool) -> Iterator[tuple[int, int]]:
        score, inside = scores(group, across)
        return bridges(score, inside.max(1), least, sure) if across else forest(score, least)

    return pairs_by_block(dealt_blocks(members.join(reps.select("rep", "sig"), "rep"), ["sig"]), pairs_of)


def remaining_links(members: DataFrame, reps: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links across components within the buckets, enough of them to join all that are linked.

    All pairs of a bucket whose signatures allow the similarity are verified,
    likeliest first, but for those that links found in their block already join. Only
    links are given out, so rows stay in proportion to members.
    """
    least = least_agreement(percent)

    def pairs_of(group: list, across: bool) -> Iterator[tuple[int, int]]:
        score, _ = scores(group, across)
        left, right = np.nonzero(np.triu(score, 1) >= least)
        order = np.argsort(-score[left, right], kind="stable")
        labels = np.array([g[2] for g in group], np.int64)
        sets = [np.frombuffer(g[4], np.uint64) for g in group]
        for i, j in zip(left[order].tolist(), right[order].tolist()):
            if labels[i] != labels[j] and similar(sets[i], sets[j], percent):
                labels[labels == labels[j]] = labels[i]
                yield i, j

    return pairs_by_block(dealt_blocks(members.join(reps.select("rep", "sig"), "rep").join(known, "rep"), ["sig", "shingles"]), pairs_of)


def similar(mine: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted hashes have 100 |intersection| >= percent |union|."""
    if 100 * min(len(mine), len(other)) < percent * max(len(mine), len(other)):
        return False
    both = len(np.intersect1d(mine, other, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(mine) + len(other) - both)


def labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with these."""
    own = members.drop("component").join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    return own.where("n > 2").join(mixed, "band", "left_semi")


SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Sets are of ``size``-word shingles of A-Z lower-cased texts. Texts without
    words and null ones have the empty set and link with nothing. Rows of one
    doc_id are one document, linked by what any of them links. Rows with a null
    doc_id link with nothing: their component_id is null and kept is true. An
    empty table gives no rows; only doc_id and text are read.
    """
    found, _ = keep(features(docs, size), "minhash")
    usable = found.where("doc_id IS NOT NULL AND n_shingles > 0").withColumn("rep", node_of())
    classes = usable.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("f"))
    classes, _ = keep(classes.select("rep", "doc_id", "n", "f.bands", "f.sig"), "classes")
    reps = classes.select("rep", "sig")
    in_band = classes.select("rep", F.explode("bands").alias("band"))
    sizes = in_band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members, _ = keep(in_band.join(sizes, "band"), "buckets")
    likely, _ = keep(likely_pairs(members.withColumn("component", F.col("rep")), reps, percent), "pairs")
    # every member of a further pair is in one of these
    paired = likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct()
    known = shingle_table(docs, classes.select("rep", "doc_id").join(paired, "rep", "left_semi"), size)
    links, _ = keep(verify(known, likely, percent), "links")
    links = links.union(remaining_links(labelled(members, star_components(links)), reps, known, percent))
    # a document of several texts joins their classes
    several = usable.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b <> high").select("doc_id", "b")
    same = usable.join(several, "doc_id").select(F.col("rep").alias("a"), "b")
    rooted = classes.select("rep", "doc_id", "n").join(star_components(links.union(same)).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    rooted, _ = keep(rooted.select("rep", "doc_id", "n", "root"), "roots")
    least, _ = keep(rooted.groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("n")), "least")
    labels, _ = keep(join_groups(rooted, least, ["root"], ["rep"], "inner").select("rep", "n", "component"), "components")
    everything = join_groups(usable.select("doc_id", "rep"), labels, ["rep"], ["doc_id"], "inner").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = found.select("doc_id", "n_shingles").join(everything, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates: of its least doc_id, all columns unchanged; if that has several rows, any of them.

    Rows with a null doc_id and documents without words all stay.
    """
    found = near_duplicates(docs, size, percent)
    verdicts = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_n"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id")).join(verdicts, "doc_id", "left")
    kept = rows.where(F.coalesce("_kept", F.lit(True)))
    once = kept.where(F.coalesce("_n", F.lit(1)) == 1).select("_row")
    repeated = kept.where("_n > 1").groupBy("doc_id").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")
