"""Near-duplicate embeddings by product quantisation with inverted lists.

Equal vectors are one class first. A coarse quantiser deals the unit vectors
into lists; what remains after subtracting a list's centroid is split into
subspaces and coded by codebooks. The vectors of a link lie within some reach (0.447 at
cosine 0.9), and the border between their lists separates them; so one of them at
least is within half the reach of it. A vector therefore searches every list whose border is
no farther than that, and no link is missed, in any number of dimensions.
In a list, distances come from tables of the query's residual against the codes
(the query itself isn't coded). Since the code of a vector is off by a stored
length at most, only what lies closer than the limit plus that length can be a link; it is
reranked by the exact cosine in double precision.

Every vector carries the set of lists it searches, so where two vectors search each
other's lists, the pair counts in the later list alone. Lists are
cut into blocks of BLOCK vectors, and queries stream past one block at a time.
Links are counted where they are found and given out as a spanning forest of
the block, so many vectors of one place make few rows.

The quantisers are fitted on a sample taken by hash: 16 vectors for each list, SAMPLE at
least, and 16 * MOST_LISTS at most. All vectors are indexed and searched. There are half as many lists as the square root of
the number of vectors, so lists grow no faster than that up to MOST_LISTS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import star_components
from .workspace import join_groups, keep

SAMPLE = 16384
BLOCK = 1024
CODEWORDS = 64
#: Most coarse lists; their centroids are sent to every executor.
MOST_LISTS = 4096
#: Added to distances, against rounding.
ROUNDING = 1e-6


def k_means(points: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's method; an empty one moves to the point farthest from its own."""
    k = min(k, len(points))
    centroids = points[random.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        gap = (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)
        at = gap.argmin(1)
        counts = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=column, minlength=k) for column in points.T], axis=1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        for empty in np.flatnonzero(counts == 0):
            far = gap[np.arange(len(points)), at].argmax()
            centroids[empty], at[far], gap[far] = points[far], empty, 0
    return centroids


@dataclass
class Index:
    """Coarse centroids, the subspaces' bounds and codebooks."""

    centroids: np.ndarray
    bounds: list[int]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, units: np.ndarray, lists: int, subspaces: int = 16, seed: int = 7) -> "Index":
        random = np.random.default_rng(seed)
        centroids = k_means(units, lists, 10, random)
        residuals = units - centroids[cls.nearest(units, centroids)[0]]
        dims = units.shape[1]
        bounds = sorted({round(i * dims / min(subspaces, dims)) for i in range(min(subspaces, dims) + 1)})
        books = [k_means(residuals[:, a:b], CODEWORDS, 8, random) for a, b in zip(bounds, bounds[1:])]
        return cls(centroids, bounds, books)

    @staticmethod
    def nearest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = (units**2).sum(1)[:, None] - 2 * units @ centroids.T + (centroids**2).sum(1)
        return gap.argmin(1), gap

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the coding error of each vector, and its distance to the border of every list."""
        at, gap = self.nearest(units, self.centroids)
        residuals = units - self.centroids[at]
        codes = np.empty((len(units), len(self.books)), np.uint8)
        error = np.zeros(len(units))
        for m, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            part, book = residuals[:, a:b], self.books[m]
            off = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            codes[:, m] = off.argmin(1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        homes, which = np.unique(at, return_inverse=True)
        apart = np.sqrt(np.maximum(self.nearest(self.centroids[homes], self.centroids)[1], 1e-12))
        border = (gap - gap[np.arange(len(units)), at][:, None]) / (2 * apart[which])
        return at, codes, np.sqrt(error), border

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances (vectors x queries) within one list, by table lookup."""
        residuals = queries - self.centroids[at]
        total = np.zeros((len(codes), len(queries)), np.float32)
        for m, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            part, book = residuals[:, a:b], self.books[m]
            # a row for each codeword, so that a lookup copies a row
            table = ((part**2).sum(1) - 2 * book @ part.T + (book**2).sum(1)[:, None]).astype(np.float32)
            total += table[codes[:, m]]
        return total


def unit_vectors(rows: list[bytes], kind: str = "f8") -> np.ndarray:
    """Rows of doubles, each divided by its length (by its largest component first, against overflow)."""
    values = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values**2).sum(1, keepdims=True))


POSTINGS = "list int, block int, is_query boolean, rep long, weight long, home int, error double, codes binary, searches binary, vec binary"


def postings(classes: DataFrame, index: Index, blocks: dict[int, int], half: float, kind: str) -> DataFrame:
    """A row for each class in its own list, and one as a query for each block of each list it searches."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for frame in frames:
            for begin in range(0, frame.num_rows, 2000):
                part = frame.slice(begin, 2000)
                rep, weight = part.column(0).to_numpy(), part.column(1).to_numpy()
                vecs = part.column(2).to_pylist()
                at, codes, error, border = own.encode(unit_vectors(vecs, kind))
                searched = border <= half + ROUNDING
                rows, lists = np.nonzero(searched)
                times = np.array([blocks.get(int(k), 1) for k in lists], np.int64)
                rows, lists = np.repeat(rows, times), np.repeat(lists, times)
                block = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                mine = rep % np.array([blocks.get(int(k), 1) for k in at])
                nothing = [None] * len(rows)
                packed = [c.tobytes() for c in codes]
                sets = [s.tobytes() for s in np.packbits(searched, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((at, lists)), pa.int32()), pa.array(np.concatenate((mine, block)), pa.int32()),
                        pa.array(np.repeat([False, True], [len(at), len(rows)])), pa.array(np.concatenate((rep, rep[rows]))),
                        pa.array(np.concatenate((weight, weight[rows]))), pa.array(np.concatenate((at, at[rows])), pa.int32()),
                        pa.array(np.concatenate((error, error[rows]))), pa.array(packed + nothing, pa.binary()), pa.array(sets + nothing, pa.binary()),
                        pa.array(vecs + [vecs[r] for r in rows], pa.binary()),
                    ],
                    names=["list", "block", "is_query", "rep", "weight", "home", "error", "codes", "searches", "vec"],
                )

    return classes.select("rep", "weight", "vec").mapInArrow(emit, POSTINGS)


def search(rows: DataFrame, index: Index, cosine: float, kind: str) -> DataFrame:
    """Links as rows (a, b, n): a and b are linked (b null: none named); a has n links more."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    limit = float(np.sqrt(2 - 2 * cosine))

    class Members:
        """A block of one list, with its counts and the labels of its local components."""

        def __init__(self):
            self.parts: list[pa.RecordBatch] = []
            self.ready = False

        def finish(self) -> None:
            table = pa.Table.from_batches(self.parts).combine_chunks()
            self.rep, self.weight, error = (table.column(c).to_numpy() for c in ("rep", "weight", "error"))
            self.near = ((limit + error + 1e-4) ** 2).astype(np.float32)[:, None]
            self.units = unit_vectors(table.column("vec").to_pylist(), kind)
            self.codes, self.searches = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(len(self.rep), -1) for c in ("codes", "searches"))
            self.labels, self.found = np.arange(len(self.rep)), np.zeros(len(self.rep), np.int64)
            self.ready = True

    def links(members: Members, part: pa.RecordBatch, at: int) -> Iterator[tuple[int, int | None, int]]:
        rep, weight, home = (part.column(c).to_numpy() for c in ("rep", "weight", "home"))
        units = unit_vectors(part.column("vec").to_pylist(), kind)
        query, member = np.nonzero((shared.value.distances(units, at, members.codes) <= members.near).T)
        from_list = home[query]
        # a member that searches the query's list as well meets it there, if that is the later one
        again = (members.searches[member, from_list >> 3] >> (7 - (from_list & 7))) & 1
        once = np.where(from_list == at, rep[query] > members.rep[member], (from_list < at) | (again == 0))
        query, member = query[once], member[once]
        step = max(1, (1 << 22) // units.shape[1])
        exact = [np.einsum("ij,ij->i", units[query[i : i + step]], members.units[member[i : i + step]]) >= cosine for i in range(0, len(query), step)]
        if not exact:
            return
        exact = np.concatenate(exact)
        query, member = query[exact], member[exact]
        np.add.at(members.found, member, weight[query])
        cuts = [0, *(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(query)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            i, hits = query[begin], member[begin:end]
            yield int(rep[i]), int(members.rep[hits[0]]), int(members.weight[hits].sum())
            labels = np.unique(members.labels[hits])
            if len(labels) > 1:
                for label in labels[members.labels[hits[0]] != labels]:
                    yield int(rep[i]), int(members.rep[label]), 0
                members.labels[np.isin(members.labels, labels)] = labels[0]

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, Members()

        def given(out: list) -> pa.RecordBatch:
            a, b, n = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        def counts() -> list:
            if not members.ready:
                return []
            at = np.flatnonzero(members.found)
            return [(int(r), None, int(n)) for r, n in zip(members.rep[at], members.found[at])]

        for frame in frames:
            keys = np.stack([frame.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            out: list = []
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                at, block, is_query = keys[begin].tolist()
                if (at, block) != key:
                    out += counts()
                    key, members = (at, block), Members()
                part = frame.slice(begin, end - begin)
                if not is_query:
                    members.parts.append(part)
                elif members.parts:
                    if not members.ready:
                        members.finish()
                    for start in range(0, part.num_rows, 256):
                        out += links(members, part.slice(start, 256), at)
            yield given(out)
        yield given(counts())

    dealt = rows.repartition("list", "block").sortWithinPartitions("list", "block", "is_query")
    return dealt.mapInArrow(emit, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding).

    Null vectors, zero vectors, those with a null or non-finite component and
    rows with a null vec_id link with nothing; with a null vec_id component_id
    is null and kept true. Vectors are compared with those of the same length.
    Every row counts as a vector, repeated ones too; different vectors of one
    vec_id are one node, whose n_links is what its vectors have together. An empty table gives no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    wide = F.col("embedding").cast("array<double>")
    # vectors of floats travel as such; all arithmetic is in doubles
    kind = "f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "f8"
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & wide.isNotNull() & (F.size(wide) > 0) & ~odd & F.exists(wide, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.transform(wide, lambda x: x + 0.0)).alias("v"))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        return pa.array([np.asarray(x, kind).tobytes() for x in v.to_pylist()], pa.binary())

    classes, _ = keep(classes.select("rep", "weight", F.size("v").alias("dims"), pack("v").alias("vec")), "vectors")
    found = None
    for dims, n in sorted((r.dims, r.n) for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()):
        mine = classes.where(F.col("dims") == dims)
        lists = max(1, min(MOST_LISTS, int(np.sqrt(n) / 2)))
        taken = mine.orderBy(F.xxhash64("vec"), "rep").limit(max(sample, 16 * lists)).select("vec").toArrow().column(0).to_pylist()
        index = Index.fit(unit_vectors(taken, kind), min(lists, max(1, len(taken) // 8)))
        blocks = list_blocks(mine, index, kind)
        part = search(postings(mine, index, blocks, float(np.sqrt(2 - 2 * cosine)) / 2, kind), index, cosine, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    found, _ = keep(found, "vector-links")
    linked = found.groupBy("a").agg(F.sum("n").alias("outside"))
    components = star_components(found.where("b IS NOT NULL").select("a", "b"))
    own = rows.select("vec_id", F.when(F.col("v").isNotNull(), pack(F.coalesce("v", F.array().cast("array<double>")))).alias("vec"))
    results = classes.join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    results, _ = keep(results.select("vec", "rep", "weight", "outside", "component", F.col("weight").alias("n")), "vector-results")
    own = join_groups(own, results, ["vec"], ["vec_id"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return own.select(
        "vec_id",
        (F.coalesce("outside", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def list_blocks(classes: DataFrame, index: Index, kind: str) -> dict[int, int]:
    """Number of blocks of each list that needs more than one; a row per list at most."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("int")
    def home(vec: pa.Array) -> pa.Array:
        return pa.array(Index.nearest(unit_vectors(vec.to_pylist(), kind), shared.value.centroids)[0], pa.int32())

    sizes = classes.groupBy(home("vec").alias("list")).agg(F.count("*").alias("n"))
    return {r.list: -(-r.n // BLOCK) for r in sizes.collect() if r.n > BLOCK}
