"""A kept vector index: inverted lists of a coarse quantiser, residual product codes, exact scores of the best.

A bounded sample fits the centroids and the code books. Every vector is kept, in the folder of its nearest
centroid's cell, as a unit vector and as a code of a byte for each PART of its residual. A question reads the codes of the cells next to it,
estimates all similarities from a table of partial products, and scores the best by their vectors. With all cells and no estimate it is an exact scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.search import dot, unit
from folioscope.sources.segments import Segments

#: Vectors that the quantisers are fitted on (about, chosen by a hash of the key), and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12
#: Centroids at most, and vectors of the sample for each; dimensions of a part, and codes of one at most.
CELLS, PER_CELL, PART, CODES = 256, 40, 4, 256
#: Cells that a question reads at least, and estimates that are scored exactly, as a multiple of what is asked for.
PROBES, RESCORED = 8, 20
#: What the fit measures on its sample: share of the nearest so many that questions are to find, and questions asked. FITTED as probes: the cells found necessary.
REACHED, NEAREST, ASKED, FITTED = 0.95, 10, 500, 0
#: Where many questions are asked at once: vectors and questions of a block at most (about), and blocks of vectors at least.
BLOCK_VECTORS, BLOCK_QUERIES, LEAST_PARTS = 1 << 17, 1 << 14, 8
#: Pairs that are multiplied at a time and pairs that wait to be sorted, about, and by how much two ways to a product may differ.
TILE, WAITING, NEAR = 1 << 21, 1 << 21, 1e-9


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of a sample: first ones drawn far from each other, then Lloyd's rounds; an empty cell stays where it is."""
    random = np.random.default_rng(seed)
    centroids = x[[random.integers(len(x))]]
    near = ((x - centroids[0]) ** 2).sum(1)
    while len(centroids) < min(k, len(x)) and near.sum() > 0:
        centroids = np.vstack([centroids, x[random.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, ((x - centroids[-1]) ** 2).sum(1))
    for _ in range(rounds):
        cell = nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(cell, minlength=len(centroids))
        np.add.at(sums, cell, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (-2 * x @ centroids.T + (centroids**2).sum(1)).argmin(1)


def as_units(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Quantiser:
    """Centroids, for each part of the dimensions a book of codes, and the cells that a question has to read."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int = PROBES

    @classmethod
    def fit(cls, sample: np.ndarray, *, cells: int) -> Quantiser:
        centroids = k_means(sample, cells)
        rest = sample - centroids[nearest(sample, centroids)]
        model = cls(centroids, [k_means(rest[:, i : i + PART], CODES) for i in range(0, sample.shape[1], PART)])
        model.probes = model.needed(sample)
        return model

    def needed(self, sample: np.ndarray) -> int:
        """The fewest cells by which questions of the sample find REACHED of their NEAREST others, compared with all of the sample; all cells if none do."""
        if len(sample) <= NEAREST + 1:
            return len(self.centroids)
        cell, code = self.encode(sample)
        ranks = []
        for own in np.array_split(np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int), 10):
            exact, of_cell = sample[own] @ sample.T, sample[own] @ self.centroids.T
            estimates = of_cell[:, cell]
            for i, book in enumerate(self.books):
                estimates += (sample[own, PART * i : PART * (i + 1)] @ book.T)[:, code[:, i]]
            for scores in (exact, estimates):
                scores[np.arange(len(own)), own] = -np.inf
            top = np.argsort(-exact, 1, kind="stable")[:, :NEAREST]
            least = -np.sort(-estimates, 1)[:, min(RESCORED * NEAREST, len(sample)) - 1]
            rank = np.take_along_axis(np.argsort(np.argsort(-of_cell, 1, kind="stable"), 1), cell[top], 1)
            ranks.append(np.where(np.take_along_axis(estimates, top, 1) >= least[:, None], rank, len(self.centroids)).ravel())
        found = np.cumsum(np.bincount(np.concatenate(ranks), minlength=len(self.centroids) + 1)[:-1]) / sum(map(len, ranks))
        enough = np.flatnonzero(found >= REACHED)
        return max(PROBES, int(enough[0]) + 1) if len(enough) else len(self.centroids)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(v, self.centroids)
        rest = v - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, PART * i : PART * (i + 1)], book) for i, book in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        return self.centroids[cell] + np.concatenate([book[code[:, i]] for i, book in enumerate(self.books)], 1)

    def products(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of a query with the centroids, and with the codes: parts x CODES."""
        table = np.zeros((len(self.books), CODES))
        for i, book in enumerate(self.books):
            table[i, : len(book)] = book @ query[PART * i : PART * (i + 1)]
        return self.centroids @ query, table


class VectorIndex:
    """Cosine search over vectors (key, vector) of one dimension. Null vectors, null keys, vectors of another dimension and zero
    vectors are left out: they have no direction. A key may be replaced or removed; centroids stay as they were fitted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Segments(spark, path, "key", partitions={"vectors": ["cell"]})
        self._model: Quantiser | None = None

    # ------------------------------------------------------------ fit and change

    def fit(self, vectors: DataFrame, key: str, vector: str, *, sample: int = SAMPLE, cells: int = CELLS) -> None:
        """Fits the quantisers on about `sample` vectors at most and keeps them in the store; a table without vectors fits none."""
        rows = vectors.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
        share = min(1.0, sample / max(1, rows.count()))
        drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("key").limit(2 * sample).collect()
        if not drawn:
            return
        size = len(drawn[0]["v"])
        x = as_units(np.array([r["v"] for r in drawn if len(r["v"]) == size]))
        model = Quantiser.fit(x, cells=max(1, min(cells, len(x) // PER_CELL)))
        kept = [("centroids", i, [float(y) for y in row]) for i, row in enumerate(model.centroids)]
        kept += [(f"book {i}", j, [float(y) for y in row]) for i, book in enumerate(model.books) for j, row in enumerate(book)]
        kept.append(("probes", model.probes, []))
        self.store.commit("model", {"model": self.spark.createDataFrame(kept, "part string, n int, v array<double>").withColumn("key", F.lit(None).cast("string"))})
        self._model = None

    @property
    def model(self) -> Quantiser | None:
        """The quantisers: at most CELLS + CODES x parts rows and one, which fit the driver and each task."""
        if self._model is None and "model" in self.store.manifest().schemas:
            parts: dict[str, list] = {}
            probes = PROBES
            for r in self.store.read("model").orderBy("part", "n").collect():
                if r["part"] == "probes":
                    probes = r["n"]
                else:
                    parts.setdefault(r["part"], []).append(r["v"])
            books = sorted((p for p in parts if p != "centroids"), key=lambda p: int(p.split()[1]))
            self._model = Quantiser(np.array(parts["centroids"]), [np.array(parts[b]) for b in books], probes)
        return self._model

    def replace(self, batch: str, vectors: DataFrame, key: str, vector: str, *, removed: DataFrame | None = None) -> bool:
        """Keeps vectors in place of those of the same keys, and drops the keys in `removed`; false if the batch was applied before."""
        model = self.model
        if model is None or batch in self.store.manifest().batches:
            return False
        size = model.centroids.shape[1]
        rows = vectors.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key IS NOT NULL")
        keys = rows.select("key")
        if removed is not None:
            keys = keys.unionByName(removed.select(F.col(removed.columns[0]).cast("string").alias("key")))

        def encode(column: pa.Array) -> pa.Array:
            if not len(column):
                return pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], ["cell", "code"])
            cell, code = model.encode(np.stack(column.to_numpy(zero_copy_only=False)))
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "code"])

        rows = rows.where((F.size("vector") == size) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
        rows = rows.select("key", unit(F.col("vector")).alias("vector"))
        coded = rows.withColumn("c", F.arrow_udf(encode, "struct<cell: int, code: binary>")(F.col("vector"))).select("c.cell", "key", "c.code", "vector")
        return self.store.commit(batch, {"vectors": coded.repartitionByRange("cell", "key")}, gone=keys if "vectors" in self.store.manifest().schemas else None)

    # ------------------------------------------------------------ questions

    def search(self, query: Sequence[float], *, top: int, probes: int | None = FITTED, rescored: int = RESCORED) -> DataFrame:
        """(key, score) of the nearest vectors, score = max(0, cosine), in as many cells as the fit found necessary; probes None: all of them, exactly."""
        model, wanted = self.model, as_units(np.array(query, float))
        if model is None or "vectors" not in self.store.manifest().schemas or len(wanted) != model.centroids.shape[1]:
            return self.spark.createDataFrame([], "key string, score double")
        rows = self.store.read("vectors")
        exact = F.greatest(dot(F.col("vector"), F.array(*(F.lit(float(x)) for x in wanted))), F.lit(0.0))
        probes = model.probes if probes == FITTED else probes
        if probes is not None:
            of_cell, table = model.products(wanted)
            cells = np.argsort(-of_cell, kind="stable")[:probes]
            rows = rows.where(F.col("cell").isin(*map(int, cells)))
            few = rows.select("key", "cell", estimate(F.col("cell"), F.col("code"), of_cell, table).alias("estimate")).orderBy(F.desc("estimate"), "key").limit(rescored * top)
            rows = rows.join(F.broadcast(few.select("key", "cell")), ["cell", "key"], "left_semi")  # rescored * top rows
        return rows.select("key", exact.alias("score")).orderBy(F.desc("score"), "key").limit(top)


    def search_all(self, queries: DataFrame, *, top: int, probes: int | None = FITTED, rescored: int = RESCORED) -> DataFrame:
        """(query_id, key, score) of the nearest vectors of each query (query_id, vector); queries with nulls or NaN find none.

        Queries and vectors are dealt into blocks of a bounded size, and each block of queries meets each of vectors in a task, which scores them as
        matrices, cell by cell for the queries that probe it (with probes None all by all, exactly), and hands on its best of a query. So pairs are never
        rows: what is shuffled and sorted are the blocks and the best of each.
        """
        model = self.model
        if model is None or "vectors" not in self.store.manifest().schemas:
            return self.spark.createDataFrame([], "query_id string, key string, score double")
        size = model.centroids.shape[1]
        probes = model.probes if probes == FITTED else probes
        wanted = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("query")).where(F.size("query") == size)
        rows = self.store.read("vectors").select("key", "vector", *(() if probes is None else ("cell", "code")))
        parts, groups = max(LEAST_PARTS, -(-rows.count() // BLOCK_VECTORS)), max(1, -(-wanted.count() // BLOCK_QUERIES))

        def dealt(own: DataFrame, by: str, name: str, n: int, other: str, all_: int) -> DataFrame:
            """Rows in one of n blocks, sent to all of the other side's."""
            to = F.explode(F.sequence(F.lit(0), F.lit(all_ - 1))).alias(other)
            # four partitions for each pair of blocks, so that few meet in one
            return own.select("*", F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias(name), to).repartition(4 * parts * groups, "part", "group")

        sent = dealt(wanted.select("query_id", unit(F.col("query")).alias("query")), "query_id", "group", groups, "part", parts).groupBy("part", "group")
        held = dealt(rows, "key", "part", parts, "group", groups).groupBy("part", "group")
        best = partial(best_of_blocks, model=model, top=top if probes is None else rescored * top, probes=probes)
        scored = sent.cogroup(held).applyInArrow(best, "query_id string, key string, estimate double, score double")
        if probes is not None:
            near = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "key")
            scored = scored.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= rescored * top)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return scored.select("query_id", "key", "score").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def _rows_of(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Lists of one size as the rows of a matrix; nulls become NaN."""
    return pc.list_flatten(column).to_numpy().astype(float).reshape(-1, size)


def best_of_blocks(asked: pa.Table, held: pa.Table, *, model: Quantiser, top: int, probes: int | None) -> pa.Table:
    """(query_id, key, estimate, score): of a block of vectors the best `top` of each query of another, by estimates from the codes in the probed cells, or by scores with probes None."""
    held = held.sort_by("key")  # so that places stand for keys
    size = model.centroids.shape[1]
    q, v = (_rows_of(t.column(name), size) for t, name in ((asked, "query"), (held, "vector")))
    queries, places = np.arange(len(q), dtype=np.int32), np.arange(len(v), dtype=np.int32)
    tile = max(128, TILE // max(1, len(q)))
    if probes is None:
        best = Best(q, v, top, least=0.0)
        for at in range(0, len(v), tile):
            best.offer(queries, places[at : at + tile])
    else:
        cell = held.column("cell").to_numpy()
        code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(v), len(model.books))
        best = Best(q, model.decode(cell, code), top)
        probed = np.zeros((len(q), len(model.centroids)), bool)
        np.put_along_axis(probed, np.argsort(-(q @ model.centroids.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        order = np.argsort(cell, kind="stable").astype(np.int32)
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(v) else ():
            for at in range(0, len(own), tile):
                best.offer(queries[probed[:, cell[own[0]]]], own[at : at + tile])
    query, place, estimate = best.cut()
    score = estimate if probes is None else np.maximum(products(q, query, v, place), 0.0)
    columns = [asked.column("query_id").take(pa.array(query)), held.column("key").take(pa.array(place)), pa.array(estimate), pa.array(score)]
    return pa.table(columns, names=["query_id", "key", "estimate", "score"])


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of a with the rows j of b, summed in the order of the dimensions: equal rows have equal products, those of `dot`."""
    out = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[i] * y[j]
    return out


class Best:
    """The best `top` vectors of each query, by product and then by place, of all that are offered. Matrix products, whose last digits depend on
    what they are made with, only tell what can't be among the best; what may be is multiplied again. Products below `least` count as that."""

    def __init__(self, q: np.ndarray, v: np.ndarray, top: int, *, least: float = -np.inf):
        self.q, self.v, self.top, self.least = q, v, top, least
        self.by_dimension = np.asfortranarray(q), np.asfortranarray(v)
        self.floor = np.full(len(q), -np.inf)  # what a further vector has to reach
        self.kept = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, queries: np.ndarray, places: np.ndarray) -> None:
        """Takes a few vectors for some of the queries, TILE pairs or so."""
        scores = self.q[queries] @ self.v[places].T
        if self.least > -np.inf:
            np.maximum(scores, self.least, out=scores)
        floor = self.floor[queries]
        if len(places) > self.top and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, len(places) - self.top, axis=1)[:, len(places) - self.top] - NEAR)
        i, j = np.nonzero(scores >= floor[:, None])
        self.more.append((queries[i], places[j]))
        self.waiting += len(i)
        if self.waiting > WAITING:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, product) of the best so far."""
        if self.more:
            i, j = (np.concatenate(x) for x in zip(*self.more, strict=True))
            score = np.maximum(products(self.by_dimension[0], i, self.by_dimension[1], j), self.least)
            query, place, score = (np.concatenate(x) for x in zip(self.kept, (i, j, score), strict=True))
            order = np.lexsort((place, -score, query))
            query, place, score = query[order], place[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            self.kept = tuple(x[rank < self.top] for x in (query, place, score))
            last = rank == self.top - 1
            self.floor[query[last]] = score[last] - NEAR
            self.more, self.waiting = [], 0
        return self.kept


def estimate(cell: Column, code: Column, of_cell: np.ndarray, table: np.ndarray) -> Column:
    """Similarity of a query to coded vectors: the product with the centroid and those with the codes."""
    parts = np.arange(len(table))

    def products(cells: pa.Array, codes: pa.Array) -> pa.Array:
        if not len(codes):
            return pa.array([], pa.float64())
        taken = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), len(parts))
        return pa.array(of_cell[cells.to_numpy()] + table[parts, taken].sum(1))

    return F.arrow_udf(products, "double")(cell, code)


def recall(index: VectorIndex, queries: DataFrame, *, top: int, probes: int = FITTED) -> float:
    """Share of the exact nearest of all queries (query_id, vector) that the probed cells and estimates give."""
    found = index.search_all(queries, top=top, probes=probes).select("query_id", "key", F.lit(1.0).alias("hit"))
    exact = index.search_all(queries, top=top, probes=None)
    return exact.join(found, ["query_id", "key"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0)))).first()[0] or 0.0
