"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 11; Dong, Charikar and Li 2011).

Equal vectors are one node. The graph starts from blocks of nodes that random
hyperplanes put near one another; then each round joins every node's neighbours,
in both directions, at that node, compares them with each other and hands each
what is nearer than its worst neighbour so far, until few change. Queries walk the
finished graph: each round opens the nearest nodes that aren't open yet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.tables import settings
from .common import cut, drop, maybe_broadcast, mix64


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec (doubles) of the rows that take part, one for each id; written.

    Left out: null ids, null, empty and zero vectors, those with null or
    non-finite components, and those whose length isn't the most common one (of
    several, the greatest). Of rows with the same id the least vector stays.
    """
    vec = F.col(vec_col).cast("array<double>")
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: x + F.lit(0.0)).alias("vec"), finite.alias("ok")).where("id IS NOT NULL AND ok AND exists(vec, x -> x <> 0)").drop("ok")
    rows = cut(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(2).collect()
    return rows if len(sizes) < 2 else rows.where(F.size("vec") == sizes[0].n)


def cosine(x: str, y: str):
    """The cosine of two array<double> columns, term by term in order."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unpacked(column, kind) -> np.ndarray:
    """Rows of an Arrow binary column as a matrix of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], pa.binary())


#: Queries that walk at once; more take turns. Their vectors and the worst of their beams are what tasks get as a broadcast.
QUERIES = 20_000
#: Queries of a node that one row holds, about.
TOGETHER = 1_000


@dataclass(frozen=True)
class NeighbourGraph:
    """Settings of the graph and its search.

    k: neighbours of a node. Rounds also follow edges backwards, to the k nearest nodes that name this one; an edge
    beyond these stays with the node that has it. trees, block: orders and block size of the start. A round that changes
    at most `settled` of all edges is the last. beam: nodes that a search keeps; open_: how many it opens a round;
    entries: nodes at which each search starts besides its own.
    """

    k: int = 32
    trees: int = 2
    block: int = 64
    rounds: int = 12
    settled: float = 0.1
    beam: int = 256
    open_: int = 128
    entries: int = 32

    # -- the graph ----------------------------------------------------------

    @staticmethod
    def scaled(vectors: DataFrame) -> DataFrame:
        """node, unit, small of rows (node, vec).

        unit is the vector at length 1 in single precision; small, in 8 bits a component, is what travels while the graph is made.
        """

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column("vec"))
                    m = m / np.abs(m).max(axis=1, keepdims=True)
                    unit = (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([b.column("node"), _packed(unit), _packed(np.rint(m * 127).astype(np.int8))], ["node", "unit", "small"])

        return vectors.select("node", "vec").mapInArrow(run, "node bigint, unit binary, small binary")

    @staticmethod
    def _vectors(small) -> np.ndarray:
        m = _unpacked(small, np.int8).astype(np.float32)
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def _start(self, nodes: DataFrame) -> DataFrame:
        """node, other, sim: the k nearest within blocks of nodes that are neighbours in one of `trees` random orders.

        An order sorts by the signs of 24 random projections, then by a hash, so
        that blocks are of one size however dense the nodes lie.
        """
        block, k, vectors = self.block, self.k, self._vectors

        def coded(tree):
            def run(batches):
                for b in batches:
                    if b.num_rows:
                        m = vectors(b.column("small"))
                        planes = np.random.default_rng(tree).standard_normal((m.shape[1], 24)).astype(np.float32)
                        code = ((m @ planes) > 0) @ (1 << np.arange(23, -1, -1))
                        mixed = mix64(b.column("node").to_numpy().astype(np.uint64) + np.uint64(tree)) >> np.uint64(1)
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64)), pa.array(mixed.astype(np.int64))], ["node", "small", "code", "mixed"])

            return run

        def near(batches):
            held = None
            for b in batches:
                table = pa.Table.from_batches([b.select(["node", "small"])])
                held = table if held is None else pa.concat_tables([held, table])
                while held.num_rows >= 2 * block:
                    yield from compared(held.slice(0, block))
                    held = held.slice(block)
            if held is not None and held.num_rows:
                yield from compared(held)

        def compared(table):
            ids, m = table.column("node").to_numpy(), vectors(table.column("small"))
            sims = m @ m.T
            np.fill_diagonal(sims, -2)
            most = min(k, len(ids) - 1)
            if most:
                best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, most)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(sims, best, 1).ravel())], ["node", "other", "sim"])

        found = None
        for tree in range(self.trees):
            order = nodes.select("node", "small").mapInArrow(coded(tree), "node bigint, small binary, code bigint, mixed bigint").repartitionByRange("code", "mixed").sortWithinPartitions("code", "mixed")
            pairs = order.mapInArrow(near, "node bigint, other bigint, sim float")
            found = pairs if found is None else found.unionByName(pairs)
        return found

    def _best(self, edges: DataFrame, by: list[str], most: int) -> DataFrame:
        """The rows of the `most` greatest sims of each group. Spark limits the groups before it shuffles them, too."""
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sim"), *[c for c in ("node", "other") if c in edges.columns and c not in by]))
        return edges.withColumn("rank_", rank).where(F.col("rank_") <= most).drop("rank_")

    def graph(self, nodes: DataFrame) -> DataFrame:
        """node, other, sim: the k nearest nodes found of each node; written."""
        k = self.k
        start = self._start(nodes).groupBy("node", "other").agg(F.max("sim").alias("sim"))
        edges = cut(self._best(start, ["node"], k).withColumn("new", F.lit(True)), "graph")
        for _ in range(self.rounds):
            worst = edges.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
            known = nodes.join(worst, "node", "left").select(F.col("node").alias("member"), "small", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
            back = self._best(edges, ["other"], k)
            ends = edges.select(F.col("node").alias("at"), F.col("other").alias("member"), "new").unionByName(back.select(F.col("other").alias("at"), F.col("node").alias("member"), "new"))
            around = ends.join(known, "member").groupBy("at").agg(F.collect_list(F.struct("member", "new", "worst", "small")).alias("m")).where("exists(m, x -> x.new)")
            found = around.select(*(F.col("m")[c].alias(c) for c in ("member", "new", "worst", "small"))).mapInArrow(self._meet, "node bigint, other bigint, sim float")
            both = found.withColumn("new", F.lit(True)).unionByName(edges.withColumn("new", F.lit(False)))
            both = both.repartition("node").groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))  # one shuffle serves this and the ranks
            seen = Observation()
            after = cut(self._best(both, ["node"], k).observe(seen, F.count("*").alias("all"), F.count(F.when(F.col("new"), 1)).alias("new")), "graph")
            drop(edges)
            edges = after
            if seen.get["new"] <= self.settled * seen.get["all"]:
                break
        return edges.select("node", "other", "sim")

    def _meet(self, batches):
        """Compares the neighbours of one node with each other, where one of them is new; 2 * k of them at most."""
        for b in batches:
            members, news, worsts, small = (b.column(c) for c in ("member", "new", "worst", "small"))
            size = np.diff(members.offsets.to_numpy())
            flat = [members.flatten().to_numpy(), news.flatten().to_numpy(zero_copy_only=False).astype(bool), worsts.flatten().to_numpy()]
            if not len(flat[0]):
                continue
            # A node that comes forwards and backwards counts once, as new if either edge is.
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((~flat[1], flat[0], row))
            first = np.append(True, (np.diff(row[order]) != 0) | (np.diff(flat[0][order]) != 0))
            order = order[first]
            size, flat = np.bincount(row[order], minlength=len(size)), [x[order] for x in flat]
            vectors = self._vectors(small.flatten())[order]
            starts = np.concatenate([[0], np.cumsum(size)])
            out = [[], [], []]
            for n in np.unique(size):
                if n < 2:
                    continue
                at = starts[:-1][size == n][:, None] + np.arange(n)
                for part in np.array_split(at, max(1, len(at) * n * n >> 20)):
                    ids, new, worst, v = flat[0][part], flat[1][part], flat[2][part], vectors[part]
                    sims = v @ v.transpose(0, 2, 1)
                    sims[~(new[:, :, None] | new[:, None, :]) | (sims <= worst[:, :, None])] = -2
                    sims[:, np.arange(n), np.arange(n)] = -2
                    if n - 1 > self.k:  # a node takes no more than its k nearest from here
                        sims[sims < -np.partition(-sims, self.k - 1, axis=2)[:, :, self.k - 1 : self.k]] = -2
                    g, x, y = np.nonzero(sims > -2)
                    for column, value in zip(out, (ids[g, x], ids[g, y], sims[g, x, y])):
                        column.append(value)
            if out[0]:
                found = [np.concatenate(c) for c in out]
                for i in range(0, len(found[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)]) for c in found], ["node", "other", "sim"])

    def both_ways(self, edges: DataFrame) -> DataFrame:
        """node, others: neighbours that a search follows, the node's own and the k nearest that name it; written."""
        back = self._best(edges, ["other"], self.k).select(F.col("other").alias("node"), F.col("node").alias("other"))
        return cut(edges.select("node", "other").unionByName(back).groupBy("node").agg(F.collect_set("other").alias("others")), "graph-both")

    # -- search -------------------------------------------------------------

    def search(self, queries: DataFrame, nodes: DataFrame, adjacent: DataFrame) -> DataFrame:
        """query, node: up to `beam` nearest nodes found of each query (columns query, unit, home).

        A query starts at its home, the node of its own vector, if the index has
        one (home may be null), and at `entries` fixed nodes.
        """
        entry = [r.node for r in nodes.orderBy(F.xxhash64("node"), "node").limit(self.entries).select("node").collect()]
        turns = max(1, -(-queries.count() // QUERIES))
        found = None
        for k in range(turns):
            part = self._walk(queries.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == k), nodes, adjacent, entry)
            found = part if found is None else found.unionByName(part)
        return found

    def _walk(self, queries: DataFrame, nodes: DataFrame, adjacent: DataFrame, entry: list[int]) -> DataFrame:
        """All queries of a turn at once: a round joins the opened nodes with their neighbours, and these with their vectors; a query is done when its beam is open."""
        sc = queries.sparkSession.sparkContext
        own = queries.select("query", "unit").orderBy("query").toArrow()
        ids = own.column("query").to_numpy()
        asked = sc.broadcast((ids, _unpacked(own.column("unit"), np.float32))) if len(ids) else None
        pairs = queries.select("query", F.explode(F.array_append(F.lit(entry).cast("array<bigint>"), F.col("home"))).alias("node")).where("node IS NOT NULL")
        beam, worst = None, np.full(len(ids), -2, np.float32)
        while True:
            held = beam and beam.select("query", "node", "sim", (F.col("opened") | F.col("next")).alias("opened"))
            limit = sc.broadcast(worst)
            seen = Observation()
            now = self._beams(self._nearer(pairs, nodes, asked, limit), held).observe(seen, F.count(F.when(F.col("next"), 1)).alias("next"))
            after = cut(now, "search")
            limit.unpersist()
            if beam:
                drop(beam)
            beam = after
            if not seen.get["next"]:
                return beam.select("query", "node")
            least = beam.groupBy("query").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= self.beam).toArrow()
            worst = np.full(len(ids), -2, np.float32)
            worst[np.searchsorted(ids, least.column("query").to_numpy())] = least.column("worst").to_numpy()
            opened = maybe_broadcast(beam.where("next").select("query", "node"))
            pairs = adjacent.join(opened, "node").select("query", F.explode("others").alias("node"))

    @staticmethod
    def _nearer(pairs: DataFrame, nodes: DataFrame, asked, limit) -> DataFrame:
        """query, node, sim of the pairs that are nearer than the worst of the query's beam. A node's vector travels once for many queries."""

        def run(batches):
            ids, matrix = asked.value
            for b in batches:
                lists = b.column("queries")
                size = np.diff(lists.offsets.to_numpy())
                vectors, node = _unpacked(b.column("unit"), np.float32), b.column("node").to_numpy()
                row = np.repeat(np.arange(len(size)), size)
                at = np.searchsorted(ids, lists.flatten().to_numpy())
                for i in range(0, len(at), 1 << 15):
                    r, q = row[i : i + (1 << 15)], at[i : i + (1 << 15)]
                    sims = np.einsum("ij,ij->i", vectors[r], matrix[q])
                    keep = np.flatnonzero(sims >= limit.value[q])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(node[r[keep]]), pa.array(sims[keep])], ["query", "node", "sim"])

        part = F.pmod(F.xxhash64("query"), F.lit(QUERIES // TOGETHER)).alias("part")
        lists = pairs.groupBy("node", part).agg(F.collect_set("query").alias("queries"))
        return lists.join(nodes.select("node", "unit"), "node").select("node", "unit", "queries").mapInArrow(run, "query bigint, node bigint, sim float")

    def _beams(self, found: DataFrame, held: DataFrame | None) -> DataFrame:
        """The `beam` nearest nodes of each query; next marks those to be opened."""
        found = found.withColumn("opened", F.lit(False))
        both = found if held is None else held.unionByName(found)
        both = both.repartition("query").groupBy("query", "node").agg(F.max("sim").alias("sim"), F.max("opened").alias("opened"))  # one shuffle serves this and the ranks
        turn = F.row_number().over(Window.partitionBy("query").orderBy("opened", F.desc("sim"), "node"))
        return self._best(both, ["query"], self.beam).withColumn("next", ~F.col("opened") & (turn <= self.open_))

    def nearest(self, rows: DataFrame, asked: DataFrame, most: int) -> DataFrame:
        """query_id, rank, vec_id, score: the `most` nearest rows (id, vec) found for each row of asked, itself left out.

        Scores are cosines of the whole vectors in double precision; equal ones go to the smaller id.
        """
        with settings(rows.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
            names = rows.groupBy("vec").agg(F.min("id").alias("home"))  # equal vectors are one node, named by their least id
            nodes = cut(self.scaled(names.select(F.col("home").alias("node"), "vec")), "graph-nodes")
            asked = cut(asked.join(names, "vec", "left").select(F.col("id").alias("query"), "vec", "home"), "search-asked")
            units = self.scaled(asked.select(F.col("query").alias("node"), "vec")).select(F.col("node").alias("query"), "unit")
            units = cut(units.join(asked.select("query", "home"), "query"), "search-units")
            found = self.search(units, nodes, self.both_ways(self.graph(nodes)))
        # The ids of a node's vector: one more than asked for, as the query may be among them.
        place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
        own = rows.withColumn("place", place).where(F.col("place") <= most + 1).select("id", "vec")
        members = own.join(names.withColumnRenamed("home", "node"), "vec")
        pairs = found.join(members, "node").where("id <> query").join(asked.select("query", F.col("vec").alias("asked")), "query")
        return _ranked(pairs.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), cosine("asked", "vec").alias("score")), most)


def exact_nearest(rows: DataFrame, asked: DataFrame, most: int, block: int = 2_000) -> DataFrame:
    """The same columns, exactly: all rows against the queries, block by block. It measures the recall of the graph."""
    asked = asked.select("id", "vec")
    named = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(asked.count() // block + 1))).groupBy("block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("vec")).alias("vecs"))
    found = None
    for b in named.toLocalIterator():
        ids, m = np.array(b.ids), np.array(b.vecs).reshape(len(b.ids), -1)

        def run(batches, ids=ids, m=m / np.linalg.norm(m, axis=1, keepdims=True)):
            for part in batches:
                if part.num_rows:
                    own, v = part.column("id").to_numpy(), _matrix(part.column("vec"))
                    sims = m @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                    sims[ids[:, None] == own[None, :]] = -2
                    n = min(most, len(own))
                    best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                    keep = sims >= np.take_along_axis(sims, best, 1).min(axis=1, keepdims=True) - 1e-9  # with all ties
                    keep &= sims > -2
                    q, x = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[x]), pa.array(sims[q, x])], ["node", "other", "sim"])

        pairs = rows.select("id", "vec").mapInArrow(run, "node bigint, other bigint, sim double")
        found = pairs if found is None else found.unionByName(pairs)
    side = lambda k, v: rows.select(F.col("id").alias(k), F.col("vec").alias(v))
    scored = found.select(F.col("node").alias("query_id"), F.col("other").alias("vec_id")).join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("asked")), "query_id").join(side("vec_id", "vec"), "vec_id")
    return _ranked(scored.select("query_id", "vec_id", cosine("asked", "vec").alias("score")), most)


def _ranked(scored: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows found of every row whose vec_id is divisible by 50, by cosine.

    Which rows take no part: see usable. An empty table gives no rows.
    """
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return NeighbourGraph().nearest(rows, rows.where("id % 50 = 0"), 5)
