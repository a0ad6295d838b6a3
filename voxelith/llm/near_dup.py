"""N-gram Jaccard join by PartEnum signatures (operator 10; Arasu, Ganti and Kaushik 2006).

Sets of word n-grams fall into bands of sizes; each band and its predecessor
make one instance with a bound k on the symmetric difference of linked sets. The
domain of n-grams is partitioned by hash: n1 parts of n2 sub-parts, of which any
n2 - k2 are enumerated, so that sets within k share a signature. There are more
parts than k asks for, so that such sets share several signatures: a set with
fewer popular or empty ones than that doesn't need them, and leaves the large
groups. Equal sets are one node. Nodes that share a signature are compared with
its pivots; links among nodes that don't link with a pivot are found by their
differences from it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from ..plans.tables import settings
from .common import BROADCAST_ROWS, WordHasher, cut, drop, maybe_broadcast, mix64, ngram_hashes, text_chunks


#: Classes of a sketch; nodes of a signature up to which all of them are compared (a row gives 3.5 pairs at most).
SKETCH, FEW = 128, 8
#: Bits of a table that tells signatures of one node apart from most others before a shuffle: 16 MB, whatever the input. With
#: more shared signatures than half of them it isn't made.
FILTER_BITS = 1 << 27
#: Nodes by root, about, that tell which differences are common; n-grams of all roots up to which they are broadcast.
SAMPLE, BROADCAST_GRAMS = 32, 2_000_000


@dataclass(frozen=True)
class JaccardJoin:
    """Sets of words n-grams (A-Z lowered) that link when den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100
    #: Below `whole` differences all subsets of parts but k of one level are enumerated. From there on there is one level
    #: of k + 1 parts and `spare` of k more. Sets with more empty parts than are spare make signatures of another partition
    #: too; those of the last of `partitions` keep their empty parts. So no link is lost.
    whole: int = 8
    spare: float = 0.25
    partitions: int = 5

    @cached_property
    def bands(self) -> np.ndarray:
        """The greatest size of each band, up to the largest sizes that 32 bits count."""
        tops = [1]
        while tops[-1] < 2**31:
            tops.append(max(tops[-1] + 1, (tops[-1] + 1) * self.den // self.num))
        return np.array(tops)

    def most_differences(self, band: int) -> int:
        return int(2 * int(self.bands[band]) * (self.den - self.num) // (self.den + self.num))

    # -- sets ---------------------------------------------------------------

    @cached_property
    def hasher(self) -> WordHasher:
        return WordHasher(lower_ascii=True)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, n-gram hash) of all distinct n-grams of each text, sorted. A text with fewer words has its whole sequence."""
        n = self.words
        h, _, _, bounds = self.hasher.words(data, offsets)
        count = np.diff(bounds)
        rows = np.repeat(np.arange(len(count)), count)
        grams = ngram_hashes(h, n)
        fits = np.arange(len(grams)) + n - 1 < bounds[rows[: len(grams)] + 1] if len(grams) else np.empty(0, bool)
        row, gram = [rows[: len(grams)][fits]], [grams[fits]]
        for m in range(1, n):
            short = np.flatnonzero(count == m)
            if len(short):
                parts = sum(h[bounds[short] + i] * np.uint64(pow(0x9E3779B97F4A7C15, i + m, 2**64)) for i in range(m))
                row.append(short)
                gram.append(mix64(parts + np.uint64(m)))
        row, gram = np.concatenate(row), np.concatenate(gram)
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        return row[keep], gram[keep]

    # -- signatures ---------------------------------------------------------

    def signatures(self, row: np.ndarray, gram: np.ndarray, n_rows: int) -> tuple[np.ndarray, ...]:
        """(row, signature, plan, spare) for sorted distinct (row, n-gram).

        plan numbers the instance and its partition; spare is how many popular
        signatures the set can do without there, below 0 if none.
        """
        size = np.bincount(row, minlength=n_rows)
        own = np.searchsorted(self.bands, size)
        out: list[list] = [[], [], [], []]
        for instance in np.unique(np.concatenate([own[size > 0], own[size > 0] + 1])):
            k = self.most_differences(int(instance))
            if k == 0:  # only equal sets link
                continue
            ids = np.flatnonzero((size > 0) & ((own == instance) | (own + 1 == instance)))
            for number in range(self.partitions):
                member = np.zeros(n_rows, bool)
                member[ids] = True
                pick = member[row]
                place = np.searchsorted(ids, row[pick])
                n1, n2, subset = (1, k + 4, 3) if k < self.whole else (k + 1 + max(2, int(k * self.spare)), 1, 1)
                shared = n2 - k if k < self.whole else n1 - k
                last = k < self.whole or number == self.partitions - 1
                r, s, spare = self._partition(place, gram[pick], len(ids), int(instance) * 8 + number, n1, n2, subset, shared, last)
                for column, value in zip(out, (ids[r], s, np.full(len(r), int(instance) * 8 + number, np.int32), spare[r])):
                    column.append(value)
                ids = ids[spare < 0]
                if last or not len(ids):
                    break
        types = (np.int64, np.uint64, np.int32, np.int32)
        return tuple(np.concatenate(c).astype(t) if c else np.empty(0, t) for c, t in zip(out, types))

    @staticmethod
    def _partition(place, gram, n_sets, plan, n1, n2, subset, shared, last):
        """Signatures of one partition, and by set the number of them beyond which popular ones count.

        Sets within k share `shared` parts at least (subsets of that many, if
        they are enumerated). Of a set with fewer empty ones some shared one has
        n-grams, so empty ones give no signature; else only in the last partition.
        """
        cells = n1 * n2
        slot = place * cells + (mix64(gram + np.uint64(((plan % 8) * 0x632BE59BD9B4E019 + 1) % 2**64)) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], mix64(gram[order] ^ np.uint64(0xD6E8FEB86659FD93))
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        sums, filled = np.zeros(n_sets * cells, np.uint64), np.zeros(n_sets * cells, bool)
        if len(first):
            sums[slot[first]] = np.add.reduceat(value, first)
            filled[slot[first]] = True
        sums, filled = sums.reshape(n_sets * n1, n2), filled.reshape(n_sets * n1, n2)
        which = np.tile(np.arange(n1, dtype=np.uint64), n_sets)
        owner = np.repeat(np.arange(n_sets), n1)
        subsets = [list(c) for c in combinations(range(n2), subset)]
        full = [filled[:, c].any(axis=1) for c in subsets]
        empty = np.bincount(owner, sum((~f).astype(np.int64) for f in full), n_sets).astype(np.int64)
        spare = np.where(empty < comb(shared, subset), comb(shared, subset) - 1 - empty, -1)
        rows, sigs = [], []
        for number, (c, f) in enumerate(zip(subsets, full)):
            total = sums[:, c].sum(axis=1, dtype=np.uint64)
            tag = mix64(which * np.uint64(65536) + np.uint64(number)) + np.uint64(plan * 0xA0761D6478BD642F % 2**64)
            keep = f | ((spare < 0)[owner] if last else False)
            rows.append(owner[keep])
            sigs.append(mix64(total ^ mix64(tag))[keep])
        return np.concatenate(rows), np.concatenate(sigs), spare

    # -- tables -------------------------------------------------------------

    def _node_table(self, docs: DataFrame) -> DataFrame:
        """doc_id, n, s1, s2 (a 128-bit digest of the set) and sketch of every row; written.

        The sketch counts the n-grams of each of 128 classes, up to 255: the sum
        of two sketches' differences is never more than the sets' difference.
        """

        def run(batches):
            for b in batches:
                for i, j, data, off in text_chunks(b.column(1), 1 << 20):
                    row, gram = self.sets(data, off)
                    n = j - i
                    digests = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    if len(first):
                        digests[0][row[first]] = np.add.reduceat(mix64(gram), first)
                        digests[1][row[first]] = np.add.reduceat(mix64(gram + np.uint64(0x5851F42D4C957F2D)), first)
                    size = np.bincount(row, minlength=n).astype(np.int64)
                    classes = np.bincount(row * SKETCH + (mix64(gram) >> np.uint64(57)).astype(np.int64), minlength=n * SKETCH)
                    sketch = np.minimum(classes, 255).astype(np.uint8).reshape(n, SKETCH)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(size), *(pa.array(d.view(np.int64)) for d in digests), pa.array([r.tobytes() for r in sketch], pa.binary())], ["doc_id", "n", "s1", "s2", "sketch"])

        return cut(docs.mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch binary"), "jaccard-nodes")

    def _plausible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and sketches don't rule out; no pair that links is ruled out."""
        lost, all_ = self.den - self.num, self.den + self.num
        side = lambda d, n, k: nodes.select(F.col("doc_id").alias(d), F.col("n").alias(n), F.col("sketch").alias(k))
        both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").where(self.den * F.least("n", "m") >= self.num * F.greatest("n", "m"))

        def run(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("x", "y"))
                apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
                n, m = (b.column(c).to_numpy() for c in ("n", "m"))
                keep = np.flatnonzero(apart <= (n + m) * lost // all_)
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

        return both.mapInArrow(run, "a bigint, b bigint").distinct()

    @staticmethod
    def _filter(found: DataFrame):
        """A broadcast bit table in which every signature of found has its bit set; None if there are too many."""
        if found.count() > FILTER_BITS // 2:
            return None
        words = found.selectExpr(f"shiftrightunsigned(sig & {FILTER_BITS - 1}, 6) AS w", "shiftleft(1L, CAST(sig & 63 AS INT)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(FILTER_BITS // 64, np.uint64)
        table[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return found.sparkSession.sparkContext.broadcast(table)

    def _signature_rows(self, docs: DataFrame, filter_=None) -> DataFrame:
        """sig, d, plan, spare: a row for each signature of each document with n-grams; those that filter_ rules out are left out."""

        def run(batches):
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for i, j, data, off in text_chunks(b.column(1), 1 << 18):
                    row, gram = self.sets(data, off)
                    r, s, plan, spare = self.signatures(row, gram, j - i)
                    if filter_ is not None:
                        at = s & np.uint64(FILTER_BITS - 1)
                        keep = np.flatnonzero((filter_.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                        r, s, plan, spare = r[keep], s[keep], plan[keep], spare[keep]
                    for k in range(0, len(r), 1 << 16):
                        part = slice(k, k + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(s[part].view(np.int64)), pa.array(ids[i + r[part]].astype(np.int64)), pa.array(plan[part]), pa.array(spare[part])], ["sig", "d", "plan", "spare"])

        return docs.mapInArrow(run, "sig bigint, d bigint, plan int, spare int")

    def _set_table(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """doc_id and its n-gram hashes, for the documents named in ids; written."""

        def run(batches):
            for b in batches:
                for i, j, data, off in text_chunks(b.column(1), 1 << 20):
                    row, gram = self.sets(data, off)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))], ["doc_id", "grams"])

        return cut(docs.join(maybe_broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, grams array<bigint>"), "jaccard-sets")

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link."""
        x, y = (sets.select(F.col("doc_id").alias(d), F.col("grams").alias(g)) for d, g in (("a", "x"), ("b", "y")))
        if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then only the sets in question travel
            pairs = F.broadcast(pairs)
            y = y.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        both = x.join(pairs, "a").join(y, "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), common.alias("c")).where(self.den * F.col("c") >= self.num * (F.col("n") + F.col("m") - F.col("c"))).select("a", "b")

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id of every row.

        component_id is the smallest id that links reach. Null and empty texts
        have no n-grams and stand alone; rows that share an id are one node and
        each keeps its own n_shingles; a null id links with nothing and has a null component; an empty table gives no rows.
        """
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):  # batches of a few MB of text
            return self._components(texts)

    def _components(self, texts: DataFrame) -> DataFrame:
        nodes = self._node_table(texts)
        usable = nodes.where("n > 0 AND doc_id IS NOT NULL")
        equal = usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
        copies = equal.where("copies > 1").select("n", "s1", "s2", "node")
        copies = cut(usable.select("doc_id", "n", "s1", "s2").join(maybe_broadcast(copies), ["n", "s1", "s2"]).select("doc_id", "node"), "jaccard-copies")
        others = copies.where("doc_id <> node").select("doc_id").distinct()
        # One row per node and signature. They are made twice: first to find the signatures that several rows have, then to
        # keep the rows of these. That takes less disk than to keep them all.
        single = texts.where("doc_id IS NOT NULL").join(maybe_broadcast(others), "doc_id", "left_anti")
        rows = self._signature_rows(single)
        # Almost every signature is there once in a task, so counting before the shuffle would hold a task's signatures in memory for nothing.
        found = cut(rows.select("sig").repartition("sig").groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig", "k"), "jaccard-signatures")
        filter_ = self._filter(found)
        kept = cut(self._signature_rows(single, filter_).join(maybe_broadcast(found), "sig"), "jaccard-rows")
        if filter_ is not None:
            filter_.unpersist()
        drop(found)
        # Popular signatures matter only to nodes that have more of them than the parts to spare.
        popular = kept.where(F.col("k") > FEW)
        bound = popular.groupBy("d", "plan").agg(F.count("*").alias("bad"), F.min("spare").alias("spare")).where("bad > spare").select("d", "plan")
        popular = cut(popular.select("sig", "d", "plan").join(maybe_broadcast(cut(bound, "jaccard-bound")), ["d", "plan"], "left_semi").select("sig", "d"), "jaccard-popular")
        groups = popular.groupBy("sig").agg(F.min("d").alias("pivot"), F.count("*").alias("size"))
        shared = cut(popular.join(groups.where("size > 1"), "sig"), "jaccard-shared")
        # A signature of few nodes compares them all; one of more nodes compares them with its pivot, the smallest id.
        few = kept.where(F.col("k") <= FEW).select("sig", "d").unionByName(shared.where(F.col("size") <= FEW).select("sig", "d"))
        many = shared.where(F.col("size") > FEW)
        members = cut(many.where("d > pivot").select("pivot", "d").distinct(), "jaccard-members")
        pairs = few.select("sig", F.col("d").alias("a")).join(few.select("sig", F.col("d").alias("b")), "sig").where("a < b").select("a", "b")
        pairs = pairs.unionByName(members.select(F.col("pivot").alias("a"), F.col("d").alias("b"))).distinct()
        pairs = cut(self._plausible(pairs, usable.select("doc_id", "n", "sketch")), "jaccard-pairs")
        ends = [pairs.select(F.col("a").alias("doc_id")), pairs.select("b"), members.select("pivot"), members.select("d")]
        sets = self._set_table(texts, ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct())
        # One pair of each node first; of the others only those whose ends that didn't tie.
        tree = self._tied(None, pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
        apart = self._rooted(self._rooted(pairs, tree, "a", "ra"), tree, "b", "rb").where("ra <> rb").select("a", "b")
        tree = self._tied(tree, apart, sets)
        if not members.isEmpty():
            tree = self._settle(many.select("sig", "d"), nodes, sets, tree)
        drop(kept, popular, shared, members, pairs, sets)
        # A copy's node, then the node's component.
        node = nodes.select("doc_id", F.col("n").alias("n_shingles")).join(copies.distinct(), "doc_id", "left")
        node = node.withColumn("node", F.coalesce("node", "doc_id"))
        joint = tree.unionByName(copies.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
        twice = joint.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").limit(1).count()
        if twice:  # ids with several texts can tie components together
            tree = stars(joint)
        return node.join(tree.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))

    @staticmethod
    def _rooted(rows: DataFrame, tree: DataFrame, node: str = "d", root: str = "root") -> DataFrame:
        """rows with the component of a node so far."""
        return rows.join(tree.select(F.col("a").alias(node), F.col("b").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))

    def _tied(self, tree: DataFrame | None, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """tree with the pairs that link."""
        found = cut(self._linked(pairs, sets), "jaccard-links")
        if tree is not None and found.isEmpty():
            return tree
        out = stars(found if tree is None else tree.unionByName(found))
        drop(found)
        if tree is not None:
            drop(tree)
        return out

    def _settle(self, many: DataFrame, nodes: DataFrame, sets: DataFrame, tree: DataFrame) -> DataFrame:
        """Finds all links between nodes of one signature that lie in different components still.

        Each signature takes as its reference the root of its largest
        component, so a group of near copies mostly has one. Linked nodes share
        a signature, hence its reference. Let D be a node's symmetric
        difference from that. Nodes a and b differ in |Da| + |Db| - 2 |Da and Db|
        n-grams, so a link needs an overlap of (|Da| + |Db| - k) / 2; if that is
        not positive both link with the reference itself, which D's size tells.
        With D in the order of rarity among the reference's nodes, such sets meet
        in their prefixes. Prefixes hold what is peculiar to a node, so a large
        group of near copies gives few pairs, not the square of its size.
        """
        rows = self._rooted(many, tree)
        large = tree.groupBy(F.col("b").alias("root")).agg(F.count("*").alias("size"))
        by_size = F.struct((-F.coalesce("size", F.lit(0))).alias("s"), F.col("root").alias("ref"))
        chosen = rows.join(large, "root", "left").groupBy("sig").agg(F.min(by_size).alias("m"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
        rooted = rows.join(chosen.select("sig", F.col("m.ref").alias("ref")), "sig").where("d <> ref").select("ref", "d", "root").distinct()
        rooted = cut(rooted, "jaccard-mixed")
        if rooted.isEmpty():
            return tree
        counted = rooted.groupBy("ref").agg(F.count("*").alias("size"))
        refs = cut(counted.select(F.col("ref").alias("doc_id"), F.ceil(F.col("size") / SAMPLE).alias("every")), "jaccard-refs")
        own = sets.join(refs.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("ref"), F.col("grams").alias("x"))
        if own.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0] <= BROADCAST_GRAMS:
            own = F.broadcast(own)

        def apart_from(some: DataFrame) -> DataFrame:
            both = sets.select(F.col("doc_id").alias("d"), F.col("grams").alias("y")).join(maybe_broadcast(some), "d").join(own, "ref")
            return both.select("ref", "d", "root", F.size("y").alias("n"), F.size("x").alias("rn"), F.concat(F.array_except("y", "x"), F.array_except("x", "y")).alias("apart"))

        # What many of a reference's nodes have goes to the end. A sample of nodes tells it; any order gives the same links.
        some = rooted.join(refs.withColumnRenamed("doc_id", "ref"), "ref").where(F.pmod(F.xxhash64("d"), F.col("every")) == 0).select("ref", "d", "root")
        often = apart_from(some).select("ref", F.explode("apart").alias("e")).groupBy("ref", "e").agg(F.count("*").alias("c")).where("c > 1")
        common = cut(often.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("o")).select("ref", F.col("o.e").alias("common")), "jaccard-common")  # by a bounded sample
        apart = apart_from(rooted)
        lost, all_ = self.den - self.num, self.den + self.num
        most = (F.floor((F.col("n") + F.floor(F.col("n") * self.den / self.num)) * lost / all_) + 1).cast("int")
        late = F.coalesce("common", F.array().cast("array<bigint>"))
        first = F.slice(F.concat(F.sort_array(F.array_except("apart", late)), F.array_intersect(late, "apart")), F.lit(1), most)
        start = apart.join(maybe_broadcast(common), "ref", "left").select("ref", "d", "root", "n", "rn", F.size("apart").alias("size"), most.alias("most"), first.alias("first"))
        start = cut(start, "jaccard-prefixes")
        direct = start.where("root <> ref").where(F.col("size") * all_ <= (F.col("n") + F.col("rn")) * lost).select(F.least("ref", "d").alias("a"), F.greatest("ref", "d").alias("b"))
        prefix = start.select("ref", "d", "root", "n", "size", "most", F.posexplode("first").alias("at", "e")).withColumn("e", F.xxhash64("ref", "e"))
        k = F.floor((F.col("n") + F.col("m")) * lost / all_)
        overlap = F.greatest(F.ceil((F.col("size") + F.col("tsize") - k) / 2), F.lit(1))
        meet = (F.col("root") != F.col("troot")) & ((F.col("size") < F.col("tsize")) | ((F.col("size") == F.col("tsize")) & (F.col("d") < F.col("t")))) & (F.col("at") <= F.col("size") - overlap) & (F.col("tat") <= F.col("tsize") - overlap)
        # The smaller difference has the shorter prefix: half of the differences that a link allows.
        short = prefix.where(F.col("at") <= F.col("most") / 2).drop("ref", "most")
        long = prefix.select("e", F.col("d").alias("t"), F.col("root").alias("troot"), F.col("n").alias("m"), F.col("size").alias("tsize"), F.col("at").alias("tat"))
        pairs = short.join(long, "e").where(meet).select(F.least("d", "t").alias("a"), F.greatest("d", "t").alias("b")).distinct().unionByName(direct)
        pairs = cut(self._plausible(pairs, nodes.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "sketch")), "jaccard-last")
        drop(rooted, refs, common, start)
        tree = self._tied(tree, pairs, sets)
        drop(pairs)
        return tree


#: Ids that stand in for null ones start here, above those of documents.
NO_ID = 1 << 62


def drop_near_copies(docs: DataFrame, join: JaccardJoin, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of a group but that of the smallest id; all columns stay.

    Rows with the same id are one document; of those that also have the same
    text one stays. Rows without an id get one from their text, above all others. Null and empty
    texts are in no group, but repeated rows of one id are one here too. An empty table gives no rows.
    """
    text = docs[text_col].cast("string")
    stand_in = F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1))
    own = F.coalesce(docs[id_col].cast("long"), stand_in)
    groups = cut(join.components(docs.select(own.alias("doc_id"), text.alias("text"))), "jaccard-groups")
    more = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id_")).distinct(), "duplicate-ids")
    kept = docs.join(maybe_broadcast(more), own == more["id_"], "left_anti")
    again = cut(groups.groupBy(F.col("doc_id").alias("id_")).agg(F.count("*").alias("n")).where("n > 1").select("id_"), "repeated-ids")
    if again.isEmpty():
        return kept
    several = kept.join(maybe_broadcast(again), own == again["id_"], "left_semi")
    names = [f"c_{k}" for k in range(len(docs.columns))]
    one = several.select(own.alias("id_"), F.md5(text).alias("text_"), F.struct(*(several[c].alias(n) for c, n in zip(docs.columns, names))).alias("row_")).dropDuplicates(["id_", "text_"])
    one = one.select(*(F.col(f"row_.{n}").alias(c) for c, n in zip(docs.columns, names)))
    return kept.join(maybe_broadcast(again), own == again["id_"], "left_anti").unionByName(one)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents: three words, 0.9."""
    return JaccardJoin().components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
