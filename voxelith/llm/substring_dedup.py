"""Repeated word windows, found by a log-structured fingerprint index (operator 7).

Each window of 20 words is represented by its minimiser: the least hash among
its 8-word sequences. Equal windows have equal minimisers, and neighbouring
windows mostly share one, so the index holds about one fingerprint for seven
words. A batch of documents becomes an immutable run: the fingerprints' keys with
their counts, bucketed and sorted, and their places. A new run's keys are
merge-joined with those of the older runs bucket by bucket, without a shuffle;
each key is one row there, however often it occurs. Places of keys that match are
verified on the whole windows of the texts concerned. The keys of the runs are
merged into one run when there are too many. A manifest in the index's folder
names the runs, so a later session can go on with it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import CLEANUP, settings
from .common import BROADCAST_ROWS, WordHasher, cut, drop, maybe_broadcast, ngram_hashes, shared_path, text_chunks, write_parquet

WINDOW, GRAM = 20, 8

_WORDS = WordHasher(seed=3)
_OTHER = WordHasher(seed=4)


def _minimisers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window within a text: its first word, and the place and hash of its minimiser (leftmost on ties)."""
    n, span = len(words), WINDOW - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= bounds[row[: n - WINDOW + 1] + 1])
    grams = ngram_hashes(words, GRAM)
    count = len(grams) - span + 1
    least = grams[:count].copy()
    for k in range(1, span):
        np.minimum(least, grams[k : k + count], out=least)
    place = np.zeros(count, np.int64)
    for k in range(span - 1, -1, -1):
        place[grams[k : k + count] == least] = k
    return starts, starts + place[starts], least[starts]


PLACES = "h bigint, doc_id bigint, pos int"


def fingerprints(docs: DataFrame) -> DataFrame:
    """h, doc_id, pos: the distinct minimisers of all windows of each text (doc_id, text), pos a word number."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, off in text_chunks(b.column(1)):
                words, _, _, bounds = _WORDS.words(data, off)
                _, place, h = _minimisers(words, bounds)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                place, h = place[first], h[first]
                row = np.searchsorted(bounds, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i + row].astype(np.int64)), pa.array((place - bounds[row]).astype(np.int32))], ["h", "doc_id", "pos"])

    return docs.mapInArrow(run, PLACES)


#: Places of one key from which its rows are dealt over SALTS tasks in a shuffled join.
HOT, SALTS = 10_000, 64


class FingerprintIndex:
    """Sorted runs of fingerprints. append(batch) writes a run and gives the places that have to be verified.

    With keep_texts the batches themselves are stored too: later calls compare
    their windows with those of the earlier texts, which fingerprints can't tell.
    With a path, the index is one that an earlier session left there, if there is one. An
    index has one writer at a time. Files are written first, then the manifest that names them, then files that it no longer
    names go: a session that breaks off anywhere leaves the index of its last whole call, and the next one clears the rest.
    """

    def __init__(self, spark: SparkSession, most_runs: int = 4, buckets: int | None = None, keep_texts: bool = True, path: str | None = None):
        self.spark, self.most_runs, self.keep_texts = spark, most_runs, keep_texts
        self.path = path or shared_path(spark, "fingerprint-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self.sources = 0, [], []  # a run: its keys' table, buckets, and folders of places
        if path:
            self._open()

    # -- manifest ------------------------------------------------------------

    def _files(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        at, files = self._files()
        found = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        versions = sorted(f for f in found if f.startswith("manifest-") and files.exists(self._files(f"{f}/_SUCCESS")[0]))
        if not versions:
            return
        state = json.loads(self.spark.read.text(f"{self.path}/{versions[-1]}").first()[0])
        self.version, self.runs, self.sources = state["version"], state["runs"], state["sources"]
        # What a call that didn't end has left: no manifest names it.
        named = {p.rsplit("/", 1)[-1] for p in [*self.sources, *(q for r in self.runs for q in (r["keys"], *r["places"]))]}
        for name in found:
            if name.startswith(("texts-", "places-", "fingerprints_")) and name not in named:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}" if name.startswith("fingerprints_") else "SELECT 1")
                files.delete(self._files(name)[0], True)
        for run in self.runs:
            if not self.spark.catalog.tableExists(run["keys"]):
                self.spark.sql(f"CREATE TABLE {run['keys']} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{run['keys']}'")

    def _save(self) -> None:
        self.version += 1
        state = json.dumps({"version": self.version, "runs": self.runs, "sources": self.sources})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")

    # -- runs ------------------------------------------------------------------

    def texts(self) -> DataFrame | None:
        """doc_id, text of all stored batches so far."""
        return self.spark.read.parquet(*self.sources) if self.sources else None

    def _write_keys(self, counted: DataFrame) -> dict:
        """A run of h, n (one row for each h; counted is partitioned by h)."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        with settings(self.spark, **{CLEANUP: "true", "spark__sql__shuffle__partitions": str(self.buckets)}):
            counted.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return {"keys": name, "buckets": self.buckets, "places": []}

    def _at(self, places: list[str], matched: DataFrame) -> DataFrame:
        """doc_id, pos of the places whose keys are among matched (h, n)."""
        rows = self.spark.read.schema(PLACES).parquet(*places)
        if matched.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return rows.join(F.broadcast(matched.select("h")), "h", "left_semi").select("doc_id", "pos")
        # Frequent keys, at most one for HOT rows, go to SALTS tasks each.
        hot = cut(matched.where(F.col("n") >= HOT).select("h"), "fingerprint-hot")
        salts = F.sequence(F.lit(0), F.when(F.col("n") >= HOT, SALTS - 1).otherwise(0))
        keys = matched.select("h", F.explode(salts).alias("salt"))
        dealt = rows.join(maybe_broadcast(hot.withColumn("hot", F.lit(True))), "h", "left")
        dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).otherwise(0))
        return dealt.join(keys, ["h", "salt"], "left_semi").select("doc_id", "pos")

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds the documents (doc_id, text) as a run; doc_id, pos of fingerprints, old and new, that match another; written.

        The joined keys are bucketed alike: runs meet bucket by bucket.
        """
        stored = []
        if self.keep_texts:
            stored = [f"{self.path}/texts-{uuid.uuid4().hex}"]
            write_parquet(docs, stored[0])
            docs = self.spark.read.parquet(*stored)
        folder = f"{self.path}/places-{uuid.uuid4().hex}"
        write_parquet(fingerprints(docs), folder)
        run = self._write_keys(self.spark.read.schema(PLACES).parquet(folder).groupBy("h").agg(F.count("*").alias("n")))
        run["places"] = [folder]
        new = self.spark.table(run["keys"])
        known = new
        for k, old in enumerate(self.runs):
            known = known.join(self.spark.table(old["keys"]).select("h", F.col("n").alias(f"n_{k}")), "h", "left")
        olds = [F.col(f"n_{k}") for k in range(len(self.runs))]
        known = cut(known.where(reduce(lambda a, b: a | b, (c.isNotNull() for c in olds), F.col("n") > 1)), "fingerprint-matches")
        found = [self._at([folder], known.select("h", "n"))]
        for k, old in enumerate(self.runs):
            found.append(self._at(old["places"], known.where(olds[k].isNotNull()).select("h", olds[k].alias("n"))))
        out = cut(reduce(DataFrame.unionByName, found), "fingerprint-found")
        drop(known)
        self.runs.append(run)
        self.sources += stored
        old = self.compact()
        self._save()
        self._remove(old)  # only now does no manifest name them
        return out

    def compact(self) -> list[dict]:
        """Merges the keys of all runs into one run if there are more than most_runs. Gives the runs that it took the place of; places stay."""
        if len(self.runs) <= self.most_runs:
            return []
        rows = reduce(DataFrame.unionByName, (self.spark.table(r["keys"]) for r in self.runs))
        merged = self._write_keys(rows.groupBy("h").agg(F.sum("n").alias("n")))
        merged["places"] = [p for r in self.runs for p in r["places"]]
        old, self.runs = self.runs, [merged]
        return old

    def _remove(self, runs: list[dict]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['keys']}")
            at, files = self._files(run["keys"])
            files.delete(at, True)

    def remove(self) -> None:
        """Deletes the index."""
        self._remove(self.runs)
        at, files = self._files()
        files.delete(at, True)
        self.runs, self.sources = [], []


#: A start and 24 bits of a digest of the text, which tells rows with the same id apart.
VERSION = 1 << 24
#: Above every start: document and start in one number that sorts, so that minima are hash aggregates.
ORDER = 1 << 55


def _version(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=3).digest(), "big")


def _windows(texts: DataFrame) -> DataFrame:
    """w1, w2, doc_id, at of each window whose minimiser is among places, from (doc_id, text, places)."""

    def run(batches):
        for b in batches:
            ids, places = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for i, j, data, off in text_chunks(b.column(1)):
                words, _, _, bounds = _WORDS.words(data, off)
                other = _OTHER.words(data, off)[0]
                starts, place, _ = _minimisers(words, bounds)
                wanted = np.zeros(len(words), bool)
                for r in range(i, j):
                    p = np.asarray(places[r].values.to_numpy(zero_copy_only=False))
                    p = p[p < bounds[r - i + 1] - bounds[r - i]]
                    wanted[bounds[r - i] + p] = True
                starts = starts[wanted[place]]
                if not len(starts):
                    continue
                row = np.searchsorted(bounds, starts, "right") - 1
                version = np.array([_version(data[off[r] : off[r + 1]].tobytes()) for r in range(j - i)], np.int64)
                at = (starts - bounds[row]) * VERSION + version[row]
                keys = [ngram_hashes(x, WINDOW)[starts].view(np.int64) for x in (words, other)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), pa.array(ids[i + row].astype(np.int64)), pa.array(at)], ["w1", "w2", "doc_id", "at"])

    return texts.mapInArrow(run, "w1 bigint, w2 bigint, doc_id bigint, at bigint")


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _cut_words(texts: DataFrame, digest: bool) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space (or their sha256), from (doc_id, text, copy, ats)."""

    def run(batches):
        for b in batches:
            out, size = [[], [], [], []], 0
            for key, text, copy, ats in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                n, removed = len(words), 0
                if copy and n >= WINDOW:
                    words, removed = [], n
                elif ats.is_valid and len(ats.values):
                    at = np.asarray(ats.values.to_numpy(zero_copy_only=False))
                    start = at[at % VERSION == _version(raw)] // VERSION
                    start = start[start + WINDOW <= n]
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + WINDOW, -1)
                    keep = np.cumsum(step[:n]) == 0
                    removed = n - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                kept = b" ".join(words)
                for column, value in zip(out, (key, n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass"))):
                    column.append(value)
                size += 64 if digest else len(kept)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
                    out, size = [[], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return texts.mapInArrow(run, OUT)


def drop_repeats(docs: DataFrame, batches: int = 6, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row.

    Removed is each word covered by a window of 20 words that also starts
    earlier: in a smaller id, or at an earlier word of the same text. kept holds
    the other words joined by a space, or their sha256. Documents go into the
    index in `batches` ranges of ids. Texts equal to one with a smaller id aren't indexed:
    all of their windows start earlier. Null texts have no words. A null id is
    compared with nothing. Rows with the same id are separate texts at the same
    place: none starts earlier than the other at the same word. An empty table gives no rows.
    With an index of earlier calls, windows of its texts count like those of docs;
    what the earlier calls gave stays, also if docs have smaller ids.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or FingerprintIndex(spark, keep_texts=False)
    if index.runs and not index.keep_texts:
        raise ValueError("an index for several calls needs keep_texts")
    history = index.texts()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    digests = cut(named.select("doc_id", F.md5("text").alias("digest")), "text-digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    copies = cut(digests.join(firsts, "digest").where("doc_id > original").select("doc_id").distinct(), "text-copies")
    n_copies = copies.count()
    single = digests.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    ids = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    copied = F.broadcast(copies) if n_copies <= 200_000 else copies
    low, high = (ids[0], ids[1]) if ids[0] is not None else (0, 0)
    edges = [low + (high - low + 1) * k // batches for k in range(batches)] + [None]
    found = []
    for a, b in zip(edges[:-1], edges[1:]):
        part = named.where(F.col("doc_id") >= a) if b is None else named.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))
        if single:  # with several texts for an id, copies go in too
            part = part.join(copied, "doc_id", "left_anti")
        found.append(index.append(part))
    if own:
        index.remove()
    places = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    if history is not None:
        places = cut(places, "index-places")  # also of earlier texts, whose ids may be those of copies
        earlier = _windows(history.join(places, "doc_id").select("doc_id", "text", "places"))
    if single:
        places = places.join(copied, "doc_id", "left_anti")
    places = cut(places, "window-places")
    windows = _windows(texts.join(places, "doc_id").select("doc_id", "text", "places"))
    known = windows if history is None else windows.unionByName(earlier)
    # The windows are made twice, which costs less than to keep them; each time their shuffles go when the job ends.
    order = F.col("doc_id").cast("decimal(20,0)") * F.lit(ORDER).cast("decimal(17,0)") + F.col("at").cast("decimal(17,0)")
    first = cut(known.groupBy("w1", "w2").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n"), "window-firsts")
    later = windows.join(first, ["w1", "w2"]).where(F.floor(order / VERSION) > F.floor(F.col("f") / VERSION))
    covered = cut(later.groupBy("doc_id").agg(F.collect_list("at").alias("ats")), "window-covered")
    marked = copies.withColumn("copy", F.lit(single))
    both = texts.join(covered, "doc_id", "left").join(F.broadcast(marked) if n_copies <= 200_000 else marked, "doc_id", "left")
    return _cut_words(both.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ats"), digest)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of the kept words of every document."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")
