"""Benchmark decontamination by spaced-seed hashing (operator 4).

Fixed masks choose some of the next words and ignore the others. Hashes of the
chosen words of benchmark items form an index; those of every text are looked up
in it, and around each hit the aligned words of text and item are compared,
substitutions allowed. The masks of a length class are such that however the
tolerated substitutions lie, one mask meets none of them somewhere: no passage
within the tolerance is missed. Hashes are computed and looked up in one
generated stage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, maybe_broadcast

#: Masks by the least number of aligned words they serve, while at most one word in five is substituted. Found by a greedy
#: search over all placements: two substitutions in 10 words and three in 15 (so also two for each further 10), and one in 5.
FAMILIES = ((10, ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 2, 3, 4))), (5, ((0, 1, 2), (0, 1, 3))))


def words_of(text, name: str):
    """Lower-cased runs of letters and digits of a text column, as an array; null: empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias(name)


def least_equal(size: int, similarity: float) -> int:
    """Equal words that `size` aligned words need, as _verified counts them."""
    return math.ceil(similarity * size)


def masks_for(size: int, similarity: float) -> tuple:
    """Masks of which one, at some place, meets only equal words of any `size` aligned words within the tolerance."""
    equal = least_equal(size, similarity)
    if 5 * (size - equal) <= size:
        for least, masks in FAMILIES:
            if size >= least:
                return masks
    # short or more tolerant: neighbours, as many as must be equal somewhere (pigeonhole)
    return (tuple(range(max(1, -(-equal // (size - equal + 1))))),)


def _key(words: str, at: str, mask) -> str:
    """SQL: hash of the words at `at` + mask; null if the window reaches over either end."""
    items = ", ".join(f"get({words}, {at} + {k})" for k in mask)
    return f"CASE WHEN {at} >= 0 AND {at} + {max(mask)} < size({words}) THEN xxhash64({items}) END"


def seed_index(benchmark: DataFrame, overlap: int = 20, similarity: float = 0.8, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list]:
    """Items (item_id, item_words as hashes), their seeds (mask, key, item_id, at, before) and all masks in use.

    before is the key one word earlier: a hit whose predecessor hits too is the
    same diagonal and needs no second look. An item has the masks of its own
    number of words, those of `overlap` words if it is longer.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col).cast("string"), "w")).where(F.size("w") > 0).distinct()
    items = cut(items.select("item_id", F.expr("transform(w, x -> xxhash64(x))").alias("item_words")), "benchmark-items")
    sizes = [r[0] for r in items.select(F.least(F.size("item_words"), F.lit(overlap)).alias("n")).distinct().orderBy("n").collect()]  # at most `overlap` values
    used = sorted({m for n in sizes for m in masks_for(n, similarity)})
    size = F.least(F.size("item_words"), F.lit(overlap))
    own = F.array(*(size.isin([n for n in sizes if m in masks_for(n, similarity)]) for m in used))
    keys = "array(" + ", ".join(f"named_struct('mask', {i}, 'key', {_key('item_words', 'at', m)}, 'before', {_key('item_words', '(at - 1)', m)})" for i, m in enumerate(used or [(0,)])) + ")"
    seeds = items.select("item_id", "item_words", F.explode(F.sequence(F.lit(0), F.size("item_words") - 1)).alias("at"))
    seeds = seeds.select("item_id", "at", own.alias("own"), F.explode(F.expr(keys)).alias("s")).where("s.key IS NOT NULL AND get(own, s.mask)").select(F.col("s.mask").alias("mask"), F.col("s.key").alias("key"), "item_id", "at", F.col("s.before").alias("before"))
    return items, cut(seeds, "benchmark-seeds"), used or [(0,)]


def _verified(pairs: DataFrame, overlap: int, similarity: float) -> DataFrame:
    """doc_id, item_id, equal, compared: the best window of each aligned pair that is similar enough.

    Windows have `overlap` words, or all of a shorter item; at least the share `similarity` of them must be equal.
    """
    equal = "transform(item_words, (x, k) -> CASE WHEN diag + k >= 0 AND get(doc_words, diag + k) = x THEN 1 ELSE 0 END)"
    pairs = pairs.withColumn("size", F.least(F.size("item_words"), F.lit(overlap)))
    best = f"""element_at(transform(array({equal}), e ->
        array_max(transform(sequence(0, size(e) - size), k -> aggregate(slice(e, k + 1, size), 0, (a, x) -> a + x)))), 1)"""
    pairs = pairs.select("doc_id", "item_id", F.expr(best).alias("equal"), F.col("size").alias("compared"))
    return pairs.where(F.col("equal") >= F.ceil(F.lit(similarity) * F.col("compared"))).groupBy("doc_id", "item_id").agg(F.max("equal").cast("long").alias("equal"), F.max("compared").cast("long").alias("compared"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = 20, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, equal, compared for every text that shares a passage with an item.

    A passage: `overlap` aligned words (all words of a shorter item) of which the
    share `similarity` is equal. Null and empty texts and items, without words,
    match nothing; an item of one word matches every text with that word; rows with the same id count as one; null ids stay null;
    ties (several passages) give the best; an empty table on either side gives no rows.
    """
    items, seeds, used = seed_index(benchmark, overlap, similarity, item_col, item_text_col)
    small = seeds.count() <= BROADCAST_ROWS
    doc = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string"), "w"))
    doc = doc.select("doc_id", F.expr("transform(w, x -> xxhash64(x))").alias("doc_words")).where(F.size("doc_words") > 0)
    windows = doc.select("doc_id", "doc_words", F.explode(F.sequence(F.lit(0), F.size("doc_words") - 1)).alias("pos"))
    keys = "array(" + ", ".join(f"named_struct('mask', {i}, 'key', {_key('doc_words', 'pos', m)})" for i, m in enumerate(used)) + ")"
    before = "CASE mask " + " ".join(f"WHEN {i} THEN {_key('doc_words', '(pos - 1)', m)}" for i, m in enumerate(used)) + " END"
    if small:
        hits = windows.select("doc_id", "doc_words", "pos", F.explode(F.expr(keys)).alias("s")).select("doc_id", "doc_words", "pos", F.col("s.mask").alias("mask"), F.col("s.key").alias("key"))
        hits = hits.join(F.broadcast(seeds), ["mask", "key"]).where(f"NOT coalesce({before} = before, false)")
        pairs = hits.select("doc_id", "doc_words", "item_id", (F.col("pos") - F.col("at")).alias("diag")).join(F.broadcast(items), "item_id")
    else:  # an index of any size: narrow windows meet the seeds in a shuffled join, then the hits their texts
        keyed = windows.select(F.col("doc_id").alias("hit_id"), F.xxhash64("doc_words").alias("hit_version"), "pos", F.explode(F.expr(keys)).alias("s")).select("hit_id", "hit_version", "pos", F.col("s.mask").alias("mask"), F.col("s.key").alias("key")).where("key IS NOT NULL")
        hits = keyed.join(seeds, ["mask", "key"]).select("hit_id", "hit_version", "item_id", (F.col("pos") - F.col("at")).alias("diag")).distinct()
        texts = doc.withColumn("version", F.xxhash64("doc_words"))
        pairs = hits.join(texts, F.expr("hit_id <=> doc_id AND hit_version = version")).select("doc_id", "doc_words", "item_id", "diag").join(items, "item_id")
    return _verified(pairs, overlap, similarity)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text shares a passage with an item; all columns stay.

    A row is judged by its text alone, whatever its id: null and repeated ids
    make no difference. Null texts stay. An empty benchmark removes nothing.
    """
    digest = F.md5(docs[text_col].cast("string"))
    texts = docs.select(digest.alias("digest_"), F.col(text_col).alias("text_"))
    leaks = cut(find_leaks(texts, benchmark, id_col="digest_", text_col="text_", **options).select(F.col("doc_id").alias("digest_")).distinct(), "leak-texts")
    if leaks.isEmpty():
        return docs
    return docs.join(maybe_broadcast(leaks), digest == leaks["digest_"], "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same result in SQL, with other seeds: neighbouring words, as many as must be equal somewhere (pigeonhole).
ORACLE_SQL = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
 b0 AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
 b1 AS (SELECT item_id, v, least(20, len(v)) AS size, CAST(ceil(0.8 * least(20, len(v))) AS BIGINT) AS need FROM b0 WHERE len(v) > 0),
 b AS (SELECT item_id, v, size, need, CAST(ceil(need / (size - need + 1)) AS BIGINT) AS run FROM b1),
 runs AS (SELECT DISTINCT run FROM b),
 tq AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM t),
 tk AS (SELECT doc_id, pos, run, array_to_string(w[pos + 1 : pos + run], ' ') AS key FROM tq, runs WHERE pos + run <= len(w)),
 bq AS (SELECT item_id, v, run, unnest(range(len(v))) AS pos FROM b),
 bk AS (SELECT item_id, pos, run, array_to_string(v[pos + 1 : pos + run], ' ') AS key FROM bq WHERE pos + run <= len(v)),
 hits AS (SELECT DISTINCT doc_id, item_id, tk.pos - bk.pos AS diag FROM tk JOIN bk USING (key, run)),
 eq AS (SELECT doc_id, item_id, diag, size, need, list_transform(range(len(v)), lambda k: CASE WHEN diag + k >= 0 AND w[diag + k + 1] = v[k + 1] THEN 1 ELSE 0 END) AS e FROM hits JOIN t USING (doc_id) JOIN b USING (item_id)),
 best AS (SELECT doc_id, item_id, size, need, list_max(list_transform(range(len(e) - size + 1), lambda k: list_sum(e[k + 1 : k + size]))) AS equal FROM eq)
SELECT doc_id, item_id, CAST(max(equal) AS BIGINT) AS equal, CAST(max(size) AS BIGINT) AS compared FROM best
WHERE equal >= need GROUP BY doc_id, item_id
"""
