"""Conversation prefix trie, built level by level (operator 13).

Conversations are ordered lists of turns. A node of depth d is a distinct
sequence of first d turns; its name is the smallest conversation that starts with
it. Downwards, each depth groups the live conversations by (parent node, next
turn). A conversation that is alone in a node shares nothing deeper down, so it
leaves the live ones and the rest of its path follows from its turns. Upwards,
each depth joins its nodes with the sums of their children. There are as many
levels as the longest shared beginning has turns, not as the longest conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.tables import numbered
from .common import cut, maybe_broadcast

#: Characters of joined ids that one row carries to the task that digests a node's list.
CHUNK = 1 << 16


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, key, bytes: the turns of each conversation, at = 1, 2, .. in order of turn (null first); written.

    key is a digest of role and text, null ones being empty; bytes is the UTF-8
    length of the text. Turns of one number come in the order of role, then of the
    text's digest; repeated rows are turns of their own. Rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    ranked = numbered(rows, ["conv_id"], ["turn", "role", "digest"], "at")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "digest"), 256))
    return cut(ranked.select("conv_id", F.col("at").cast("long").alias("at"), key.alias("key"), "bytes"), "trie-turns")


def rebuilt(turns: DataFrame, block: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations whose beginning is that of the first conversation of their block.

    Conversation c takes the first h turns of c - c % block, if that exists, then
    its own turns after its first h; h is the CRC-32 of c in decimal, modulo heads.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    lengths = cut(own.join(base, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-lengths")
    taken = turns.where(F.col("at") < heads).withColumnRenamed("conv_id", "base").join(lengths.where("head > 0").select("conv_id", "base", "head"), "base").where("at <= head").select("conv_id", F.col("at").alias("depth"), "key", "bytes")
    kept = turns.join(lengths.select("conv_id", "h", "head"), "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("depth"), "key", "bytes")
    both = taken.unionByName(kept).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth")  # so a level reads its own row groups
    return cut(both, "trie-rebuilt"), lengths.select("conv_id", "length")


def joined_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sha256: the digest of each group's ids (long column id) in ascending order, in decimal, joined by commas.

    A group of any size is joined in ranges first, then hashed as a stream of these parts.
    """
    names = [*keys, "first", "part"]
    kind = ", ".join(f"{k} bigint" for k in keys)

    def parts(batches):
        for b in batches:
            found: list[list] = []
            for row in zip(*(b.column(c).to_pylist() for c in [*keys, "id"])):
                word = str(row[-1])
                if found and found[-1][0] == row[:-1] and found[-1][3] < CHUNK:
                    found[-1][2].append(word)
                    found[-1][3] += len(word) + 1
                else:
                    found.append([row[:-1], row[-1], [word], len(word)])
            columns = [*zip(*(f[0] for f in found))] if found else [()] * len(keys)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([f[1] for f in found], pa.int64()), pa.array([",".join(f[2]) for f in found], pa.string())], names)

    def digests(batches):
        key, state = None, None
        for b in batches:
            done = []
            for *own, part in zip(*(b.column(c).to_pylist() for c in [*keys, "part"])):
                if own == key:
                    state.update(b"," + part.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(part.encode())
            yield pack(done)
        if key is not None:
            yield pack([(*key, state.hexdigest())])

    def pack(done):
        columns = [*zip(*done)] if done else [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*keys, "sha256"])

    spread = rows.select(*keys, "id").repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id")
    joined = spread.mapInArrow(parts, f"{kind}, first bigint, part string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, f"{kind}, sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of all conversations.

    turns: conv_id, depth = 1, 2, .., key, bytes; lengths: conv_id, length, also of
    conversations without turns. Gives conv_id, depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversation gives no row.
    """
    spark = turns.sparkSession
    top = lengths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
    root = cut(top.where("n > 0").select("node", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("depth")), "trie-nodes")
    first = root.select("node").first()
    members = cut(lengths.select("conv_id", "length", F.lit(first and first[0]).cast("long").alias("node")), "trie-members")
    levels, held, more = [root], [members], first is not None
    while more:
        depth = len(levels)
        step = held[-1].where(F.col("length") >= depth).select("conv_id", "length", F.col("node").alias("parent")).join(turns.where(F.col("depth") == depth).select("conv_id", "key", "bytes"), "conv_id")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
        nodes = cut(groups.withColumn("depth", F.lit(depth).cast("long")), "trie-nodes")
        shared = maybe_broadcast(nodes.where("n > 1").select("parent", "key", "node"))
        seen = Observation()
        kept = step.join(shared, ["parent", "key"]).select("conv_id", "length", "node").observe(seen, F.count(F.when(F.col("length") > depth, 1)).alias("live"))
        held.append(cut(kept, "trie-members"))
        levels.append(nodes)
        more = seen.get["live"] > 0
    # Upwards: what a node gathers from its children. Alone in a node: one leaf, nothing saved.
    rolled: list[DataFrame] = []
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth] if depth == 0 else levels[depth].where("n > 1")
        own = nodes.select("node", "parent", "n", "bytes", "depth")
        if depth + 1 < len(levels):
            kids = levels[depth + 1].where("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
            if below is not None:
                kids = kids.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
            sums = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.join(sums, "node", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "leaves", "saved")})
        saved = (F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))
        below = cut(own.select(F.col("node").alias("conv_id"), "depth", "parent", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens")), "trie-rolled")
        rolled.append(below)

    def whole(tables: list[DataFrame]) -> DataFrame:
        paths = [t._written for t in tables]
        return spark.read.schema(tables[0].schema).parquet(*paths)

    ended = [m.where(F.col("length") == d).select(F.lit(d).cast("long").alias("depth"), "node", F.col("conv_id").alias("id")) for d, m in enumerate(held)]
    ends = ended[0]
    for e in ended[1:]:
        ends = ends.unionByName(e)
    shared = whole(rolled).join(joined_digests(ends, ["depth", "node"]).withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    none, own_id = F.sha2(F.lit(""), 256), F.sha2(F.col("conv_id").cast("string"), 256)
    columns = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = shared.select(*columns, F.coalesce("sha256", none).alias("ends_sha256"))
    # The rest of a path from its first node of one conversation on.
    if len(levels) == 1:
        return shared
    alone = whole(levels[1:]).where("n = 1").select(F.col("node").alias("conv_id"), F.col("depth").alias("from"), F.col("parent").alias("above"))
    tail = turns.select("conv_id", "depth").join(alone, "conv_id").where(F.col("depth") >= F.col("from")).join(lengths, "conv_id")
    last = F.col("depth") == F.col("length")
    parent = F.when(F.col("depth") == F.col("from"), F.col("above")).otherwise(F.col("conv_id"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tail = tail.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, own_id).otherwise(none).alias("ends_sha256"))
    return shared.unionByName(tail)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the beginning of the first conversation of its block of five.

    Null roles and texts are empty, a null turn comes first, rows without a
    conv_id take no part, repeated rows are turns of their own (order: see ordered_turns). An empty table gives no rows.
    """
    return prefix_trie(*rebuilt(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The same rows by whole prefixes: a node is a distinct string of the digests of its turns.
ORACLE_SQL = """
WITH turns AS (
    SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || sha256(coalesce(text, ''))) AS k,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
               lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
    SELECT c.conv_id, 0 AS own, t.pos, t.k, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.k, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
path AS (
    SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(k, '') OVER w AS p FROM parts
    WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
sizes AS (SELECT conv_id, max(depth) AS length FROM path GROUP BY conv_id),
nodes AS (
    SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
    FROM path JOIN sizes USING (conv_id) GROUP BY depth, p),
named AS (
    SELECT n.*, u.conv_id AS parent FROM nodes n
    LEFT JOIN path a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1
    LEFT JOIN nodes u ON u.depth = a.depth AND u.p = a.p),
kids AS (SELECT depth - 1 AS depth, parent AS conv_id, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM named n LEFT JOIN kids k ON k.depth = n.depth AND k.conv_id = n.conv_id),
up AS (
    SELECT a.depth, a.p, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.bytes) AS saved
    FROM full_ f JOIN path a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.p)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN up u ON u.depth = f.depth AND u.p = f.p
"""
