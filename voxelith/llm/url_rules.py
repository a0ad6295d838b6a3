"""URL verdicts by listed rules and mined association rules (operator 6).

Listed rules decide where one fits; the longest wins. Their verdicts (or labels
that a caller gives) are the labels of the mining: Spark's FP-growth finds
frequent combinations of URL tokens and a label, rules below a confidence or
that a shorter rule makes superfluous are dropped, and an inverted index from
each rule's rarest token finds the rules that a URL may satisfy.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: Verdict, host and path of the listed rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and the start of the path, and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct, sorted tokens: scheme, each parent domain and label of the host, numbered path segments, extension, query keys, fragment."""
    host, path = url_host(url), url_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))), lambda k: F.concat(F.lit("domain="), F.array_join(F.slice(labels, -k, k), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    parts = [
        F.when(url.contains("://"), F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(labels) > 0, parents).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("label="), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), F.least(i + 1, F.lit(9)).cast("string"), F.lit("="), x)),
        F.transform(F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("ext="), x)),
        keys,
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*parts))), F.array().cast("array<string>"))


def alike_tokens(items: DataFrame, least: int) -> DataFrame:
    """token, same, n: for the tokens of at least `least` rows (id, tokens), the sorted tokens that have exactly the same rows.

    Sets of rows are compared by their size and two 64-bit sums of row hashes.
    """
    each = items.select("id", F.explode("tokens").alias("token"))
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")]
    tokens = cut(each.groupBy("token").agg(*marks).where(F.col("n") >= least), "url-tokens-frequent")
    same = tokens.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_set("token")).alias("same"))
    return same.select("same", "n", F.explode("same").alias("token"))


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """antecedent (sorted tokens), same, label, confidence, support of the rules that hold in labelled (tokens, label).

    Tokens that always occur together are one item, named by the first of them;
    same lists, for each token of the antecedent, those that may stand in its place. Rules have a
    label alone on the right. One that a rule with one token less
    and the same label equals in confidence or exceeds is dropped. No rows in,
    no rules out. Frequent tokens number at most the mean tokens of a URL over
    min_support, whatever the size of the table.
    """
    mark = "label:"
    items = cut(labelled.where(F.col("label").isNotNull()).select(F.monotonically_increasing_id().alias("id"), "tokens", "label"), "url-items")
    rows = items.count()
    if not rows:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, same array<array<string>>, label string, confidence double, support double")
    alike = cut(alike_tokens(items, max(1, ceil(min_support * rows))), "url-alike")
    heads = sorted(r[0] for r in alike.select(F.col("same")[0]).distinct().collect())  # bounded, see above
    kept = F.array_intersect("tokens", F.lit(heads).cast("array<string>"))
    baskets = items.select(F.concat(F.transform(kept, lambda t: F.concat(F.lit("t:"), t)), F.array(F.concat(F.lit(mark), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(mark) & F.forall("antecedent", lambda t: t.startswith("t:")))
    rules = rules.select(
        F.array_sort(F.transform("antecedent", lambda t: F.substr(t, F.lit(3)))).alias("antecedent"),
        F.substr(F.col("consequent")[0], F.lit(len(mark) + 1)).alias("label"),
        "confidence",
        "support",
    )
    rules = cut(rules, "url-rules")
    shorter = rules.select(F.col("antecedent").alias("part"), "label", F.col("confidence").alias("c"))
    parts = rules.select("antecedent", "label", "confidence", F.explode("antecedent").alias("t")).select("antecedent", "label", "confidence", F.array_remove("antecedent", F.col("t")).alias("part"))
    idle = parts.join(shorter, ["part", "label"]).where("c >= confidence").select("antecedent", "label").distinct()
    rules = rules.join(idle, ["antecedent", "label"], "left_anti")
    names = maybe_broadcast(alike.where(F.col("token") == F.col("same")[0]).select("token", "same"))
    named = rules.select("*", F.explode("antecedent").alias("token")).join(names, "token")
    same = F.transform(F.array_sort(F.collect_list(F.struct("token", "same"))), lambda x: x["same"])
    return named.groupBy("antecedent", "label", "confidence", "support").agg(same.alias("same")).select("antecedent", "same", "label", "confidence", "support")


def judge_by_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (with tokens) and mined: the label of the best rule that the page fits, else default.

    A page fits a rule if it has, for each token of the antecedent, that or one
    of the same. Best: highest confidence, then support, then the smaller tokens that fit and label in order. Pages are reduced to the
    tokens that rules have; each distinct set is judged once, and the verdict
    goes back to its pages, so a hot host is one row in the matching.
    """
    rules = cut(rules, "url-kept-rules")
    head = rules.select(F.explode(F.arrays_zip("antecedent", "same")).alias("z")).select(F.col("z.antecedent").alias("item"), F.explode("z.same").alias("token")).distinct()
    head = cut(head, "url-rule-tokens")
    known = sorted(r[0] for r in head.select("token").collect())  # bounded, see mine_rules
    if not known:
        return pages.withColumn("mined", F.lit(default)).withColumn("mined_rule", F.lit(None).cast("string"))
    counts = rules.select(F.explode("antecedent").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    anchors = rules.select("*", F.explode("antecedent").alias("item")).join(counts, "item")
    rarest = Window.partitionBy("antecedent", "label").orderBy("n", "item")
    index = anchors.withColumn("k", F.row_number().over(rarest)).where("k = 1").drop("k", "n", "same")
    seen = pages.withColumn("seen_tokens", F.array_intersect("tokens", F.lit(known)))
    sets = seen.select("seen_tokens").distinct()
    # Of tokens that are the same to the rules, the first that a page has stands for them.
    own = sets.select("seen_tokens", F.explode("seen_tokens").alias("token")).join(maybe_broadcast(head), "token").groupBy("seen_tokens", "item").agg(F.min("token").alias("token"))
    own = own.groupBy("seen_tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("own"))
    own = cut(own.withColumn("items", F.map_keys("own")), "url-sets")
    hits = own.select("*", F.explode("items").alias("item")).join(maybe_broadcast(index), "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    shown = F.array_join(F.array_sort(F.transform("antecedent", lambda t: F.try_element_at("own", t))), " ")
    best = hits.groupBy("seen_tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), shown.alias("a"), "label")).alias("best"))
    best = cut(best.select("seen_tokens", F.col("best.label").alias("mined"), F.col("best.a").alias("mined_rule")), "url-verdicts")
    out = seen.join(maybe_broadcast(best), "seen_tokens", "left").drop("seen_tokens")
    return out.withColumn("mined", F.coalesce("mined", F.lit(default)))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, min_support: float = 0.01, min_confidence: float = 0.8, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every row of pages.

    labels (id, label) are used for mining where given, one per id; else the
    listed rules' verdicts. Null or odd urls have empty host and path and no
    tokens but what they show; without a rule they get default. Null ids and
    repeated rows stay as they are; an empty table gives no rows.
    """
    url = F.col("url")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_tokens(url).alias("tokens"))
    rule, listed = listed_rule(F.col("host"), F.col("path"), rules)
    base = cut(base.select("*", rule.alias("rule"), listed.alias("listed")), "url-tokens")
    if labels is None:
        labelled = base.select("tokens", F.col("listed").alias("label"))
    else:
        own = labels.select(F.col(labels.columns[0]).alias("page_id"), F.col(labels.columns[1]).cast("string").alias("label"))
        labelled = base.join(own, "page_id").select("tokens", "label")
    judged = judge_by_rules(base, mine_rules(labelled, min_support, min_confidence), default)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined").alias("verdict"), "mined_rule")


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    """The verdict of every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _rule_sql(column: str) -> str:
    parts = []
    for what, h, p in sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        parts.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else what}'")
    return f"CASE {' '.join(parts)} END"


_NONE = "CAST([] AS VARCHAR[])"
#: The same rows in SQL: frequent token sets level by level, their rules, and the best rule of each page.
ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '{SHAPE}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{SHAPE}', 2) AS path FROM pages),
 p AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS ss, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS listed FROM u),
 k AS (SELECT page_id, host, path, rule, listed, list_sort(list_distinct(list_concat(
   CASE WHEN contains(url, '://') THEN ['scheme=' || lower(split_part(url, '://', 1))] ELSE {_NONE} END,
   CASE WHEN len(ls) > 0 THEN list_transform(range(1, least(len(ls), 3) + 1), lambda i: 'domain=' || array_to_string(ls[len(ls) - i + 1 : len(ls)], '.')) ELSE {_NONE} END,
   list_transform(ls[1 : greatest(len(ls) - 2, 0)], lambda x: 'label=' || x),
   list_transform(ss, lambda x, i: 'path' || CAST(least(i, 9) AS VARCHAR) || '=' || x),
   CASE WHEN regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) <> '' THEN ['ext=' || regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)] ELSE {_NONE} END,
   list_transform(list_filter(string_split(regexp_extract(url, '(?s)\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query=' || split_part(x, '=', 1)),
   CASE WHEN contains(url, '#') THEN ['fragment'] ELSE {_NONE} END))) AS tokens FROM p),
 least_n AS (SELECT ceil(0.01 * count(*)) AS m, count(*) AS n FROM k WHERE listed IS NOT NULL),
 t AS (SELECT page_id, listed, unnest(tokens) AS token FROM k WHERE listed IS NOT NULL),
 lv AS (SELECT page_id, listed, [token] AS items FROM (SELECT *, count(*) OVER (PARTITION BY token) AS c FROM t) WHERE c >= (SELECT m FROM least_n)
   UNION ALL SELECT page_id, listed, items FROM (SELECT lv.page_id, lv.listed, list_append(lv.items, t.token) AS items, count(*) OVER (PARTITION BY list_append(lv.items, t.token)) AS c FROM lv JOIN t ON t.page_id = lv.page_id AND t.token > lv.items[len(lv.items)]) WHERE c >= (SELECT m FROM least_n)),
 a AS (SELECT items, count(*) AS c FROM lv GROUP BY items),
 r AS (SELECT lv.items, lv.listed AS label, count(*) / max(a.c) AS conf, count(*) / max(least_n.n) AS supp FROM lv JOIN a ON a.items = lv.items CROSS JOIN least_n GROUP BY lv.items, lv.listed HAVING count(*) >= max(least_n.m) AND count(*) / max(a.c) >= 0.8),
 idle AS (SELECT DISTINCT r.items, r.label FROM (SELECT *, unnest(items) AS one FROM r) r JOIN r s ON s.label = r.label AND s.items = list_filter(r.items, lambda x: x <> r.one) AND s.conf >= r.conf),
 kept AS (SELECT * FROM r ANTI JOIN idle USING (items, label)),
 hit AS (SELECT k.page_id, min(struct_pack(c := -conf, s := -supp, a := array_to_string(kept.items, ' '), l := label)) AS b FROM k JOIN kept ON list_has_all(k.tokens, kept.items) GROUP BY k.page_id)
SELECT k.page_id, host, path, rule, coalesce(listed, b.l, 'allow') AS verdict, b.a AS mined_rule FROM k LEFT JOIN hit USING (page_id)
"""
