"""Quality statistics and robust multivariate outliers (operator 2).

Statistics of each text are array expressions of one row: no shuffle. For each
language and source, the minimum covariance determinant is estimated in the
deterministic manner (Hubert, Rousseeuw and Verdonck 2012): three starts from
medians and median deviations (no correlation, that of squashed values, that of
signs), two concentration steps each, then steps from the start of the least
determinant until the determinant falls no more. A step takes mean and covariance
of the share of rows with the least Mahalanobis distance. Rows beyond a cutoff of
the final, rescaled distance are rejected. Statistics are whole numbers (1/1000),
sums are exact, so results don't depend on the order of rows; quantiles are read
from exact counts of narrow bins.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, maybe_broadcast

#: Characters of the base rule's n_symbols, and its limits.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Transformed statistics. Each is a ratio or a count after adding USUAL_WORDS usual words to the text, as short texts vary more.
NAMES = ["f_words", "f_word_length", "f_marks", "f_distinct", "f_line_words"]
USUAL_WORDS = 100
#: Of the usual words: letters, marks and distinct words; and the lines and their words that are added.
USUAL = {"word_chars": 500, "n_marks": 15, "n_distinct": 92, "n_lines": 4, "line_words": 160}
PAIRS = list(combinations_with_replacement(range(len(NAMES)), 2))
#: A statistic whose variance, given those before it, is less than the rounding can show (thousandths squared) is constant:
#: it is left out of the distance of its cell, and of the degrees of freedom.
CONSTANT = 1.0
#: Median and 1 - 1e-6 point of the chi-square distribution with 1 to 5 degrees of freedom.
CHI2 = ((0.4549, 23.9281), (1.3863, 27.6310), (2.3660, 30.6648), (3.3567, 33.3768), (4.3515, 35.8882))


def _repeat_words(windows: str, size: int) -> str:
    """SQL: words covered by windows whose hash occurs twice or more among the row's windows (array named windows)."""
    return f"""
    CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
      element_at(transform(array(sort_array(transform({windows}, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        aggregate(
          sort_array(transform(filter(s, (e, j) -> coalesce(get(s, j - 1).h = e.h, false) OR coalesce(get(s, j + 1).h = e.h, false)), e -> e.i)),
          named_struct('last', -{size}, 'total', 0L),
          (a, p) -> named_struct('last', p, 'total', a.total + least({size}, p - a.last)),
          a -> a.total)), 1)
    END"""


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text", window: int = 5) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_marks of every row; null text: zeros.

    A text is split once; sorting its window hashes finds repeats in n log n.
    """
    space = r"[\\x20\\x09-\\x0D]"
    items = ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(window))
    words = f"""element_at(transform(
        array(filter(split(coalesce(text_, ''), '{space}+'), x -> x != '')), w ->
        element_at(transform(array(
          CASE WHEN size(w) >= {window} THEN transform(sequence(0, size(w) - {window}), i -> xxhash64({items})) ELSE array() END), h ->
          named_struct('n', CAST(size(w) AS LONG), 'u', CAST(size(array_distinct(w)) AS LONG), 'r', {_repeat_words('h', window)})), 1)), 1)"""
    lines = f"""element_at(transform(
        array(filter(split(coalesce(text_, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), l ->
        named_struct('n', CAST(size(l) AS LONG), 'd', CAST(size(l) - size(array_distinct(l)) AS LONG))), 1)"""
    text = F.coalesce("text_", F.lit(""))
    length = F.length(text)
    out = docs.select(*keep, F.col(text_col).cast("string").alias("text_")).select(
        *keep,
        F.expr(words).alias("w_"),
        F.expr(lines).alias("l_"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.regexp_replace(text, r"[\p{P}\p{S}]+", ""))).cast("long").alias("n_marks"),
    )
    return out.select(*keep, F.col("w_.n").alias("n_words"), "word_chars", "n_symbols", F.col("l_.n").alias("n_lines"), F.col("l_.d").alias("n_dup_lines"), F.col("w_.r").alias("n_repeat_words"), F.col("w_.u").alias("n_distinct"), "n_marks")


def transformed(stats: DataFrame) -> DataFrame:
    """stats with the columns of NAMES, whole thousandths of logarithms."""
    scaled = lambda c, by=1: F.round(1000 * by * F.log(c)).cast("long")
    words = F.col("n_words") + USUAL_WORDS
    chars = F.col("word_chars") + USUAL["word_chars"]
    return stats.withColumns(
        {
            "f_words": scaled(words),
            "f_word_length": scaled(chars / words, 4),
            "f_marks": scaled((F.col("n_marks") + USUAL["n_marks"]) / chars),
            "f_distinct": scaled((F.col("n_distinct") + USUAL["n_distinct"]) / words, 4),
            "f_line_words": scaled((F.col("n_words") + USUAL["line_words"]) / (F.col("n_lines") + USUAL["n_lines"])),
        }
    )


def _cells(rows: DataFrame, groups: list[str], least: int) -> DataFrame:
    """rows with cell: the finest of all groups, first group, none that has least rows or more."""
    keyed = rows.withColumn("cell_fine", F.to_json(F.struct(*groups))).withColumn("cell_mid", F.to_json(F.struct(groups[0])))
    fine = keyed.groupBy("cell_fine").agg(F.count("*").alias("n_fine"))
    keyed = keyed.join(maybe_broadcast(fine), "cell_fine").withColumn("small", F.col("n_fine") < least)
    mid = keyed.where("small").groupBy("cell_mid").agg(F.count("*").alias("n_mid"))
    keyed = keyed.join(maybe_broadcast(mid), "cell_mid", "left")
    cell = F.when(~F.col("small"), F.col("cell_fine")).when(F.col("n_mid") >= least, F.col("cell_mid")).otherwise(F.lit("all"))
    return keyed.withColumn("cell", cell).drop("cell_fine", "cell_mid", "n_fine", "n_mid", "small")


def _bin_quantile(bins: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """keys and name: the least bin at or below which lies the share of the counts."""
    ordered = Window.partitionBy(*keys).orderBy("bin")
    full = Window.partitionBy(*keys)
    reached = bins.withColumn("upto", F.sum("n").over(ordered)).withColumn("all_n", F.sum("n").over(full))
    return reached.where(F.col("upto") >= F.ceil(F.lit(share) * F.col("all_n"))).groupBy(*keys).agg(F.min("bin").alias(name))


P = range(len(NAMES))
#: Columns of an estimate: origin of the sums, mean, covariance.
ESTIMATE = [f"o_{i}" for i in P] + [f"m_{i}" for i in P] + [f"c_{i}_{j}" for i, j in PAIRS]


def _factor(params: DataFrame) -> DataFrame:
    """Adds l_i_j, the Cholesky factor of the covariance c_i_j; df, its rank; and log_det. A constant statistic has l_i_i = 0."""
    for i, j in [(i, j) for i in P for j in range(i + 1)]:
        value = F.col(f"c_{j}_{i}")
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        if i == j:
            value = F.when(value >= CONSTANT, F.sqrt(value)).otherwise(F.lit(0.0))
        else:
            value = F.when(F.col(f"l_{j}_{j}") > 0, value / F.col(f"l_{j}_{j}")).otherwise(F.lit(0.0))
        params = params.withColumn(f"l_{i}_{j}", value)
    return params.withColumns(
        {
            "df": reduce(lambda a, b: a + b, (F.when(F.col(f"l_{i}_{i}") > 0, 1).otherwise(0) for i in P)),
            "log_det": reduce(lambda a, b: a + b, (F.log(F.greatest(F.col(f"l_{i}_{i}"), F.lit(CONSTANT**0.5))) for i in P)),
        }
    )


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by the row's m_i and l_i_j."""
    for i in P:
        value = F.col(NAMES[i]) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", F.when(F.col(f"l_{i}_{i}") > 0, value / F.col(f"l_{i}_{i}")).otherwise(F.lit(0.0)))
    total = reduce(lambda a, b: a + b, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in P))
    return rows.withColumn("d2", total).drop(*(f"z_{i}" for i in P))


#: Distances are counted in bins of this share of a natural-log unit.
BINS = 200


def _distance_bin(d2: Column) -> Column:
    return F.round(BINS * F.log(d2 + 1e-3)).cast("int")


def _covariance(n: str, sums: str, products: str) -> dict:
    """m_i and c_i_j from exact sums and products of differences from the origins o_i."""
    count = F.col(n).cast("double")
    out = {f"m_{i}": F.col(f"o_{i}") + F.col(f"{sums}{i}") / count for i in P}
    return out | {f"c_{i}_{j}": F.col(f"{products}{i}_{j}") / count - (F.col(f"{sums}{i}") / count) * (F.col(f"{sums}{j}") / count) for i, j in PAIRS}


def _sums(values: list[Column]) -> list[Column]:
    return [F.sum(v).alias(f"s_{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"q_{i}_{j}") for i, j in PAIRS]


def _starts(rows: DataFrame) -> DataFrame:
    """cell, start (0 to 2) and ESTIMATE: medians with median deviations, and two robust correlations (bins of 1/100)."""
    long = rows.select("cell", F.posexplode(F.array(*((F.col(n) / 10).cast("long") for n in NAMES))).alias("i", "bin")).groupBy("cell", "i", "bin").agg(F.count("*").alias("n"))
    long = cut(long, "mcd-bins")
    middle = _bin_quantile(long, ["cell", "i"], 0.5, "median")
    spread = long.join(middle, ["cell", "i"]).select("cell", "i", "n", F.abs(F.col("bin") - F.col("median")).alias("bin")).groupBy("cell", "i", "bin").agg(F.sum("n").alias("n"))
    both = middle.join(_bin_quantile(spread, ["cell", "i"], 0.5, "mad"), ["cell", "i"])
    of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))) * 10
    first = both.groupBy("cell").agg(*(of("median", i).alias(f"o_{i}") for i in P), *(F.greatest(of("mad", i) * 1.4826, F.lit(5.0)).alias(f"e_{i}") for i in P))
    first = cut(first, "mcd-medians")
    n_cells = first.count()
    z = [(F.col(NAMES[i]) - F.col(f"o_{i}")) / F.col(f"e_{i}") for i in P]
    norm = F.greatest(F.sqrt(reduce(lambda a, b: a + b, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in P))), F.lit(1e-9))
    scored = rows.join(maybe_broadcast(first, _weight(n_cells, first)), "cell").select("cell", *(v.alias(f"z_{i}") for i, v in enumerate(z)))
    whole = lambda c: F.round(1000 * c).cast("long")
    scored = scored.select("cell", F.explode(F.array(*(F.struct(F.lit(k).alias("start"), *(v.alias(f"v_{i}") for i, v in enumerate(vs))) for k, vs in ((1, [whole(F.tanh(f"z_{i}")) for i in P]), (2, [whole(F.col(f"z_{i}") / norm) for i in P]))))).alias("v")).select("cell", "v.*")
    sums = scored.groupBy("cell", "start").agg(F.count("*").alias("n"), *_sums([F.col(f"v_{i}") for i in P]))
    n = F.col("n").cast("double")
    central = {(i, j): F.col(f"q_{i}_{j}") / n - F.when(F.col("start") == 1, (F.col(f"s_{i}") / n) * (F.col(f"s_{j}") / n)).otherwise(F.lit(0.0)) for i, j in PAIRS}
    size = lambda i: F.sqrt(F.greatest(central[i, i], F.lit(1.0)))
    corr = [F.when(F.lit(i == j), F.lit(1.0)).otherwise(F.least(F.greatest(central[i, j] / (size(i) * size(j)), F.lit(-1.0)), F.lit(1.0))).alias(f"r_{i}_{j}") for i, j in PAIRS]
    plain = first.select("cell", F.lit(0).alias("start"), *(F.lit(1.0 if i == j else 0.0).alias(f"r_{i}_{j}") for i, j in PAIRS))
    every = sums.select("cell", "start", *corr).unionByName(plain).join(maybe_broadcast(first, _weight(n_cells, first)), "cell")
    out = every.select("cell", "start", *(f"o_{i}" for i in P), *(F.col(f"o_{i}").cast("double").alias(f"m_{i}") for i in P), *((F.col(f"r_{i}_{j}") * F.col(f"e_{i}") * F.col(f"e_{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS))
    out = cut(_factor(out), "mcd-starts")
    drop(long, first)
    return out


def _weight(rows: int, table: DataFrame) -> int:
    """The number of narrow rows (of four columns) that are as large as the rows of a wide table."""
    return rows * -(-len(table.columns) // 4)


def _concentrated(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """cell, start and the estimate from the share of rows nearest to each of params; written.

    One aggregate over the rows, by distance bins; the bins up to the share are added up.
    """
    near = _distance(rows.select("cell", *NAMES).join(maybe_broadcast(params, _weight(params.count(), params)), "cell"))
    near = near.withColumn("bin", _distance_bin(F.col("d2")))
    keys = ["cell", "start"]
    origins = [f"o_{i}" for i in P]
    bins = near.groupBy(*keys, "bin", *origins).agg(F.count("*").alias("n"), *_sums([F.col(NAMES[i]) - F.col(f"o_{i}") for i in P]))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(*keys))
    inner = bins.withColumns({"before": F.coalesce(before, F.lit(0)), "total": total}).where(F.col("before") < F.ceil(F.lit(share) * F.col("total")))
    added = [F.sum(c).alias(c) for c in ["n", *(f"s_{i}" for i in P), *(f"q_{i}_{j}" for i, j in PAIRS)]]
    out = inner.groupBy(*keys, *origins).agg(*added).withColumns(_covariance("n", "s_", "q_"))
    return cut(_factor(out.select(*keys, *ESTIMATE)), "mcd-step")


def _least_determinant(rows: DataFrame, share: float) -> DataFrame:
    """The estimate of each cell: cell, ESTIMATE, its factor, df."""
    starts = _starts(rows)
    once = _concentrated(rows, starts, share)
    twice = _concentrated(rows, once, share)
    drop(starts, once)
    best = F.row_number().over(Window.partitionBy("cell").orderBy("log_det", "start"))
    moving = cut(twice.withColumn("at", best).where("at = 1").drop("at"), "mcd-moving")
    drop(twice)
    settled: list[DataFrame] = []
    while True:  # determinants fall in finitely many steps
        after = _concentrated(rows, moving, share)
        old = moving.select("cell", F.col("log_det").alias("was"))
        fell = after.join(maybe_broadcast(old), "cell").where("log_det < was - 1e-9").drop("was")
        fell = cut(fell, "mcd-moving")
        settled.append(cut(moving.join(maybe_broadcast(fell.select("cell")), "cell", "left_anti"), "mcd-settled"))
        drop(moving, after)
        moving = fell
        if moving.isEmpty():
            drop(moving)
            break
    out = cut(reduce(DataFrame.unionByName, settled), "mcd-estimates")
    drop(*settled)
    return out


def mcd_distances(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """rows with d2, the robust squared distance within the cell, scaled so that its median is the chi-square's, and df.

    Only the cells' parameters travel, by broadcast where their counted number
    allows, else by a join that Spark splits where skewed.
    """
    params = _least_determinant(rows, share)
    weight = _weight(params.count(), params)
    far = _distance(rows.join(maybe_broadcast(params, weight), "cell")).drop(*(c for c in params.columns if c not in ("cell", "df")))
    middle = _bin_quantile(far.withColumn("bin", _distance_bin(F.col("d2"))).groupBy("cell", "df", "bin").agg(F.count("*").alias("n")), ["cell", "df"], 0.5, "middle")
    median = F.element_at(F.array(*(F.lit(m) for m, _ in CHI2)), F.greatest("df", F.lit(1)))
    scale = cut(middle.select("cell", F.greatest(F.exp(F.col("middle") / BINS) / median, F.lit(1.0)).alias("scale")), "mcd-scale")
    return far.join(maybe_broadcast(scale, weight), "cell").withColumn("d2", F.col("d2") / F.col("scale")).drop("scale")


def quality_outliers(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), least: int = 25, share: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2 of every row.

    Rows that fail the base rule are not kept and take no part in estimates.
    The rest is judged in its (lang, source), or with the small sources of its
    language, or with all rows left, whichever first has `least` rows (five for
    each statistic, below which the estimate is not defined well). A statistic
    that is constant among the nearest rows of a cell doesn't count there. Null
    text: no words. Null groups are a group. Null ids stay; repeated rows count each;
    an empty table gives no rows.
    """
    names = [f"g_{i}" for i in range(len(groups))]
    base = docs.select(F.col(id_col).alias("doc_id"), *(F.col(g).cast("string").alias(n) for g, n in zip(groups, names)), F.col(text_col).alias("text"))
    stats = text_statistics(base, ["doc_id", *names])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = cut(transformed(stats.withColumn("base_failed", failed)), "quality-statistics")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = mcd_distances(_cells(stats.where("not base_failed").select(*columns, *names, *NAMES), names, least), share=share)
    cutoff = F.element_at(F.array(*(F.lit(c) for _, c in CHI2)), F.greatest("df", F.lit(1)))
    good = judged.select(*columns, (F.col("d2") <= cutoff).alias("kept"), F.col("d2").alias("distance2"))
    bad = stats.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"))
    return good.unionByName(bad)


def op2_quality_outliers(spark, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of every document."""
    return quality_outliers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
