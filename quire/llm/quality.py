"""Quality rules: per-document statistics, hard base rules, and robust multivariate outliers per language and source.

All of it is DataFrame expressions. The statistics of a text are one projection without a shuffle. Vectors of
transformed statistics are fitted per (language, source) by minimum covariance determinant: from a median and MAD start,
concentration steps keep the half of a group with the least Mahalanobis distances and refit, until nothing changes or
``most_steps`` are done (each lowers the determinant, the first ones by far the most); a reweighting step follows. The
start is one for all, not several at random: it is the same on every run, and good where each statistic alone has a
clear middle. FLOOR is added to the spread of every coordinate: a document must differ by that much to count, however
alike its group is. Every statistic of a group is a mergeable aggregate: distances and coordinates are counted in
fine fixed buckets, so the half and the medians are exact to a bucket, the same on every run, and a group that holds a
third of all rows costs one row per bucket and task. Groups under ``least_rows`` are fitted with their language, then
with all rows; with fewer than that in all, no document is an outlier.

Defined cases: a null or empty text has zero counts and fails the base rules; null language or source is a group of its
own; rows that repeat are judged alike; an empty table gives an empty one. Windows are sorted by the part of their hash
that a position leaves room for, and neighbours count as equal only if their whole 64-bit hashes are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, table

SPACE = r"[\x20\x09-\x0D]"
VECTOR = ["x_word_length", "x_symbols", "x_upper", "x_punctuation", "x_dup_lines", "x_repeats"]
#: Least spread of each coordinate (log length; arcsine of a root share): what a document may differ by however alike its group is.
FLOOR = [0.08, 0.06, 0.06, 0.06, 0.10, 0.12]
STEP, GRID = 0.002, 40  # width of a coordinate's bucket; buckets per unit of a log distance


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and n_punctuation (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__t", text)
    df = df.withColumn("__w", F.array_remove(F.split("__t", SPACE + "+"), ""))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    size = F.size("__w")

    def without(pattern: str) -> Column:
        return F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))

    # Sorted keys of 3-word windows: hash above, position in the lowest bits; equal neighbours are repeated windows.
    df = df.withColumn("__b", F.length(F.bin(size)))
    df = df.withColumn("__f", F.expr("""case when size(__w) < 3 then cast(array() as array<bigint>) else
        transform(array(transform(__w, w -> xxhash64(w))), h -> transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])))[0] end"""))
    df = df.withColumn("__k", F.expr("transform(sort_array(transform(__f, (x, i) -> shiftleft(x, __b) | cast(i as bigint))), x -> cast(x & (shiftleft(1L, __b) - 1L) as int))"))
    df = df.withColumn("__p", F.expr("""sort_array(transform(array(transform(__k, i -> __f[i])), h ->
        filter(transform(__k, (x, i) -> if(h[i] = get(h, i - 1) or h[i] = get(h, i + 1), x, null)), x -> x is not null))[0])"""))
    df = df.withColumn("n_repeat_words", F.expr("transform(array(__p), p -> aggregate(transform(p, (x, i) -> cast(least(3, coalesce(get(p, i + 1) - x, 3)) as bigint)), 0L, (a, x) -> a + x))[0]"))
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        size.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        without(r"\p{Lu}+").cast("long").alias("n_upper"),
        without(r"[^\p{L}\p{N}\x20\x09-\x0D]+").cast("long").alias("n_punctuation"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with the coordinates of VECTOR: log of the mean word length, and arcsine-root shares.

    A share of few lines or words varies more, so its base is raised by a prior count before the root.
    """

    def share(a: str, b: str, prior: float = 1.0) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / (F.col(b) + prior))))

    length = F.ln(F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")), F.lit(1.0))))
    made = [length, share("n_symbols", "word_chars"), share("n_upper", "word_chars"), share("n_punctuation", "word_chars"), share("n_dup_lines", "n_lines", 8.0), share("n_repeat_words", "n_words", 100.0)]
    return stats.withColumns(dict(zip(VECTOR, made)))


def _chi2(x: float, dof: int) -> float:
    """The chi-square distribution for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(dof // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def _quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, dof) < share else (low, mid)
    return high


def _attach(df: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Join a checkpointed table of groups; broadcast only while its counted rows are few, else by AQE's skew join."""
    return df.join(F.broadcast(small) if small.count() <= 50_000 else small, on)


def _reached(counts: DataFrame, keys: list[str], share: float, least: int = 0) -> DataFrame:
    """(keys, bucket): the bucket in which ``share`` of the group's ``n``, plus ``least``, is reached."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys)
    sofar = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(own)
    return counts.withColumn("sofar", sofar).withColumn("need", F.least(total, F.ceil(total * share) + least)).where("sofar >= need").groupBy(*keys).agg(F.min("bucket").alias("bucket"))


def _median(rows: DataFrame, values: list[Column]) -> DataFrame:
    """(g, m0, m1, ...): medians per group, exact to STEP."""
    buckets = F.array(*[F.struct(F.lit(j).alias("j"), F.round(v / STEP).cast("long").alias("bucket")) for j, v in enumerate(values)])
    counts = rows.select("g", F.explode(buckets).alias("e")).select("g", "e.*").groupBy("g", "j", "bucket").agg(F.count("*").alias("n"))
    found = _reached(counts, ["g", "j"], 0.5)
    return found.groupBy("g").agg(*[F.max(F.when(F.col("j") == j, F.col("bucket") * STEP)).alias(f"m{j}") for j in range(len(values))])


def _factor(params: DataFrame) -> DataFrame:
    """Means m_i and covariances c_i_j (j <= i) to m_i and the Cholesky factor l_i_j, the least spread added to the diagonal."""
    p = len(VECTOR)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            params = params.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    return params.select("g", *[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i in range(p) for j in range(i + 1)])


def distance2() -> list[tuple[str, Column]]:
    """The steps of the squared Mahalanobis distance d2 by forward substitution; each is a column that later ones use."""
    steps = []
    for i, x in enumerate(VECTOR):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        steps.append((f"z{i}", rest / F.col(f"l{i}_{i}")))
    return [*steps, ("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(VECTOR))), F.lit(0.0)))]


def _measured(rows: DataFrame, params: DataFrame) -> DataFrame:
    df = _attach(rows, params, "g")
    for name, step in distance2():
        df = df.withColumn(name, step)
    return df


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    p = range(len(VECTOR))
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    return rows.groupBy("g").agg(*means, *[(F.covar_pop(VECTOR[i], VECTOR[j]) * scale).alias(f"c{i}_{j}") for i in p for j in range(i + 1)])


def robust_fit(rows: DataFrame, share: float = 0.5, most_steps: int = 12) -> DataFrame:
    """Per group ``g`` of checkpointed ``rows``: reweighted MCD means and Cholesky factor."""
    p = len(VECTOR)
    middle = cut(_median(rows, [F.col(x) for x in VECTOR]))
    spread = _median(_attach(rows, middle, "g"), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(VECTOR)])
    spread = spread.select("g", *[F.col(f"m{i}").alias(f"s{i}") for i in range(p)])
    start = middle.join(spread, "g")
    for i in range(p):
        for j in range(i + 1):
            start = start.withColumn(f"c{i}_{j}", (F.col(f"s{i}") * 1.4826) ** 2 if i == j else F.lit(0.0))
    params, state = cut(_factor(start)), None
    inner = _quantile(share, p)
    for _ in range(most_steps):
        near = _measured(rows, params).withColumn("bucket", F.floor(F.ln(F.col("d2") + 1e-6) * GRID))
        limit = _reached(near.groupBy("g", "bucket").agg(F.count("*").alias("n")), ["g"], share, least=p + 1).withColumnRenamed("bucket", "most")
        kept = _attach(near, cut(limit), "g").where("bucket <= most")
        params = cut(_factor(_moments(kept, share / _chi2(inner, p + 2))))
        now = params.agg(F.sum(F.round(F.hash(*[F.round(c, 9) for c in params.columns if c != "g"]).cast("long")))).first()[0]
        if now == state:
            break
        state = now
    outer = _quantile(0.975, p)
    close = _measured(rows, params).where(F.col("d2") <= outer)
    return cut(_factor(_moments(close, 0.975 / _chi2(outer, p + 2))))


def verdicts(docs: DataFrame, carried: list[str] | None = None, least_rows: int = 60, tail: float = 1e-6) -> DataFrame:
    """(row, doc_id, the statistics, base_failed, d2, kept): one row per row of ``docs``, whose columns (or those of ``carried``) are in the struct ``row``.

    A document is kept if the base rules pass and its squared distance is at most the chi-square quantile that a
    Gaussian document exceeds with chance ``tail``. Rows stay where they are: only sums and small tables travel.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carried is None else carried)])
    stats = statistics(docs.select(own.alias("row"), "doc_id", "lang", "source", "text")).drop("text")
    stats = cut(vectors(stats).withColumn("base_failed", base_failed()).withColumn("key_lang", F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("n"))).withColumn("key", F.concat_ws("\t", "key_lang", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")))))
    passed = stats.where(~F.col("base_failed"))
    sizes = cut(passed.groupBy("key", "key_lang").agg(F.count("*").alias("n")))
    by_lang = sizes.groupBy("key_lang").agg(F.sum("n").alias("n_lang"))
    groups = sizes.join(by_lang, "key_lang")
    enough = (sizes.agg(F.sum("n")).first()[0] or 0) >= least_rows
    chosen = F.when(F.col("n") >= least_rows, F.col("key")).when(F.col("n_lang") >= least_rows, F.col("key_lang")).when(F.lit(enough), F.lit(""))
    groups = cut(groups.select("key", chosen.alias("g")))
    named = _attach(passed, groups, "key")
    # A pooled group holds all rows of its language, or all rows, not only those of its small sources.
    pooled = F.array(F.col("key"), F.col("key_lang"), F.lit(""))
    wanted = cut(groups.select("g").where("g is not null").distinct())
    fit_rows = cut(_attach(passed.select(F.explode(pooled).alias("g"), *VECTOR), wanted, "g"))
    params = robust_fit(fit_rows)
    few = params if params.count() > 50_000 else F.broadcast(params)  # a row per group, counted
    judged = named.join(few, "g", "left")
    for name, step in distance2():
        judged = judged.withColumn(name, step)
    own = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    limit = _quantile(1 - tail, len(VECTOR))
    good = judged.select(*own, "d2", F.coalesce(F.col("d2") <= limit, F.lit(True)).alias("kept"))
    return good.unionByName(stats.where("base_failed").select(*own, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each row of ``documents``; defined cases as in the module's docstring."""
    found = verdicts(table(spark, sf_dir, "documents"), carried=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("distance2"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the outlier test keep."""
    return verdicts(docs).where("kept").select("row.*")
