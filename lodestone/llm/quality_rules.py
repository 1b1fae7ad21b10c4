"""Quality rules, in DataFrame operations only: base counts, then robust multivariate outliers.

Base counts come from array functions on each whole text; a base rule rejects texts of under 50 words or
with over half of their words in repeated 3-word windows. The rest is judged per language and
source: four transformed statistics of each text form a vector, and a minimum-covariance-
determinant estimate gives the centre and the scatter of the densest three quarters of the group.
A text whose squared Mahalanobis distance exceeds the cutoff is rejected. A group of under ``LEAST_GROUP`` passing texts is
judged by the estimate of its whole language, or of all texts if the language has too few.

The estimate starts twice, from medians with absolute deviations and from the plain mean with the plain covariance;
each start takes concentration steps (keep the nearest three quarters, estimate anew), and the
smaller determinant wins. Quantiles come from counts of logarithmic bins, so every statistic is
a sum that partial aggregation combines: a group of any size costs one row for each task,
and results do not depend on the order of rows.

At scale: texts are read once and never shuffled; the steps move sums for each group. Group
tables join by the size Spark measures at run time (broadcast below its threshold, else a skew-split join).

Defined cases: a null text has no words and fails; a null language or source forms a group
of its own; if fewer than 40 texts pass in all, none is an outlier; repeated rows count each; a text of any length is judged
whole (its words and 3-word hashes are one row's arrays); an empty table gives no rows. Other columns, whatever their names, are carried in a struct and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import made, materialize, remove

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = 4
SHARE, STEPS, LEAST_GROUP = 0.75, 4, 40
#: The cutoff is the quantile that one in 10**9 normal vectors exceed, since statistics of texts have longer tails than normal
#: ones. It lies in a gap: of 8,884 passing texts of sf0.1, 92 % have a distance below 15, the others one above 80.
TAIL = 1e-9
#: Stands for all languages or all sources; a label is empty or begins with "=".
ANY = "*"
#: Added to variances, so that statistics which hardly vary (no symbols, no repeats) cannot reject by a trifle.
RIDGE = 0.02


def base_counts(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``row`` (its names cannot clash), with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    names = ["row"]
    docs = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        *names,
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),  # translate() makes an object of each character
        lines.alias("_lines"),
        words.alias("_words"),
    )
    names = [*names, "n_symbols"]
    grams = F.expr("transform(sequence(0, greatest(size(_words), 3) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)))")
    out = out.select(
        *names,
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_words").cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_words") > 3, grams).otherwise(F.array().cast("array<bigint>")).alias("_grams"),
    )
    names = [*names, "word_chars", "n_words", "n_lines", "n_dup_lines"]
    ordered = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.select(*names, F.when(again, ordered).otherwise(F.expr("filter(array(struct(0L as g, 0 as i)), x -> false)")).alias("_ordered"))
    twice = F.expr("filter(_ordered, (e, k) -> coalesce(get(_ordered, k - 1).g = e.g, false) or coalesce(get(_ordered, k + 1).g = e.g, false))")
    out = out.select(*names, F.sort_array(F.transform(twice, lambda e: e["i"])).alias("_at"))
    repeat = F.expr("aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    out = out.select(*names, repeat.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    """The transformed statistics, for texts with words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(words.cast("double")),
        2 * F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars) * 4,
        F.col("n_repeat_words") / words + F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    ]


X = [f"x{i}" for i in range(FEATURES)]
PAIRS = [(i, j) for i in range(FEATURES) for j in range(i + 1)]


def _chi2_cdf(x: float, even: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def chi2_quantile(q: float, even: int) -> float:
    """Quantile of the chi-squared distribution with an even number of degrees of freedom."""
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, even) < q else (lo, mid)
    return hi


def consistency() -> float:
    """What makes the covariance of the nearest SHARE of normal vectors that of all."""
    return SHARE / _chi2_cdf(chi2_quantile(SHARE, FEATURES), FEATURES + 2)


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.avg(x).alias(f"m_{x}") for x in X] + [F.avg(F.col(X[i]) * F.col(X[j])).alias(f"s_{i}_{j}") for i, j in PAIRS]
    return rows.groupBy("g_lang", "g_source", "start").agg(*sums)


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """Centre m_*, lower Cholesky factor l_i_j of the scatter, and its log determinant, one column after another."""
    out = moments
    for i, j in PAIRS:
        cov = (F.col(f"s_{i}_{j}") - F.col(f"m_{X[i]}") * F.col(f"m_{X[j]}")) * scale + (RIDGE if i == j else 0.0)
        out = out.withColumn(f"c_{i}_{j}", cov)
    for i in range(FEATURES):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    det = sum((F.log(f"l_{i}_{i}") for i in range(FEATURES)), F.lit(0.0)) * 2
    keep = ["g_lang", "g_source", "start", *[f"m_{x}" for x in X], *[f"l_{i}_{j}" for i, j in PAIRS]]
    return out.withColumn("log_det", det).select(*keep, "log_det")


KEY = ["g_lang", "g_source", "start"]


def _distance(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by their group's shape (null without one)."""
    out = rows.join(shapes, KEY, "left")
    for i in range(FEATURES):
        rest = F.col(X[i]) - F.col(f"m_{X[i]}") - sum((F.col(f"l_{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"z{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(FEATURES)), F.lit(0.0))
    return out.withColumn("d2", d2).drop(*[f"z{i}" for i in range(FEATURES)], *[c for c in shapes.columns if c not in KEY and c != "log_det"])


def _nearest(rows: DataFrame) -> DataFrame:
    """Rows up to the logarithmic distance bin that completes SHARE of their group."""
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * 64).cast("bigint"))
    counts = binned.groupBy(*KEY, "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*KEY)
    run = counts.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    cut = run.where(F.col("upto") >= F.ceil(F.col("total") * SHARE)).groupBy(*KEY).agg(F.min("bin").alias("cut"))
    return binned.join(cut, KEY).where("bin <= cut")


def _median_start(rows: DataFrame) -> DataFrame:
    """Shapes with the medians as centre and the absolute deviations from them as independent scales."""
    def medians(value: str, of: DataFrame) -> DataFrame:
        counts = of.withColumn("bin", F.floor(F.col(value) * 256).cast("bigint")).groupBy(*KEY, "f", "bin").agg(F.count(F.lit(1)).alias("n"))
        group = Window.partitionBy(*KEY, "f")
        run = counts.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
        return run.where(F.col("upto") * 2 >= F.col("total")).groupBy(*KEY, "f").agg(((F.min("bin") + 0.5) / 256).alias("q"))

    long = rows.select(*KEY, F.posexplode(F.array(*X)).alias("f", "x"))
    middle = medians("x", long)
    spread = medians("a", long.join(middle, [*KEY, "f"]).withColumn("a", F.abs(F.col("x") - F.col("q"))).drop("q")).withColumnRenamed("q", "d")
    both = middle.join(spread, [*KEY, "f"]).groupBy(*KEY).agg(
        *[F.max(F.when(F.col("f") == i, F.col("q"))).alias(f"m_{X[i]}") for i in range(FEATURES)],
        *[F.max(F.when(F.col("f") == i, F.sqrt(F.pow(F.col("d") * 1.4826, 2) + RIDGE))).alias(f"l_{i}_{i}") for i in range(FEATURES)],
    )
    for i, j in PAIRS:
        if i != j:
            both = both.withColumn(f"l_{i}_{j}", F.lit(0.0))
    return both.withColumn("log_det", F.lit(0.0))


def judges(vectors: DataFrame) -> DataFrame:
    """For each (g_lang, g_source): the key of the shape that judges it (null if there are too few texts in all), and the keys its rows feed."""
    sizes = materialize(vectors.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    langs = sizes.groupBy("g_lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    own, lang = F.col("n") >= LEAST_GROUP, F.col("n_lang") >= LEAST_GROUP
    any_, enough = F.lit(ANY), F.lit(total >= LEAST_GROUP)
    use_lang = F.when(own | lang, F.col("g_lang")).when(enough, any_)
    use_source = F.when(own, F.col("g_source")).when(lang | enough, any_)
    key = lambda a, b: F.struct(a.alias("g_lang"), b.alias("g_source"))
    none = F.lit(None).cast("struct<g_lang:string,g_source:string>")
    whole = langs.where(F.col("n_lang") < LEAST_GROUP).limit(1).count() > 0  # some language is judged by all texts
    feeds = [F.when(own, key(F.col("g_lang"), F.col("g_source"))).otherwise(none), F.when(lang & (F.col("least") < LEAST_GROUP), key(F.col("g_lang"), any_)).otherwise(none), key(any_, any_) if whole and total >= LEAST_GROUP else none]
    return sizes.join(langs, "g_lang").select("g_lang", "g_source", use_lang.alias("use_lang"), use_source.alias("use_source"), F.filter(F.array(*feeds), lambda k: k.isNotNull()).alias("feeds"))


def shapes(vectors: DataFrame, judged: DataFrame) -> DataFrame:
    """The minimum-determinant shape of each key that rows with x0, x1, ... feed, by judges()."""
    rows = vectors.join(judged.select("g_lang", "g_source", "feeds"), ["g_lang", "g_source"]).select(F.explode("feeds").alias("k"), *X).select("k.*", *X)
    rows = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    columns = [*KEY, *[f"m_{x}" for x in X], *[f"l_{i}_{j}" for i, j in PAIRS], "log_det"]
    first = _median_start(rows.where("start = 0")).select(*columns).union(_factor(_moments(rows.where("start = 1")), 1.0).select(*columns))
    shape, spark = materialize(first), vectors.sparkSession
    for step in range(STEPS):
        last, before = step == STEPS - 1, made(spark)[-1]
        shape = materialize(_factor(_moments(_nearest(_distance(rows, shape).drop("log_det"))), consistency() if last else 1.0).select(*columns))
        remove(spark, [before])
    best = shape.groupBy("g_lang", "g_source").agg(F.min(F.struct("log_det", "start")).alias("b")).select("g_lang", "g_source", F.col("b.start").alias("start"))
    return shape.join(best, KEY, "left_semi")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """row (a struct of the columns named in ``carry``, or of all), the base counts, base_failed, distance and kept of each row of ``docs`` (text, lang, source and others)."""
    label = lambda name: F.coalesce(F.concat(F.lit("="), F.col(f"row.{name}").cast("string")), F.lit(""))
    counted = base_counts(docs).withColumns({"g_lang": label("lang"), "g_source": label("source")})
    row = F.struct(*[F.col(f"row.{c}").alias(c) for c in carry]).alias("row") if carry else F.col("row")
    held = materialize(counted.select(row, *COUNTS, "g_lang", "g_source", *[v.alias(x) for v, x in zip(_vector(), X, strict=True)]))
    vectors = held.where("not base_failed").select("g_lang", "g_source", *X)
    who = judges(vectors)
    found = shapes(vectors, who).drop("log_det").withColumn("start", F.lit(0))
    by = who.select("g_lang", "g_source", "use_lang", "use_source")
    mine = held.join(by, ["g_lang", "g_source"], "left").drop("g_lang", "g_source").withColumnsRenamed({"use_lang": "g_lang", "use_source": "g_source"})
    judged = _distance(mine.withColumn("start", F.lit(0)), found)
    cutoff = chi2_quantile(1 - TAIL, FEATURES)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select("row", *COUNTS, F.col("d2").alias("distance"), kept.alias("kept"))
