"""Quality rules by robust multivariate outliers: minimum covariance determinant, in native expressions.

Each text gets a vector of transformed statistics. For each language and source, the
centre and covariance of the half of its documents that lies most tightly together are found by
concentration steps (keep the documents nearest by Mahalanobis distance, estimate again) from one start, medians and
median absolute deviations, until no group's determinant falls any more; they are scaled to be consistent at the normal distribution, and documents beyond a distance are rejected. All of it is DataFrame
expressions: aggregates with map-side partial sums, a Cholesky factor written out over the few
columns, and no Python on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WS, quoted, small, written

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Concentration steps at most; the share that each keeps; the fall of the log determinant that counts as none; squared distance beyond which a document goes (the chi-squared
#: quantile of 5 degrees at 1e-9); the least spread that a coordinate counts with, in the transform's units; groups with
#: fewer documents are judged as one. Repeats up to 30% of the words are the base rule's affair: at that share
#: they alone reach 30 of the distance, and what is left is ample for the others; repeated lines come with repeated words.
STEPS, SHARE, STILL, REJECT, FLOOR, LEAST = 40, 0.5, 1e-2, 51.0, (0.35, 0.05, 0.03, 0.06, 0.1), 50
DIMS = len(FLOOR)
#: Groups (languages by sources) up to which their models are broadcast: some 300 bytes each.
GROUPS = 20_000


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once: a lambda's variable, so nested uses don't repeat it."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside a window of `width` words that occurs twice or more in the array.

    Windows are compared by 64-bit hashes. Nearly all texts end at the first test (as many distinct
    windows as windows); for the others (hash, place) is sorted, equal neighbours give the places
    that repeat, and their union is counted: n log n, whatever repeats how often.
    """
    windows = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.try_element_at(s, a)["h"] == F.try_element_at(s, b)["h"], F.lit(False))
        return _let(ordered, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(s, j + 1, j + 2) | ((j > 0) & same(s, j + 1, F.greatest(j, F.lit(1)))), x["i"])), lambda x: x.isNotNull())))

    def covered(at: Column) -> Column:
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(
            F.aggregate(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width))), F.lit(0), lambda s, x: s + x)
        )

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(places(h), covered)))


def statistics(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """For each row of docs (text, lang, source): carry, _lang, _source and STATS of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"[{WS}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    first = docs.select(
        F.struct(*carry).alias("_row"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), words.alias("_words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(text, f"[{WS}]+", "")).cast("long").alias("word_chars"),
    )
    second = first.select("*", _let(F.col("_words"), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("_w"))
    return second.select("_row", "_lang", "_source", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics: logarithms of counts and of mean word length, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")), F.log((F.col("word_chars") + 1.0) / n),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1.0)), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n),
    ]


def _estimates(rows: DataFrame, weight: Column) -> DataFrame:
    """Mean m_i and covariance c_ij of the rows with weight, for each group: one shuffle of partial sums."""
    x = [F.when(weight, F.col(f"_x{i}")) for i in range(DIMS)]
    sums = [F.count(F.when(weight, 1)).alias("_n"), *(F.avg(x[i]).alias(f"m{i}") for i in range(DIMS))]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return rows.groupBy("_g").agg(*sums)


def _factors(est: DataFrame) -> DataFrame:
    """The Cholesky factor l_ij of each group's covariance, with FLOOR squared added to the diagonal, and its
    log determinant."""
    out = est
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest + FLOOR[i] ** 2, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    out = out.withColumn("logdet", sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(DIMS)), F.lit(0.0)))
    return out.drop(*[f"c{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution over the factor's columns."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"_x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    # z_i repeats z_k's expressions; at five columns the tree stays small
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _described(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """statistics() with base_failed and the vector."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return statistics(docs, carry).select("*", failed.alias("base_failed"), *[v.alias(f"_x{i}") for i, v in enumerate(vector())])


def _grouped(rows: DataFrame, names: DataFrame, groups: int) -> DataFrame:
    """rows with _g: the name of their group, or that of all small groups together."""
    same = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    return rows.join(small(names, groups, GROUPS), same, "left").withColumn("_g", F.coalesce("_g", F.lit(""))).drop("_l", "_s")


def fit(rows: DataFrame, steps: int = STEPS, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame, int]:
    """Minimum covariance determinant estimates from _described() rows that pass the base rules: the groups' names, their
    models, and how many groups there are."""
    ok = rows.where(~F.col("base_failed"))
    name = F.when(F.col("_size") >= least, F.to_json(F.struct("_lang", "_source"))).otherwise("")
    sizes = ok.groupBy("_lang", "_source").agg(F.count("*").alias("_size"))
    names = written(sizes.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), name.alias("_g")), "groups")
    groups = names.count()
    ok = written(_grouped(ok, names, groups).select("_g", *[f"_x{i}" for i in range(DIMS)]), "vectors")
    # the first centre: each coordinate's median and median absolute deviation, on a grid that bounds what is held
    medians = ok.groupBy("_g").agg(*[F.percentile(F.round(F.col(f"_x{i}"), 2), F.lit(0.5)).alias(f"m{i}") for i in range(DIMS)])
    near = ok.join(small(medians, groups, GROUPS), "_g")
    spread = near.groupBy("_g").agg(*[F.percentile(F.round(F.abs(F.col(f"_x{i}") - F.col(f"m{i}")), 2), F.lit(0.5)).alias(f"s{i}") for i in range(DIMS)], *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)])
    pairs = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    model = _factors(spread.select("_g", *[f"m{i}" for i in range(DIMS)], *[(F.pow(F.col(f"s{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs]))
    model = written(model, "model")
    for step in range(steps):
        # distances on a logarithmic grid: the percentile holds a bounded count of values
        seen = ok.join(small(model, groups, GROUPS), "_g").withColumn("_mark", F.round(F.log(_distance() + 1e-9), 2))
        cut = seen.groupBy("_g").agg(F.percentile("_mark", F.lit(share)).alias("_cut"))
        kept = seen.join(small(cut, groups, GROUPS), "_g")
        last, model = model, written(_factors(_scaled(_estimates(kept, F.col("_mark") <= F.col("_cut")), share)), "model")
        if step:  # the start is no estimate from a share
            before = last.select("_g", F.col("logdet").alias("_before"))
            if model.join(small(before, groups, GROUPS), "_g").where(F.col("logdet") < F.col("_before") - STILL).isEmpty():
                break
    return names, model.drop("logdet"), groups


def _verdicts(rows: DataFrame, fitted: tuple[DataFrame, DataFrame, int], reject: float) -> DataFrame:
    names, model, groups = fitted
    out = _grouped(rows, names, groups).join(small(model, groups, GROUPS), "_g", "left").withColumn("distance", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= reject))


def judged(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): doc_id, STATS, base_failed, kept, distance.

    A null or empty text has no words and fails; a long one is described whole. Null languages and sources are values like any
    other, and a null id passes through; groups of fewer than LEAST documents that pass the base rules are judged together as one
    group. Documents tied at the share's edge are all kept for the estimate; repeated rows count each;
    an empty table gives an empty table; other columns are ignored.
    """
    rows = written(_described(docs, [F.col("doc_id")]), "statistics")
    out = _verdicts(rows, fit(rows), reject)
    return out.select("_row.doc_id", *STATS, "base_failed", "kept", "distance")


def kept_only(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs, all columns as they are, that judged() keeps, with the same treatment of nulls, small groups and repeated
    rows (each row is judged for itself, so rows with one id may part); an empty table gives an empty table. Rows are written once
    beside their statistics: texts are described once, and none is shuffled."""
    rows = written(_described(docs, [F.struct(*[quoted(c) for c in docs.columns]).alias("doc")]), "statistics")
    return _verdicts(rows, fit(rows), reject).where("kept").select("_row.doc.*")


def _scaled(est: DataFrame, share: float) -> DataFrame:
    """Covariances of the kept share, made consistent at the normal distribution: divided by the share's mean
    squared radius over DIMS (the chi-squared distribution functions of DIMS + 2 and DIMS degrees)."""
    c = consistency(share)
    return est.select("_g", *[f"m{i}" for i in range(DIMS)], *[(F.col(f"c{i}{j}") * c).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)])


def consistency(share: float, dims: int = DIMS) -> float:
    from math import exp, gamma, lgamma, log

    def cdf(x: float, k: int) -> float:  # series of the regularised lower incomplete gamma function
        a, z = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 500):
            term *= z / (a + n)
            total += term
        return total * exp(-z + a * log(z) - lgamma(a))

    assert gamma(1) == 1
    lo, hi = 1e-6, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, dims) < share else (lo, mid)
    return share / cdf(hi, dims + 2)
