"""Operator 6, quality rules. DataFrame functions only.

Base rules reject texts with too few words or too many repeated windows. Of the others, robust multivariate
outliers are rejected: per language and source, minimum-covariance-determinant estimates of transformed
statistics, and a bound on the Mahalanobis distance. Concentration steps run from several deterministic starts until no group's
determinant falls, and each group takes the estimate of least determinant that any start came by.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Scratch, table, text_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: The fall of a log determinant below which a group counts as settled; share of rows in the core; squared distance beyond which a row is an outlier (chi-square, 4 degrees, at about 1 - 1e-9); rows a group needs for estimates of its own.
SETTLED, CORE, CUTOFF, LEAST = 1e-3, 0.75, 46.0, 50
#: Features and the least standard deviation each is given, so that a core of equal values does not make every other value an outlier.
FLOORS = {"z_len": 0.12, "z_sym": 0.5, "z_dup": 0.6, "z_rep": 0.6}


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts; null text: zeros.

    A text's windows are hashed in its row; only where a hash occurs twice are they sorted, so that equal ones meet.
    """
    t = F.col("t")
    # nondeterministic or costly arrays are columns of their own, so that they are made once
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_of(text).alias("t"))
    rows = rows.select(
        "k", "lang", "source",
        (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.locate("\n", t) > 0, F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))).otherwise(F.array().cast("array<string>")).alias("lines"),
        F.transform(F.regexp_extract_all(t, F.lit(f"({WORD})"), 1), lambda w: F.xxhash64(w)).alias("w"),
    )
    w, last = F.col("w"), WINDOW - 1
    windows = F.when(F.size(w) >= WINDOW + 1, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(last + 1)]))).otherwise(F.array().cast("array<long>"))
    rows = rows.select(
        "k", "lang", "source", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    rows = rows.drop("h").withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    at = F.col("at")
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at").withColumnRenamed("k", key)


def features(stats: DataFrame) -> DataFrame:
    """The transformed statistics: log mean word length, root of the share of symbols, log of repeated lines and share of repeated words, on scales where clean texts vary by less than one."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "z_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "z_sym": 10 * F.sqrt(F.col("n_symbols") / n),
            "z_dup": F.log1p(F.col("n_dup_lines").cast("double")),
            "z_rep": 10 * F.col("n_repeat_words") / n,
        }
    )


def chi_square(x: float, degrees: int) -> float:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def consistency(core: float, degrees: int) -> float:
    """What the covariance of the core's share of normal rows is to be multiplied by: core over the chi-square, of two degrees more, of its quantile."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < core else (low, mid)
    return core / chi_square(low, degrees + 2) if core < 1 else 1.0


def _triangle(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]


def _moments(names: list[str]) -> list[Column]:
    return [F.avg(a).alias(f"mu_{a}") for a in names] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in _triangle(names)]


def _factor(fits: DataFrame, names: list[str], scale: float) -> DataFrame:
    """(g, start, mu_, l_, logdet): the Cholesky factor, column by column, of the floored covariance and its log determinant; one row
    per group and start, so that rows of the corpus only substitute."""
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            s = F.coalesce(F.col(f"c_{a}_{b}"), F.lit(0.0)) * scale
            if i == j:
                s = F.greatest(s, F.lit(FLOORS[a] ** 2))
            for k in names[:j]:
                s = s - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            fits = fits.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(s, F.lit(FLOORS[a] ** 2 / 100))) if i == j else s / F.col(f"l_{b}_{b}"))
    return fits.select("g", "start", *[f"mu_{a}" for a in names], *[f"l_{a}_{b}" for a, b in _triangle(names)], _logdet(names).alias("logdet"))


def _logdet(names: list[str]) -> Column:
    return 2 * reduce(lambda x, y: x + y, [F.log(f"l_{a}_{a}") for a in names])


def _with_distance(rows: DataFrame, fits: DataFrame, names: list[str]) -> DataFrame:
    """rows (g, ...) by every start of their group's fits, with d2. fits is a written table: some rows per group, broadcast below the session's threshold."""
    out = rows.join(fits.drop("logdet"), "g")
    for i, a in enumerate(names):
        s = F.col(a) - F.col(f"mu_{a}")
        for b in names[:i]:
            s = s - F.col(f"l_{a}_{b}") * F.col(f"y_{b}")
        out = out.withColumn(f"y_{a}", s / F.col(f"l_{a}_{a}"))
    d2 = sum((F.col(f"y_{a}") * F.col(f"y_{a}") for a in names), F.lit(0.0))
    return out.select(*rows.columns, "start", d2.alias("d2"))


def _bin(d2: Column) -> Column:
    return F.floor(32 * F.log2(d2 + 1e-6))


def _levels(rows: DataFrame, share: float) -> DataFrame:
    """(g, start, edge): the upper edge of the histogram bin of d2 in which a group's share of rows is reached. Bins are 1/32 of a doubling: some hundred counts per group, whatever its size."""
    bins = rows.groupBy("g", "start", _bin(F.col("d2")).alias("b")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("g", "start")
    bins = bins.withColumns({"upto": F.sum("n").over(each.orderBy("b")), "all": F.sum("n").over(each)})
    return bins.where(F.col("upto") >= F.ceil(share * F.col("all"))).groupBy("g", "start").agg(F.min("b").alias("edge"))


def _starts(rows: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """Fits (g, start, mu_, l_, logdet) to set out from: 0, medians and median deviations; 1, means and covariance of all rows; 2, those of rows
    drawn in to within two deviations of the median on each axis, which leaves correlation to the bulk of the rows."""
    at = [F.percentile_approx(a, 0.5, 2000).alias(f"mu_{a}") for a in names]
    # written, so that their size is known: some hundred groups are broadcast, and a source with a third of all rows is not dealt to one task
    mid = scratch.write(rows.groupBy("g").agg(*at))
    spread = rows.join(mid, "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(a) - F.col(f"mu_{a}")), 0.5, 2000).alias(f"s_{a}") for a in names])
    mid = scratch.write(mid.join(spread, "g").withColumns({f"s_{a}": F.greatest(1.4826 * F.col(f"s_{a}"), F.lit(FLOORS[a])) for a in names}))
    first = mid.select("g", F.lit(0).alias("start"), *[f"mu_{a}" for a in names], *[(F.col(f"s_{a}") if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in _triangle(names)])
    near = mid.select("g", *[F.col(f"mu_{a}").alias(f"at_{a}") for a in names], *[f"s_{a}" for a in names])
    inside = [F.greatest(F.least(F.col(a), F.col(f"at_{a}") + 2 * F.col(f"s_{a}")), F.col(f"at_{a}") - 2 * F.col(f"s_{a}")).alias(a) for a in names]
    both = rows.join(near, "g").select("g", F.explode(F.array(F.struct(F.lit(1).alias("start"), *names), F.struct(F.lit(2).alias("start"), *inside))).alias("e")).select("g", "e.*")
    others = _factor(both.groupBy("g", "start").agg(*_moments(names)), names, 1.0)
    return scratch.write(first.withColumn("logdet", _logdet(names)).unionByName(others))


def least_determinant(rows: DataFrame, scratch: Scratch, names: list[str], core: float = CORE, settled: float = SETTLED) -> DataFrame:
    """(g, start, mu_, l_, logdet): each group's estimate of least determinant, of rows (g, names).

    A concentration step refits mean and covariance on the core nearest to the last fit; it can't raise the determinant (but for the
    histogram's bins). Steps go on until no start of any group falls by more than settled below the least it came by so far; as determinants have a floor, that
    comes to an end whatever the rows. Each group takes the least of all, the first start of equals.
    """
    scale, fits, best = consistency(core, len(names)), _starts(rows, names, scratch), None
    of = lambda *by: F.min_by(F.struct(*[c for c in fits.columns if c not in by]), F.struct("logdet", "start")).alias("e")
    while True:
        far = _with_distance(rows, fits, names)
        near = far.join(scratch.write(_levels(far, core)), ["g", "start"]).where(_bin(F.col("d2")) <= F.col("edge"))
        fits = scratch.write(_factor(near.groupBy("g", "start").agg(*_moments(names)), names, scale))
        if best is None:
            best = fits  # the starts are no cores, so they do not count
            continue
        fall = best.select("g", "start", F.col("logdet").alias("was")).join(fits, ["g", "start"]).agg(F.max(F.nanvl(F.col("was") - F.col("logdet"), F.lit(0.0)))).first()[0]
        best = scratch.write(best.unionByName(fits).groupBy("g", "start").agg(of("g", "start")).select("g", "start", "e.*").select(fits.columns))
        if fall is None or fall <= settled:
            return scratch.write(best.groupBy("g").agg(of("g")).select("g", "e.*"))


def outliers(stats: DataFrame, scratch: Scratch, key: str = "doc_id", core: float = CORE, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """stats with d2, the squared robust distance, and outlier. Groups are languages in sources (nulls are values).

    Groups below least rows are judged by the estimate of their language, and that by the whole table's where it is too
    small as well; these are made from all judged rows of the language or table. Statistics cover every row that passed the base rules; rows that failed them are not judged (d2 null).
    """
    names = list(FLOORS)
    judged = features(stats).where("not base_failed")
    sizes = judged.groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    sizes = scratch.write(sizes.withColumns({"n_lang": F.sum("n").over(of_lang), "n_least": F.min("n").over(of_lang)}))
    both, by_lang, whole = F.xxhash64(F.lit("both"), "lang", F.col("lang").isNull(), "source", F.col("source").isNull()), F.xxhash64(F.lit("lang"), "lang", F.col("lang").isNull()), F.lit(0).cast("long")
    group = F.when(F.col("n") >= least, both).when(F.col("n_lang") >= least, by_lang).otherwise(whole)
    # the estimates that a row goes into: its own group's, and the wider ones that a small group asks for
    asked = F.array(
        F.when(F.col("n") >= least, both),
        F.when((F.col("n_lang") >= least) & (F.col("n_least") < least), by_lang),
        F.when(F.lit(not sizes.where(F.col("n_lang") < least).isEmpty()), whole),
    )
    groups = scratch.write(sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), group.alias("g"), F.array_compact(asked).alias("into")))
    rows = judged.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    own = scratch.write(rows.select(key, "g", "into", *names))
    fits = least_determinant(own.select(F.explode("into").alias("g"), *names), scratch, names, core)
    return _with_distance(own, fits, names).select(key, "d2", (F.col("d2") > cutoff).alias("outlier"))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, the four statistics, base_failed, d2, kept): one row per row of docs with a distinct key; rows that repeat a key are all kept in the result, each judged by itself where their texts agree and by the largest distance where not.

    Null text has no words and fails. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = statistics(docs, key, text).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = scratch.write(stats)
    far = outliers(stats, scratch, key, **options).groupBy(F.col(key).alias("__k")).agg(F.max("d2").alias("d2"), F.max("outlier").alias("outlier"))
    out = stats.join(far, F.col(key).eqNullSafe(F.col("__k")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("outlier", F.lit(False))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2", "lang", "source")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
