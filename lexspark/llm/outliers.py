"""Quality rules with robust multivariate outliers, by SQL functions only.

Base statistics come from the whole text inside one row. Documents that pass the base rules are then held against a
minimum-covariance-determinant estimate of their own language and source, over four transformed statistics: of the
`SUPPORT` share of documents whose covariance has the least determinant, found by concentration steps from many
starts; the best of them are taken over all documents until the determinant falls no more, and the one that ends lowest
counts. A reweighting step estimates anew from all documents near to that, and documents beyond a high chi-square quantile of the squared
Mahalanobis distance are rejected. `SUPPORT` is one half (the maximal breakdown), so that junk may hold nearly half of a
group and is still rejected.

Every step is a map-side aggregation by group and a join of the group's few figures back to the rows, and takes only the
groups and starts that still move. The covariance has a fixed floor on its diagonal (a regularised estimate, whose
determinant is the one compared), so that groups in which most documents share a value, or a group of copies, don't
reject whatever differs a little.

Small groups lean on their language, and small languages on all documents: with n documents, a group's own estimate
weighs n / (n + `PRIOR`), so that no verdict jumps when a group grows.

Defined cases: null and empty texts have no words and fail; null lang or source is a group like any other; repeated rows
are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import bounded, checkpointed, text_or_empty, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SUPPORT = 0.5
#: Concentration settles in a few steps; this only guards against a loop that never ends.
MAX_STEPS = 50
REWEIGHT, REJECT = 0.975, 0.99999
#: Starts are tried on so many rows of a group, so many of them drawn, and so many go on over all rows.
START_ROWS, ELEMENTAL, KEPT_STARTS = 300, 20, 2
PRIOR = 200
#: Summaries and vectors, which are small beside the texts they come from, lie in partitions of about so many rows.
SUMMARY_ROWS, VECTOR_ROWS = 10_000, 10_000
ACCURACY = 5_000
#: Least standard deviations of the transformed statistics: log mean word length, and roots of the rates of symbols,
#: of lines that repeat, and of words in windows that repeat.
FLOORS = (0.06, 0.05, 0.15, 0.12)
P = len(FLOORS)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(share: float, dof: int = P) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        low, high = (low, (low + high) / 2) if _chi2_cdf((low + high) / 2, dof) > share else ((low + high) / 2, high)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal vectors must be multiplied by."""
    return share / _chi2_cdf(chi2_quantile(share), P + 2)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_lines, _n_repeat_words."""
    text = text_or_empty(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # each array is a column of its own before a lambda looks into it, so that it is made once a row
    a = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines, "_n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])),
    )
    b = a.withColumns({
        "_n_words": F.size("_words").cast("long"),
        "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": windows,
    }).drop("_words", "_lines")
    by_hash = F.array_sort(F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), by_hash)).drop("_windows")

    def repeats(x: Column, i: Column) -> Column:
        return (F.get(F.col("_sorted"), i - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("_sorted"), i + 1)["h"].eqNullSafe(x["h"]))

    places = F.array_sort(F.transform(F.filter(F.col("_sorted"), repeats), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return c.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted")


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))


def vector() -> list[Column]:
    """The transformed statistics of a document with words."""
    words, chars = F.greatest(F.col("_n_words"), F.lit(1)), F.greatest(F.col("_word_chars"), F.lit(1))
    return [
        F.log(chars / words),
        F.sqrt(F.col("_n_symbols") / chars),
        F.sqrt(F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))),
        F.sqrt(F.col("_n_repeat_words") / words),
    ]


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(P)]


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
CENTRE, COVARIANCE, FACTOR = _names("m"), [f"c{i}_{j}" for i, j in PAIRS], [f"l{i}_{j}" for i, j in PAIRS]


def _factored(est: DataFrame) -> DataFrame:
    """est with the Cholesky factor of its covariance, l0_0 .. l3_3, and the log of its determinant."""
    out = est
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.withColumn("log_det", sum((2 * F.log(f"l{i}_{i}") for i in range(P)), F.lit(0.0)))


def _distance() -> Column:
    """The squared Mahalanobis distance of x0..x3 from the joined group figures, by forward substitution."""
    solved: list[Column] = []
    total = F.lit(0.0)
    for i in range(P):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}_{k}") * solved[k]
        solved.append(z / F.col(f"l{i}_{i}"))
        total = total + solved[i] * solved[i]
    return total


def _moments(near: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and regularised covariance of the given rows by keys."""
    sums = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(P)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in PAIRS]
    )
    return sums.withColumns({f"c{i}_{j}": F.lit(factor) * F.col(f"c{i}_{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS})


def starts(rows: DataFrame, groups: int) -> DataFrame:
    """(_group, start, m0..3, c0_0..3_3): where concentration begins. Quartile ranges about the medians, about the lower
    and about the upper quartiles; and about the medians, the covariances of the signs of the standardised vectors and of
    their hyperbolic tangents."""
    quartiles = rows.groupBy("_group").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    figures = bounded(_summary(quartiles.select("_group", *_names("q"), *[spread[i].alias(f"s{i}") for i in range(P)]), groups), groups)
    ranges = lambda name, k: figures.select(
        "_group", F.lit(name).alias("start"), *[F.col(f"q{i}")[k].alias(f"m{i}") for i in range(P)],
        *[(F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in PAIRS],
    )
    scaled = rows.join(figures, "_group").select("_group", *[((F.col(f"x{i}") - F.col(f"q{i}")[1]) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)])
    length = F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))), F.lit(1e-9))
    pulled = scaled.groupBy("_group").agg(
        *[(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / length**2) * P).alias(f"sign{i}_{j}") for i, j in PAIRS],
        *[F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"tanh{i}_{j}") for i, j in PAIRS],
    )
    joined = pulled.join(figures, "_group")
    bent = lambda name: joined.select(
        "_group", F.lit(name).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)],
        *[(F.col(f"{name}{i}_{j}") * F.col(f"s{i}") * F.col(f"s{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in PAIRS],
    )
    return ranges("middle", 1).union(ranges("low", 0)).union(ranges("high", 2)).union(bent("sign")).union(bent("tanh"))


def _summary(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, kept in few files."""
    return checkpointed(df.coalesce(-(-max(1, rows) // SUMMARY_ROWS)))


KEYS, STATE = ["_group", "start"], [*CENTRE, *COVARIANCE, *FACTOR, "log_det"]


def elemental(sample: DataFrame, count: int = ELEMENTAL) -> DataFrame:
    """(_group, start, centre, covariance) of count subsets of P + 1 rows of each group, drawn by hashes."""
    tried = sample.withColumn("start", F.explode(F.array(*[F.lit(f"drawn{k}") for k in range(count)])))
    order = Window.partitionBy(*KEYS).orderBy(F.xxhash64("_draw", "start"), "_draw")
    picked = tried.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= P + 1)
    return _moments(picked, KEYS, 1.0).select(*KEYS, *CENTRE, *COVARIANCE)


def _concentrated(rows: DataFrame, now: DataFrame, count: int) -> DataFrame:
    """One step of every start in now, of which there are at most count: (_group, start, _before, _after)."""
    now = bounded(now, count)
    measured = rows.join(now, "_group").select(*KEYS, *_names("x"), _distance().alias("_d"))
    cuts = bounded(measured.groupBy(*KEYS).agg(F.percentile_approx("_d", SUPPORT, ACCURACY).alias("_cut")), count)
    near = measured.join(cuts, KEYS).where(F.col("_d") <= F.col("_cut"))
    after = _factored(_moments(near, KEYS, consistency(SUPPORT))).select(*KEYS, F.struct(*STATE).alias("_after"))
    return _summary(after.join(now.select(*KEYS, F.struct(*STATE).alias("_before")), KEYS), count)


def least_determinants(rows: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """Per _group of the vectors x0..x3: centre, covariance, factor and log_det of the subset with the least determinant.

    As in the fast algorithm for large groups (Rousseeuw and Van Driessen, 1999): all starts take two steps on a sample
    of about START_ROWS rows of each group, and the best go on over all rows until the determinant falls no more.
    sizes: (_group, n), of so many groups.
    """
    drawn = rows.withColumn("_draw", F.xxhash64(F.monotonically_increasing_id())).join(bounded(sizes, groups), "_group")
    sample = checkpointed(drawn.where(F.pmod("_draw", F.lit(1 << 20)) < F.lit(START_ROWS << 20) / F.col("n")).select("_group", "_draw", *_names("x")))
    tried = groups * (ELEMENTAL + 5)
    fresh = lambda df: _summary(_factored(df).withColumn("log_det", F.lit(float("inf"))).select(*KEYS, *STATE), tried)
    now = fresh(starts(sample, groups).union(elemental(sample)))
    for _ in range(2):
        now = _concentrated(sample, now, tried).select(*KEYS, "_after.*")
    best = Window.partitionBy("_group").orderBy("log_det", "start")
    now = fresh(now.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= KEPT_STARTS).select(*KEYS, *CENTRE, *COVARIANCE))
    settled = None
    for _ in range(MAX_STEPS):
        both = _concentrated(rows, now, groups * KEPT_STARTS)
        falls = F.col("_after.log_det") < F.col("_before.log_det") - 1e-9
        rest = both.where(~falls).select(*KEYS, "_before.*")
        settled = rest if settled is None else settled.union(rest)
        now = both.where(falls).select(*KEYS, "_after.*")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"concentration did not settle in {MAX_STEPS} steps")
    least = settled.groupBy("_group").agg(F.min_by(F.struct(*STATE), F.struct("log_det", "start")).alias("_best"))
    return _summary(least.select("_group", "_best.*"), groups)


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """Per _group of the vectors x0..x3: n (its rows), centre and covariance after reweighting; and the number of groups.
    A column _parent of rows is kept, which is the same for all of a group."""
    told = [F.first(c).alias(c) for c in rows.columns if c == "_parent"]
    sizes = checkpointed(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *told))
    groups = sizes.count()
    raw = bounded(least_determinants(rows, sizes, groups), groups)
    near = rows.join(raw, "_group").where(_distance() <= chi2_quantile(REWEIGHT)).select("_group", *_names("x"))
    return _summary(_moments(near, ["_group"], consistency(REWEIGHT)).drop("n").join(bounded(sizes, groups), "_group"), groups), groups


def _group(level: int) -> Column:
    """All documents, a language, or a language and source."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit(level).alias("level"), (F.col("_lang") if level else none).alias("lang"), (F.col("_source") if level == 2 else none).alias("source"))


def leaned(own: DataFrame, parent: DataFrame) -> DataFrame:
    """own (_group, _parent, n, centre, covariance), drawn to the parent's estimate by PRIOR documents' weight."""
    above = parent.select(F.col("_group").alias("_above"), *[F.col(c).alias(f"p{c}") for c in CENTRE + COVARIANCE])
    w = F.col("n") / (F.col("n") + PRIOR)
    between = lambda i, j: w * (1 - w) * (F.col(f"m{i}") - F.col(f"pm{i}")) * (F.col(f"m{j}") - F.col(f"pm{j}"))
    return own.join(above, F.col("_parent") == F.col("_above")).select(
        "_group", *[(w * F.col(c) + (1 - w) * F.col(f"p{c}")).alias(c) for c in CENTRE],
        *[(w * F.col(f"c{i}_{j}") + (1 - w) * F.col(f"pc{i}_{j}") + between(i, j)).alias(f"c{i}_{j}") for i, j in PAIRS],
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the squared distance (null where the base rules decide)."""
    stats = with_statistics(docs.select("doc_id", "text", F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source")))
    made = stats.select(
        "doc_id", "_lang", "_source", *[F.col(f"_{s}").alias(s) for s in STATS], base_failed().alias("base_failed"),
        *[v.alias(f"x{i}") for i, v in enumerate(vector())],
    )
    rows = checkpointed(made)
    narrow = rows.where(~F.col("base_failed")).coalesce(-(-max(1, rows.count()) // VECTOR_ROWS))
    levels = F.array(*[F.struct(_group(k).alias("_group"), _group(max(0, k - 1)).alias("_parent")) for k in range(3)])
    found, groups = estimates(narrow.select(F.explode(levels).alias("_l"), *_names("x")).select("_l.*", *_names("x")))
    level = lambda k: bounded(found.where(F.col("_group.level") == k), groups)
    known = bounded(_summary(_factored(leaned(level(2), leaned(level(1), level(0)))), groups), groups)
    far = rows.withColumn("_own", _group(2)).join(known, F.col("_own") == F.col("_group"), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= chi2_quantile(REJECT))
    return far.select("doc_id", *STATS, "base_failed", kept.alias("kept"), distance.alias("distance"))
