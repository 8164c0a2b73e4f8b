"""Robust multivariate outliers by minimum covariance determinant, as DataFrame operations only.

Each text becomes a vector of transformed statistics in fixed point. Estimates are made for each language and source,
each language and all rows. For each, concentration steps from several starts keep the nearest h = (n + d + 1) / 2
rows and take their mean and covariance anew, until the determinant falls no more; the start of least determinant
stays. Rows tied at the edge of the h nearest share the places left there, so a block of alike rows below half of a
group cannot enter whole. A source's estimate is then drawn towards its language's, and that towards all rows', by
the weights h - d - 1 (the degrees of freedom of h rows; none if that is negative) and PRIOR_ROWS: small groups are
measured mostly by what they belong to, with no step at any size. A row is rejected if its squared Mahalanobis distance is beyond the chi-square quantile that a clean row exceeds with
probability ``miss``. Sums are of integers, so the result does not depend on their order; every aggregate combines on
the map side, so a hot group costs no more than another.

A null text has no words and fails the base rules, as an empty one does. Null languages and sources are values of
their own. Repeated rows and ids count as often as they occur. Extra columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle, settle_and_watch

SPACES = r"[\x20\x09-\x0D]"
#: A-Z and the capitals of Latin-1, one by one: Java tests a class of single Latin-1 characters by a bit set, ranges one after another.
CAPITALS = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0xDF)) if c != 0xD7)
#: ln(chars per word), and ln(1 + 100 x) of symbols, marks and capitals per char, repeated words and dup lines per word or line.
VECTOR = (
    "ln(word_chars * 1e0 / n_words)",
    "ln(1e0 + n_symbols * 1e2 / word_chars)",
    "ln(1e0 + n_marks * 1e2 / word_chars)",
    "ln(1e0 + n_capitals * 1e2 / word_chars)",
    "n_repeat_words * 1e0 / n_words",
    "n_dup_lines * 1e0 / n_lines",
)
SCALE, RIDGE, PRIOR_ROWS, MISS = 64, (6.0, 16.0, 12.0, 12.0, 6.0, 6.0), 100, 5e-8
D = len(VECTOR)
#: A determinant is stable when its logarithm falls by less than this.
STABLE = 1e-6


def chi_square_tail(x: float, d: int) -> float:
    """P(chi-square of even d > x)."""
    return exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(d // 2))


def chi_square_quantile(tail: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, d) > tail else (low, mid)
    return low


#: The nearest half of a normal sample has a covariance too small by this factor.
CONSISTENCY = 0.5 / (1 - chi_square_tail(chi_square_quantile(0.5, D), D + 2))
CUTOFF = round(chi_square_quantile(MISS, D), 6)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Counts of every whole text, beside its language, source and the columns ``keep``."""
    rows = docs.select(F.struct(F.lit(0), *keep).alias("own"), F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    word = F.filter(F.split("text", SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select("own", "doc_id", "lang", "source", "text", word.alias("words"), lines.alias("lines"))
    # A window is known by a hash of its words' hashes. Only texts that repeat one sort (hash, place) pairs, which puts
    # equal windows side by side.
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.slice("hashes", 1, F.greatest(F.size("hashes") - 2, F.lit(0)))
    rows = rows.withColumn("windows", F.transform(starts, lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform(F.when(repeats, F.col("windows")).otherwise(F.array().cast("array<bigint>")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("windows", F.sort_array(placed))
    again = F.filter("windows", lambda x, i: (F.get("windows", i - 1)["h"] == x["h"]) | (F.get("windows", i + 1)["h"] == x["h"]))
    rows = rows.withColumn("spots", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("spots", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("spots", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    count = lambda what: F.length(F.regexp_replace("text", f"[^{what}]+", "")).cast("long")
    return rows.select(
        "own", "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), count("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        count("!?.,;:").alias("n_marks"), count(CAPITALS).alias("n_capitals"), F.size("lines").cast("long").alias("n_lines"),
    )


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def vector_columns() -> list[str]:
    return [f"CAST(round({SCALE}e0 * ({x})) AS BIGINT) AS z{i}" for i, x in enumerate(VECTOR)]


def start_distances() -> list[str]:
    """Squared distances from medians m in units of absolute deviations u: over all coordinates, and the largest."""
    parts = [f"pow((z{i} - m{i}) / greatest(u{i} * 1.4826e0, {RIDGE[i]!r}e0), 2)" for i in range(D)]
    return [" + ".join(parts), f"greatest({', '.join(parts)})"]


def level(d2: str) -> str:
    """A distance in 1/16 octaves, as an integer: its order statistics need few values."""
    return f"CAST(floor(16e0 * ln(1e0 + {d2}) / ln(2e0)) AS INT)"


LOWER = [(i, j) for i in range(D) for j in range(i + 1)]


def moments() -> list[str]:
    return ["count(*) AS n", *(f"sum(z{i}) AS s{i}" for i in range(D)), *(f"sum(z{i} * z{j}) AS s{i}{j}" for i, j in LOWER)]


def covariance_stages() -> list[list[str]]:
    """Columns that turn moments into the mean m and the ridged covariance v."""
    mean = [f"s{i} * 1e0 / n AS m{i}" for i in range(D)]
    return [mean, [f"{CONSISTENCY!r}e0 * (s{i}{j} * 1e0 / n - m{i} * m{j})" + (f" + {RIDGE[i] ** 2!r}e0" if i == j else "") + f" AS v{i}{j}" for i, j in LOWER]]


def factor_stages() -> list[list[str]]:
    """The lower Cholesky factor c of v, a column at a time."""
    stages = []
    for j in range(D):
        less = "".join(f" - c{j}{k} * c{j}{k}" for k in range(j))
        stages.append([f"sqrt(v{j}{j}{less}) AS c{j}{j}"])
        if j + 1 < D:
            stages.append([f"(v{i}{j}" + "".join(f" - c{i}{k} * c{j}{k}" for k in range(j)) + f") / c{j}{j} AS c{i}{j}" for i in range(j + 1, D)])
    return stages


LOG_DET = " + ".join(f"2e0 * ln(c{j}{j})" for j in range(D))


def shrunk() -> list[str]:
    """m and v of a source (own), drawn towards its language's (lang), which is drawn towards all rows' (whole)."""
    own, of_lang = (f"greatest(0e0, least({k}.n, floor(({k}.n + {D + 1}) / 2e0)) - {D + 1})" for k in ("own", "lang"))  # h - d - 1
    lang = lambda x: f"(({of_lang} * lang.{x} + {PRIOR_ROWS} * whole.{x}) / ({of_lang} + {PRIOR_ROWS}))"
    return [f"({own} * own.{x} + {PRIOR_ROWS} * {lang(x)}) / ({own} + {PRIOR_ROWS}) AS {x}" for x in (*(f"m{i}" for i in range(D)), *(f"v{i}{j}" for i, j in LOWER))]


def distance_stages() -> list[list[str]]:
    """Forward substitution, then the squared Mahalanobis distance."""
    stages = [[f"(z{i} - m{i}" + "".join(f" - c{i}{k} * y{k}" for k in range(i)) + f") / c{i}{i} AS y{i}"] for i in range(D)]
    return [*stages, [" + ".join(f"y{i} * y{i}" for i in range(D)) + " AS d2"]]


Z = [f"z{i}" for i in range(D)]
FIT = [*(f"m{i}" for i in range(D)), *(f"v{i}{j}" for i, j in LOWER), *(f"c{i}{j}" for i, j in LOWER)]
#: Names of a source's, a language's and the whole estimate; the length in front keeps values with a slash apart.
OF_LANG = "concat(length(of_lang), ':', of_lang)"
NAMES = {"own": f"concat({OF_LANG}, '/', of_source)", "lang": OF_LANG, "whole": "''"}


def _moments(near: DataFrame) -> DataFrame:
    """Moments of the h rows of least level q by g and start; rows at the last level share what is left of h."""
    key = ["g", "start"]
    upto = Window.partitionBy(*key).orderBy("q")
    levels = near.groupBy(*key, "q").agg(F.count("*").alias("here")).select(*key, "q", "here", (F.sum("here").over(upto) - F.col("here")).alias("below"), F.sum("here").over(Window.partitionBy(*key)).alias("n"))
    levels = levels.selectExpr(*key, "q", "here", "below", f"least(n, (n + {D} + 1) div 2) AS h").where("below < h").selectExpr(*key, "q", "least(1e0, (h - below) * 1e0 / here) AS share")
    # Integer sums by share; a group has two shares at most, so its weighted sums have no order either.
    sums = near.join(levels, [*key, "q"]).groupBy(*key, "share").agg(*[F.expr(x) for x in moments()])
    names = [x.rpartition(" AS ")[2] for x in moments()]
    return sums.groupBy(*key).agg(*[F.sum(F.col("share") * F.col(x)).alias(x) for x in names])


def _refit(near: DataFrame) -> DataFrame:
    """g, start and the estimate from the nearest rows; each step is written, so that no plan holds the next one's."""
    near = settle(near, "near")
    sums = settle(_moments(near), "moments")
    discard(near)
    return _staged(sums, covariance_stages() + factor_stages()).select("g", "start", F.struct(*FIT, F.expr(LOG_DET).alias("log_det")).alias("fit"))


def estimate(rows: DataFrame) -> DataFrame:
    """n, mean, covariance and its factor for each group g of the vectors, by minimum covariance determinant."""
    middle = settle(rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile(z, 0.5).alias(f"m{i}") for i, z in enumerate(Z)]), "medians")
    spread = settle(rows.join(middle, "g").groupBy("g").agg(*[F.percentile(F.abs(F.col(z) - F.col(f"m{i}")), 0.5).alias(f"u{i}") for i, z in enumerate(Z)]), "deviations")
    levels = ", ".join(level(x) for x in start_distances())
    near = rows.join(middle.join(spread, "g"), "g").selectExpr("g", *Z, f"posexplode(array({levels})) AS (start, q)")
    model = settle(_refit(near).withColumn("moved", F.lit(True)), "model")
    moves = True
    while moves:
        last, moving = model, model.where("moved").select("g", "start", *[f"fit.{x}" for x in FIT if x[0] != "v"])
        near = _staged(rows.join(moving, "g"), distance_stages()).selectExpr("g", "start", *Z, f"{level('d2')} AS q")
        better = F.coalesce(F.col("new.log_det") < F.col("fit.log_det") - STABLE, F.lit(False))
        model = model.drop("moved").join(_refit(near).withColumnRenamed("fit", "new"), ["g", "start"], "left")
        model = model.select("g", "start", F.when(better, F.col("new")).otherwise(F.col("fit")).alias("fit"), better.alias("moved"))
        model, seen = settle_and_watch(model, "model", moves=F.max("moved"))
        moves = seen["moves"]
        discard(last)
    best = model.groupBy("g").agg(F.min_by("fit", F.struct("fit.log_det", "start")).alias("fit"))
    return settle(best.join(middle.select("g", "n"), "g").select("g", "n", *[f"fit.{x}" for x in FIT if x[0] != "c"]), "estimates")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS, keep: list | tuple = ()) -> DataFrame:
    """``keep``, doc_id, the statistics, base_failed, kept, d2 (squared distance; null where the base rules failed)."""
    cutoff = CUTOFF if miss == MISS else round(chi_square_quantile(miss, D), 6)
    stats = settle(statistics(docs, id_col, text_col, tuple(keep)).selectExpr("*", f"{BASE_FAILED} AS base_failed", "coalesce(concat('=', lang), '') AS of_lang", "coalesce(concat('=', source), '') AS of_source"), "statistics")
    good = stats.where("NOT base_failed").selectExpr("of_lang", "of_source", *vector_columns())
    # A row counts in the estimates of its source, its language and all rows.
    vectors = settle(good.selectExpr(f"explode(array({', '.join(NAMES.values())})) AS g", *Z), "vectors")
    found = estimate(vectors)
    discard(vectors)
    groups = good.select("of_lang", "of_source").distinct()
    for name, g in NAMES.items():
        groups = groups.withColumn("g", F.expr(g)).join(found.select("g", F.struct(*found.columns[1:]).alias(name)), "g").drop("g")
    model = _staged(groups.selectExpr("of_lang", "of_source", *shrunk()), factor_stages())
    model = settle(model.select("of_lang", "of_source", *(x for x in FIT if x[0] != "v")), "groups")
    judged = stats.selectExpr("*", *[f"CASE WHEN NOT base_failed THEN {c.rpartition(' AS ')[0]} END AS z{i}" for i, c in enumerate(vector_columns())])
    d2 = _staged(judged.join(model, ["of_lang", "of_source"], "left"), distance_stages())
    names = [f"own.{x}" for x in stats.select("own.*").columns[1:]]
    return d2.selectExpr(*names, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", f"NOT base_failed AND d2 <= {cutoff!r}e0 AS kept", "d2")


def _staged(df: DataFrame, stages: list[list[str]]) -> DataFrame:
    """Columns that build on each other, in one projection (later ones name earlier ones)."""
    return df.selectExpr("*", *[c for columns in stages for c in columns])
