"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant (MCD).

Everything on the main path is DataFrame expressions.  ``statistics`` takes counts from each text.  ``vectors`` turns five
shares that every text has (``AXES``) into coordinates: the square root, which steadies the scatter of a share, less the median of the language and
source, shrunk for short texts (``PRIOR``), whose shares say less.  ``fit`` finds, for each language and source, location and scatter of
the half of the distinct vectors whose covariance has the least determinant:

* it starts from three deterministic estimates (scaled by the coordinates' absolute deviations: none, spatial signs, and hyperbolic tangents);
* a concentration step takes the half with the smallest distances under an estimate and gives its mean and covariance.  Steps are
  repeated while the determinant falls by more than ``FALL`` (of its logarithm), so they end; the start with the least determinant wins;
* distances are scaled so that their median is that of the chi-square distribution, which corrects the half's covariance and the
  size of the sample at once; the rows within its 0.975 quantile give the final, reweighted estimate, scaled likewise.

A row is an outlier if its scaled squared Mahalanobis distance exceeds ``CUTOFF``, the chi-square quantile that one of ten thousand normal rows exceeds.

A step is one pass over the distinct vectors: counts, sums and products by group and distance bucket, combined before their shuffle,
so a source with a third of all rows is no hot spot; the bucket that completes the half counts by the share that it needs.
Groups of fewer than ``GROUP_ROWS`` rows (20 for each coordinate) join the rest of their language, and if that is as small the rest of all languages.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, table, unit

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Words (or five times as many characters) from which on a share counts half.
PRIOR = 200
GROUP_ROWS = 100
#: Quantiles of the chi-square distribution with five degrees: 0.5, 0.975, 0.9999.
CHI_MEDIAN, CHI_NEAR, CUTOFF = 4.35146, 12.832502, 25.744832
#: Fall of a determinant's logarithm that asks for another step, least standard deviation (a guard against rows that are all equal).
FALL, GUARD = 1e-2, 1e-3
#: Distance buckets of a unit of the logarithm; groups whose estimates may be broadcast (some 300 bytes each), and parts that
#: a group is dealt to where its rows meet its estimates in a shuffle instead.
FINE, BROADCAST_GROUPS, SALTS = 64, 20_000, 64
_SPACE = "[\\x20\\x09-\\x0D]+"
#: The shares: numerator, denominator, and the weight by which a row's deviation counts.
AXES = {
    "x1": ("word_chars", "n_words", PRIOR),
    "x2": ("n_marks", "word_chars", 5 * PRIOR),
    "x3": ("n_upper", "word_chars", 5 * PRIOR),
    "x4": ("n_short", "n_words", PRIOR),
    "x5": ("n_distinct", "n_words", PRIOR),
}
P = len(AXES)
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and those of the vectors, in place of columns with their names.

    Null text is empty.  ``n_repeat_words`` counts words within windows of five words that occur at least twice; ``n_marks`` ASCII
    punctuation, ``n_short`` words of one or two code points.
    """
    text = unit()
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.withColumns({"__words": words, "__lines": lines})
    step = step.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        "n_marks": F.length(F.regexp_replace(text, "[^!-/:-@\\[-`{-~]+", "")).cast("long"),
        "n_short": F.size(F.filter("__words", lambda w: F.length(w) <= 2)).cast("long"),
        "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
        "__hash": F.when(F.size("__words") >= WINDOW, F.slice(F.transform("__words", lambda w, i: F.xxhash64(w, *[F.get("__words", i + k) for k in range(1, WINDOW)])), F.lit(1), F.size("__words") - (WINDOW - 1))),
    })
    # only a text that repeats a window needs its windows sorted
    step = step.withColumn("__sorted", F.when(F.size(F.array_distinct("__hash")) < F.size("__hash"), F.sort_array(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("__sorted", k)["h"] == x["h"], F.lit(False))
    step = step.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    gaps = F.transform("__at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", k + 1) - x, F.lit(WINDOW))))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return step.drop("__words", "__lines", "__hash", "__sorted", "__at").withColumn("base_failed", failed)


def _shares(stats: DataFrame) -> DataFrame:
    """``stats`` with the square roots of the shares and the weights of their deviations, rounded."""
    made = {}
    for a, (top, below, prior) in AXES.items():
        made[f"r_{a}"] = F.round(F.sqrt(F.try_divide(F.col(top), F.col(below))), 9)
        made[f"w_{a}"] = F.round(F.sqrt(F.col(below) / (F.col(below) + float(prior))), 9)
    return stats.withColumns(made)


def _median(value: Column | str) -> Column:
    return F.percentile_approx(value, 0.5, 2_000)  # exact up to a thousand rows or so, else within n / 2,000 ranks


def grouped(rows: DataFrame, least: int = GROUP_ROWS) -> DataFrame:
    """``lang, source, g`` of all pairs in ``rows``: the group whose estimates hold for them, a pair or a wider rest.

    Null languages and sources are values of their own.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("rest"))
    both = sizes.join(rest.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left")
    # the texts of structs differ wherever the values do, whatever marks they contain
    pair, wide = F.concat(F.lit("pair"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("rest"), F.to_json(F.struct("lang")))
    return both.select("lang", "source", F.when(F.col("n") >= least, pair).when(F.col("rest") >= least, wide).otherwise("all").alias("g"))


class _Meeting:
    """Joins rows with tables of groups: by a broadcast if the groups are few, else dealt to parts of each group."""

    def __init__(self, groups: int):
        self.few = groups <= BROADCAST_GROUPS

    def __call__(self, rows: DataFrame, groups: DataFrame, keys: dict[str, str], by: str) -> DataFrame:
        """``rows`` with the columns of ``groups``, equal (nulls too) in ``keys`` (of rows: of groups); ``by`` is what deals rows."""
        on = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()])
        if self.few:
            return rows.join(F.broadcast(groups), on).drop(*keys.values())
        groups = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__own", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
        return rows.join(groups, on & (F.col("__own") == F.col("__part"))).drop(*keys.values(), "__own", "__part")


_ESTIMATE = [*[f"m_{i}" for i in range(P)], *[f"k_{i}_{j}" for i, j in LOWER]]


def _sql(df: DataFrame, text: str) -> DataFrame:
    """A query over ``df``, which the text names ``{rows}``: analysed once, however many levels it has."""
    name = f"rows_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(text.format(rows=name))
    finally:
        df.sparkSession.catalog.dropTempView(name)


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` with ``d2`` from the coordinates and the estimate ``m_i, k_i_j`` beside them, rounded, so a rerun gives the same."""
    return _sql(rows, _sql_distance("SELECT * FROM {rows}")).drop(*[f"y{i}" for i in range(P)], *_ESTIMATE)


def _factored(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``m_i``, ``k_i_j`` and ``logdet`` from ``m_i`` and the covariance ``c_i_j``: the inverse of its Cholesky factor, with the guard added.

    No filter may follow on these columns before they are stored: it would be pushed down with all of them written out.
    """
    return _sql(rows, _sql_factored("SELECT * FROM {rows}", ", ".join(keep)))


def _factors() -> list[dict[str, str]]:
    """The columns of ``_factored`` in the order in which they follow from one another, as SQL that Spark and DuckDB share."""
    levels, product = [], lambda parts: "".join(f" - {a} * {b}" for a, b in parts)
    for j in range(P):
        cov = f"greatest(c_{j}_{j}, CAST(0 AS DOUBLE)) + CAST('{GUARD**2!r}' AS DOUBLE)"
        levels.append({f"l_{j}_{j}": f"round(sqrt(greatest({cov}{product([(f'l_{j}_{k}', f'l_{j}_{k}') for k in range(j)])}, CAST('{GUARD**2 / 2!r}' AS DOUBLE))), 9)"})
        if j + 1 < P:
            levels.append({f"l_{i}_{j}": f"round((c_{i}_{j}{product([(f'l_{i}_{k}', f'l_{j}_{k}') for k in range(j)])}) / l_{j}_{j}, 9)" for i in range(j + 1, P)})
    levels.append({f"k_{i}_{i}": f"round(1 / l_{i}_{i}, 9)" for i in range(P)} | {"logdet": f"round(2 * ({' + '.join(f'ln(l_{i}_{i})' for i in range(P))}), 6)"})
    for d in range(1, P):
        levels.append({f"k_{i}_{i - d}": f"round((CAST(0 AS DOUBLE){product([(f'l_{i}_{t}', f'k_{t}_{i - d}') for t in range(i - d, i)])}) / l_{i}_{i}, 9)" for i in range(d, P)})
    return levels


_NAMES = list(AXES)
_SUMMED = [*[f"s_{i}" for i in range(P)], *[f"s_{i}_{j}" for i, j in LOWER]]
_SUMS = ", ".join(["count(*) AS n", *[f"sum({a}) AS s_{i}" for i, a in enumerate(_NAMES)], *[f"sum({_NAMES[i]} * {_NAMES[j]}) AS s_{i}_{j}" for i, j in LOWER]])


def _starts(points: DataFrame, meet: _Meeting) -> DataFrame:
    """``g, s`` and the estimates to start from."""
    spread = points.groupBy("g").agg(*[F.greatest(F.round(_median(F.abs(a)) * 1.4826, 9), F.lit(GUARD)).alias(f"u_{i}") for i, a in enumerate(AXES)])
    spread = spread.withColumnRenamed("g", "__g")
    z = meet(points, spread, {"g": "__g"}, "x1").withColumns({f"z_{i}": F.col(a) / F.col(f"u_{i}") for i, a in enumerate(AXES)})
    norm = reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)])
    z = z.withColumn("norm", F.greatest(norm, F.lit(1e-12))).withColumns({f"t_{i}": F.tanh(f"z_{i}") for i in range(P)})
    units = [F.first(f"u_{i}").alias(f"u_{i}") for i in range(P)]
    means = [F.avg(f"t_{i}").alias(f"t_{i}") for i in range(P)]
    signs = [F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("norm")).alias(f"a_{i}_{j}") for i, j in LOWER]
    bends = [F.avg(F.col(f"t_{i}") * F.col(f"t_{j}")).alias(f"b_{i}_{j}") for i, j in LOWER]
    found = z.groupBy("g").agg(*units, *means, *signs, *bends).withColumns({f"m_{i}": F.lit(0.0) for i in range(P)})
    found = found.withColumn("s", F.explode(F.array(*map(F.lit, range(3)))))
    cov = {}
    for i, j in LOWER:
        plain = F.lit(1.0 if i == j else 0.0)
        bent = F.col(f"b_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}")
        cov[f"c_{i}_{j}"] = F.when(F.col("s") == 0, plain).when(F.col("s") == 1, F.col(f"a_{i}_{j}") * P).otherwise(bent) * F.col(f"u_{i}") * F.col(f"u_{j}")
    return _factored(found.withColumns(cov), ["g", "s"]).withColumn("logdet", F.lit(float("inf")))


def _concentrated(points: DataFrame, stats: DataFrame, meet: _Meeting) -> DataFrame:
    """The estimates of one step from those of ``stats``, and whether the determinant ``fell``."""
    met = meet(points, stats.withColumnRenamed("g", "__g"), {"g": "__g"}, "x1")
    # some thousand buckets a group at most, whatever the number of rows
    held = f"SELECT g, s, logdet AS before, CAST(floor(ln(d2 + 1e-6D) * {FINE}) AS INT) AS bucket, {_SUMS} FROM ({_sql_distance('SELECT * FROM {rows}')}) GROUP BY 1, 2, 3, 4"
    held = f"SELECT *, coalesce(sum(n) OVER (PARTITION BY g, s ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, (sum(n) OVER (PARTITION BY g, s) + {P} + 1) DIV 2 AS half FROM ({held})"
    parts = ", ".join(f"sum({c} * part) AS {c}" for c in _SUMMED)
    inner = f"SELECT g, s, max(before) AS before, max(half) AS n, {parts} FROM (SELECT *, least(1D, (half - below) / n) AS part FROM ({held}) WHERE below < half) GROUP BY g, s"
    return _sql(met, f"SELECT * EXCEPT (before), logdet < before - {FALL}D AS fell FROM ({_sql_moments(inner, 'g, s, before')})")


def _scales(points: DataFrame, stats: DataFrame, meet: _Meeting) -> DataFrame:
    """``__g, scale``: what brings the median distance of each group to that of the chi-square distribution."""
    met = _distance(meet(points, stats.withColumnRenamed("g", "__g"), {"g": "__g"}, "x1"))
    return met.groupBy(F.col("g").alias("__g")).agg(F.round(CHI_MEDIAN / F.greatest(_median("d2"), F.lit(1e-6)), 9).alias("scale"))


def fit(points: DataFrame, folder: str, meet: _Meeting) -> DataFrame:
    """The reweighted MCD estimates ``g, m_i, k_i_j, scale`` of each group of the distinct ``points`` (``g`` and coordinates)."""
    now, made, k = stored(_starts(points, meet), f"{folder}/mcd0"), [], 0
    while True:
        k += 1
        now = stored(_concentrated(points, now, meet), f"{folder}/mcd{k}").where("fell").drop("fell")
        if now.first() is None:
            break
        made.append(now.withColumn("step", F.lit(k)))
    if not made:
        return now.drop("s", "logdet").withColumn("scale", F.lit(1.0))
    # of equal determinants the first start's last step
    order = F.struct(F.col("logdet"), F.col("s"), -F.col("step"))
    best = reduce(DataFrame.unionByName, made).groupBy("g").agg(F.min_by(F.struct(*_ESTIMATE), order).alias("e")).select("g", "e.*")
    best = stored(best, f"{folder}/best")
    scale = stored(_scales(points, best, meet), f"{folder}/scale")
    raw = best.join(scale, best.g == scale["__g"]).drop("g")
    near = _distance(meet(points, raw, {"g": "__g"}, "x1")).where(F.col("d2") * F.col("scale") <= CHI_NEAR)
    last = _sql(near, _sql_moments(f"SELECT g, {_SUMS} FROM {{rows}} GROUP BY g", "g")).drop("logdet")
    last = stored(last, f"{folder}/last")
    scale = stored(_scales(points, last, meet), f"{folder}/scale2")
    return stored(last.join(scale, last.g == scale["__g"]).drop("__g"), f"{folder}/fit")


def vectors(rows: DataFrame, medians: DataFrame, meet: _Meeting) -> DataFrame:
    """``rows`` (with the shares) with their coordinates: weighted deviations from ``medians`` of their ``lang`` and ``source``,
    and the other columns of ``medians``."""
    named = medians.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    met = meet(rows, named, {"lang": "__lang", "source": "__source"}, "r_x1")
    coordinates = {a: F.round((F.col(f"r_{a}") - F.col(f"c_{a}")) * F.col(f"w_{a}"), 6) for a in AXES}
    return met.withColumns(coordinates).drop(*[f"{k}_{a}" for k in "rcw" for a in AXES])


def _estimates(good: DataFrame, folder: str) -> tuple[DataFrame, _Meeting]:
    """``lang, source``, medians and MCD estimates of all pairs in ``good`` (rows that pass the base rules, with their shares)."""
    names = stored(grouped(good), f"{folder}/names")
    meet = _Meeting(names.count())
    by_pair = names.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    shares = meet(good.select("lang", "source", *[f"{k}_{a}" for k in "rw" for a in AXES]), by_pair, {"lang": "__lang", "source": "__source"}, "r_x1")
    centres = shares.groupBy("g").agg(*[_median(f"r_{a}").alias(f"c_{a}") for a in AXES])
    medians = stored(names.join(centres, "g"), f"{folder}/medians")
    # equal vectors count once, so copies don't pass for the bulk of a group
    points = stored(vectors(good, medians, meet).select("g", *AXES).distinct(), f"{folder}/points")
    return stored(medians.join(fit(points, folder, meet), "g").drop("g"), f"{folder}/estimates"), meet


def _judged(rows: DataFrame, folder: str) -> DataFrame:
    """Stored ``rows`` with their shares that pass the base rules, with ``d2``."""
    found, meet = _estimates(rows.select("lang", "source", *[f"{k}_{a}" for k in "rw" for a in AXES]), folder)
    return _distance(vectors(rows, found, meet)).withColumn("d2", F.round(F.col("d2") * F.col("scale"), 4)).drop("scale", *AXES)


def judged(docs: DataFrame, folder: str | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id`` with all counts, ``d2`` and ``kept`` for each row of ``docs``.

    The fit is on all rows that pass the base rules; equal vectors count once.  Null languages and sources are values of their own; null and
    empty texts fail the base rules; repeated rows and null ids each get a row, texts may be of any length, other columns are
    ignored.  Rows that fail have no distance.
    """
    folder = folder or shared_dir(docs.sparkSession)
    rows = stored(_shares(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")), f"{folder}/stats")
    shares = [f"{k}_{a}" for k in "rw" for a in AXES]
    good = _judged(rows.where("not base_failed"), folder)
    failed = rows.where("base_failed").drop(*shares).withColumn("d2", F.lit(None).cast("double"))
    return good.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff))


def keep_good(docs: DataFrame, folder: str | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    Each row is judged by its own text, whatever its id, null too.  Rows are stored once with their shares and
    read again when the estimates are there, so texts don't move in a shuffle (but where there are over ``BROADCAST_GROUPS`` pairs
    of language and source).  Columns of ``docs`` may have any names.
    """
    folder, own = folder or shared_dir(docs.sparkSession), docs.columns
    staged = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in own]).alias("__whole"))
    shares = [f"{k}_{a}" for k in "rw" for a in AXES]
    # the filter comes after the table is stored: pushed down, it would write out the statistics over and over
    rows = _shares(statistics(staged)).select("lang", "source", "__whole", "base_failed", *shares)
    good = _judged(stored(rows, f"{folder}/staged").where("not base_failed").drop("base_failed"), folder)
    return good.where(F.col("d2") <= cutoff).select("__whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: counts, base verdict and verdict of every document; see ``judged`` for odd rows."""
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_factored(source: str, keep: str) -> str:
    """SQL of ``_factored`` over a select with ``m_i`` and ``c_i_j``."""
    for made in _factors():
        source = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in made.items())} FROM ({source})"
    return f"SELECT {keep}, {', '.join(_ESTIMATE)}, logdet FROM ({source})"


def _sql_moments(source: str, keep: str) -> str:
    source = f"SELECT *, {', '.join(f'round(s_{i} / n, 9) AS m_{i}' for i in range(P))} FROM ({source})"
    source = f"SELECT *, {', '.join(f's_{i}_{j} / n - m_{i} * m_{j} AS c_{i}_{j}' for i, j in LOWER)} FROM ({source})"
    return _sql_factored(source, keep)


def _sql_distance(source: str) -> str:
    """SQL that adds ``d2`` to a select with coordinates and an estimate."""
    ys = ", ".join(" + ".join(f"k_{i}_{j} * ({_NAMES[j]} - m_{j})" for j in range(i + 1)) + f" AS y{i}" for i in range(P))
    return f"SELECT *, round({' + '.join(f'y{i} * y{i}' for i in range(P))}, 6) AS d2 FROM (SELECT *, {ys} FROM ({source}))"


def oracle() -> str:
    """The same rules as DuckDB SQL, the concentration steps as a recursive table."""
    names, sums, scaled = _NAMES, _SUMS, _SUMMED
    columns = ", ".join(names)
    shares = ", ".join(f"round(sqrt({top} / {below}), 9) AS r_{a}, round(sqrt({below} / ({below} + {prior}.0::DOUBLE)), 9) AS w_{a}" for a, (top, below, prior) in AXES.items())
    starts = []
    for i, j in LOWER:
        plain = 1.0 if i == j else 0.0
        starts.append(f"CASE s WHEN 0 THEN {plain}::DOUBLE WHEN 1 THEN a_{i}_{j} * {P} ELSE b_{i}_{j} - t_{i} * t_{j} END * u_{i} * u_{j} AS c_{i}_{j}")
    z = ", ".join(f"{a} / u_{i} AS z_{i}" for i, a in enumerate(names))
    norm = " + ".join(f"z_{i} * z_{i}" for i in range(P))
    averages = ", ".join([*[f"avg(t_{i}) AS t_{i}" for i in range(P)], *[f"avg(z_{i} * z_{j} / norm) AS a_{i}_{j}, avg(t_{i} * t_{j}) AS b_{i}_{j}" for i, j in LOWER], *[f"min(u_{i}) AS u_{i}" for i in range(P)]])
    start = f"SELECT *, {', '.join(starts)}, {', '.join(f'0.0::DOUBLE AS m_{i}' for i in range(P))} FROM z CROSS JOIN (SELECT unnest([0, 1, 2]) AS s)"
    held = f"SELECT g, s, logdet AS before, floor(ln(d2 + 1e-6) * {FINE}) AS bucket, {sums} FROM ({_sql_distance('SELECT v.*, it.* EXCLUDE (g) FROM v JOIN it USING (g)')}) GROUP BY ALL"
    held = f"SELECT *, coalesce(sum(n) OVER (PARTITION BY g, s ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, (sum(n) OVER (PARTITION BY g, s) + {P} + 1) // 2 AS half FROM ({held})"
    half = f"SELECT g, s, max(before) AS before, max(half) AS n, {', '.join(f'sum({c} * least(1.0::DOUBLE, (half - below)::DOUBLE / n)) AS {c}' for c in scaled)} FROM ({held}) WHERE below < half GROUP BY g, s"
    step = f"SELECT * EXCLUDE (before) FROM ({_sql_moments(half, 'g, s, before')}) WHERE logdet < before - {FALL}"
    scale = f"SELECT g, round({CHI_MEDIAN}::DOUBLE / greatest(quantile_disc(d2, 0.5), 1e-6::DOUBLE), 9) AS scale FROM"
    near = f"SELECT g, {sums} FROM ({_sql_distance('SELECT v.*, best.* EXCLUDE (g), scale FROM v JOIN best USING (g) JOIN scale1 USING (g)')}) WHERE d2 * scale <= {CHI_NEAR} GROUP BY g"
    parts = [
        r"""w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents)""",
        "win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w))",
        "rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1)",
        "cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM (SELECT rid, i, unnest(range(5)) AS d FROM rep) GROUP BY rid)",
        r"""c AS MATERIALIZED (SELECT w.rid, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!-/:-@\[-`{-~]+', '', 'g')) AS n_marks, len(list_filter(words, lambda x: length(x) <= 2)) AS n_short, len(list_distinct(words)) AS n_distinct FROM w LEFT JOIN cov ON w.rid = cov.rid)""",
        f"b AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c)",
        f"good AS MATERIALIZED (SELECT rid, lang, source, {shares} FROM b WHERE NOT base_failed)",
        "sizes AS (SELECT lang, source, count(*) AS n FROM good GROUP BY lang, source)",
        f"rest AS (SELECT lang, sum(n) AS rest FROM sizes WHERE n < {GROUP_ROWS} GROUP BY lang)",
        f"names AS (SELECT sizes.lang, source, CASE WHEN n >= {GROUP_ROWS} THEN 'pair' || coalesce(sizes.lang, chr(2)) || chr(1) || coalesce(source, chr(2)) WHEN rest >= {GROUP_ROWS} THEN 'rest' || coalesce(sizes.lang, chr(2)) ELSE 'all' END AS g FROM sizes LEFT JOIN rest ON sizes.lang IS NOT DISTINCT FROM rest.lang)",
        "gg AS MATERIALIZED (SELECT good.*, g FROM good JOIN names ON good.lang IS NOT DISTINCT FROM names.lang AND good.source IS NOT DISTINCT FROM names.source)",
        f"centres AS MATERIALIZED (SELECT g, {', '.join(f'quantile_disc(r_{a}, 0.5) AS c_{a}' for a in names)} FROM gg GROUP BY g)",
        f"vectors AS MATERIALIZED (SELECT rid, g, {', '.join(f'round((r_{a} - c_{a}) * w_{a}, 6) AS {a}' for a in names)} FROM gg JOIN centres USING (g))",
        f"v AS MATERIALIZED (SELECT DISTINCT g, {columns} FROM vectors)",
        f"u AS MATERIALIZED (SELECT g, {', '.join(f'greatest(round(quantile_disc(abs({a}), 0.5) * 1.4826::DOUBLE, 9), {GUARD!r}::DOUBLE) AS u_{i}' for i, a in enumerate(names))} FROM v GROUP BY g)",
        f"z AS MATERIALIZED (SELECT g, {averages} FROM (SELECT *, greatest({norm}, 1e-12::DOUBLE) AS norm, {', '.join(f'tanh(z_{i}) AS t_{i}' for i in range(P))} FROM (SELECT v.*, u.* EXCLUDE (g), {z} FROM v JOIN u USING (g))) GROUP BY g)",
        f"it AS (SELECT * REPLACE ('infinity'::DOUBLE AS logdet), 0 AS step FROM ({_sql_factored(start, 'g, s')}) UNION ALL SELECT *, 1 AS step FROM ({step}))",
        f"best AS MATERIALIZED (SELECT g, {', '.join(_ESTIMATE)} FROM it WHERE step > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY logdet, s) = 1)",
        f"scale1 AS MATERIALIZED ({scale} ({_sql_distance('SELECT v.*, best.* EXCLUDE (g) FROM v JOIN best USING (g)')}) GROUP BY g)",
        f"near AS MATERIALIZED (SELECT g, {', '.join(_ESTIMATE)} FROM ({_sql_moments(near, 'g')}))",
        f"scale2 AS MATERIALIZED ({scale} ({_sql_distance('SELECT v.*, near.* EXCLUDE (g) FROM v JOIN near USING (g)')}) GROUP BY g)",
        f"far AS MATERIALIZED (SELECT rid, round(d2 * scale, 4) AS d2 FROM ({_sql_distance('SELECT vectors.*, near.* EXCLUDE (g), scale FROM vectors JOIN near USING (g) JOIN scale2 USING (g)')}))",
    ]
    last = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2, 0) <= {CUTOFF} AS kept FROM b LEFT JOIN far USING (rid)"
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + last
