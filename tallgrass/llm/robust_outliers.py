"""Quality rules: robust multivariate outliers by the minimum covariance determinant, in DataFrame operations only.

Each document's base statistics become a vector of transformed ratios. For every language and source, the share COVER of the vectors
with the least covariance determinant is sought (Rousseeuw and Van Driessen, 1999). Several deterministic starts (after Hubert,
Rousseeuw and Verdonck, 2012) go through concentration steps: mean and covariance of the h nearest vectors are estimated again, until
the determinant stops falling. The start with the least one wins; it is scaled to be consistent at the normal distribution, and the
vectors within RIM of it give the final, reweighted estimate. A document is rejected when its squared Mahalanobis distance is beyond
`cut`. If more than the rest, a quarter, of a group is bad, this shifts the estimate, and bad documents can hide. A ridge (FLOOR
squared) bounds every variance from below, so a statistic that is 0 in most documents does not make the covariance singular, nor one
symbol an outlier.

A step is one pass over a narrow table: distances are cut into BINS bins to the octave, each bin's count and sums of vectors are
mergeable, and the nearest h are whole bins and the needed share of one bin. So a group that holds a third of all rows is combined
before the shuffle, and no estimate depends on how rows are partitioned. Groups whose determinant no longer falls leave the passes.

Every group has an estimate of its own. That of fewer than `enough` vectors is shrunk towards the estimate of its language, as that is
towards the estimate of all: means and covariances are averaged with weight n / enough, which is 1 from `enough` on, so nothing jumps with
the size of a group. Column `weight` is the weight of the document's own group. All three levels are estimated together.

Defined results: a null or empty text has no words and zero statistics, fails the base rules and is not kept; null languages and sources
are groups of their own; repeated rows count each; if all texts fail the base rules no estimate is made; columns with clashing names do
not matter, as only doc_id, text, lang and source are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.shared import discard, join_small, stored

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"[\x20\x09-\x0D]+"
#: These characters count as symbols: a fixed set.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Share of a group's vectors that an estimate covers.
COVER = 0.75
#: Least standard deviation of each entry of the vector: bounds of ridge, in the units of the transformed statistics.
FLOOR = (0.05, 0.03, 0.10, 0.03)
#: Squared distance beyond which a vector is an outlier; chi2(4) exceeds it once in about 10^9.
CUT = 48.0
#: Vectors from which a group's own estimate stands alone: about twice the entries of mean and covariance.
ENOUGH = 30
#: Bins to the octave of squared distance, and of one unit of a statistic where medians are taken.
BINS = 64
MEDIAN_BINS = 1024
#: Vectors within this squared distance of the best start make the reweighted estimate: the 0.975 quantile of chi2(4).
RIM, RIM_COVER = 11.1433, 0.975
#: Smaller falls of the logarithm of the determinant count as none. Steps stop by themselves; a group that still falls after so many keeps
#: its last estimate.
STILL, MOST_STEPS = 1e-6, 200
#: The starts: scaled deviations, squashed vectors, directions only, the half nearest to the median.
STARTS = ("scale", "tanh", "sign", "half")
_VECTOR = ("x0", "x1", "x2", "x3")
_GROUP = ("level", "lang", "source")


def consistency(cover: float) -> float:
    """What the covariance of the central share of normal vectors is multiplied with: cover / P(chi2(6) <= q), q the quantile of chi2(4)."""
    lo, hi = 0.0, 100.0
    for _ in range(60):
        y = (lo + hi) / 2  # q / 2
        lo, hi = (y, hi) if 1 - math.exp(-y) * (1 + y) < cover else (lo, y)
    return cover / (1 - math.exp(-lo) * (1 + lo + lo * lo / 2))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    rows = rows.withColumn("words", F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD))
    rows = rows.withColumn("lines", lines).withColumn("n_words", F.size("words"))
    hashes = F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get("words", i - 1 + j) for j in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    # only texts with an equal pair of windows are sorted
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none))
    out = rows.select(
        "doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"), F.length(F.regexp_replace("t", _BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered("placed").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _covered(placed: str) -> Column:
    """Words under windows that occur twice or more, of (hash, place) in order: equal windows are side by side. In order of place,
    each such window adds the words from the last one's end on."""
    ahead = F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0)))
    same = F.zip_with(placed, ahead, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def vectors(stats: DataFrame) -> DataFrame:
    """stats with x0..x3: log mean word length, root of the share of symbols, log lines repeated, root of the share of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumns({
        "x0": F.log(chars / n),
        "x1": F.sqrt(F.col("n_symbols") / chars),
        "x2": F.log1p(F.col("n_dup_lines").cast("double")),
        "x3": F.sqrt(F.col("n_repeat_words") / n),
    })


def _leveled(rows: DataFrame) -> DataFrame:
    """Each row once for its language and source, once for its language, once for all."""
    null = F.lit(None).cast("string")
    spread = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), null.alias("source")),
        F.struct(F.lit(2).alias("level"), null.alias("lang"), null.alias("source")),
    )
    return rows.select(F.explode(spread).alias("g"), *_VECTOR).select("g.*", *_VECTOR)


def _median(rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """A row a group: n and the medians of the values as <name>0, <name>1, ..., to the width of a bin."""
    cells = ", ".join(f"struct({i} AS i, floor(({v}) * {MEDIAN_BINS}) AS bin)" for i, v in enumerate(values))
    counts = rows.selectExpr(*_GROUP, f"explode(array({cells})) AS c").groupBy(*_GROUP, "c.i", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as a group has bins
    part = f"PARTITION BY {', '.join(_GROUP)}, i"
    placed = counts.selectExpr("*", f"sum(n) OVER ({part} ORDER BY bin) AS to", f"sum(n) OVER ({part}) AS all").filter("2 * to >= all")
    middle = placed.groupBy(*_GROUP, "i").agg(F.min("bin").alias("bin"), F.first("all").alias("n"))
    at = [F.expr(f"max(CASE WHEN i = {i} THEN (bin + 0.5D) / {MEDIAN_BINS} END) AS {name}{i}") for i in range(len(values))]
    return middle.groupBy(*_GROUP).agg(F.max("n").alias("n"), *at)


_D = range(len(_VECTOR))
#: The entries of a symmetric matrix, row by row.
_ENTRIES = [(i, j) for i in _D for j in range(i + 1)]
_MEANS = [f"m{i}" for i in _D]
_COVS = [f"c{i}{j}" for i, j in _ENTRIES]
_ROOTS = [f"l{i}{j}" for i, j in _ENTRIES]


def _factor(estimates: DataFrame, ridge: bool = True) -> DataFrame:
    """Puts l00 .. l33 in the place of c00 .. c33: the Cholesky factor of the covariance plus ridge, one entry from those before it."""
    entries = []
    for i, j in _ENTRIES:
        rest = f"c{i}{j}" + (f" + {FLOOR[i] ** 2!r}D" if i == j and ridge else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        entries.append((f"sqrt(greatest({rest}, 1e-12D))" if i == j else f"({rest}) / l{j}{j}") + f" AS l{i}{j}")
    return estimates.selectExpr("*", *entries).drop(*_COVS)


def _with_distance(rows: DataFrame) -> DataFrame:
    """d2: forward substitution through the factor."""
    steps = [f"(x{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} AS z{i}" for i in _D]
    return rows.selectExpr("*", *steps, " + ".join(f"z{i} * z{i}" for i in _D) + " AS d2").drop(*(f"z{i}" for i in _D))


def _moments(rows: DataFrame, weight: str, scale: float) -> DataFrame:
    """m0.. and l00.. of each group and start, from rows with a count n and sums y0.., y00.. of deviations from m0.., each with a weight."""
    mean = lambda y: f"sum(({weight}) * {y}) / sum(({weight}) * n)"
    sums = [f"{mean(f'y{i}')} AS a{i}" for i in _D] + [f"{mean(f'y{i}{j}')} AS a{i}{j}" for i, j in _ENTRIES]
    out = rows.groupBy(*_GROUP, "start").agg(*(F.first(m).alias(m) for m in _MEANS), *map(F.expr, sums))
    # the last digits depend on the order of adding
    covs = [f"round((a{i}{j} - a{i} * a{j}) * {scale!r}D, 11) AS c{i}{j}" for i, j in _ENTRIES]
    return _factor(out.selectExpr(*_GROUP, "start", *(f"round(m{i} + a{i}, 11) AS m{i}" for i in _D), *covs))


_LOG_DET = "2 * (" + " + ".join(f"ln(l{i}{i})" for i in _D) + ")"


def _binned(rows: DataFrame, bin_of: str) -> DataFrame:
    """Counts and sums of deviations by group, start and bin."""
    sums = [f"sum(x{i} - m{i}) AS y{i}" for i in _D] + [f"sum((x{i} - m{i}) * (x{j} - m{j})) AS y{i}{j}" for i, j in _ENTRIES]
    keep = [F.first(m).alias(m) for m in _MEANS]
    return rows.selectExpr("*", f"{bin_of} AS bin").groupBy(*_GROUP, "start", "bin").agg(F.count(F.lit(1)).alias("n"), *keep, *map(F.expr, sums))


def _distances(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """rows with each start's estimate of their group and the distance from it; groups without an estimate are left out."""
    packed = estimates.groupBy(*_GROUP).agg(F.collect_list(F.struct("start", *_MEANS, *_ROOTS)).alias("of"))  # a few starts
    met = join_small(rows, packed, list(_GROUP), groups)
    return _with_distance(met.select(*_GROUP, *_VECTOR, F.inline("of")))


def _nearest(far: DataFrame, cover: float) -> DataFrame:
    """The estimate from the share `cover` of each group and start with the least d2: whole bins, and of one bin a share."""
    bins = _binned(far, f"floor(log2(d2 + {2.0**-20!r}D) * {BINS})")
    part = f"PARTITION BY {', '.join(_GROUP)}, start"
    bins = bins.selectExpr("*", f"sum(n) OVER ({part} ORDER BY bin) - n AS before", f"sum(n) OVER ({part}) AS all")
    return _moments(bins, f"greatest(0D, least(1D, (ceil(all * {cover!r}D) - before) / n))", 1.0)


def _starts(rows: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """The size of each group, and its first estimates. All are of z, the vector from the median in units of the scaled absolute
    deviations: the identity, the covariance of tanh(z), that of z / |z|, and that of the half with the least |z|."""
    sizes = stored(_median(rows, list(_VECTOR), "m"), "medians")
    off = _median(join_small(rows, sizes, list(_GROUP), groups), [f"abs(x{i} - m{i})" for i in _D], "s")
    unit = join_small(sizes, off.drop("n"), list(_GROUP), groups)
    unit = stored(unit.selectExpr(*_GROUP, "n", *_MEANS, *(f"sqrt(pow(1.4826D * s{i}, 2) + {FLOOR[i] ** 2!r}D) AS s{i}" for i in _D)), "units")
    z = join_small(rows, unit.drop("n"), list(_GROUP), groups).selectExpr("*", *(f"(x{i} - m{i}) / s{i} AS z{i}" for i in _D))
    z = z.selectExpr("*", "sqrt(greatest(" + " + ".join(f"z{i} * z{i}" for i in _D) + ", 1e-24D)) AS size")
    tanh = [f"avg(tanh(z{i}) * tanh(z{j})) AS tanh{i}{j}" for i, j in _ENTRIES]
    sign = [f"avg(z{i} * z{j} / (size * size)) * {len(_VECTOR)} AS sign{i}{j}" for i, j in _ENTRIES]
    met = join_small(unit, z.groupBy(*_GROUP).agg(*map(F.expr, tanh + sign)), list(_GROUP), groups)
    kinds = []
    for name in STARTS[:3]:
        covs = [f"round({f'{name}{i}{j}' if name != 'scale' else float(i == j)} * s{i} * s{j}, 11) AS c{i}{j}" for i, j in _ENTRIES]
        kinds.append(f"struct('{name}' AS start, {', '.join(covs)})")
    found = met.selectExpr(*_GROUP, *_MEANS, f"inline(array({', '.join(kinds)}))").select(*_GROUP, "start", *_MEANS, *_COVS)
    half = _nearest(z.selectExpr(*_GROUP, "'half' AS start", *_VECTOR, *_MEANS, "size * size AS d2"), 0.5)
    return sizes.select(*_GROUP, "n"), _factor(found).unionByName(half)


def raw_estimate(rows: DataFrame, groups: int, first: DataFrame, cover: float = COVER) -> DataFrame:
    """level, lang, source, start, m0.., l00.., log_det: each start's estimate when its determinant no longer falls."""
    key, values = [*_GROUP, "start"], [*_MEANS, *_ROOTS, "log_det"]
    now = stored(first.selectExpr(*key, *_MEANS, *_ROOTS, "double('inf') AS log_det", "false AS still"), "estimates")
    for _ in range(MOST_STEPS):
        new = _nearest(_distances(rows, now.filter("NOT still"), groups), cover).selectExpr(*key, *_MEANS, *_ROOTS, f"{_LOG_DET} AS log_det")
        both = now.alias("old").join(new.alias("new"), F.expr(" AND ".join(f"old.{c} <=> new.{c}" for c in key)), "left")
        fell = f"coalesce(new.log_det < old.log_det - {STILL!r}D, false)"
        step = both.selectExpr(*(f"old.{c}" for c in key), *(f"CASE WHEN {fell} THEN new.{c} ELSE old.{c} END AS {c}" for c in values), f"NOT {fell} AS still")
        before, now = now, stored(step, "estimates")
        discard(before)
        if now.filter("NOT still").isEmpty():
            break
    return now.drop("still")


def estimate(stats: DataFrame, cover: float = COVER) -> DataFrame:
    """level, lang, source, n, m0.. and l00..: one row a group. stats(lang, source, x0..x3): the rows to estimate from."""
    rows = stored(_leveled(stats), "leveled")
    groups = rows.select(*_GROUP).distinct().count()
    sizes, first = _starts(rows, groups)
    found = raw_estimate(rows, groups, first, cover)
    w = Window.partitionBy(*_GROUP).orderBy(F.round("log_det", 4), "start")
    best = found.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place", "log_det")
    # the raw estimate made consistent: its factor grows by a root
    grown = best.selectExpr(*_GROUP, "start", *_MEANS, *(f"{c} * {consistency(cover) ** 0.5!r}D AS {c}" for c in _ROOTS))
    near = _distances(rows, stored(grown, "raw"), groups).filter(F.col("d2") <= RIM)
    final = _moments(_binned(near, "0"), "1D", consistency(RIM_COVER)).drop("start")
    return join_small(final, sizes, list(_GROUP), groups)


def _shrunk(own: DataFrame, parent: DataFrame, keys: list[str], groups: int, enough: int) -> DataFrame:
    """own(keys.., n, m0.., l00..) with the averages of mean and covariance of own and parent(keys.., m0.., l00..), by the weight n / enough."""
    met = join_small(own.withColumn("w", F.least(F.lit(1.0), F.col("n") / F.lit(float(enough)))), parent.withColumnsRenamed({c: f"p_{c}" for c in (*_MEANS, *_ROOTS)}), keys, groups)
    square = lambda p, i, j: " + ".join(f"{p}l{i}{k} * {p}l{j}{k}" for k in range(j + 1))
    mean = [f"w * m{i} + (1 - w) * p_m{i} AS m{i}" for i in _D]
    covs = [f"w * ({square('', i, j)}) + (1 - w) * ({square('p_', i, j)}) AS c{i}{j}" for i, j in _ENTRIES]  # both with their ridge
    names = [c for c in own.columns if c not in (*_MEANS, *_ROOTS)]
    return _factor(met.selectExpr(*names, "w AS weight", *mean, *covs), ridge=False)


def judge(docs: DataFrame, cut: float = CUT, enough: int = ENOUGH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2 and weight (both null where
    base_failed): the squared distance from the estimate of the document's language and source, and that estimate's own part in it."""
    stats = stored(vectors(base_statistics(docs)), "statistics")
    found = stored(estimate(stats.filter(~F.col("base_failed"))), "group-estimates")
    groups = found.count()
    level = lambda k: found.filter(F.col("level") == k)
    every = level(2).select(F.lit(0).alias("k"), *_MEANS, *_ROOTS)
    by_lang = _shrunk(level(1).select("lang", F.lit(0).alias("k"), "n", *_MEANS, *_ROOTS), every, ["k"], 1, enough)
    own = _shrunk(level(0).select("lang", "source", "n", *_MEANS, *_ROOTS), by_lang.select("lang", *_MEANS, *_ROOTS), ["lang"], groups, enough)
    own = stored(own.select("lang", "source", "weight", *_MEANS, *_ROOTS), "shrunk-estimates")
    rows = _with_distance(join_small(stats, own, ["lang", "source"]))
    kept = ~F.col("base_failed") & (F.col("d2") <= cut)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"),
        F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"), F.when(~F.col("base_failed"), F.col("weight")).alias("weight"),
    )
