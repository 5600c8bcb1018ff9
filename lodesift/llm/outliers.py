"""Quality rules: robust multivariate outliers within each language and source.

Every whole text becomes counts (words, symbols, repeated lines and windows) and
a vector of transformed rates.  Within a group of one language and source the
minimum-covariance-determinant method finds the mean and covariance of the ``H``
share of rows that lie closest together; rows far from them by Mahalanobis
distance are rejected.

Concentration steps are Spark jobs over a narrow table of vectors: one pass counts
distances in fine bins, which gives the radius that holds the wanted share, and
one sums the moments of the rows inside it.  Several deterministic starts run
side by side; the one of least determinant wins.  All rows take part.  Vectors
lie on a grid, so sums are exact and no result depends on how rows are dealt to
tasks.  Only estimates, a row per group, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .packed import runs
from .words import Texts, slices, span_hashes, windows, word_hashes, words_of

#: Rules before the estimate: fewest words, and largest percentage of words in repeated windows.
LEAST_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 20, 8, 30
#: Share of a group that the estimate rests on, concentration steps for all starts and then for the best one.
H, FIRST_STEPS, MORE_STEPS = 0.7, 2, 6
#: Rows that a group needs for an estimate of its own; smaller ones take that of their language, then that of all rows.
LEAST_ROWS = 200
#: Chance that a regular vector is rejected.
REJECT = 1e-8
#: Words at which the noise of a rate weighs as much as the differences between texts.
NOISE_WORDS = 60
#: Bytes of estimates in a task; more groups are fitted in several rounds.
ESTIMATE_BYTES = 64 << 20
_GRID = 1024.0
_BINS_PER_OCTAVE = 32

#: The rates, and the least spread of each that counts as a difference.
FEATURES = {
    "word_length": 0.05, "symbols": 0.04, "digits": 0.04, "capitals": 0.04, "marks": 0.04, "breaks": 0.04,
    "repeated_lines": 0.08, "repeated_words": 0.08, "distinct_words": 0.03,
}

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_MARK = np.isin(np.arange(256), [ord(c) for c in "!?.,;:()[]{}\"'/\\=+-_~^@`"])
_LETTER = ~np.isin(np.arange(256), [*range(0, 65), *range(91, 97), *range(123, 128)])
_LINE = np.isin(np.arange(256), [10])
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Set flags between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated_lines(texts: Texts, words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = words_of(texts, _LINE)  # an empty line has no word
    has = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    h = span_hashes(texts.data, lines.starts, lines.ends)[has]
    owner = lines.text_of()[has]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=texts.count)


def _repeated_words(hashes: np.ndarray, words) -> np.ndarray:
    """Words in windows that occur more than once in their text."""
    one, two, at = windows(hashes, words, REPEAT_WORDS)
    owner = words.text_of()[at]
    order = np.lexsort((two, one, owner))
    begins = runs(owner[order], one[order], two[order])
    times = np.diff(np.append(begins, len(order)))
    again = np.repeat(times > 1, times)
    first = at[order[again]]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + REPEAT_WORDS, -1)
    return _sums(np.cumsum(change[:-1]) > 0, words.first)


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts that rules and rates rest on, for every text."""
    words = words_of(texts)
    hashes = word_hashes(texts, words)
    data, owner = texts.data, words.text_of()
    of_text = np.concatenate(([0], np.cumsum(_STARTS_CHARACTER[data], dtype=np.int64)))
    order = np.lexsort((hashes, owner))
    distinct = np.bincount(owner[order][runs(owner[order], hashes[order])], minlength=texts.count)
    lines = words_of(texts, _LINE)
    return {
        "n_words": words.counts,
        "word_chars": _sums_of(of_text[words.ends] - of_text[words.starts], words.first),
        "n_symbols": _sums(_SYMBOL[data], texts.offsets), "n_dup_lines": _repeated_lines(texts, words),
        "n_repeat_words": _repeated_words(hashes, words), "digits": _sums(_DIGIT[data], texts.offsets),
        "capitals": _sums(_CAPITAL[data], texts.offsets), "letters": _sums(_LETTER[data] & _STARTS_CHARACTER[data], texts.offsets),
        "marks": _sums(_MARK[data], texts.offsets), "lines": lines.counts, "distinct": distinct,
    }


def _sums_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed rates of texts with at least a word: roots of shares, whose noise hardly depends on their size, and logarithms."""
    n = np.maximum(c["n_words"], 1).astype(np.float64)
    letters, chars = np.maximum(c["letters"], 1), np.maximum(c["word_chars"], 1)
    root = lambda part, whole: np.sqrt(np.minimum(part / whole, 4.0))
    columns = [
        np.log(chars / n), root(c["n_symbols"], n), root(c["digits"], chars), root(c["capitals"], letters), root(c["marks"], chars),
        root(np.maximum(c["lines"] - 1, 0), n), root(c["n_dup_lines"], np.maximum(c["lines"], 1)), root(c["n_repeat_words"], n),
        # A text of n words in a language has about n**0.9 different ones.
        np.log(np.maximum(c["distinct"], 1)) / np.maximum(np.log(n), 1.0),
    ]
    return np.round(np.column_stack(columns) * _GRID) / _GRID


# ---------------------------------------------------------------------------
# Distances, radii and moments
# ---------------------------------------------------------------------------

def chi_square(x: float, d: int) -> float:
    """Probability that a chi-square variable of ``d`` degrees of freedom is at most ``x``."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * exp(a * log(x) - x - lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, d) < p and high < 1e4:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return high


def consistency(share: float, d: int) -> float:
    """What the covariance of the closest ``share`` of normal rows has to be multiplied by."""
    if share >= 1:
        return 1.0
    return share / max(chi_square(chi_square_quantile(share, d), d + 2), 1e-12)


def whitening(scatter: np.ndarray) -> np.ndarray:
    """The matrix that turns deviations into vectors of Mahalanobis length; features differ by their least spread at least."""
    return np.linalg.inv(np.linalg.cholesky(scatter + np.diag(np.square(list(FEATURES.values())))))


def log_determinant(scatter: np.ndarray) -> float:
    return float(np.linalg.slogdet(scatter + np.diag(np.square(list(FEATURES.values()))))[1])


def distance_bins(squared: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(squared, 1e-12)) * _BINS_PER_OCTAVE).astype(np.int64)


def centred(x: np.ndarray, n_words: np.ndarray, median: np.ndarray) -> np.ndarray:
    """Deviations from the group's median; those of short texts shrink by the share of noise in them."""
    shrink = np.sqrt(n_words / (n_words + NOISE_WORDS))[:, None]
    return np.round((x - median) * shrink * _GRID) / _GRID


@dataclass
class Estimates:
    """For each of some groups: medians, and for each start a centre and a whitening matrix."""

    keys: dict[str, int]
    median: np.ndarray  # groups x features
    centre: np.ndarray  # groups x starts x features
    white: np.ndarray  # groups x starts x features x features
    limit: np.ndarray  # groups x starts: last bin inside


def squared_distances(e: tuple, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """rows x starts"""
    _, centre, white, _ = e
    apart = np.einsum("nsij,nsj->nsi", white[codes], y[:, None, :] - centre[codes])
    return np.square(apart).sum(2)


def _codes(column: pa.Array, keys: dict[str, int]) -> np.ndarray:
    coded = column.dictionary_encode()
    return np.array([keys[k] for k in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


_D = len(FEATURES)
_UPPER = np.triu_indices(_D)
_MOMENTS = "g int, s int, n long, " + ", ".join(f"m{j} double" for j in range(_D + len(_UPPER[0])))


def _moment_rows(groups: np.ndarray, starts: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Counts, sums and sums of products of ``values`` by (group, start)."""
    key = groups * 4 + starts
    found, at = np.unique(key, return_inverse=True)
    columns = [values[:, j] for j in range(_D)] + [values[:, i] * values[:, j] for i, j in zip(*_UPPER)]
    sums = [np.bincount(at, c, len(found)) for c in columns]
    n = np.bincount(at, minlength=len(found))
    return pa.RecordBatch.from_arrays(
        [pa.array((found // 4).astype(np.int32)), pa.array((found % 4).astype(np.int32)), pa.array(n.astype(np.int64)), *map(pa.array, sums)],
        names=["g", "s", "n", *(f"m{j}" for j in range(len(sums)))])


def _merged(moments: list[pa.RecordBatch]) -> pa.Table:
    """Moment rows of a task with one row for each (group, start)."""
    table = pa.Table.from_batches(moments).combine_chunks()
    found, at = np.unique(table["g"].to_numpy().astype(np.int64) * 4 + table["s"].to_numpy(), return_inverse=True)
    sums = [np.bincount(at, table[f"m{j}"].to_numpy(), len(found)) for j in range(_D + len(_UPPER[0]))]
    n = np.bincount(at, table["n"].to_numpy(), len(found)).astype(np.int64)
    return pa.table({"g": (found // 4).astype(np.int32), "s": (found % 4).astype(np.int32), "n": n} | {f"m{j}": v for j, v in enumerate(sums)})


def _gathered(rows: DataFrame, groups: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and covariances from the moment rows of all tasks."""
    table = rows.groupBy("g", "s").agg(F.sum("n").alias("n"), *[F.sum(f"m{j}").alias(f"m{j}") for j in range(_D + len(_UPPER[0]))]).toArrow()
    n = np.zeros((groups, starts))
    mean, scatter = np.zeros((groups, starts, _D)), np.zeros((groups, starts, _D, _D))
    g, s = table["g"].to_numpy(), table["s"].to_numpy()
    n[g, s] = table["n"].to_numpy()
    sums = np.column_stack([table[f"m{j}"].to_numpy() for j in range(_D + len(_UPPER[0]))]) / n[g, s][:, None]
    mean[g, s] = sums[:, :_D]
    for k, (i, j) in enumerate(zip(*_UPPER)):
        scatter[g, s, i, j] = scatter[g, s, j, i] = sums[:, _D + k] - sums[:, i] * sums[:, j]
    return n, mean, scatter


class Fit:
    """Concentration steps over stored rows (key, y)."""

    def __init__(self, rows: DataFrame, keys: dict[str, int], totals: np.ndarray):
        self.rows, self.keys, self.totals, self.context = rows, keys, totals, rows.sparkSession.sparkContext

    def first(self, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centres and whitening matrices of three starts: spreads alone, and covariances of squashed vectors and of directions."""
        shared = self.context.broadcast((self.keys, scale))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, scale = shared.value
            found = []
            for batch in batches:
                if batch.num_rows:
                    codes = _codes(batch.column(0), keys)
                    z = _lists(batch.column(1)) / scale[codes]
                    length = np.sqrt(np.square(z).sum(1, keepdims=True))
                    for start, v in ((1, np.tanh(z)), (2, z / np.maximum(length, 1e-9))):
                        found.append(_moment_rows(codes, np.full(len(v), start), np.round(v * 2**20) / 2**20))
            if found:
                yield from _merged(found).to_batches()

        _, _, scatter = _gathered(self.rows.mapInArrow(run, _MOMENTS), len(self.keys), 3)
        white = np.zeros((len(self.keys), 3, _D, _D))
        for g in range(len(self.keys)):
            white[g, 0] = np.diag(1 / scale[g])
            for start in (1, 2):
                spread = np.sqrt(np.maximum(np.diag(scatter[g, start]), 1e-6))
                alike = scatter[g, start] / spread[:, None] / spread
                np.fill_diagonal(alike, 1.0)
                white[g, start] = whitening(scale[g][:, None] * alike * scale[g])
        return np.zeros((len(self.keys), 3, _D)), white

    def radius(self, centre: np.ndarray, white: np.ndarray) -> np.ndarray:
        """The last bin of each (group, start) with which the wanted share of rows is inside."""
        shared = self.context.broadcast((self.keys, centre, white, None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple, int] = {}
            for batch in batches:
                if batch.num_rows:
                    codes = _codes(batch.column(0), shared.value[0])
                    bins = distance_bins(squared_distances(shared.value, codes, _lists(batch.column(1))))
                    for start in range(bins.shape[1]):
                        cells, n = np.unique(np.column_stack((codes, bins[:, start])), axis=0, return_counts=True)
                        for (g, b), count in zip(cells.tolist(), n.tolist()):
                            seen[g, start, b] = seen.get((g, start, b), 0) + count
            if seen:
                g, s, b = (np.array(x) for x in zip(*seen))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(b), pa.array(np.array(list(seen.values()), np.int64))], names=["g", "s", "bin", "n"])

        counted = self.rows.mapInArrow(run, "g int, s int, bin long, n long").groupBy("g", "s", "bin").agg(F.sum("n").alias("n"))
        by = F.sort_array(F.collect_list(F.struct("bin", "n")))
        table = counted.groupBy("g", "s").agg(by.alias("bins")).toArrow()
        limit = np.zeros(centre.shape[:2], np.int64)
        for g, s, bins in zip(*(table[c].to_pylist() for c in ("g", "s", "bins"))):
            wanted, inside = ceil(H * self.totals[g]), 0
            for cell in bins:
                inside += cell["n"]
                if inside >= wanted:
                    limit[g, s] = cell["bin"]
                    break
        return limit

    def moments(self, centre: np.ndarray, white: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, means and covariances of the rows whose bin is at most ``limit``."""
        shared = self.context.broadcast((self.keys, centre, white, limit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for batch in batches:
                if batch.num_rows:
                    keys, limit = shared.value[0], shared.value[3]
                    codes, y = _codes(batch.column(0), keys), _lists(batch.column(1))
                    row, start = np.nonzero(distance_bins(squared_distances(shared.value, codes, y)) <= limit[codes])
                    found.append(_moment_rows(codes[row], start, y[row]))
            if found:
                yield from _merged(found).to_batches()

        return _gathered(self.rows.mapInArrow(run, _MOMENTS), len(self.keys), centre.shape[1])

    def estimate(self, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre and whitening matrix of every group: the best start, concentrated, made consistent and reweighted."""
        centre, white = self.first(scale)
        groups, one = np.arange(len(self.keys)), slice(None)
        share = np.ones(len(self.keys))
        before = None
        for step in range(FIRST_STEPS + MORE_STEPS):
            n, centre, scatter = self.moments(centre, white, self.radius(centre, white))
            white = np.array([[whitening(x) for x in of_group] for of_group in scatter])
            if step == FIRST_STEPS - 1:
                volume = np.array([[log_determinant(x) for x in of_group] for of_group in scatter])
                best = volume.argmin(1)
                n, centre, white, scatter = (x[groups, best][:, None] for x in (n, centre, white, scatter))
            if step >= FIRST_STEPS and before is not None and np.array_equal(before, scatter):
                break
            before = scatter
        share = n[one, 0] / self.totals
        white = np.array([[whitening(scatter[g, 0] * consistency(share[g], _D))] for g in groups])
        inside = distance_bins(np.array([chi_square_quantile(0.975, _D)]))[0]
        _, centre, scatter = self.moments(centre, white, np.full((len(self.keys), 1), inside))
        white = np.array([whitening(scatter[g, 0] * consistency(0.975, _D)) for g in groups])
        return centre[:, 0], white


# ---------------------------------------------------------------------------
# The rule over a table
# ---------------------------------------------------------------------------

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, own, language, counts, base_failed, x): the counts and rates of every text, without the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch):
                c = text_counts(texts)
                failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
                x = rates(c)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * _D
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:3], *(pa.array(c[n].astype(np.int64)) for n in _COUNTS), pa.array(failed), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))],
                    names=["doc_id", "own", "language", *_COUNTS, "base_failed", "x"])

    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("own "), part("lang"), F.lit("\n"), part("source")).alias("own"),
        F.concat(F.lit("lang "), part("lang")).alias("language"), F.col("text").alias("text"))
    return named.mapInArrow(run, f"doc_id long, own string, language string, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, x array<double>")


def _plan(rows: DataFrame) -> DataFrame:
    """(own, key, feeds): which estimate judges a group, and which estimates its rows feed."""
    sizes = materialise(rows.filter("NOT base_failed").groupBy("own", "language").agg(F.count(F.lit(1)).alias("n")), "sizes")
    languages = sizes.groupBy("language").agg(F.sum("n").alias("of_language"), F.min("n").alias("least"))
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    enough = F.when(F.lit(total >= 5 * _D), F.lit("all"))
    key = F.when(F.col("n") >= LEAST_ROWS, F.col("own")).when(F.col("of_language") >= LEAST_ROWS, F.col("language")).otherwise(enough)
    plan = sizes.join(languages, "language").withColumn("key", key).withColumn("for_language", (F.col("least") < LEAST_ROWS) & (F.col("of_language") >= LEAST_ROWS))
    plan = materialise(plan, "groups")
    for_all = not plan.filter("key = 'all'").isEmpty()
    feeds = F.array(F.when(F.col("n") >= LEAST_ROWS, F.col("own")), F.when(F.col("for_language"), F.col("language")), F.lit("all") if for_all else F.lit(None).cast("string"))
    return plan.select("own", "key", F.array_compact(feeds).alias("feeds"))


def _fitted(rows: DataFrame, keys: list[tuple[str, int]]) -> Estimates:
    """Estimates of the groups ``keys`` (key, rows) from rows (key, n_words, x)."""
    number = {k: n for n, (k, _) in enumerate(sorted(keys))}
    totals = np.array([n for _, n in sorted(keys)], np.float64)

    def medians(df: DataFrame, column: str, value=lambda c: c) -> np.ndarray:
        table = df.groupBy("key").agg(*[F.percentile(value(F.col(column)[j]), F.lit(0.5)).alias(f"m{j}") for j in range(_D)]).toArrow()
        found = np.zeros((len(number), _D))
        found[[number[k] for k in table["key"].to_pylist()]] = np.column_stack([table[f"m{j}"].to_numpy() for j in range(_D)])
        return found

    median = medians(rows, "x")
    shared = rows.sparkSession.sparkContext.broadcast((number, median))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, median = shared.value
        for batch in batches:
            if batch.num_rows:
                y = centred(_lists(batch.column(2)), batch.column(1).to_numpy(), median[_codes(batch.column(0), number)])
                offsets = np.arange(len(y) + 1, dtype=np.int32) * _D
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], names=["key", "y"])

    deviations = materialise(rows.select("key", "n_words", "x").mapInArrow(run, "key string, y array<double>"), "deviations")
    scale = np.maximum(1.4826 * medians(deviations, "y", F.abs), list(FEATURES.values()))
    centre, white = Fit(deviations, number, totals).estimate(scale)
    return Estimates(number, median, centre[:, None], white[:, None], np.zeros((len(number), 1)))


def judged(rows: DataFrame) -> DataFrame:
    """Rows of :func:`counted` with ``distance`` (Mahalanobis; null without an estimate) and ``kept``."""
    rows = materialise(rows, "counts")
    plan = materialise(_plan(rows), "plan")
    sizes = rows.filter("NOT base_failed").join(plan, "own").select(F.explode("feeds").alias("key"), "n_words", "x")
    names = materialise(sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    rounds = max(1, ceil(names.count() * 3 * 8 * (_D + 1) * _D / ESTIMATE_BYTES))
    turn = F.pmod(F.xxhash64("key"), F.lit(rounds))
    named = rows.join(plan.select("own", "key"), "own", "left")
    cutoff = chi_square_quantile(1 - REJECT, _D)
    schema = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, distance double, kept boolean"
    columns = ["doc_id", *_COUNTS, "base_failed"]
    unjudged = named.filter("key IS NULL").select(*columns, F.lit(None).cast("double").alias("distance"), (~F.col("base_failed")).alias("kept"))
    out = unjudged
    for n in range(rounds):
        keys = [(r["key"], r["n"]) for r in names.filter(turn == n).collect()]
        if not keys:
            continue
        fit = _fitted(materialise(sizes.filter(turn == n), "fit"), keys)
        # Plain arrays: a class of this package would have to be installed on the workers.
        shared = rows.sparkSession.sparkContext.broadcast((fit.keys, fit.median, fit.centre, fit.white, fit.limit))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            e = Estimates(*shared.value)
            for batch in batches:
                if batch.num_rows:
                    codes = _codes(batch.column(7), e.keys)
                    y = centred(_lists(batch.column(8)), batch.column(1).to_numpy(), e.median[codes])
                    squared = squared_distances((None, e.centre, e.white, None), codes, y)[:, 0]
                    failed = batch.column(6).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:7], pa.array(np.sqrt(squared)), pa.array(~failed & (squared <= cutoff))], names=[*columns, "distance", "kept"])

        out = out.unionByName(named.filter(F.col("key").isNotNull() & (turn == n)).select(*columns, "key", "x").mapInArrow(run, schema))
    return out


def quality(docs: DataFrame) -> DataFrame:
    """Counts, base rules and verdict for every document (doc_id, text, lang, source).

    A null or empty text has no words and fails the base rules.  Null languages
    and sources are groups of their own; repeated rows are judged alike.  Groups
    under ``LEAST_ROWS`` are judged by their language, then by all rows; with
    fewer than five rows for each rate only the base rules decide.  Other columns
    are ignored; an empty table gives none.
    """
    return judged(counted(docs))
