"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned and weighted lexicon, how near
its words stand to second-person words, rates of capitals, of punctuation and of
obfuscated spellings.  The lexicon are the words that labelled toxic texts use
significantly more often, besides common insults.  Lexicon, trees and calibration
learn from different parts of the labelled rows.  At most about ``TRAIN_ROWS`` labelled rows
are used, picked by a hash of the id; every document is scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialise
from .language import remainder
from .words import Texts, Words, slices, span_hashes, words_of

TRAIN_ROWS = 40_000
#: Words of the lexicon at most, and the significance each needs.
LEXICON_WORDS, LEXICON_Z = 1000, 3.0
TREES, DEPTH, STEP = 25, 4, 0.3
THRESHOLD = 0.3
#: Words that begin alike are also looked up as one entry of the lexicon.
STEM = 5

#: Second-person words of the corpus languages.
SECOND_PERSON = """
you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure
tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro
""".split()
#: Common insults, in the lexicon whatever the labels say, with the weight of one that no label has shown.
INSULTS = """
idiot idiots idiotic moron morons stupid stupidity dumb dumbass fool fools loser losers pathetic worthless scum trash
garbage clown clowns disgusting filth filthy vermin ugly imbecile cretin jerk asshole bastard bitch shit crap fuck
fucking retard retarded coward liar hate dummkopf trottel abschaum wertlos schwachkopf arschloch dreckig hasse
imbecile idiote connard salaud ordure minable inutile stupide merde abruti imbecil estupido basura asqueroso inutil
""".split()
INSULT_WEIGHT = 3.0
#: Characters that stand for letters in disguised spellings.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = [
    "log_words", "lexicon_density", "lexicon_weight_density", "log_lexicon_words", "log_lexicon_weight", "largest_weight",
    "second_person_density", "nearest_second_person", "near_second_person", "capital_letters", "capital_words",
    "exclamations", "punctuation", "obfuscated_words", "obfuscated_lexicon",
]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STAND_IN = np.zeros(256, bool)
_STAND_IN[[ord(c) for c in DISGUISE] + [ord("*")]] = True
_BREAK = ~(_LETTER | _STAND_IN | np.isin(np.arange(256), [*range(48, 58), 39]))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_PLAIN = np.arange(256, dtype=np.uint8)
for _c, _to in DISGUISE.items():
    _PLAIN[ord(_c)] = ord(_to)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive positions of ``first``."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


@dataclass
class _Spans:
    words: Words
    raw: np.ndarray  # hash as written, lower case
    plain: np.ndarray  # hash with stand-ins read as letters
    stem: np.ndarray  # hash of the first STEM bytes of that, apart from those of whole words
    mixed: np.ndarray  # letters and stand-ins in one word


def _spans(texts: Texts) -> _Spans:
    """Words without the punctuation around them."""
    words = words_of(texts, _BREAK)
    low = texts.lowered()
    letters = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))
    stands = np.concatenate(([0], np.cumsum(_STAND_IN[texts.data])))
    # A stand-in at the end of a word is punctuation: "idiot!!".
    ends = words.ends.copy()
    for _ in range(3):
        trim = (ends - words.starts > 1) & np.isin(texts.data[ends - 1], [33, 39, 42])
        ends -= trim
    mixed = (letters[ends] > letters[words.starts]) & (stands[ends] > stands[words.starts])
    raw = span_hashes(low.data, words.starts, ends)
    plain = raw
    if mixed.any():
        plain = raw.copy()
        plain[mixed] = span_hashes(_PLAIN[low.data], words.starts[mixed], ends[mixed])
    stem = span_hashes(_PLAIN[low.data] if mixed.any() else low.data, words.starts, np.minimum(ends, words.starts + STEM)) ^ np.uint64(1)
    return _Spans(words, raw, plain, stem, mixed)


def _hashes(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(span_hashes(np.frombuffer(data, np.uint8), np.concatenate(([0], ends[:-1])), ends))


@dataclass
class Lexicon:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Words that rows (text, toxic) with toxic = 1 use more, with their log odds ratio."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for piece, texts in slices(batch):
                spans = _spans(texts)
                toxic = piece.column(piece.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
                owner = spans.words.text_of()
                pairs = np.unique(np.rec.fromarrays((np.tile(owner, 2), np.concatenate((spans.plain, spans.stem)))))
                hashes, at = np.unique(pairs.f1, return_inverse=True)
                one = toxic[pairs.f0] == 1
                found.append((hashes, np.bincount(at, one, len(hashes)), np.bincount(at, ~one, len(hashes))))
        if found:
            hashes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            counts = [np.bincount(at, np.concatenate([f[k] for f in found]), len(hashes)).astype(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *map(pa.array, counts)], names=["word", "bad", "good"])

    sizes = labelled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = float(sizes["bad"] or 0), float(sizes["good"] or 0)
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (F.lit(bad) - F.col("bad") + 0.5)) - F.log(b / (F.lit(good) - F.col("good") + 0.5))
    spread = F.sqrt(1 / a + 1 / b + 1 / (F.lit(bad) - F.col("bad") + 0.5) + 1 / (F.lit(good) - F.col("good") + 0.5))
    words = labelled.mapInArrow(run, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    picked = words.select("word", odds.alias("weight"), (odds / spread).alias("z")).filter(F.col("z") >= LEXICON_Z)
    rows = picked.orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()
    known = {h: INSULT_WEIGHT for h in _hashes(sorted(set(INSULTS))).view(np.int64).tolist()}
    known |= {r["word"]: r["weight"] for r in rows}
    hashes, weights = np.array(list(known), np.int64).view(np.uint64), np.array(list(known.values()))
    order = np.argsort(hashes)
    return Lexicon(hashes[order], weights[order])


def text_features(texts: Texts, lexicon: Lexicon) -> np.ndarray:
    """The values of ``FEATURES`` for every text; all zero for an empty one."""
    spans = _spans(texts)
    words, n = spans.words, spans.words.counts
    most = np.maximum(n, 1)
    weight = np.zeros(len(spans.plain))
    for entry in (spans.plain, spans.stem):
        place = np.minimum(np.searchsorted(lexicon.words, entry), len(lexicon.words) - 1)
        weight = np.maximum(weight, np.where(lexicon.words[place] == entry, lexicon.weights[place], 0.0))
    hit = weight > 0
    you = np.isin(spans.raw, _YOU)
    owner = words.text_of()
    # Distance in words from every hit to the nearest second-person word of its text.
    near = np.zeros(len(hit))
    if hit.any() and you.any():
        at, spots = np.flatnonzero(hit), np.flatnonzero(you)
        right = np.searchsorted(spots, at)
        for side in (np.maximum(right - 1, 0), np.minimum(right, len(spots) - 1)):
            same = owner[spots[side]] == owner[at]
            near[at] = np.maximum(near[at], np.where(same, 1.0 / np.maximum(np.abs(spots[side] - at), 1), 0.0))
    filled = np.flatnonzero(n)
    largest, nearest = np.zeros(texts.count), np.zeros(texts.count)
    if len(filled):
        largest[filled] = np.maximum.reduceat(weight, words.first[:-1][filled])
        nearest[filled] = np.maximum.reduceat(near, words.first[:-1][filled])
    letters = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))
    upper = np.concatenate(([0], np.cumsum(_UPPER[texts.data])))
    loud = (upper[words.ends] - upper[words.starts] == words.ends - words.starts) & (words.ends - words.starts > 1)
    size = np.maximum(np.diff(texts.offsets), 1)
    signs = ~(_LETTER | _SPACE | np.isin(np.arange(256), np.arange(48, 58)))
    return np.column_stack([
        np.log1p(n), _sums(hit, words.first) / most, _sums(weight, words.first) / most,
        np.log1p(_sums(hit, words.first)), np.log1p(_sums(weight, words.first)), largest,
        _sums(you, words.first) / most, nearest, _sums(near, words.first) / most,
        _sums(_UPPER[texts.data], texts.offsets) / np.maximum(letters[texts.offsets[1:]] - letters[texts.offsets[:-1]], 1),
        _sums(loud, words.first) / most, _sums(texts.data == 33, texts.offsets) / size, _sums(signs[texts.data], texts.offsets) / size,
        _sums(spans.mixed, words.first) / most, _sums(spans.mixed & hit, words.first) / most,
    ])


_YOU = _hashes(SECOND_PERSON)


def features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``features`` in place of the text column."""
    schema = T.StructType([*docs.drop(text).schema.fields, T.StructField("features", T.ArrayType(T.DoubleType(), False), False)])
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, text):
                values = text_features(texts, lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in keep), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


class Scorer:
    """A fitted model: :meth:`transform` turns a ``features`` column into ``score``."""

    def __init__(self, lexicon: Lexicon, trees=None, curve=None, share: float = 0.0):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            return rows.drop("features").withColumn("score", F.lit(self.share))
        raw = _probability(self.trees, rows)
        if self.curve is None:
            return raw.withColumnRenamed("probability_1", "score")
        done = self.curve.transform(raw).drop("probability_1")
        return done.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def _probability(trees, rows: DataFrame) -> DataFrame:
    done = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return done.withColumn("probability_1", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(labelled: DataFrame) -> Scorer:
    """A scorer from rows (doc_id, text, toxic): two fifths for the lexicon, two for the trees, one for the calibration.

    So the trees see how well the lexicon does on texts it was not learned from.

    With one class only, or no rows, the score is the share of toxic rows.
    """
    part = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5))
    labelled = materialise(labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), part.alias("part")), "toxicity-labelled")
    lexicon = learn_lexicon(labelled.filter("part < 2"))
    rows = materialise(features(labelled.filter("part >= 2"), lexicon), "toxicity-features")
    counts = {(r["old"], r["toxic"]): r["count"] for r in rows.groupBy((F.col("part") < 4).alias("old"), "toxic").count().collect()}
    total, bad = sum(counts.values()), sum(n for (_, toxic), n in counts.items() if toxic == 1)
    if not counts.get((True, 0)) or not counts.get((True, 1)):
        return Scorer(lexicon, share=bad / total if total else 0.0)
    vectors = rows.withColumn("features", array_to_vector("features"))
    booster = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=7)
    trees = booster.fit(vectors.filter("part < 4").coalesce(4))
    if not counts.get((False, 0)) or not counts.get((False, 1)):
        return Scorer(lexicon, trees)
    graded = _probability(trees, rows.filter("part = 4"))
    curve = IsotonicRegression(featuresCol="probability_1", labelCol="label", predictionCol="score").fit(
        graded.select("probability_1", F.col("toxic").cast("double").alias("label")).coalesce(1))  # at most a fifth of TRAIN_ROWS
    return Scorer(lexicon, trees, curve)


def labelled_rows(docs: DataFrame, labels: DataFrame, allowed: Column, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about ``limit`` labelled documents for which ``allowed`` holds, by a hash of the id.

    Of several labels of a document the largest counts; null labels and ids are left out.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, limit / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about ``limit`` rows of 12 bytes


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a score between 0 and 1; a null text is scored as the empty one.

    Columns named score, features, prediction, rawPrediction or probability are replaced or dropped.
    """
    docs = docs.drop("score", "features", "prediction", "rawPrediction", "probability", "probability_1")
    return scorer.transform(features(docs, scorer.lexicon, text))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels of rows whose remainder is not 2."""
    scorer = fit(labelled_rows(docs, labels, ~remainder(4).isin(2, -1)))
    done = score(docs.select("doc_id", "text"), scorer)
    return done.select(
        "doc_id", remainder(4).isin(2, -1).alias("held_out"), F.col("score").cast("double").alias("score"),
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
