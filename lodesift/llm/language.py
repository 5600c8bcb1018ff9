"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

A model is, for each language, the smoothed frequency of byte trigrams (hashed
to ``BUCKETS``) in labelled texts.  A document is a mixture: each word belongs
to one language and its likelihood is the product of those of its trigrams.
Expectation-maximisation finds the proportions; languages come in one after the
other, the likeliest first, as long as the log-likelihood grows by more than the
penalty.  Training is one pass with a sum per language and bucket, prediction
one pass without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .words import Texts, slices, words_of

BUCKETS = 1 << 16
#: Languages at most; the model then has 128 MB.
MAX_LANGUAGES = 512
SMOOTHING = 0.1
ROUNDS = 6
#: Log-likelihood that a further language must add for each log of a document's words.
PENALTY = 2.0
UNKNOWN = "und"


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the trigram around every byte of a word, where words begin among them, and words per text."""
    t = texts.lowered()
    words = words_of(t)
    inside = np.zeros(len(t.data) + 2, np.int32)
    size = words.ends - words.starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(words.starts - first, size)
    inside[at + 1] = t.data[at]
    left, right = inside[at], inside[at + 2]
    left[first] = 32  # a word of the text before may touch
    right[first + size - 1] = 32
    key = (left * 65536 + inside[at + 1] * 256 + right).astype(np.uint32)
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), first, words.first


def gram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, gram, n): how often each bucket occurs in the texts of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for piece, texts in slices(batch, text):
                gram, first, of_text = _grams(texts)
                bounds = np.append(first, len(gram))[of_text]
                for n, name in enumerate(piece.column(piece.schema.get_field_index(lang)).to_pylist()):
                    if bounds[n] < bounds[n + 1]:
                        seen[name] += np.bincount(gram[bounds[n]:bounds[n + 1]], minlength=BUCKETS)
        for name, counts in seen.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there)), pa.array(there), pa.array(counts[there])], names=["lang", "gram", "n"])

    parts = labelled.select(F.col(text).alias(text), F.col(lang).alias(lang)).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # languages x buckets


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all labelled texts; rows with a null text or language are left out."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if len(rows.select(lang).distinct().take(MAX_LANGUAGES + 1)) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = gram_counts(rows, text, lang).toArrow()  # at most MAX_LANGUAGES x BUCKETS rows
    coded = pc.dictionary_encode(found["lang"]).combine_chunks() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    names = sorted(coded.dictionary.to_pylist())
    place = np.array([names.index(x) for x in coded.dictionary.to_pylist()], np.int64)
    table = np.zeros((len(names), BUCKETS))
    table[place[coded.indices.to_numpy()], found["gram"].to_numpy()] = found["n"].to_numpy()
    smooth = table + SMOOTHING
    return Model(names, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32))


def _mixture(likelihood: np.ndarray, owner: np.ndarray, first: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per text after the rounds, and the log-likelihood they give (without the words' own offsets)."""
    n = np.diff(first)
    filled = np.flatnonzero(n)
    total = np.zeros(len(n))
    for step in range(ROUNDS):
        joint = likelihood * shares[owner]
        mass = joint.sum(1, keepdims=True)
        np.maximum(mass, 1e-30, out=mass)
        total[filled] = np.add.reduceat(np.log(mass[:, 0], dtype=np.float64), first[:-1][filled])
        if step < ROUNDS - 1:
            joint /= mass
            shares = shares.copy()
            shares[filled] = np.add.reduceat(joint, first[:-1][filled], axis=0) / n[filled, None]
    return shares, total


def proportions(texts: Texts, model: Model) -> np.ndarray:
    """Language shares of every text, zero outside its language set and for texts without words."""
    gram, starts, first = _grams(texts)
    count, langs = texts.count, len(model.languages)
    out = np.zeros((count, langs))
    n = np.diff(first)
    filled = np.flatnonzero(n)
    if not langs or not len(filled):
        return out
    words = np.empty((len(starts), langs), np.float32)
    for k in range(langs):
        words[:, k] = np.add.reduceat(model.log_likelihood[k][gram], starts)
    single = np.full((count, langs), -np.inf)
    single[filled] = np.add.reduceat(words.astype(np.float64), first[:-1][filled], axis=0)
    top = words.max(1, keepdims=True)
    offset = np.zeros(count)
    offset[filled] = np.add.reduceat(top[:, 0].astype(np.float64), first[:-1][filled])
    words -= top
    np.exp(words, out=words)
    owner = np.repeat(np.arange(count), n)
    shares, _ = _mixture(words, owner, first, np.full((count, langs), 1 / langs, np.float32))
    # Nested sets: the best single language, then the others by their share.
    best = np.argmax(single, 1)
    rank = shares.copy()
    rank[np.arange(count), best] = 2
    order = np.argsort(-rank, axis=1, kind="stable")
    out[filled, best[filled]] = 1
    value = single[np.arange(count), best]
    growing = filled[n[filled] > 1]
    # Only texts that the last language has improved go on, so the set ends where the penalised likelihood does.
    for k in range(2, langs + 1):
        if not len(growing):
            break
        sizes = n[growing]
        picked = np.arange(int(sizes.sum())) + np.repeat(first[growing] - (np.cumsum(sizes) - sizes), sizes)
        inside = np.concatenate(([0], np.cumsum(sizes)))
        own = np.repeat(np.arange(len(growing)), sizes)
        start = np.zeros((len(growing), langs), np.float32)
        np.put_along_axis(start, order[growing, :k], np.maximum(np.take_along_axis(shares[growing], order[growing, :k], 1), 1e-3), 1)
        start /= start.sum(1, keepdims=True)
        found, total = _mixture(words[picked], own, inside, start)
        gained = total + offset[growing] - PENALTY * (k - 1) * np.log(sizes) > value[growing]
        better = growing[gained]
        out[better] = found[gained]
        value[better] = (total + offset[growing] - PENALTY * (k - 1) * np.log(sizes))[gained]
        growing = better
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and languages.

    ``lang_pred`` is the language with the largest share, ``score`` its share
    and ``languages`` an array of (lang, share) of the selected set, largest
    first; ties go to the name that sorts first.  A text that is null or has no
    letter, or a model without languages, gives `und`, 0 and no languages.
    Columns of these names in ``docs`` are replaced, all others stay.
    """
    spark = docs.sparkSession
    kept = docs.drop("lang_pred", "score", "languages")
    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(pair))]
    schema = T.StructType([*kept.schema.fields, *added])
    shared = spark.sparkContext.broadcast((model.languages, model.log_likelihood))  # BUCKETS x MAX_LANGUAGES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        names = [*known.languages, UNKNOWN]
        for batch in batches:
            for piece, texts in slices(batch, text):
                share = proportions(texts, known)
                lettered = pc.match_substring_regex(piece.column(piece.schema.get_field_index(text)), r"\pL").fill_null(False)
                share[~lettered.to_numpy(zero_copy_only=False)] = 0
                sure = share.sum(1) > 0
                best = np.argmax(share, 1) if share.shape[1] else np.zeros(len(share), int)
                score = share.max(1, initial=0)
                lists = []
                for row, order in zip(share, np.argsort(-share, axis=1, kind="stable")):
                    lists.append([{"lang": names[k], "share": float(row[k])} for k in order if row[k] > 0])
                found = [names[b] if s else UNKNOWN for b, s in zip(best, sure)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(found, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(lists, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=schema.names)

    return kept.mapInArrow(run, schema)


def split(docs: DataFrame) -> DataFrame:
    """The rows to learn from: those whose crc32 remainder by 3 is not 1; a null id is never learned from."""
    return docs.filter(~remainder(3).isin(1, -1))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the other rows' lang.

    Null texts and texts without letters are `und` with score 0; a null id is
    held out; repeated rows are predicted alike, whatever the length of a text.
    Other columns are ignored; without labels all texts are `und`.
    """
    model = fit(split(docs.select("doc_id", "text", "lang")))
    done = identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", remainder(3).isin(1, -1).alias("held_out"), "lang_pred", "score")
