"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting: each task sums its bigrams and sends them, packed and sorted, to a
range of the key space by their first word (by both words where the first is
frequent, so that no range is larger than the others).  A range sums the counts
of each bigram, writes them as one sorted array of hashes, and sends what it
adds to the statistics of words to ranges of words, which write those as sorted
arrays too.  The driver sees one row per file.

Scoring: a worker maps the files from the shared folder, which all workers must
have mounted (a ``file:`` path), and looks up the distinct words and bigrams of
a slice in sorted order.  Texts stay where they are read.

The order is 2: in corpora of mostly distinct trigrams, their counts would take
several times the disk of the texts themselves.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import scratch_path
from .language import remainder
from .words import Texts, mix, slices, word_hashes, words_of

#: Tokens that a task sums before it sends, and tokens that a range holds.
FLUSH = 4_000_000
RANGE = 4_000_000
#: A first word with more than this share of all tokens is spread over all ranges.
HOT = 0.002

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_LOW48 = np.uint64((1 << 48) - 1)
_LOW16 = np.uint64(0xFFFF)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_MOVED = "place int, kind string, keys binary, sizes binary, more binary, counts binary, path string, stats array<long>"


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words in lower case, then one end), of what precedes each, and where texts begin."""
    low = texts.lowered()
    words = words_of(low)
    first = words.first + np.arange(texts.count + 1)
    token = np.full(int(first[-1]), END)
    inside = np.ones(len(token), bool)
    inside[first[1:] - 1] = False
    token[inside] = word_hashes(low, words)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    return token, before, first


def bigram_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _A + (token & _LOW48) * _B)


def six(values: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _row(place: int, kind: str, keys=b"", sizes=b"", more=b"", counts=b"", path=None, stats=()) -> dict:
    return {"place": place, "kind": kind, "keys": keys, "sizes": sizes, "more": more, "counts": counts, "path": path, "stats": list(map(int, stats))}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_ARROW = pa.schema([
    ("place", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("sizes", pa.binary()),
    ("more", pa.binary()), ("counts", pa.binary()), ("path", pa.string()), ("stats", pa.list_(pa.int64())),
])


def _sent(before: np.ndarray, token: np.ndarray, hot: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Summed bigrams, a row per range: distinct first words, how many bigrams each has, second words, counts."""
    second = token & _LOW48
    order = np.lexsort((second, before))
    before, second = before[order], second[order]
    begin = runs(before, second)
    counts = np.diff(np.append(begin, len(before))).astype(np.uint32)
    before, second = before[begin], second[begin]
    spread = mix(before)
    often = np.isin(before, hot)
    spread[often] = mix(before[often] ^ mix(second[often]))
    place = (spread % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(ranges + 1))
    for r in range(ranges):
        rows = order[bounds[r]:bounds[r + 1]]
        if len(rows):
            firsts = runs(before[rows])
            sizes = np.diff(np.append(firsts, len(rows))).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([_row(r, "bigrams", before[rows][firsts].tobytes(), sizes.tobytes(), six(second[rows]), counts[rows].tobytes())], _ARROW)


def _save(folder: str, name: str, array: np.ndarray) -> str:
    """Write an array under a name that no other attempt uses."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}-{uuid.uuid4().hex}.npy"
    np.save(f"{path}.part.npy", array)
    os.replace(f"{path}.part.npy", path)
    return path


def _range_writer(folder: str, places: int):
    """Sums the bigrams of a range; writes their array, returns its row and what it adds to words."""
    def run(table: pa.Table) -> pa.Table:
        r = table["place"][0].as_py()
        first, second, counts = [], [], []
        for keys, sizes, more, n in zip(*(table[c].to_pylist() for c in ("keys", "sizes", "more", "counts"))):
            first.append(np.repeat(np.frombuffer(keys, np.uint64), np.frombuffer(sizes, np.uint32)))
            second.append(from_six(more))
            counts.append(np.frombuffer(n, np.uint32))
        first, second, counts = np.concatenate(first), np.concatenate(second), np.concatenate(counts)
        key = bigram_keys(first, second)
        order = np.argsort(key)
        begin = runs(key[order])
        total = np.add.reduceat(counts[order].astype(np.int64), begin)
        rows = order[begin]
        key, first, second = key[rows], first[rows], second[rows]
        # 48 bits of the hash, then the count; counts that do not fit follow in full.
        packed = (key & ~_LOW16) | np.minimum(total, 0xFFFF).astype(np.uint64)
        large = total >= 0xFFFF
        tail = np.column_stack((key[large] & ~_LOW16, total[large].astype(np.uint64))).ravel()
        array = np.concatenate((np.array([len(packed)], np.uint64), packed, tail))
        out = [_row(-1 - r, "file", path=_save(folder, f"bigrams-{r}", array), stats=[r, *(int((total == n).sum()) for n in (1, 2, 3, 4))])]
        order = np.argsort(first)
        begin = runs(first[order])
        n = total[order]
        columns = [n, n == 1, n == 2, n >= 3]
        stats = np.column_stack([np.add.reduceat(c.astype(np.int64), begin) for c in columns]).astype(np.uint32) if len(begin) else np.zeros((0, 4), np.uint32)
        words = first[order][begin]
        ends, kinds = np.unique(second, return_counts=True)
        at, to = ((w & _LOW48) % np.uint64(places) for w in (words, ends))
        for p in range(places):
            own, met = at == p, to == p
            if own.any() or met.any():
                out.append(_row(p, "words", words[own].tobytes(), np.ascontiguousarray(stats[own].T).tobytes(), six(ends[met]), kinds[met].astype(np.uint32).tobytes()))
        return _rows(out, _ARROW)
    return run


def _word_writer(folder: str):
    """Sums what ranges add to words: totals and kinds of followers as a first word, kinds of predecessors as a second."""
    def run(table: pa.Table) -> pa.Table:
        p = table["place"][0].as_py()
        if p < 0:
            return table
        words, stats, ends, kinds = [], [], [], []
        for keys, sizes, more, n in zip(*(table[c].to_pylist() for c in ("keys", "sizes", "more", "counts"))):
            words.append(np.frombuffer(keys, np.uint64))
            stats.append(np.frombuffer(sizes, np.uint32).reshape(4, -1).T)
            ends.append(from_six(more))
            kinds.append(np.frombuffer(n, np.uint32))
        words, at = np.unique(np.concatenate(words), return_inverse=True)
        stats = np.concatenate(stats)
        sums = np.array([np.bincount(at, stats[:, k], len(words)) for k in range(4)]).astype(np.uint64)
        ends, at = np.unique(np.concatenate(ends), return_inverse=True)
        kinds = np.bincount(at, np.concatenate(kinds), len(ends)).astype(np.uint64)
        path = _save(folder, f"words-{p}", np.concatenate((np.array([len(words), len(ends)], np.uint64), words, sums.ravel(), ends, kinds)))
        start = words == START
        met = [int((kinds == n).sum()) for n in (1, 2, 3, 4)]
        row = [p, int(sums[0][~start].sum()), int((~start).sum()), int(sums[0][start].sum()), int(kinds.sum()), *met]
        return _rows([_row(p, "words", path=path, stats=row)], _ARROW)
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and 3 or more; from counts of counts, kept within the counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that concern all of them."""

    bigrams: tuple[str, ...]
    words: tuple[str, ...]
    hot: tuple[int, ...]
    tokens: int
    texts: int
    distinct: int
    kinds: int
    discount: tuple[float, ...]
    base_discount: tuple[float, ...]
    rest: float  # of the lower model, for the uniform one


def shared_folder(df: DataFrame, label: str) -> str:
    where = urlparse(scratch_path(df.sparkSession, label))
    if where.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a mounted folder (file:) for arrays to be mapped from it")
    return where.path


def fit(docs: DataFrame, text: str = "text") -> Model:
    """A model of all texts of ``docs``; a null text is the empty one, only its end is counted."""
    docs = docs.select(F.col(text).alias("text"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First words with a large share in a task; the number of tokens is in a row of word 0."""
        def tell(parts: list[np.ndarray]) -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(parts), return_counts=True)
            often = n >= HOT / 2 * n.sum()
            columns = np.append(words[often].view(np.int64), 0), np.append(n[often], 0), np.append(np.zeros(often.sum(), np.int64), n.sum())
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["word", "n", "tokens"])
        held, size = [], 0
        for batch in batches:
            for _, texts in slices(batch):
                held.append(tokens_of(texts)[1])
                size += len(held[-1])
                if size >= FLUSH:
                    yield tell(held)
                    held, size = [], 0
        if held:
            yield tell(held)

    often = docs.mapInArrow(frequent, "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    rows = often.orderBy(F.desc("tokens"), F.desc("n")).limit(int(4 / HOT) + 1).collect()
    tokens = sum(r["tokens"] for r in rows)
    frequent_words = {r["word"] for r in rows if r["n"] >= HOT * max(tokens, 1)} | {int(START)}
    hot = np.array(sorted(frequent_words), np.int64).view(np.uint64)
    ranges = ceil(tokens / RANGE) or 1
    folder = shared_folder(docs, "bigram-model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in slices(batch):
                token, before, _ = tokens_of(texts)
                held.append((before, token))
                size += len(token)
                if size >= FLUSH:
                    yield from _sent(*map(np.concatenate, zip(*held)), hot, ranges)
                    held, size = [], 0
        if held:
            yield from _sent(*map(np.concatenate, zip(*held)), hot, ranges)

    done = (
        docs.mapInArrow(count, _MOVED).repartition(ranges, "place").groupBy("place").applyInArrow(_range_writer(folder, ranges), _MOVED)
        .repartition(ranges, "place").groupBy("place").applyInArrow(_word_writer(folder), _MOVED)
        .select("kind", "path", "stats").collect()  # a row per file
    )
    bigrams, words, counts, sums = [""] * ranges, [""] * ranges, np.zeros(4, np.int64), np.zeros(8, np.int64)
    for r in done:
        at, *stats = r["stats"]
        if r["kind"] == "file":
            bigrams[at], counts = r["path"], counts + stats
        else:
            words[at], sums = r["path"], sums + stats
    total, distinct, texts, kinds = map(int, sums[:4])
    base = discounts(*sums[4:])
    more = distinct + (texts > 0) - int(sums[4] + sums[5])  # tokens with three predecessors or more
    rest = float(base[1] * sums[4] + base[2] * sums[5] + base[3] * more) / max(kinds, 1)
    return Model(tuple(bigrams), tuple(words), tuple(map(int, hot)), total + texts, texts, distinct + (texts > 0), kinds, tuple(discounts(*counts)), tuple(base), rest if kinds else 1.0)


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r") if path else np.zeros(2, np.uint64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_statistics(model: Model, words: np.ndarray) -> np.ndarray:
    """For each distinct, sorted hash: count as a first word, followers met once, twice, more often, predecessors."""
    out = np.zeros((5, len(words)), np.int64)
    place = (words & _LOW48) % np.uint64(len(model.words))
    for p in range(len(model.words)):
        rows = np.flatnonzero(place == p)
        if not len(rows) or not model.words[p]:
            continue
        array = _mapped(model.words[p])
        n, m = int(array[0]), int(array[1])
        at, hit = _found(array[2:2 + n], words[rows])
        sums = array[2 + n:2 + 5 * n].reshape(4, n)
        out[:4, rows[hit]] = sums[:, at[hit]]
        low = words[rows] & _LOW48
        order = np.argsort(low)
        at, hit = _found(array[2 + 5 * n:2 + 5 * n + m], low[order])
        out[4, rows[order[hit]]] = array[2 + 5 * n + m:][at[hit]]
    return out


def bigram_counts(model: Model, before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Counts of pairs of hashes."""
    ranges, second = len(model.bigrams), token & _LOW48
    spread = mix(before)
    often = np.isin(before, np.array(model.hot, np.uint64))
    spread[often] = mix(before[often] ^ mix(second[often]))
    place = (spread % np.uint64(ranges)).astype(np.int64)
    key = bigram_keys(before, second) & ~_LOW16
    out = np.zeros(len(token), np.int64)
    order = np.lexsort((key, place))
    bounds = np.searchsorted(place[order], np.arange(ranges + 1))
    for r in range(ranges):
        rows = order[bounds[r]:bounds[r + 1]]
        if not len(rows) or not model.bigrams[r]:
            continue
        array = _mapped(model.bigrams[r])
        n = int(array[0])
        keys = array[1:1 + n]
        if not n:
            continue
        at = np.minimum(np.searchsorted(keys, key[rows]), n - 1)
        value = keys[at]
        hit = (value & ~_LOW16) == key[rows]
        count = np.where(hit, value & _LOW16, np.uint64(0)).astype(np.int64)
        full = np.flatnonzero(count == 0xFFFF)
        if len(full):
            tail = array[1 + n:].reshape(-1, 2)
            where, _ = _found(np.ascontiguousarray(tail[:, 0]), key[rows][full])
            count[full] = tail[where, 1]
        out[rows] = count
    return out


def text_scores(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens, base score and log10 probability of every text."""
    token, before, first = tokens_of(texts)
    words, at = np.unique(np.concatenate((token, before)), return_inverse=True)
    stats = word_statistics(model, words)
    count = stats[0].copy()
    count[words == START] = 0
    count[words == END] = model.texts
    now, then = at[:len(token)], at[len(token):]
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
    d, low = np.array(model.discount), np.array(model.base_discount)
    met = stats[4]
    lower = np.maximum(met - low[np.minimum(met, 3)], 0) / max(model.kinds, 1) + model.rest / (model.distinct + 1)
    follow = np.maximum(stats[0], 1)
    left = np.where(stats[0] > 0, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]) / follow, 1.0)
    pairs, back = np.unique(now.astype(np.int64) * len(words) + then, return_inverse=True)
    token_at, before_at = pairs // len(words), pairs % len(words)
    n = bigram_counts(model, words[before_at], words[token_at])
    chance = np.maximum(n - d[np.minimum(n, 3)], 0) / follow[before_at] + left[before_at] * lower[token_at]
    begin = first[:-1]
    return np.diff(first), np.add.reduceat((count > 0)[now].astype(np.int64), begin), np.add.reduceat(base[now], begin), np.add.reduceat(np.log10(chance)[back], begin)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Every text has an end token, so a null or empty one has one token.  An empty
    model gives every token the same chance.  Columns of these names are replaced.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = docs.drop(*names, "perplexity")
    keep = [c for c in kept.columns if c != text]
    schema = T.StructType([*kept.drop(text).schema.fields, *(T.StructField(n, T.DoubleType() if "score" in n else T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, text):
                tokens, known, base, found = text_scores(model, texts)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(piece.schema.get_field_index(c)) for c in keep), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), model.tokens)), pa.array(base), pa.array(found)],
                    names=schema.names)

    return kept.mapInArrow(run, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 remainder by 10 is not 0."""
    held = remainder(10).isin(0, -1)
    done = score(docs.select("doc_id", "text"), fit(docs.filter(~held)))
    return done.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
