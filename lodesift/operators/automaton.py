"""All words of a list in many texts: an Aho-Corasick automaton as arrays.

The automaton is a trie whose states know the longest proper suffix that is a
state too (``fail``) and the nearest word that ends there (``ends``).  Every text
is walked once, whatever the number of words; the texts of a batch advance
together, a character a step.  The list goes to every task while its measured
size allows; a longer one is split by first characters into lists that do, and
each is walked on its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..config import SizeLimits
from .sizing import measure

_CHARACTER = 1 << 21        # code points are below
#: Bytes of an automaton for each byte of its words, about.
_PER_BYTE = 40


@dataclass(frozen=True)
class Automaton:
    keys: np.ndarray        # sorted state * 2**21 + character
    next: np.ndarray        # the state that the key leads to
    fail: np.ndarray        # longest proper suffix of a state that is a state
    word: np.ndarray        # word that a state spells, or -1
    ends: np.ndarray        # nearest suffix (the state itself included) that spells a word, or 0

    def step(self, state: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros_like(state)
        at, state = np.arange(len(state)), state.copy()
        while len(at):
            key = state * _CHARACTER + character[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            out[at[found]] = self.next[place[found]]
            on = ~found & (state > 0)       # the root stays where it is
            at, state = at[on], self.fail[state[on]]
        return out

    def walk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of every occurrence."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
        order = np.argsort([-len(c) for c in codes], kind="stable")
        size = np.array([len(codes[n]) for n in order], np.int64)
        flat = np.concatenate([codes[n] for n in order]) if len(order) else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        state = np.zeros(len(order), np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not len(self.keys):
            return found[0]
        # Texts are sorted by length, so those that go on are a prefix.
        left = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for n, alive in enumerate(left):
            state = self.step(state[:alive], flat[begin[:alive] + n])
            at, end = np.arange(alive), self.ends[state]
            while True:
                hit = end > 0
                if not hit.any():
                    break
                at, end = at[hit], end[hit]
                found.append((order[at], self.word[end]))
                end = self.ends[self.fail[end]]
        return tuple(np.concatenate(x) for x in zip(*found))


def build(words: list[str]) -> Automaton:
    """The automaton of distinct, non-empty words."""
    children: list[dict[int, int]] = [{}]
    word = [-1]
    for number, text in enumerate(words):
        state = 0
        for c in map(ord, text):
            if c not in children[state]:
                children[state][c] = len(children)
                children.append({})
                word.append(-1)
            state = children[state][c]
        word[state] = number
    fail, ends = [0] * len(children), [0] * len(children)
    waiting = deque([0])
    while waiting:
        state = waiting.popleft()
        for c, child in children[state].items():
            back = fail[state]
            while back and c not in children[back]:
                back = fail[back]
            fail[child] = children[back].get(c, 0) if state else 0
            ends[child] = child if word[child] >= 0 else ends[fail[child]]
            waiting.append(child)
    edges = sorted((s * _CHARACTER + c, child) for s, near in enumerate(children) for c, child in near.items())
    keys, after = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
    return Automaton(keys, after, *(np.array(x, np.int64) for x in (fail, word, ends)))


def mentions(df: DataFrame, text: str, words: DataFrame, limits: SizeLimits = SizeLimits(), batch_rows: int = 512) -> DataFrame:
    """Rows of ``df`` with ``word`` and ``times`` for every word of ``words(word)`` that its text contains.

    Case counts: lower both sides for a search without.  Null texts contain
    nothing; empty and null words are left out.
    """
    words = words.select(F.col("word").cast("string").alias("word")).filter(F.length("word") > 0).distinct()
    size = measure(words)
    parts = max(1, -(-size.bytes * _PER_BYTE // max(limits.broadcast_bytes, 1)))
    # By the first characters: words that share a prefix share states.
    part = F.pmod(F.xxhash64(F.substring("word", 1, 2)), F.lit(parts))
    schema = T.StructType([*df.schema.fields, T.StructField("word", T.StringType()), T.StructField("times", T.LongType())])
    at = df.columns.index(text)
    out = None
    for n in range(parts):
        listed = sorted(r["word"] for r in (words.filter(part == n) if parts > 1 else words).collect())
        if not listed and parts > 1:
            continue
        a = build(listed)
        shared = df.sparkSession.sparkContext.broadcast((listed, a.keys, a.next, a.fail, a.word, a.ends))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            listed, *arrays = shared.value
            automaton = Automaton(*arrays)
            for batch in batches:
                for begin in range(0, batch.num_rows, batch_rows):
                    piece = batch.slice(begin, batch_rows)
                    row, word = automaton.walk([t or "" for t in piece.column(at).to_pylist()])
                    pairs, times = np.unique(row * max(len(listed), 1) + word, return_counts=True)
                    row, word = pairs // max(len(listed), 1), pairs % max(len(listed), 1)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(row)) for c in piece.columns), pa.array([listed[w] for w in word], pa.string()), pa.array(times.astype(np.int64))],
                        names=[*piece.schema.names, "word", "times"])

        found = df.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)
