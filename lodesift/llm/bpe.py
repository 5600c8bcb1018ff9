"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a piece ends in exactly one token, so one token
per prefix is enough to store.  A token that is a suffix of the prefix is that
one if it may stand behind the stored last token of what precedes it.  Suffix
matches come from a trie over reversed tokens, longest first, then along links
to the next shorter suffix.  All pieces of a slice advance together, one prefix
length per step; following the stored tokens back from the end gives the ids.

Nothing is shuffled: each text is encoded where it is read.  A worker keeps its
vocabulary and the pieces it met last, at most ``KEPT_PIECES``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .words import slices

#: The split pattern of the vocabulary's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEPT_PIECES = 600_000
#: Pieces of more bytes are walked one prefix at a time by themselves.
LONG_PIECE = 256
_FILTER_BITS = 22


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a ragged array, one after the other, and their offsets."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], sizes)
    return values[at], ends


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _byte_characters()
        if model["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("expected a byte-level BPE vocabulary without a normalizer")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        top = max([*ids.values(), *self.added.values()]) + 1
        token: list[bytes] = [b""] * top
        for s, i in ids.items():
            token[i] = bytes(byte[c] for c in s)
        for s, i in self.added.items():
            token[i] = s.encode()
        self.size = top
        self.token = token
        self.length = np.array([len(t) for t in token], np.int64)
        self.bytes_offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes_flat = np.frombuffer(b"".join(token), np.uint8)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # When a token comes into being, and the two it is made of; single bytes exist from the start.
        self.rank = np.full(top, -1, np.int64)
        self.left = np.full(top, -1, np.int64)
        self.right = np.full(top, -1, np.int64)
        for n, (a, b) in enumerate(merges):
            t = ids[a + b]
            if self.left[t] >= 0:
                raise ValueError("a token of this vocabulary comes from two merges")
            self.rank[t], self.left[t], self.right[t] = n, ids[a], ids[b]
        made = [i for i in ids.values() if self.left[i] >= 0 or len(token[i]) == 1]
        keys = np.array([self.left[t] * top + self.right[t] for t in made if self.left[t] >= 0], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array([self.rank[t] for t in made if self.left[t] >= 0], np.int64)[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self._slot(self.pair_keys)] = True
        self._suffixes(made)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def _suffixes(self, made: list[int]) -> None:
        by_bytes = {self.token[i]: i for i in made}
        self.shorter = np.full(self.size, -1, np.int64)
        for s, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[s[k:]] for k in range(1, len(s)) if s[k:] in by_bytes), -1)
        edges, accepts = {}, [-1]
        for s, i in by_bytes.items():
            at = 0
            for b in reversed(s):
                to = edges.get(at * 256 + b)
                if to is None:
                    to = edges[at * 256 + b] = len(accepts)
                    accepts.append(-1)
                at = to
            accepts[at] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.accepts = np.array(accepts, np.int64)

    def longest(self, data: np.ndarray, room: np.ndarray) -> np.ndarray:
        """For each byte, the longest token that ends there and takes at most ``room`` bytes."""
        best = np.full(len(data), -1, np.int64)
        at, state, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            key = state * 256 + data[at - depth]
            found = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[found] == key
            at, state = at[hit], self.edge_to[found[hit]]
            token = self.accepts[state]
            best[at[token >= 0]] = token[token >= 0]
            depth += 1
            more = room[at] > depth
            at, state = at[more], state[more]
        return best

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether ``first`` then ``second`` is how their joined bytes are encoded.

        It is not if the last part of ``first`` and the first part of
        ``second``, at a time both exist, are a pair that merges before either
        is used up.  Of equal merges the left one comes first.
        """
        n = len(first)
        good = np.ones(n, bool)
        x, y, row = first.copy(), second.copy(), np.arange(n)
        x_ends, y_ends = np.full(n, 1 << 40), np.full(n, 1 << 40)
        while len(row):
            key = x * self.size + y
            bad = self.maybe[self._slot(key)]
            if bad.any():
                k = np.flatnonzero(bad)
                found = np.minimum(np.searchsorted(self.pair_keys, key[k]), len(self.pair_keys) - 1)
                r = self.pair_rank[found]
                bad[k] = (self.pair_keys[found] == key[k]) & (r < x_ends[k]) & (r <= y_ends[k])
                good[row[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            row, x, y, x_ends, y_ends, rx, ry = (v[go] for v in (row, x, y, x_ends, y_ends, rx, ry))
            deeper = rx > ry
            x_ends, y_ends = np.where(deeper, rx, x_ends), np.where(deeper, y_ends, ry)
            x, y = np.where(deeper, self.right[x], x), np.where(deeper, y, self.left[y])
        return good

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where those of each piece begin."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        room = np.arange(len(data)) - np.repeat(offsets[:-1], sizes) + 1
        best = self.longest(data, room)
        last = np.full(len(data), -1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        long = int(np.searchsorted(-sizes[order], -LONG_PIECE))
        for p in order[:long]:
            self._walk(best, last, offsets[p], sizes[p])
        rows = order[long:]
        begins, lengths = offsets[rows], sizes[rows]
        for i in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-lengths, -i, side="right"))
            end = begins[:active] + i - 1
            token, left = best[end], np.arange(active)
            while len(left):
                width = self.length[token]
                inner = width < i
                ok = ~inner
                k = np.flatnonzero(inner)
                ok[k] = self.compatible(last[end[left[k]] - width[k]], token[k])
                last[end[left[ok]]] = token[ok]
                left, token = left[~ok], self.shorter[token[~ok]]
        found_piece, found_at, found_token = [], [], []
        piece, end = np.flatnonzero(sizes > 0), (offsets[1:] - 1)[sizes > 0]
        while len(piece):
            token = last[end]
            found_piece.append(piece)
            found_at.append(end)
            found_token.append(token)
            end = end - self.length[token]
            more = end >= offsets[piece]
            piece, end = piece[more], end[more]
        if not found_piece:
            return np.zeros(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        order = np.argsort(np.concatenate(found_at), kind="stable")
        counts = np.bincount(np.concatenate(found_piece), minlength=len(pieces))
        return np.concatenate(found_token)[order].astype(np.int32), np.concatenate(([0], np.cumsum(counts)))

    def _walk(self, best: np.ndarray, last: np.ndarray, begin: int, size: int) -> None:
        seen: dict[tuple[int, int], bool] = {}
        stored, longest = last[begin:begin + size].tolist(), best[begin:begin + size].tolist()
        width, shorter = self.length.tolist(), self.shorter.tolist()
        for i in range(size):
            token = longest[i]
            while width[token] <= i:
                pair = (stored[i - width[token]], token)
                ok = seen.get(pair)
                if ok is None:
                    ok = seen[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if ok:
                    break
                token = shorter[token]
            stored[i] = token
        last[begin:begin + size] = stored

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        data, ends = ragged(self.bytes_flat, self.bytes_offsets, ids.astype(np.int64))
        at, raw = ends[offsets], data.tobytes()
        whole = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw))
        try:
            whole.validate(full=True)
            return whole
        except pa.ArrowInvalid:
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.large_string())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Texts to ids, with the pieces met last kept for the next slice."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(PATTERN)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self._forget()

    def _forget(self) -> None:
        added = self.vocabulary.added
        self.number: dict[str, int] = {}
        # Row n of the ragged array holds the ids of the added token or piece n.
        self.special_row = {s: n for n, s in enumerate(added)}
        self.ids = np.array(list(added.values()), np.int32)
        self.offsets = np.arange(len(added) + 1, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        ids, offsets = self.vocabulary.encode_pieces([p.encode() for p in pieces])
        first = len(self.offsets) - 1
        self.number.update(zip(pieces, range(first, first + len(pieces))))
        self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where those of each text begin."""
        if len(self.number) > KEPT_PIECES:
            self._forget()
        parts = []  # (text, pieces or the name of an added token)
        for n, text in enumerate(texts):
            for k, part in enumerate(self.special.split(text) if self.special else [text]):
                parts.append((n, part if k % 2 else self.split.findall(part)))
        unknown = set().union(*(p for _, p in parts if not isinstance(p, str))) - self.number.keys()
        if unknown:
            self._learn(list(unknown))
        sizes, rows, number = np.zeros(len(texts), np.int64), [], self.number
        for n, part in parts:
            if isinstance(part, str):
                rows.append(np.array([self.special_row[part]]))
            else:
                rows.append(np.fromiter(map(number.__getitem__, part), np.int64, len(part)))
            sizes[n] += len(rows[-1])
        ids, ends = ragged(self.ids, self.offsets, np.concatenate(rows) if rows else np.zeros(0, np.int64))
        return ids, ends[np.concatenate(([0], np.cumsum(sizes)))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder; it outlives a task."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of every whole text, and what they decode to.

    ``ids`` is array<int>.  With ``decoded``, a column of that name (that of the
    text, too) holds the text the ids give back, added tokens included.  A null text is the empty
    one: no ids, an empty decoded text.  Strings of added tokens in a text
    become their ids.  Columns of these names in ``docs`` are replaced; all
    others, repeated rows and row counts stay as they are.
    """
    kept = docs.drop(*[c for c in (ids, decoded) if c and c != text])
    keep = [c for c in kept.columns if c != decoded]
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*(kept.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        for batch in batches:
            for piece, _ in slices(batch, text):
                values = [t or "" for t in piece.column(piece.schema.get_field_index(text)).to_pylist()]
                found, offsets = worker.encode(values)
                columns = [*(piece.column(piece.schema.get_field_index(c)) for c in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))]
                if decoded:
                    columns.append(worker.vocabulary.decode(found, offsets).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text that each list of ids stands for; a null list gives the empty text."""
    kept = docs.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            offsets = np.concatenate(([0], np.cumsum([len(x or ()) for x in lists]))).astype(np.int64)
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, known.decode(flat, offsets).cast(pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and hashes of the ids and of the decoded text."""
    done = encode_texts(docs.select("doc_id", "text"), path, decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )

