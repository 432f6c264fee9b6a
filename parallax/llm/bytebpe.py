"""Encoding to the ids of a byte-level BPE vocabulary and back, in batched numpy merge rounds.

A text is cut into words as the vocabulary's file says: contractions, runs of letters, of digits and of other marks, each
with the one space before it, and white space. The words that a task has not met before are encoded together: the symbols
of all of them lie in one flat array, and each round finds the rank of every pair of neighbours by binary search over the
sorted keys of the vocabulary's pairs, takes the lowest rank in each word, and merges that pair wherever the word has it,
from the left. A word leaves the rounds when no pair of it is known. Only ranks beside a merge are searched again.

Merging all places of a word's lowest pair at once gives what merging one at a time does if no merge makes a pair of a
lower rank; that holds if every merge comes after those that make its parts, which is checked when a file is read.

Defined results: a null or empty text has no ids; bytes that are no UTF-8 count as U+FFFD; special tokens found in a text
become their ids, or, if so asked, are plain text; unknown ids are an error; very long words take as many rounds as they
have different merges, in memory of their length; rows, repeated or with null ids, are kept with all their columns, of
which those named as the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, others, text_bytes
from .tokens import byte_names

SPACE, LETTER, DIGIT, MARK, UNSEEN = range(5)
#: Words and their bytes that a worker remembers at most.
KEEP_WORDS, KEEP_BYTES = 200_000, 8 << 20
NONE = np.int64(1) << 40
#: A character of each kind but white space.
LIKE = {LETTER: "a", DIGIT: "1", MARK: "!"}

# Letters that after an apostrophe form a word of their own with it.
ONE, TWO = "stmd", ("re", "ve", "ll")

_loaded: dict[tuple[str, bool], ByteBpe] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe(path: str | None = None, specials: bool = True) -> ByteBpe:
    """The encoder of a file, loaded once a worker."""
    key = (path or default_path(), specials)
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]


def lay_out(pool: np.ndarray, begin: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``at`` of a pool end to end, and the n + 1 offsets of them."""
    n = length[at]
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    return pool[np.arange(total) + np.repeat(begin[at] - (stop - n), n)], np.concatenate(([0], stop))


class Remembered:
    """Ids of words by a memory of the words that a worker has met; ``learn`` gives those of new ones."""

    def __init__(self) -> None:
        self._forget()

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.pool = np.zeros(0, np.uint32)
        self.from_, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def remember(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The places in memory of the words that begin at ``starts`` and end where the next begins."""
        where = np.append(starts, len(data)).astype(np.int64)
        distinct = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = distinct.dictionary_encode()
        words = distinct.dictionary.to_pylist()
        if len(self.known) > KEEP_WORDS or self.held > KEEP_BYTES:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            base = len(self.from_)
            ids, ends = self.learn(new)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.held += sum(map(len, new))
            self.from_ = np.concatenate((self.from_, len(self.pool) + ends[:-1]))
            self.count = np.concatenate((self.count, np.diff(ends)))
            self.pool = np.concatenate((self.pool, ids.astype(np.uint32)))
        at = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        return at[distinct.indices.to_numpy(zero_copy_only=False)]


class ByteBpe(Remembered):
    """A vocabulary. With ``specials``, its special tokens are found in texts; otherwise they are plain text there."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import pre_tokenizers

        self._cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model.get("type") != "BPE" or spec.get("normalizer") or any(cut.get(k) != v for k, v in plain.items()):
            raise ValueError("not a byte-level BPE vocabulary without normaliser and prefix space")
        names, vocab = byte_names(), model["vocab"]
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take in their surroundings are not supported")
        spelt = {i: bytes(names[c] for c in t) for t, i in vocab.items() if t not in added}
        spelt |= {t["id"]: c.encode() for c, t in added.items()}
        self.size = max(spelt) + 1
        self.length = np.array([len(spelt.get(i, b"")) for i in range(self.size)], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(self.size)), np.uint8)
        self.base = np.zeros(256, np.int64)
        for c, b in names.items():
            self.base[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        last = np.full(self.size, -1, np.int64)
        np.maximum.at(last, made, np.arange(len(merges)))
        if len(merges) and (np.maximum(last[left], last[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before one that makes its parts")
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = np.append((left * self.size + right)[order], np.iinfo(np.int64).max)
        self.ranks, self.made = np.append(order, 0), made
        self.special = {c.encode(): t["id"] for c, t in added.items()} if specials else {}
        self._special = re.compile(b"|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._classes = np.full(0x110000, UNSEEN, np.uint8)
        super().__init__()

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge(words)

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        """Space, letter, digit or mark of each character.

        Each character is asked of the tokenizers library once, as releases of Unicode differ: it is of the kind that
        it makes one word with.
        """
        out = self._classes[points]
        if (out == UNSEEN).any():
            for p in np.unique(points[out == UNSEEN]).tolist():
                self._classes[p] = next((k for k, like in LIKE.items() if len(self._cutter.pre_tokenize_str(like + chr(p))) == 1), SPACE)
            out = self._classes[points]
        return out

    def cut(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where words begin, in bytes, and the ids of the words that are special tokens by their beginnings."""
        head = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(head, offsets)] = True
        spans, found = [], {}
        if self._special:
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for hit in self._special.finditer(raw, a, b):
                    found[hit.start()] = self.special[hit[0]]
                    spans.append(np.searchsorted(head, hit.span()))
        for a, b in spans:
            edge[[a, b]] = True
        kind = self._class_of(points)
        starts = np.flatnonzero(edge[:-1] | np.concatenate(([True], kind[1:] != kind[:-1])))
        ends = np.append(starts[1:], n)
        mark = np.zeros(n + 1, bool)
        mark[starts] = True
        # White space before a word leaves its last character: a space joins the word, another is a word of its own.
        inner = (kind[starts] == SPACE) & ~edge[ends]
        mark[ends[inner] - 1] = True
        joined = ends[inner & (points[ends - 1] == 32)]
        mark[joined] = False
        # An apostrophe alone, at the start of a word, takes the letters of a contraction from what follows.
        lone = (points[starts] == 39) & (ends - starts == 1) & mark[starts] & ~edge[ends]
        if lone.any():
            stop = ends[np.flatnonzero(lone) + 1]
            at = ends[lone]
            letters = kind[at] == LETTER
            at, stop = at[letters], stop[letters]
            first, second = points[at], points[np.minimum(at + 1, n - 1)]
            one = np.isin(first, [ord(c) for c in ONE])
            two = (stop - at > 1) & np.isin(first.astype(np.int64) << 32 | second, [ord(t[0]) << 32 | ord(t[1]) for t in TWO])
            mark[at[one | two]] = False
            mark[at[one] + 1] = True
            mark[at[two] + 2] = True
        for a, b in spans:
            mark[a + 1 : b] = False
        return np.append(head, len(data))[np.flatnonzero(mark[:-1])], found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end in UTF-8, and the offsets of each text's ids."""
        raw = data.tobytes()
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, found = self.cut(raw, data, offsets)
        at = self.remember(data, starts)
        if not found:
            ids, ends = lay_out(self.pool, self.from_, self.count, at)
            return ids, ends[np.searchsorted(starts, offsets)]
        places, special = np.searchsorted(starts, list(found)), np.array(list(found.values()), np.uint32)
        k = len(self.count) + np.arange(len(places))
        at[places] = k
        begin = np.concatenate((self.from_, len(self.pool) + np.arange(len(places))))
        count = np.concatenate((self.count, np.ones(len(places), np.int64)))
        ids, ends = lay_out(np.concatenate((self.pool, special)), begin, count, at)
        return ids, ends[np.searchsorted(starts, offsets)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not empty, end to end, and their n + 1 offsets."""
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(symbols), NONE)
        rank[:-1] = np.where(word[1:] == word[:-1], self._rank(symbols[:-1], symbols[1:]), NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            active = lowest < NONE
            if not active.all():
                stay = np.repeat(active, length)
                done.append((word[~stay], symbols[~stay]))
                word, symbols, rank = word[stay], symbols[stay], rank[stay]
                lowest, length = lowest[active], length[active]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, length))
            # Places that overlap are a run of neighbours: every other of them, from the left.
            fresh = np.concatenate(([True], np.diff(at) != 1))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbols[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # no pair if the word ends here
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            word, symbols, rank = word[keep], symbols[keep], rank[keep]
            near = np.concatenate((moved, moved[moved > 0] - 1))
            near = near[near + 1 < len(word)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self._rank(symbols[near], symbols[near + 1])
        owner = np.concatenate([d[0] for d in done])
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
        return np.concatenate([d[1] for d in done])[order], ends

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and the offsets of the texts' bytes; the ids of a text are between ``bounds``."""
        if len(ids) and int(ids.max()) >= self.size:
            raise ValueError("an id that the vocabulary doesn't have")
        out, ends = lay_out(self.bytes, self.begin, self.length, ids.astype(np.int64))
        return out, ends[bounds]


def whole_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``text_bytes`` in which bytes that are no UTF-8 are replaced by U+FFFD."""
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    try:
        raw.decode()
        cut = offsets[offsets < len(data)]
        if len(cut) and ((data[cut] & 0xC0) != 0x80).all():
            return data, offsets
    except UnicodeDecodeError:
        pass
    texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of slices of ``data`` (items of any width) between ``offsets``."""
    data = np.ascontiguousarray(data)
    where = (offsets * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(where), pa.py_buffer(data.view(np.uint8))])


def in_chunks(column: pa.Array, limit: int, compute: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``compute`` over slices of a column of at most ``limit`` bytes, or one row."""
    parts = [compute(c.column(0)) for c in chunks(iter([pa.RecordBatch.from_arrays([column], names=["c"])]), 0, limit)]
    return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)


def ids_of_text(text: Column, path: str | None = None, specials: bool = True) -> Column:
    """Ids of a text: a binary of little-endian unsigned 32-bit numbers."""

    def encode(column: pa.Array) -> pa.Array:
        ids, bounds = bpe(path, specials).encode(*whole_text(column))
        return binary_column(ids.astype("<u4"), bounds)

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return in_chunks(column, 1 << 20, encode, pa.binary())

    return run(text.cast("string"))


def text_of_ids(ids: Column, path: str | None = None) -> Column:
    """The text of such a binary, special tokens spelt out; bytes that are no UTF-8 become U+FFFD. Null gives an empty text."""

    def decode(column: pa.Array) -> pa.Array:
        raw = column.cast(pa.large_binary()).fill_null(b"")
        _, where, data = raw.buffers()
        where = np.frombuffer(where, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        flat = np.frombuffer(data, "<u4", (where[-1] - where[0]) // 4, where[0]) if where[-1] > where[0] else np.zeros(0, "<u4")
        out = binary_column(*bpe(path).decode(flat, (where - where[0]) // 4))
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return in_chunks(column, 1 << 20, decode, pa.string())

    return run(ids)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, specials: bool = True) -> DataFrame:
    """The rows with ``ids`` (see ``ids_of_text``) and ``n_tokens``."""
    kept = [F.col(f"`{c}`") for c in others(docs, ("ids", "n_tokens"))]
    out = docs.select(*kept, ids_of_text(F.col(f"`{text}`"), path, specials).alias("ids"))
    return out.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Encoded rows with ``decoded``, the text of their ids."""
    kept = [F.col(f"`{c}`") for c in others(encoded, ("decoded",))]
    return encoded.select(*kept, text_of_ids(F.col("ids"), path).alias("decoded"))
