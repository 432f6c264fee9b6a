"""Token ids of whole texts, fast: each distinct word of a chunk is encoded once and the ids are laid out by numpy.

``Encoder`` serves BPE files whose pre-tokenizer never joins what white space parts. It takes the byte-rank form of the
same vocabulary where that is proved to give the same ids, and the tokenizer file's own library otherwise.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .common import words

END_OF_TEXT = 1
_KEEP = 150_000
_loaded: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> Encoder:
    """The encoder of a file, loaded once a worker."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def byte_names() -> dict[str, int]:
    """Printable stand-ins for bytes in byte-level vocabularies: Latin-1's visible characters stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._forget()
        self.fast = self._fast(json.load(open(path, encoding="utf-8")))

    def _fast(self, spec: dict):
        """A byte-rank encoder, or None unless each vocabulary entry is what its own bytes encode to.

        Both ways merge the adjacent pair of lowest id, leftmost first; they could differ only where two neighbours
        spell an entry that its own merge doesn't produce. Such neighbours would also be left when that entry is
        encoded alone, as merges inside its span don't depend on what surrounds it. So entries that all encode to
        themselves prove that the two agree on every text.
        """
        import regex
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers", [])
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if (
            model.get("end_of_word_suffix") != "</w>"
            or [s.get("type") for s in steps] != ["Split", "ByteLevel"]
            or steps[0].get("behavior") != "Removed"
            or not steps[0].get("invert")
            or normal != ["NFC", "Replace", "Lowercase"]
        ):
            return None
        names, ranks, special = byte_names(), {}, {t["content"] for t in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in special:
                body = token.removesuffix("</w>")
                if any(c not in names for c in body):
                    return None
                ranks[bytes(names[c] for c in body) + b" " * (len(body) < len(token))] = i
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(set(order)) or len(ranks) != len(vocab.keys() - special):
            return None
        rank = {pair: i for i, pair in enumerate(merges)}
        for (a, b), joined in zip(merges, order, strict=True):
            if vocab[a] >= joined or vocab[b] >= joined:
                return None
        if any(_merged(a + b, rank) != [a + b] for a, b in merges):
            return None
        self.final = np.zeros(max(ranks.values()) + 1, bool)
        self.final[[i for b, i in ranks.items() if len(b) > 1 and b.endswith(b" ")]] = True
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        return tiktoken.Encoding("ranks", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the offsets of each text's ids."""
        raw = data.tobytes()
        if self.fast is None or b"<|" in raw:
            return self._plain(raw, offsets)
        hashes, starts, ends, bounds = words(data, offsets)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > _KEEP:
            self._forget()
        names = distinct.tolist()
        found = [self.known.get(h, -1) for h in names]
        new = [i for i, k in enumerate(found) if k < 0]
        if new:
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            base = len(self.begin)
            self._learn(b" ".join([raw[a:b] for a, b in spans]))
            for k, i in enumerate(new):
                found[i] = self.known[names[i]] = base + k
        at = np.array(found, np.int64)[inverse]
        count = self.length[at]
        stop = np.cumsum(count)
        ids = self.pool[np.arange(stop[-1]) + np.repeat(self.begin[at] - (stop - count), count)]
        return ids, np.concatenate(([0], stop))[bounds]

    def _plain(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the library alone."""
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        bounds = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        return np.array([x for i in ids for x in i], np.uint32), bounds

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.begin = self.length = np.zeros(0, np.int64)

    def _learn(self, joined: bytes) -> None:
        """Append the ids of words that spaces part."""
        text = joined.decode("utf-8", "replace")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        pieces, counts, split = [], [], self.pattern.findall
        for w in _lower(text).split(" "):
            if w.isalpha():
                pieces.append(w)
                counts.append(1)
            else:
                some = split(w)
                pieces += some
                counts.append(len(some))
        slots: dict[str, int] = {}
        order = np.array([slots.setdefault(p, len(slots)) for p in pieces], np.int64)
        ids = self.fast.encode_to_numpy(" ".join(slots) + " ") if slots else np.zeros(0, np.uint32)
        stop = np.flatnonzero(self.final[ids]) + 1  # each piece ends in the one id that carries a word end
        length = np.diff(stop, prepend=0)
        start = stop - length
        n = length[order]
        total = np.cumsum(n)
        size = int(total[-1]) if len(total) else 0
        flat = ids[np.arange(size) + np.repeat(start[order] - (total - n), n)]
        bounds = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(counts)))]
        self.begin = np.concatenate((self.begin, len(self.pool) + bounds[:-1]))
        self.length = np.concatenate((self.length, np.diff(bounds)))
        self.pool = np.concatenate((self.pool, flat.astype(np.uint32)))


def _merged(token: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """A vocabulary entry's characters after the merges of ``rank``, lowest first."""
    body = token.removesuffix("</w>")
    parts = [*body[:-1], body[-1] + token[len(body) :]]
    while len(parts) > 1:
        best, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
        if best == len(rank):
            break
        parts[at : at + 2] = ["".join(parts[at : at + 2])]
    return parts


def _lower(text: str) -> str:
    """Lower case character by character, without Python's rule for a sigma that ends a word."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
