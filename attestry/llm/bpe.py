"""Byte-level BPE in numpy: whole lists of words are merged together, round by round.

The symbols of all words lie in one flat array. A round forms the keys of adjacent pairs, finds their
ranks by binary search over the sorted pair keys, takes each word's lowest rank by a segmented minimum
and merges every leftmost non-overlapping pair of that rank at once. Words without a pair left are set
aside, so that later rounds handle fewer symbols.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: The published split pattern of this family of byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int64(1) << 40


def printable_bytes() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 shows it, else the next sign from U+0100 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b if ok else next(spare)) for b, ok in enumerate(shown)]


class ByteBPE:
    """Encoder and decoder of a ``tokenizers`` JSON file that holds a byte-level BPE model.

    ``encode`` equals the library's ``encode(text, add_special_tokens=False).ids``; ``decode`` equals its
    ``decode(ids, skip_special_tokens=False)``. Added tokens in a text are recognised as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take the blanks or words beside them are not supported")
        size = max([*vocab.values(), *self.added.values()]) + 1
        signs = printable_bytes()
        byte_of = {s: b for b, s in enumerate(signs)}
        self.byte_ids = np.array([vocab[s] for s in signs], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks, self.made = size, keys[order], order.astype(np.int64), made[order]
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[s] for s in t) if all(s in byte_of for s in t) else t.encode()
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.split = regex.compile(SPLIT_PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word (none of them empty)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], _NONE), _NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < _NONE, lengths)
            if not open_.all():
                done.append((word[~open_], symbols[~open_]))
            if not open_.any():
                break
            chosen = np.flatnonzero((rank == np.repeat(least, lengths)) & open_)
            # In a run of equal pairs (aaaa) only every other one, from the left, can be merged.
            place = np.arange(len(chosen))
            starts = np.append(True, np.diff(chosen) != 1)
            chosen = chosen[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = open_
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        words_, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words_, kind="stable")
        return ids[order], np.bincount(words_, minlength=len(words))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has. Equal words are merged once."""
        known: dict[str, int] = {}
        sequence: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            before = len(sequence)
            parts = self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    sequence.append(-1 - self.added[part])
                else:
                    sequence.extend(known.setdefault(w, len(known)) for w in self.split.findall(part))
            counts[n] = len(sequence) - before
        flat, sizes = self.merge([w.encode() for w in known])
        seq = np.array(sequence, np.int64)
        special = seq < 0
        pool = np.concatenate([flat, -1 - seq[special]])
        lens = np.where(special, 1, sizes[np.where(special, 0, seq)] if len(sizes) else 1)
        begin = np.cumsum(sizes) - sizes
        begin = np.where(special, len(flat) + np.cumsum(special) - 1, begin[np.where(special, 0, seq)] if len(sizes) else 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        ids = pool[gather(begin, lens)]
        return ids, np.bincount(owner, weights=lens, minlength=len(texts)).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def gather(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of many slices (begin, length) of one pool, one slice after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - ends + lens, lens)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """One encoder a process and file."""
    return ByteBPE(path)
