"""Whole texts to token ids, with each distinct stretch of text, or word, encoded once a process.

A text is cut where a sign other than white space meets white space. Both vocabularies' split patterns
have a token boundary there, whatever comes before or after, so the ids of a text are the ids of its
stretches one after another (the tests hold this against the library on whole texts). A process keeps
the ids of the stretches that it has met, up to ``limit`` of them; beyond, it starts anew. For a vocabulary that
drops white space the pieces are its words (see ``Words``).
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import numpy as np

from attestry.llm.bpe import SPLIT_PATTERN, byte_bpe, gather

#: Unicode's White_Space signs.
WHITE = "\\t-\\r \x85\xa0  -     　"

#: The published split pattern of the vocabulary with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Numbers(dict):
    """Numbers of pieces in the order in which they were first asked for."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class TextEncoder:
    """``encode_many`` is a function of a list of pieces: (all ids, how many each has); ``cut`` gives a text's pieces."""

    def __init__(self, encode_many, cut=STRETCH.findall, limit: int = 250_000):
        self.encode_many, self.cut, self.limit = encode_many, cut, limit
        self.forget()

    def forget(self) -> None:
        """Drop the pieces met so far."""
        self.known = Numbers()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, lens = self.encode_many(new)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, len(ids)) + 1, np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used += len(ids)

    def encode(self, texts: list[str]):
        """The ids of each text, as uint32 arrays, in order."""
        for at in range(0, len(texts), 256):
            if len(self.known) > self.limit or self.used > 8 * self.limit:
                self.forget()
            number = self.known.__getitem__
            found = [np.fromiter(map(number, p), np.int64, len(p)) for p in map(self.cut, texts[at : at + 256])]
            if new := len(self.known) - len(self.lens):
                self._learn(list(islice(reversed(self.known), new))[::-1])
            for f in found:
                yield self.pool[gather(self.begin[f], self.lens[f])]


class Words:
    """For a vocabulary with word ends that lower-cases and drops white space: texts as its words, words by its merges.

    Only texts of signs up to U+017F are cut into words, those whose lower case and classes are the same to every
    library; others stay stretches, as do texts with an added token. A word's last token alone ends in the word-end
    suffix, so many words go to the library's merges as one text and come back apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix")
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("pattern") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.fits = bool(self.suffix) and steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [{"Regex": WORD_PATTERN}] and len(split) == 2
        if not self.fits:
            return
        signs = "\t\n\r" + "".join(chr(c) for c in [*range(32, 127), *range(0xA0, 0x180)] if c != 0x130)
        of = lambda kind: "".join(c for c in signs if unicodedata.category(c)[0] == kind)
        self.safe = re.compile("[" + re.escape(signs) + "]*")
        self.word = re.compile(WORD_PATTERN.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N")))
        small = "".join(c for c in of("L") if c == c.lower())
        others = "".join(c for c in signs if not c.isspace() and unicodedata.category(c)[0] not in "LN")
        #: What ``word`` finds in a text in lower case, alone.
        self.plain = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{small}]+|[{of('N')}]|[{re.escape(others)}]+")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.merges = Tokenizer.from_file(path)
        self.merges.no_truncation()
        self.merges.no_padding()
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = spec["model"]["vocab"]
        self.last = np.zeros(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(self.suffix)]] = True

    def cut(self, text: str) -> list[str]:
        if self.safe.fullmatch(text) and not any(t in text for t in self.added):
            return self.word.findall(text.lower())
        return STRETCH.findall(text)

    def ids(self, words: list[str], at_once: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(words), at_once):
            found.append(np.array(self.merges.encode_batch_fast([" ".join(words[at : at + at_once])], add_special_tokens=False)[0].ids, np.int64))
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary's word ends don't part the words")
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=4)
def library_encoder(path: str) -> TextEncoder:
    """By the tokenizers library, without added special tokens, truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(lens.sum())), lens

    words = Words(path)
    if not words.fits:
        return TextEncoder(whole)

    def encode_many(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([m is not None for m in map(words.plain.fullmatch, pieces)], bool)
        if plain.all():
            return words.ids(pieces)
        parts = [words.ids([p for p, ok in zip(pieces, plain) if ok]), whole([p for p, ok in zip(pieces, plain) if not ok])]
        order = np.argsort(~plain, kind="stable")
        lens = np.zeros(len(pieces), np.int64)
        lens[order] = np.concatenate([n for _, n in parts])
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(lens[order]) - lens[order]
        return np.concatenate([i for i, _ in parts])[gather(begin, lens)], lens

    return TextEncoder(encode_many, words.cut)


@lru_cache(maxsize=4)
def numpy_encoder(path: str) -> TextEncoder:
    """By the batched merge rounds of ``bpe.ByteBPE``."""
    return TextEncoder(byte_bpe(path).encode_many)


class RankEncoder:
    """The ids of ``TextEncoder`` over the byte-level vocabulary, from its rank file, in native code.

    ``added``: strings that are tokens of their own wherever a text holds them, with their ids.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def forget(self) -> None:
        """Nothing is kept between texts."""

    def encode(self, texts: list[str]):
        for text in texts:
            yield self.model.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=4)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path, SPLIT_PATTERN, {"<|endoftext|>": 50256})


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; only the file's name is fixed here."""
    import public_tokenizers

    return public_tokenizers.path(name)
