"""Exact, cached encoding with the public tokenizer files.

A BPE tokenizer never merges across its pre-tokens, so the ids of a text are the ids
of its space-separated words in order. Words repeat; each worker encodes a word once
with the tokenizers library and looks it up afterwards. Texts for which that cut is
not provably exact (control or unusual white space, texts not in NFC, capitals whose
lower case depends on context, strings of the vocabulary's own control tokens, which the
library turns into those tokens) are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np

from .common import give_back_memory

#: Words one worker remembers, in two generations; about 50 MB. When the younger is full the
#: older is forgotten, but words met again have moved to the younger before.
CACHED_WORDS = 300_000
#: Words handed to the library in one call.
_JOINED = 512
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Where none of these is, every white space is a lone space or line break.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned integers of ``dtype``; nothing is added before or after."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.marks = [t["content"] for t in spec.get("added_tokens", [])]
        # The same model for words of letters that are in their final form: it only cuts at spaces.
        at_spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed" if spec["model"].get("end_of_word_suffix") else "MergedWithNext", "invert": False}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.spaced = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [at_spaces, as_bytes]}}))
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.word_end = model.get("end_of_word_suffix") == "</w>"
        self.space_start = not self.word_end and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        edge = np.zeros(self.size, dtype=bool)
        for piece, i in vocab.items():
            edge[i] = piece.endswith("</w>") if self.word_end else piece.startswith("Ġ")
        self.edge = edge
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.newline = self.tok.token_to_id("Ċ")
        self.cached_words = cached_words

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _letters(self, words: list[str], newline: bool = False) -> None:
        """Encode words of letters only, many in a call; the vocabulary marks where one ends.

        ``newline``: each of the words follows a line break that belongs to it.
        """
        groups = [words[at : at + _JOINED] for at in range(0, len(words), _JOINED)]
        led = "" if newline or self.word_end else " "
        tok = self.tok if newline else self.spaced
        encoded = tok.encode_batch_fast([led + ("" if newline else " ").join(g) for g in groups], add_special_tokens=False)
        for some, e in zip(groups, encoded, strict=True):
            ids = np.asarray(e.ids, dtype=self.dtype)
            marks = np.flatnonzero(ids == self.newline if newline else self.edge[ids])
            ends = marks + 1 if self.word_end else np.append(marks[1:], len(ids))
            if len(ends) != len(some) or ends[-1] != len(ids):
                for w in some:
                    self.words[w] = self._raw(w if self.word_end or newline else " " + w)
                continue
            raw, width, last = ids.tobytes(), self.dtype.itemsize, 0
            for w, end in zip(some, (ends * width).tolist(), strict=True):
                self.words[w] = raw[last:end]
                last = end

    def _learn(self, unknown: set[str]) -> None:
        letters, led, tailed, rest = set(), set(), [], []
        for w in unknown:
            if (known := self.older.get(w)) is not None:
                self.words[w] = known
                continue
            after_break = self.space_start and w[:1] == "\n"
            core = w[1:] if after_break else w
            if core.isalpha():
                (led if after_break else letters).add(w)
            elif len(core) > 1 and core[:-1].isalpha() and " " < core[-1] < "\x7f" and not core[-1].isalnum():
                tailed.append(w)
                if w[:-1] in self.older:
                    self.words[w[:-1]] = self.older[w[:-1]]
                elif w[:-1] not in self.words:
                    (led if after_break else letters).add(w[:-1])
            else:
                rest.append(w)
        self._letters(list(letters))
        self._letters(list(led), newline=True)
        for w in tailed:
            if (tail := self.tails.get(w[-1])) is None:
                tail = self.tails[w[-1]] = self._raw(w[-1])
            self.words[w] = self.words[w[:-1]] + tail
        for w in rest:
            self.words[w] = self._raw(w if self.word_end or w[:1] == "\n" else " " + w)

    def _cut(self, text: str) -> list[str] | None:
        """The words of a text, or None where cutting it could change its ids."""
        plain = text.isascii() and text.replace("\n", " ").isprintable()
        if not plain and _ODD.search(text) or any(m in text for m in self.marks):
            return None
        if self.word_end:
            low = text.lower()
            if not (plain or unicodedata.is_normalized("NFC", text)) or any(m in low for m in self.marks):
                return None
            return low.split()
        if self.space_start:
            if text[0].isspace() or text[-1].isspace():
                return None
            return _LONE_SPACE.split(text) if any(r in text for r in _RUNS) else text.replace("\n", " \n").split(" ")
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.cached_words // 2:
            self.words, self.older = {}, self.words
        out: list[bytes | None] = [None] * len(texts)
        cuts: list[tuple[int, list[str], bytes, list, list[int]]] = []
        unknown: set[str] = set()
        get = self.words.get
        for i, text in enumerate(texts):
            words = self._cut(text) if text else []
            if words is None:
                out[i] = self._raw(text)
                continue
            head = b""
            if self.space_start and words:
                head, words = self._raw(words[0]), words[1:]
            found = list(map(get, words))
            if None in found:
                gaps = [k for k, x in enumerate(found) if x is None]
                unknown.update([words[k] for k in gaps])
                cuts.append((i, words, head, found, gaps))
            else:
                out[i] = head + b"".join(found)
        if unknown:
            self._learn(unknown)
            for i, words, head, found, gaps in cuts:
                for k in gaps:
                    found[k] = self.words[words[k]]
                out[i] = head + b"".join(found)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, cached_words: int = CACHED_WORDS) -> Encoder:
    """One encoder for each vocabulary and worker, kept from task to task."""
    made = Encoder(path, cached_words)
    give_back_memory()  # the vocabulary as JSON and as dicts, needed to make it only
    return made


def forget() -> None:
    """Drop the worker's encoders, for tasks that need none."""
    encoder.cache_clear()


def encode_blocks(texts: list[str], enc: Encoder, limit: int = 1_000_000):
    """Encode in blocks of about ``limit`` characters, so that split words don't pile up."""
    block: list[str] = []
    held = 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= limit:
            yield from enc.encode(block)
            block, held = [], 0
    if block:
        yield from enc.encode(block)
