"""Token ids of whole texts by a vocabulary file, with repeated words encoded once per task.

Splitting a text where a white-space character follows another character never splits a token of a
vocabulary whose pre-tokenizer keeps white space only at the front of a word, or drops it.  Both kinds used here
do, so a text's ids are the ids of its words in turn; special strings hold no white space and stay
in one word.  Words are encoded by the library; a bounded table keeps those already seen.

A vocabulary file of plain byte-level BPE, whose ids are the order of its merges, is also what ``tiktoken`` takes, which gives the same ids
several times faster, from whole texts.  Texts with very long words or blanks go through words, as its time grows with their square.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np

#: White space as Unicode has it, which is what the libraries' patterns go by.
WHITE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WHITE_BEFORE_BLANK = re.compile(f"[{WHITE}] ")
WHITE_SIGNS = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
#: Words remembered by one worker before it starts anew, and the length beyond which a word is not remembered.
MEMO_WORDS = 1_000_000
MEMO_CHARS = 64
#: Words sent to the library at once, and in one string.
BATCH_WORDS = 20_000
JOINED_WORDS = 500
#: How byte-level BPE cuts a text: fixed values, part of the vocabulary's format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The longest words and runs of blanks that are given to ``tiktoken``.
LONGEST_WORD = 1000
#: Signs to set between words in one string; the first that makes a single id after a blank is taken.
SEPARATORS = "|§¦~^"


def load(path: str):
    """The tokenizer of a ``tokenizers`` file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def words(text: str) -> list[str]:
    """The text cut before each run of white space that follows another character."""
    if _WHITE_BEFORE_BLANK.search(text):
        return _PIECE.findall(text)
    parts = text.split(" ")
    first = parts[0]
    rest = [" " + part for part in parts[1:]]
    return [first, *rest] if first else rest


class Encoder:
    """Encodes texts; `result` says what is remembered of a word's ids."""

    def __init__(self, path: str):
        self._library = load(path)
        self._memo: dict = {}
        self._separator = self._mark = None
        for sign in SEPARATORS:
            ids = self._library.encode(" " + sign, add_special_tokens=False).ids
            if len(ids) == 1:
                self._separator, self._mark = sign, ids[0]
                break

    def result(self, ids: np.ndarray):
        return ids

    def encode(self, texts: list[str]) -> list[list]:
        """For each text, what is remembered of its words in turn."""
        if len(self._memo) > MEMO_WORDS:
            self._memo.clear()
        memo = self._memo
        split = [words(text) for text in texts]
        missing = set()
        for parts in split:
            missing.update(parts)
        missing = [word for word in missing if word not in memo]
        together, alone = [], []
        for word in missing:
            (together if self._can_be_joined(word) else alone).append(word)
        for start in range(0, len(together), BATCH_WORDS):
            alone += self._encode_joined(together[start : start + BATCH_WORDS])
        for start in range(0, len(alone), BATCH_WORDS):
            batch = alone[start : start + BATCH_WORDS]
            for word, ids in zip(batch, self._ids(batch), strict=True):
                memo[word] = self.result(ids)
        encoded = [[memo[word] for word in parts] for parts in split]
        for word in missing:
            if len(word) > MEMO_CHARS:
                del memo[word]
        return encoded

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        # The fast form leaves out the places of tokens in the text.
        return [np.array(e.ids, dtype="<u4") for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _can_be_joined(self, word: str) -> bool:
        """It begins with white space, ends without, and doesn't hold the sign between words."""
        return (
            self._separator is not None
            and word[0] in WHITE_SIGNS
            and word[-1] not in WHITE_SIGNS
            and self._separator not in word
        )

    def _encode_joined(self, batch: list[str]) -> list[str]:
        """Remembers words that are encoded many to a string; returns those that could not be told apart."""
        runs = [batch[i : i + JOINED_WORDS] for i in range(0, len(batch), JOINED_WORDS)]
        odd = []
        for run, ids in zip(runs, self._ids([f" {self._separator}".join(run) for run in runs]), strict=True):
            ends = [*np.flatnonzero(ids == self._mark).tolist(), len(ids)]
            if len(ends) != len(run):
                odd += run
                continue
            start = 0
            for word, end in zip(run, ends, strict=True):
                self._memo[word] = self.result(ids[start:end])
                start = end + 1
        return odd


class IdEncoder(Encoder):
    """Ids as little-endian unsigned 32-bit numbers."""

    def result(self, ids: np.ndarray) -> bytes:
        return ids.tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        return [b"".join(parts) for parts in self.encode(texts)]


class CountEncoder(Encoder):
    """Numbers of ids."""

    def result(self, ids: np.ndarray) -> int:
        return len(ids)

    def counts(self, texts: list[str]) -> list[int]:
        return [sum(parts) for parts in self.encode(texts)]


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level files write for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(path: str):
    """A ``tiktoken`` encoding with the ids of a vocabulary file, or None if the file says more than it can."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, cut = said["model"], said["pre_tokenizer"] or {}
    plain = (
        not any(said.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex") is True
        and cut.get("add_prefix_space") is False
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"])
    )
    if not plain:
        return None
    signs = _byte_signs()
    specials = {t["content"]: t["id"] for t in said["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in specials}
    merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    in_order = [vocabulary.get(a + b) for a, b in merged] == list(range(256, 256 + len(merged)))
    if not in_order or len(vocabulary) != 256 + len(merged) or any(vocabulary.get(s, 256) > 255 for s in signs):
        return None
    import tiktoken

    ranks = {bytes(signs[s] for s in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=specials)


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self._path = path
        self._ranked = ranked(path)
        self._words: IdEncoder | None = None

    def ids(self, texts: list[str]) -> list[bytes]:
        if self._ranked is None:
            return self._by_words(texts)
        encode = self._ranked.encode_to_numpy
        return [
            self._by_words([text])[0] if _has_long_word(text) else encode(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            for text in texts
        ]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        if self._words is None:
            self._words = IdEncoder(self._path)
        return self._words.ids(texts)


def _has_long_word(text: str) -> bool:
    """True if a word, or what stands between words beyond one sign each, is longer than `LONGEST_WORD`."""
    if len(text) <= LONGEST_WORD:
        return False
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) > LONGEST_WORD or len(text) - sum(sizes) - len(sizes) > LONGEST_WORD


def worker_encoder(kind: type, path: str):
    """The encoder of this worker process, which keeps its words from task to task."""
    state = sys.modules.setdefault("_tarnlake_encoders", types.ModuleType("_tarnlake_encoders"))
    file = os.stat(path)
    name = f"{kind.__name__} {path} {file.st_size} {file.st_mtime_ns}"
    if name not in vars(state):
        setattr(state, name, kind(path))
    return getattr(state, name)


def slices(texts: list[str], most_chars: int = 4_000_000):
    """Runs of texts of bounded total length, a longer text alone: (start, end) positions."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > most_chars:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)
