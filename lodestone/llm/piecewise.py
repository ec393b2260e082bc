"""Ids and token counts by way of distinct pieces, for vocabularies of the tokenizers library.

A text is cut where its pre-tokeniser cuts anyway, the distinct pieces of a block are looked up in a bounded
memory, and only pieces not seen before go through the library's model. Whatever isn't plainly within the
rules below goes through the library as a whole, so the results are the library's own.
"""

from __future__ import annotations

import os
from array import array
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

KEPT = 800_000
KEPT_BYTES = 64 << 20  # of words and their pre-tokens that a worker remembers, about
LONG = 1 << 10  # longer ones are never remembered
RUN = 100  # new parts that are encoded as one
PLAIN = "֐"  # below it, letters and white space are the same in every Unicode version in use
ENDS = ".,;:!?"
SPANS = regex.compile(r"[\p{L}\uFFFD][ .,;:!?]|[.,;:!?] ")  # a token like this could join what the pattern parts
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to some libraries and not to others
# Fixed value: the pre-token pattern of the word vocabulary, as its file has it.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _unparted(tok):
    """A byte-level tokenizer's model alone: what it is given is one pre-token."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(tok.model)
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out


class _Model:
    """A tokenizer's model on single pre-tokens."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.model, self.chars = self.tok.model, byte_chars()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def odd(self, text: str) -> bool:
        return any(s in text for s in self.special)


def _edged(parts: list[str]) -> np.ndarray:
    """Which parts are empty or begin or end with white space."""
    given = pa.array(parts, pa.large_string())
    return np.asarray(pc.or_(pc.not_equal(pc.utf8_trim_whitespace(given), given), pc.equal(given, "")))


def _split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets, codes and distinct values of the texts' parts between single spaces."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = parts.flatten().dictionary_encode()
    return np.asarray(parts.offsets), np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes eight times as long


class ByteLevelIds(_Model):
    """Ids under a byte-level BPE whose pattern lets a space start a pre-token, and without a normaliser.

    A space between two characters that aren't white space always starts a pre-token. Texts are cut there; a text
    with other white space beside a space, or with a special token's string, goes through the library whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.unparted = _unparted(self.tok)
        vocab, space = self.tok.get_vocab(), self.chars[32]
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocab.items() if t[0] == space]] = True
        code = {c: b for b, c in self.chars.items()}
        self.apart = not any(SPANS.search(bytes(map(code.get, t)).decode("utf-8", "replace")) for t in vocab if t not in self.special)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.count, self.pool = array("q", [0]), array("q", [0]), array("I")

    def _keep(self, name: str, ids: np.ndarray) -> int:
        k = self.at[name] = len(self.first)
        self.first.append(len(self.pool))
        self.count.append(len(ids))
        self.pool.frombytes(ids.tobytes())
        return k

    def _leading(self, part: str) -> int:
        """Where the ids of a text's first part lie."""
        name = "\n" + part  # no part that is looked up begins with white space
        k = self.at.get(name)
        return self._keep(name, np.array(self.tok.encode(part, add_special_tokens=False).ids, np.uint32)) if k is None else k

    def _plain(self, part: str) -> bool:
        """Whether a part is letters and at most a closing mark after them: its pre-tokens are clear, and no token spans two of them."""
        return part.isalpha() or part[-1] in ENDS and part[:-1].isalpha() and part[-2].isascii()

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts that have a space before them, many in one call: the tokens that begin with a space tell where each part begins.

        Plain parts go to the model at once, others through the library's pre-tokeniser.
        """
        plain = [self.apart and max(p) < PLAIN and self._plain(p) for p in parts]
        for direct in (True, False):
            mine = [p for p, d in zip(parts, plain) if d == direct]
            runs = [mine[i : i + RUN] for i in range(0, len(mine), RUN)]
            tok = self.unparted if direct else self.tok
            for i in range(0, len(runs), RUN):
                found = tok.encode_batch_fast([" " + " ".join(r) for r in runs[i : i + RUN]], add_special_tokens=False)
                for run, got in zip(runs[i : i + RUN], found):
                    self._store(run, np.array(got.ids, np.uint32))

    def _store(self, run: list[str], ids: np.ndarray) -> None:
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(run):  # a special token's string or an unusual space among them
            for p in run:
                self._keep(p, np.array(self.tok.encode(" " + p, add_special_tokens=False).ids, np.uint32))
            return
        k, at = len(self.first), len(self.pool)
        self.at.update(zip(run, range(k, k + len(run))))
        self.first.frombytes((starts + at).astype(np.int64).tobytes())
        self.count.frombytes(np.diff(starts, append=len(ids)).astype(np.int64).tobytes())
        self.pool.frombytes(ids.tobytes())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text."""
        if len(self.at) > KEPT:
            self._forget()
        offsets, codes, parts = _split(texts)
        bad = _edged(parts)
        lengths = np.diff(offsets)
        whole = np.array([self.odd(t) or any(c in t for c in SEPARATORS) for t in texts], bool)
        if bad.any():
            hit = np.add.reduceat(bad[codes].astype(np.int64), offsets[:-1])
            whole |= (hit > 0) & ~((lengths == 1) & (np.array([len(t) for t in texts]) == 0))
        place = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero((place < 0) & ~bad)
        unknown = [parts[i] for i in new.tolist()]
        self._learn(unknown)
        place[new] = np.fromiter(map(self.at.get, unknown), np.int64, len(unknown))
        place[bad] = 0
        key = place[codes]
        key[offsets[:-1]] = [0 if w or not t else self._leading(t.partition(" ")[0]) for t, w in zip(texts, whole.tolist())]
        key[np.repeat(whole, lengths)] = 0
        first, count = np.frombuffer(self.first, np.int64)[key], np.frombuffer(self.count, np.int64)[key]
        done = np.cumsum(count)
        total = int(done[-1]) if len(done) else 0
        ids = np.array(self.pool or [0], np.uint32)[np.arange(total) + np.repeat(first - (done - count), count)]
        sizes = np.add.reduceat(count, offsets[:-1])
        if whole.any():
            starts = np.cumsum(sizes) - sizes
            runs = []
            for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
                if whole[i]:
                    own = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                    sizes[i] = len(own)
                    runs.append(own)
                else:
                    runs.append(ids[s : s + n])
            ids = np.concatenate(runs)
        return ids, sizes


class WordPieces(_Model):
    """Pre-tokens of texts, and the number of tokens of a pre-token, under a word BPE (lower case, white space dropped, pattern WORD_LEVEL).

    A pre-token is written as the model takes it, a character for each of its bytes. A special token's string is a
    pre-token of its own, of one token; the text on either side of it is gone through by itself.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.pattern = regex.compile(WORD_LEVEL)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def normal(self, text: str) -> str:
        """The normaliser's output. Below U+0300 nothing composes and lower case is one character's affair."""
        return text.lower() if text.isascii() or max(text) < "̀" else self.tok.normalizer.normalize_str(text)

    def count(self, pre: str) -> int:
        """How many tokens a pre-token makes."""
        return 1 if pre in self.special else len(self.model.tokenize(pre))

    def _by_library(self, text: str) -> list[str]:
        return [t for t, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def _odd(self, text: str) -> list[str]:
        """Pre-tokens of a text with special tokens' strings or unusual separators."""
        return [x for part in (self.apart.split(text) if self.apart else [text]) if part for x in ([part] if part in self.special else self._by_library(part))]

    def _word(self, word: str) -> tuple[str, ...]:
        """Pre-tokens of a normalised run without white space; runs seen before are remembered within KEPT_BYTES."""
        got = self.words.get(word)
        if got is None:
            if max(word) >= PLAIN:
                got = tuple(t for t, _ in self.tok.pre_tokenizer.pre_tokenize_str(word))
            else:
                got = tuple(x.encode().decode("latin-1").translate(self.chars) for x in ((word,) if word.isalpha() else self.pattern.findall(word)))
            if len(word) <= LONG:
                self.held += 300 + 4 * len(word)
                if self.held > KEPT_BYTES:
                    self.words, self.held = {}, 0
                self.words[word] = got
        return got

    def frequencies(self, texts: list[str], code: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of its distinct pre-tokens, then their codes, ascending, and how often each occurs; new ones get the next ``code``."""
        odd = {i: self._odd(t) for i, t in enumerate(texts) if self.odd(t) or any(c in t for c in SEPARATORS)}
        plain = ["" if i in odd else self.normal(t) for i, t in enumerate(texts)]
        runs = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        parts = [[code.setdefault(x, len(code)) for x in self._word(w)] if w else [] for w in coded.dictionary.to_pylist()]
        # Runs by document, then the pre-tokens of each run, then those of each document added up.
        first = np.cumsum([0, *map(len, parts)])
        flat = np.array([c for p in parts for c in p], np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(runs.offsets)))
        pair, times = np.unique(doc * max(1, len(parts)) + np.asarray(coded.indices).astype(np.int64), return_counts=True)
        doc, run = pair // max(1, len(parts)), pair % max(1, len(parts))
        n = np.diff(first)[run]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[run], n)
        own = [(i, code.setdefault(x, len(code))) for i, pres in odd.items() for x in pres]
        doc = np.concatenate((np.repeat(doc, n), np.array([i for i, _ in own], np.int64)))
        flat = np.concatenate((flat[at], np.array([c for _, c in own], np.int64)))
        times = np.concatenate((np.repeat(times, n), np.ones(len(own), np.int64)))
        order = np.argsort(doc * max(1, len(code)) + flat, kind="stable")
        key = (doc * max(1, len(code)) + flat)[order]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        summed = np.add.reduceat(times[order], edge) if len(edge) else np.zeros(0, np.int64)
        return np.bincount(doc[order][edge], minlength=len(texts)), flat[order][edge], summed


@cache
def byte_level_ids(path: str) -> ByteLevelIds:
    return ByteLevelIds(path)


@cache
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)


def blocks(texts: list[str], chars: int = 4_000_000):
    """Ranges of texts of about ``chars`` characters together, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
