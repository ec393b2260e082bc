"""Spelling variants: words of a corpus that differ by one code point, grouped under their commonest form.

A symmetric-delete join: every word emits itself and its distinct single deletions as keys. Two words of one key differ
by one code point if one of them is the key itself, or if the same place is deleted from both; anything else that
shares a key is two edits apart and goes. A key is the string itself up to TEXT_KEYS code points; longer ones are named
by their length and 124 bits of four polynomial hashes, from which all deletions of a word follow in linear time, and
what they bring together is compared code point by code point.

After the corpus has been counted only its distinct words are shuffled. A key of length n belongs to at most
1 + 90 (n + 1) words, as runs are made of 90 different code points after lower-casing, however large the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import saved, ship, stored

TEXT_KEYS = 64  # code points
COUNTED_BYTES = 64 << 20  # of words that a task counts before it sends them on, about
ROWS = 1 << 16  # of keys in one batch
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 69069, 1664525, 22695477)
# A-Z become a-z, a-z and U+00C0 to U+00FF stay, everything else parts words.
_RUNS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, one byte for each code point."""
    return text.encode("latin-1", "replace").translate(_RUNS).split(b" ")


def damaged(doc_id: int | None, counts: dict[bytes, int], one_in: int) -> Iterator[tuple[bytes, int]]:
    """The runs of a document and how often they occur; where ``one_in`` divides h, run loses its code point h % length.

    h is the CRC-32 of the UTF-8 of "<doc_id>:<run>". Without an id nothing is lost.
    """
    if doc_id is None or not one_in:
        yield from counts.items()
        return
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): distinct words of at least ``least`` code points that occur at least ``often`` times in all rows of ``docs``.

    Null texts have no words. Every task counts its own words first, a bounded number of bytes at a time.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = Counter(w for w in runs(text or "") if len(w) >= least)
                for word, n in damaged(doc_id, counts, one_in):
                    if len(word) >= least:
                        if word not in found:
                            found[word] = n
                            size += 150 + len(word)
                        else:
                            found[word] += n
                if size >= COUNTED_BYTES:
                    yield out()
                    found, size = {}, 0
        if found:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def deletions(word: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of equal code points of ``word``: deleting any place of a run gives one and the same string."""
    code = np.frombuffer(word.encode("utf-32-le"), "<u4")
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return first, np.concatenate((first[1:] - 1, [len(code) - 1]))


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(step) % np.uint64(prime)))
        step = step * step % prime
    return out[:n]


def hashed_keys(word: str, places: np.ndarray | None) -> list[str]:
    """The names of ``word`` without the code point at each of ``places``, or of ``word`` itself: the length and four hashes."""
    code = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    parts = []
    for prime, base in zip(PRIMES, BASES):
        p = np.uint64(prime)
        along = np.concatenate(([np.uint64(0)], np.cumsum(code * _powers(base, len(code), prime) % p, dtype=np.uint64)))
        if places is None:
            parts.append(along[-1:] % p)
        else:
            back = np.uint64(pow(base, -1, prime))
            parts.append((along[places] + (along[-1] - along[places + 1]) % p * back) % p)
    n = len(code) - (places is not None)
    return [f"{n}:" + "".join(f"{x:08x}" for x in row) for row in zip(*(x.tolist() for x in parts))]


KEYS = "key string, id long, n long, first int, last int"


def keys(words: DataFrame) -> DataFrame:
    """(key, id, n, first, last) for ``words`` (id, word, n): the word itself (first -1) and each distinct deletion with the places that give it."""
    ship(words.sparkSession)
    names = [x.split()[0] for x in KEYS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for id_, word, n in zip(*(c.to_pylist() for c in b.columns)):
                first, last = deletions(word)
                for at in (-1, *range(0, len(first), ROWS)):
                    some, ends = (np.array([-1]), np.array([-1])) if at < 0 else (first[at : at + ROWS], last[at : at + ROWS])
                    if at < 0:
                        made = [word] if len(word) <= TEXT_KEYS else hashed_keys(word, None)
                    elif len(word) <= TEXT_KEYS + 1:
                        made = [word[:i] + word[i + 1 :] for i in some.tolist()]
                    else:
                        made = hashed_keys(word, some)
                    for column, values in zip(out, (made, [id_] * len(made), [n] * len(made), some.tolist(), ends.tolist())):
                        column += values
                    if len(out[0]) >= ROWS:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)
                        out = ([], [], [], [], [])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)

    return words.select("id", "word", "n").mapInArrow(run, KEYS)


def _without(text: str, place: str):
    return F.concat(F.substring(F.col(text), F.lit(1), F.col(place)), F.substring(F.col(text), F.col(place) + 2, F.char_length(text)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(id, other, other_n): all ordered pairs of ``words`` (id, word, n; distinct words) that differ by exactly one inserted, deleted or replaced code point, once each.

    A pair shares exactly one key that its place of difference explains: if one of them is the key, or if the same place
    (a place of the same run of equal code points) is deleted from both.
    """
    places = stored(keys(words), "spelling-keys")
    one = places.select("key", "id", "first", "last")
    two = places.select("key", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("first").alias("first_"), F.col("last").alias("last_"))
    itself = (F.col("first") < 0) | (F.col("first_") < 0)
    same_place = (F.col("first") <= F.col("last_")) & (F.col("first_") <= F.col("last"))
    met = one.join(two, "key").where((F.col("id") != F.col("other")) & (itself | same_place))
    at = F.greatest(F.col("first"), F.col("first_"))
    long = F.contains(F.col("key"), F.lit(":"))  # no word has a colon
    short = met.where(~long).select("id", "other", "other_n")
    texts = words.where(F.char_length("word") > TEXT_KEYS).select("id", "word")
    hashed = met.where(long).select("id", "other", "other_n", at.alias("at"), F.col("first").alias("x"), F.col("first_").alias("y"))
    both = hashed.join(texts, "id").join(texts.select(F.col("id").alias("other"), F.col("word").alias("word_")), "other")
    left, right = (F.when(F.col(p) < 0, F.col(t)).otherwise(_without(t, "at")) for p, t in (("x", "word"), ("y", "word_")))
    return short.unionByName(both.where(left == right).select("id", "other", "other_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root) for ``forms`` (id, form), a forest of links to other ids: where the links end. Each round doubles the links that are followed."""
    now = saved(forms.select("id", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = saved(now.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if longer.where("moved").isEmpty():
            return now
        now = longer.select("id", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, ratio: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z in lower case, after ``damaged``; those
    of at least ``least`` code points and ``often`` occurrences count. ``n_near`` is the number of words that differ by
    one code point, ``form`` the one of them with the largest n (ties: smallest in code-point order) if that is at
    least ``ratio`` * n, ``root`` the last word reached by following forms. n grows along forms, so there are no circles.
    Null texts and empty tables have no words; rows without id lose no code point; repeated rows count as often as they
    occur; other columns don't matter.
    """
    if ratio < 2 or least < 1:
        raise ValueError("a form has at least twice the occurrences, a word at least one code point")
    counts = word_counts(docs, id_col, text_col, least, often, one_in)
    # Ids follow the order of code points: words are sorted by ranges, and ids grow with the partition's number.
    ordered = counts.repartitionByRange("word").sortWithinPartitions("word")
    words = stored(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    best = F.max(F.struct(F.col("other_n"), (-F.col("other")).alias("minus")))
    near = saved(near_pairs(words).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best")))
    linked = words.join(near, "id").where(F.col("best.other_n") >= ratio * F.col("n")).select("id", (-F.col("best.minus")).alias("form"), F.col("best.other_n").alias("form_n"))
    forms = saved(linked)
    named = forms.join(followed(forms), "id")
    of = lambda at, name: words.select(F.col("id").alias(at), F.col("word").alias(name))
    told = named.join(of("form", "form_word"), "form").join(of("root", "root_word"), "root").select("id", "form_n", "form_word", "root_word")
    out = words.join(near.select("id", "n_near"), "id", "left").join(told, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
