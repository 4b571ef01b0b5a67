"""Fill-in-middle transformation, with units found eight bytes at a time.

A unit is a run of the letters A-Z and a-z, or any other single code point. A text's UTF-8 is
viewed as 64-bit words. A byte ends a unit if it is a letter that no letter follows, or another
byte that no continuation byte follows; both are worked out for the eight bytes of a word at once
and leave the top bit of each ending byte. Bits are counted per word and summed up, so the k-th
unit's end is found by a binary search for its word and then by clearing the lowest bits of that
word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import map_rows

SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
TOGETHER = 4 << 20  # bytes of texts that are marked in one go, or one longer text
BLOCK = 1 << 16  # words that are worked on at one time

_EACH = 0x0101010101010101
TOP = np.uint64(0x80 * _EACH)
LOW = np.uint64(0x7F * _EACH)
SMALL = np.uint64(0x20 * _EACH)
FROM_A = np.uint64((0x80 - ord("a")) * _EACH)
PAST_Z = np.uint64((0x80 - ord("z") - 1) * _EACH)
ONE, BYTE, LAST = np.uint64(1), np.uint64(8), np.uint64(56)


def letters(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is an ASCII letter."""
    small = words & LOW | SMALL  # seven bits and the sums below eight: nothing carries over
    return (small + FROM_A) & ~(small + PAST_Z) & ~words & TOP


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that continues a code point (10xxxxxx)."""
    return words & ~(words << ONE) & TOP


def unit_ends(words: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The top bit of each byte that ends a unit; `following` has the word after each."""
    letter, next_letter = letters(words), letters(following)
    next_letter = letter >> BYTE | next_letter << LAST
    goes_on = continuations(words) >> BYTE | continuations(following) << LAST
    return (letter & ~next_letter | ~letter & ~goes_on) & TOP


class Units:
    """Units of several texts in one buffer, each padded to whole words with a zero byte at least.

    Besides the buffer, one 64-bit sum per word is kept; marks are made block by block and again
    for the few words that hold a cut.
    """

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size // 8 + 1)])
        total = int(self.first[-1])
        buffer = bytearray(8 * (total + 1))
        for at, text in zip(self.first, texts):
            buffer[8 * at : 8 * at + len(text)] = text
        self.words = np.frombuffer(buffer, "<u8")
        # Bytes of the padding are no units, whereas a zero byte in a text is one.
        self.real = (ONE << (BYTE * (size % 8).astype(np.uint64))) - ONE
        self.upto = np.zeros(total + 1, np.int64)
        for at in range(0, total, BLOCK):
            word = np.arange(at, min(at + BLOCK, total))
            text = np.searchsorted(self.first, word, "right") - 1
            self.upto[1 + word] = np.bitwise_count(self._marks(word, text))
        np.cumsum(self.upto, out=self.upto)

    def _marks(self, word: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Marks of words and the texts they are in."""
        marks = unit_ends(self.words[word], self.words[word + 1])
        return np.where(word + 1 == self.first[text + 1], marks & self.real[text], marks)

    def counts(self) -> np.ndarray:
        """Units per text."""
        return np.diff(self.upto[self.first])

    def ends(self, which: np.ndarray) -> np.ndarray:
        """For each text the byte place after its first `which` units."""
        begin = self.first[:-1]
        wanted = self.upto[begin] + which
        word = np.where(which > 0, np.searchsorted(self.upto, wanted) - 1, begin)
        marks = self._marks(word, np.arange(len(word)))
        left = wanted - self.upto[word]
        for k in range(1, 8):
            marks = np.where(left > k, marks & (marks - ONE), marks)
        lowest = marks & (~marks + ONE)
        byte = (np.bitwise_count(lowest - ONE) >> 3).astype(np.int64)
        return np.where(which > 0, 8 * (word - begin) + byte + 1, 0)


def _groups(sizes: list[int]):
    """Begin and end of runs of texts of at most `TOGETHER` bytes, or of one text."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > TOGETHER:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _draws(seed: str) -> list[Column]:
    """The first four 8-digit groups of the digest of seed and id, as numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for each row.

    The text is cut after two numbers of units drawn by a digest of `seed` and doc_id. `form` is
    `psm` (prefix, suffix, middle, each after its marker) or `spm` (suffix first), or `plain`:
    the text as it is, if it is empty, holds a marker itself, or the draw says so. Null texts
    are empty; a null id draws as an empty one; repeated rows give a row each, with the same
    result; an empty table gives none; other columns are not read. Whole texts are cut, and
    besides a few megabytes one text at a time is worked on.
    """

    def run(rows):
        for ids, texts, *draws in rows:
            raw = [(t or "").encode() for t in texts]
            for lo, hi in _groups([len(r) for r in raw]):
                yield _transformed(ids[lo:hi], raw[lo:hi], [d[lo:hi] for d in draws], plain_from, spm_below)

    drawn = docs.select("doc_id", "text", *_draws(seed))
    return map_rows(drawn, drawn.columns, run, SCHEMA)


def _transformed(ids, raw, draws, plain_from, spm_below):
    h1, h2, h3, h4 = (np.array(d, np.int64) for d in draws)
    units = Units(raw)
    n = units.counts()
    one, two = h1 % (n + 1), h2 % (n + 1)
    begins, ends = units.ends(np.minimum(one, two)), units.ends(np.maximum(one, two))
    forms, prefixes, middles, outputs = [], [], [], []
    for text, begin, end, draw, order in zip(raw, begins, ends, h3 % 100, h4 % 100):
        marked = any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE))
        if not text or marked or draw >= plain_from:
            forms.append("plain")
            prefixes.append(None)
            middles.append(None)
            outputs.append(text.decode())
            continue
        prefix, middle, suffix = text[:begin].decode(), text[begin:end].decode(), text[end:].decode()
        prefixes.append(len(prefix))
        middles.append(len(middle))
        if order < spm_below:
            forms.append("spm")
            outputs.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
        else:
            forms.append("psm")
            outputs.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
    return ids, n.tolist(), forms, prefixes, middles, outputs


def restored_text(output: Column, form: Column) -> Column:
    """The text that `output` was made of. No marker stands in a cut text, so the first of each
    is the one that was put in."""

    def between(begin: str, end: str) -> Column:
        first = F.locate(begin, output) + len(begin)
        return F.substr(output, first, F.locate(end, output) - first)

    middle = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """`fill_in_middle` with digests of the output and of the text rebuilt from it in place of
    the output."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
