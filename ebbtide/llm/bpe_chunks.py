"""Byte-pair encoding and decoding with chunks that documents share.

A rolling hash over the last few bytes cuts a text wherever its value is low, so equal
passages are cut alike in whichever document they stand, and each chunk is encoded once per
Python worker and then looked up. Cuts after white space are final: the tokenizer drops white
space and no token, contraction or special string spans it. Any other cut is repaired: the two
neighbours are encoded together, and if that differs from their own encodings put together,
they become one chunk, growing until the encodings agree. Agreement proves the cut, because
the last token before a true end of a word carries the end-of-word mark, and one inside a word
does not.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from ebbtide.llm.common import Recent, kept, map_rows

WINDOW = 8  # bytes the rolling hash looks back
PASSAGE_BITS, LONG_RUN = 8, 1024
KEPT_PASSAGES, KEPT_WORDS = 4_000, 100_000
MARK = re.compile(rb"(?<=[a-z])(?=[.,;:!?])")
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the WINDOW - 1 bytes before it."""
    gear = GEAR[raw]
    out = gear.copy()
    for k in range(1, min(WINDOW, len(raw))):
        out[k:] += gear[:-k] * np.uint32(2 * k + 1)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def cut_passages(text: bytes) -> list[tuple[bytes, bool]]:
    """Chunks of `text` in order, and whether the cut after each is after white space.

    Cuts after white space come where the hash is low, a passage of some hundred bytes apart.
    In a run of more than LONG_RUN bytes without white space, low hashes cut anywhere at the
    start of a character.
    """
    if not text:
        return []
    raw = np.frombuffer(text, np.uint8)
    space = SPACE[raw]
    low = rolling_hash(raw) < (1 << (32 - PASSAGE_BITS + 3))
    after = np.flatnonzero(low[:-1] & space[:-1] & ~space[1:]) + 1
    gaps = np.flatnonzero(space)
    edges = np.concatenate(([-1], gaps, [len(raw)]))
    inside = []
    for i in np.flatnonzero(np.diff(edges) > LONG_RUN):
        lo, hi = edges[i] + 1, edges[i + 1]
        near = np.flatnonzero(low[lo : hi - 1] & (raw[lo + 1 : hi] & 0xC0 != 0x80)) + lo + 1
        inside.append(near[::8])
    cuts = np.concatenate([after, *inside])
    order = np.argsort(cuts, kind="stable")
    clean = np.concatenate([np.ones(len(after), bool), np.zeros(len(cuts) - len(after), bool)])[order]
    cuts = cuts[order].tolist()
    bounds = [0, *cuts, len(text)]
    ends = [*clean.tolist(), True]
    return [(text[a:b], e) for a, b, e in zip(bounds, bounds[1:], ends)]


def _words(chunk: bytes) -> list[bytes]:
    """Pieces of a chunk with the same tokens as the chunk: cut at white space and between an
    ASCII letter and a mark that no contraction starts with; ASCII letters in lower case as
    the tokenizer puts them, except where a special string might stand."""
    if b"<|" in chunk:
        return chunk.split()
    return MARK.sub(b" ", chunk.lower()).split()


class ChunkCodec:
    """Encodes and decodes texts exactly as the tokenizer does, reusing chunks."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        self.model.no_truncation()
        self.model.no_padding()
        self.strings = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size())]
        self.ends_word = np.array([s is not None and s.endswith("</w>") for s in self.strings])
        self.passages, self.words = Recent(KEPT_PASSAGES), Recent(KEPT_WORDS)

    def _ids(self, text: bytes) -> list[int]:
        return self.model.encode(text.decode(), add_special_tokens=False).ids

    def _encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word. Words of letters alone are encoded as one text and taken apart
        after each token that ends a word, which costs much less than one call each."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        ids = np.array(self._ids(" ".join([texts[i] for i in plain]).encode()), "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(plain):  # a letter to Python but not to the tokenizer
            plain, ends = [], []
        found = {i: ids[a:b] for i, a, b in zip(plain, [0, *ends], ends)}
        rest = [i for i in range(len(texts)) if i not in found]
        some = self.model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        found.update((i, np.array(e.ids, "<u4")) for i, e in zip(rest, some))
        return [found[i] for i in range(len(texts))]

    def repaired(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks of a run without white space, joined until every cut left is proven."""
        out, current, at, step = [], chunks[0], 1, 1
        while at < len(chunks):
            more = b"".join(chunks[at : at + step])
            if self._ids(current + more) == self._ids(current) + self._ids(more):
                out.append(current)
                current, at, step = more, at + step, 1
            else:
                current, at, step = current + more, at + step, 2 * step
        return [*out, current]

    def passages_of(self, text: bytes) -> list[bytes]:
        """The chunks of a text, all ending at proven cuts."""
        out, run = [], []
        for chunk, clean in cut_passages(text):
            run.append(chunk)
            if clean:
                out.extend(run if len(run) == 1 else self.repaired(run))
                run = []
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and its decoding.

        A chunk not met before is put together from its words, which recur far more often.
        """
        cut = [self.passages_of(t.encode()) for t in texts]
        coded = {c: self.passages.find(c) for c in set().union(*cut)}
        fresh = {c: _words(c) for c, found in coded.items() if found is None}
        words = {w: self.words.find(w) for w in set().union(*fresh.values())}
        missing = [w for w, found in words.items() if found is None]
        strings = self.strings
        for w, ids in zip(missing, self._encode_words(missing), strict=True):
            # Without a decoder the library puts blanks between the tokens' strings.
            words[w] = (ids.tobytes(), " ".join([strings[i] for i in ids.tolist()]))
            self.words.put(w, words[w])
        for c, own in fresh.items():
            coded[c] = _joined([words[w] for w in own])
            self.passages.put(c, coded[c])
        return [_joined([coded[c] for c in chunks]) for chunks in cut]


def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])


def _codec(tokenizer_file: str) -> ChunkCodec:
    return kept(f"codec of {tokenizer_file}", lambda: ChunkCodec(tokenizer_file))


def bpe_digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows and null ids
    give a row each, an empty table gives none, other columns are not read. Memory is bounded
    by one text and the two stores of chunks, whatever the number of documents.
    """

    def run(rows):
        codec = _codec(tokenizer_file)
        for keys, texts in rows:
            coded = codec.encode_batch([t or "" for t in texts])
            yield (
                keys,
                [len(ids) // 4 for ids, _ in coded],
                [hashlib.sha256(ids).hexdigest() for ids, _ in coded],
                [hashlib.sha256(text.encode()).hexdigest() for _, text in coded],
            )

    return map_rows(docs, ["doc_id", "text"], run, SCHEMA)


def bpe_encoded(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, ids (array of int), decoded: the encodings themselves; edge cases as in
    `bpe_digests`."""

    def run(rows):
        codec = _codec(tokenizer_file)
        for keys, texts in rows:
            coded = codec.encode_batch([t or "" for t in texts])
            yield keys, [np.frombuffer(i, "<u4").tolist() for i, _ in coded], [d for _, d in coded]

    return map_rows(docs, ["doc_id", "text"], run, "doc_id bigint, ids array<int>, decoded string")
