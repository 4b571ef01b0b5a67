"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A chunk's encoding may differ from that of the whole text near the chunk's ends. Neighbouring
chunks are therefore spliced at a character boundary that both encodings have as a token
boundary and that no merge can cross: byte-pair pieces only grow by joining neighbours, so if
no piece of the vocabulary holds the two characters around a boundary next to each other,
nothing on one side of it can change the other side. Where the overlap has no such boundary
it is widened, in the worst case until one chunk holds all.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import kept, map_rows

CHUNK, OVERLAP = 64 * 1024, 512  # bytes
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


class ChunkedCounter:
    """Counts tokens as the model's library does for the whole text (no added tokens)."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        raw = [t.encode() for t in texts]
        short = [i for i, b in enumerate(raw) if len(b) <= self.chunk]
        found = self.model.encode([raw[i] for i in short], num_threads=1, return_type="numpy")
        out = {i: len(ids) for i, ids in zip(short, found, strict=True)}
        return [out[i] if i in out else self._spliced(b) for i, b in enumerate(raw)]

    def _starts(self, raw: bytes, begin: int, end: int) -> list[int]:
        """Begin of each token of a chunk, as a place in the whole text."""
        return [begin + p.begin for p in self.model.encode(raw[begin:end], return_type="proto").pieces]

    def _stable(self, raw: bytes, at: int) -> bool:
        left = at - 1
        while left > 0 and raw[left] & 0xC0 == 0x80:
            left -= 1
        right = at + 1
        while right < len(raw) and raw[right] & 0xC0 == 0x80:
            right += 1
        pair = (raw[left:at] + raw[at:right]).decode().replace(" ", "▁")
        return pair not in self.joined

    @staticmethod
    def _whole(raw: bytes, at: int) -> int:
        """The first character boundary at or after `at`."""
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(raw))

    def _spliced(self, raw: bytes) -> int:
        total, begin, done = 0, 0, 0
        end = self._whole(raw, self.chunk)
        starts = self._starts(raw, begin, end)
        while end < len(raw):
            overlap = min(self.overlap, self.chunk // 2)
            while True:
                begin2 = self._whole(raw, max(done, end - overlap))
                end2 = self._whole(raw, min(len(raw), begin2 + max(self.chunk, 2 * overlap)))
                starts2 = self._starts(raw, begin2, end2)
                both = sorted(set(starts) & set(starts2))
                # The first character of a chunk got a space put before it; the last may
                # have been cut off from what it would merge with.
                cut = [x for x in both if begin2 < x < end and self._stable(raw, x)]
                if cut or begin2 <= done:
                    break
                overlap *= 2
            if cut:
                at = cut[len(cut) // 2]
                total += bisect_left(starts, at) - bisect_left(starts, done)
                starts, end, done = starts2, end2, at
            else:  # nothing in the whole chunk is stable: take a longer one from its start
                end = self._whole(raw, min(len(raw), done + 2 * (end - done)))
                begin = done
                starts = self._starts(raw, begin, end)
        return total + len(starts) - bisect_left(starts, done)


def _counter(model_file: str, chunk: int, overlap: int) -> ChunkedCounter:
    return kept(f"counter of {model_file} {chunk} {overlap}", lambda: ChunkedCounter(model_file, chunk, overlap))


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row.

    `model_file` must be readable on every executor. A null or empty text has 0 bytes and 0
    tokens; repeated rows and null ids give a row each; an empty table gives an empty result;
    other columns are not read. One row at a time is held besides a small batch, and a text
    of any length is encoded in chunks.
    """

    def run(rows):
        count = _counter(model_file, chunk, overlap)
        for ids, texts in rows:
            texts = [t or "" for t in texts]
            yield ids, [len(t.encode()) for t in texts], count.counts(texts)

    counted = map_rows(docs, ["doc_id", "text"], run, SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
