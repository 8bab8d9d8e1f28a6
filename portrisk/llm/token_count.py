"""Token counts by overlap resynchronisation: huge texts in overlapping chunks, spliced exactly.

A text longer than CHUNK characters is encoded chunk by chunk; neighbours share OVERLAP characters.
The splice point is a token boundary of both chunks that is stable: the characters beside it are
adjacent in no piece of the vocabulary, so no merge can ever cross it, and what stands left and
right of it is encoded independently. Without such a point in the overlap, the overlap doubles, in
the end up to the rest of the text. So counts equal those of one call over the whole text, and a
chunk bounds the memory wherever stable points exist (before a space after another character always).

Edge cases: a null text is empty and has no tokens; rows with equal ids stay separate rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
SPACE = "▁"


class Splicer:
    """A sentencepiece model with what splicing needs: characters of each id, and pairs inside pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.model.get_piece_size()
        self.width = np.zeros(n, dtype=np.int64)
        self.pairs: set[str] = set()
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.width[i] = int(piece[3:5], 16) & 0xC0 != 0x80  # the first byte of a character counts for it
            elif not self.model.is_control(i):
                self.width[i] = 1 if self.model.is_unknown(i) else len(piece)
                self.pairs.update(piece[k:k + 2] for k in range(len(piece) - 1))

    def stable(self, text: str, at: int) -> bool:
        """No merge crosses this place. Before one space only: the next chunk starts behind it."""
        left, right = (SPACE if c == " " else c for c in text[at - 1: at + 1])
        return left + right not in self.pairs and right == SPACE

    def ends(self, ids: list[int]) -> np.ndarray:
        """Characters of the text that end with each token, without the space put in front."""
        return np.cumsum(self.width[ids]) - 1

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return sum(len(part) for part in self.encode_parts(text, chunk, overlap))

    def encode_parts(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
        """Ids of the text in order, in parts that end at stable boundaries."""
        overlap = max(1, min(overlap, chunk // 2))
        at, size, shared = 0, chunk, overlap
        while len(text) - at > size:
            ids = self.model.encode(text[at: at + size])
            ends = self.ends(ids) + at
            following = self.model.encode(text[at + size - shared: at + size + chunk])
            common = np.intersect1d(ends[ends > at + size - shared], self.ends(following) + at + size - shared)
            place = next((int(p) for p in common[::-1] if p < at + size and self.stable(text, int(p))), None)
            if place is None:
                size, shared = size + shared, shared * 2  # widen
                continue
            yield ids[: int(np.searchsorted(ends, place, side="right"))]
            at, size, shared = place + 1, chunk, overlap  # the encoder puts the space in front again
            if at == len(text):  # the text ends with this one space, which no later chunk would show
                yield self.model.encode(" ")[-1:]
                return
        yield self.model.encode(text[at:])


@cache
def splicer(model: str) -> Splicer:
    import public_tokenizers

    return Splicer(public_tokenizers.path(model))


def count_tokens(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splicer(model)
        for batch in batches:
            counts: list[int] = []
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 256):
                some = [t or "" for t in texts[a: a + 256]]
                short = iter(own.model.encode([t for t in some if len(t) <= chunk], num_threads=1))
                counts += [len(next(short)) if len(t) <= chunk else own.count(t, chunk, overlap) for t in some]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
