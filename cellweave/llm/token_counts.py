"""Operator 7, token counts by overlap resynchronisation.

Texts are encoded in chunks of ``CHUNK_BYTES`` that reach ``OVERLAP_BYTES`` into
their successor, many chunks in one call; token offsets follow from the lengths of
the pieces. Two neighbouring chunks are spliced at a boundary that both place in
the overlap and that is proven stable: it lies between two characters that stand
side by side in no piece of the vocabulary, so no merge crosses it, whatever stands
on either side (blanks before words, digits beside digits, line ends, most pairs of
ideographs). Chunks begin at such a boundary where one is near, else at any
character. Where an overlap has no common boundary, the earlier chunk is widened,
twice as far each time, at last over its successor and over as many more as double
it, so the work stays linear. What is encoded at once is bounded by the chunk and
by the longest stretch without any proven boundary (one letter repeated), which no
encoder can cut. Only a text of at most one chunk is encoded whole: it is the one
chunk. A model for which the proof does not hold (a normaliser that rewrites text,
or no byte pieces) is refused.

Defined cases: null and empty texts have 0 bytes and 0 tokens; text that looks
like a special token is ordinary text; nothing is cut or padded; repeated rows
give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, slices, table

MARK = "▁"
#: Bytes of a chunk and of the first overlap.
CHUNK_BYTES, OVERLAP_BYTES = 1 << 12, 1 << 7

#: Bytes of text encoded together.
PART = 1 << 20

COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


class Tokenizer:
    """A sentencepiece model and the pairs of characters that its pieces hold side by side."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(size)]
        # what the model puts before a text, and how it writes blanks
        self.prefix = m.encode("a a", out_type=str)[0].startswith(MARK)
        if m.normalize("A  \tb") != (MARK if self.prefix else "") + f"A{MARK}{MARK}\tb" or not any(map(m.is_byte, range(size))):
            raise ValueError(f"{path}: texts can be spliced only where a model keeps every character and has byte pieces")
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Bytes of a text that each piece stands for; a mark stands for one blank.
        self.width = np.array([1 if m.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def parts(self, raw: bytes, at: int) -> bool:
        """Whether no merge can cross the place before byte ``at``, 0 < at < len(raw)."""
        if raw[at] & 0xC0 == 0x80:
            return False
        a, b = at - 1, at + 1
        while raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        return raw[a:b].decode().replace(" ", MARK) not in self.joined

    def count_all(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def starts(self, raw: list[bytes], spans: list[tuple[int, int]]) -> list[np.ndarray]:
        """Byte offset of each token of every raw[begin:end].

        Where a span behind a text's start begins with a blank, that is written by the
        mark that the model itself puts before a text.
        """
        own = [self.prefix and b > 0 and r[b] == 0x20 for r, (b, _) in zip(raw, spans)]
        texts = [r[b + o : e].decode() for r, (b, e), o in zip(raw, spans, own)]
        out = []
        for ids, r, text, (b, e), o in zip(self.model.encode(texts, num_threads=1), raw, texts, spans, own):
            size = self.width[np.array(ids, np.int64)]
            lead = 1 if self.prefix and text and not o else 0  # the first mark stands for nothing in the text
            at = b + np.cumsum(size) - size - lead
            if len(ids) and at[-1] + size[-1] != e or MARK in text:  # marks of the text's own: ask the model
                proto = self.model.encode(text, return_type="proto")
                at = b + o + np.fromiter((p.begin for p in proto.pieces), np.int64, len(proto.pieces))
            if len(at):
                at[0] = b
            out.append(at)
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _stable(t: Tokenizer, raw: bytes, at: np.ndarray, after: int) -> np.ndarray:
    """Token starts behind ``after`` that no merge can cross."""
    at = at[np.searchsorted(at, after, "right") :]
    return np.array([x for x in at.tolist() if t.parts(raw, x)], np.int64)


#: Bytes behind a chunk's width in which its successor's start is sought.
NEAR = 1 << 6


def _cuts(t: Tokenizer, raw: bytes, chunk: int) -> list[int]:
    """Where chunks begin: 0 and, behind every ``chunk`` bytes, a blank after another character, else a stable boundary, else any character."""
    out, at = [0], chunk
    while at < len(raw):
        x = raw.find(b" ", at, at + NEAR)
        while x > 0 and raw[x - 1] == 0x20:
            x = raw.find(b" ", x + 1, at + NEAR)
        if x < 0:
            x = next((y for y in range(at, min(at + NEAR, len(raw))) if t.parts(raw, y)), _whole(raw, at))
        out.append(x)
        at = x + chunk
    return out


def _whole(raw: bytes, at: int) -> int:
    """``at``, or the start of the character that it lies in."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(raw))


#: Chunks encoded in one call.
GROUP = 256


def count_spliced(t: Tokenizer, texts: list[bytes], chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[list[int], int]:
    """Tokens of each text, counted over overlapping chunks of its bytes; and the number of splices made."""
    chunk = max(chunk, 4)  # a chunk holds a character
    cuts = [_cuts(t, raw, chunk) for raw in texts]
    spans = [[(a, _whole(raw, b + overlap)) for a, b in zip(cut, [*cut[1:], len(raw)])] for raw, cut in zip(texts, cuts)]

    def encoded():
        flat = [(raw, span) for raw, own in zip(texts, spans) for span in own]
        for a in range(0, len(flat), GROUP):
            yield from t.starts(*map(list, zip(*flat[a : a + GROUP])))

    places = encoded()
    total, made = [], 0
    for raw, own in zip(texts, spans):
        here, begin, (lead, end), count, j = next(places), 0, own[0], 0, 0
        while j + 1 < len(own):
            j += 1
            there, (after, reach), wide = next(places), own[j], overlap
            common = np.intersect1d(_stable(t, raw, here, after), _stable(t, raw, there, after))
            while not len(common) and end < reach:
                wide *= 2
                end = _whole(raw, min(reach, after + wide))
                here = t.starts([raw], [(lead, end)])[0]
                common = np.intersect1d(_stable(t, raw, here, after), _stable(t, raw, there, after))
            if len(common):
                splice = int(common[len(common) // 2])
                count += int(np.searchsorted(here, splice) - np.searchsorted(here, begin))
                here, begin, lead, end, made = there, splice, after, reach, made + 1
                continue
            # no agreement in the whole successor: this chunk takes its place, and that of others until it has doubled
            goal = 2 * end - lead
            while j + 1 < len(own) and end < goal:
                j += 1
                next(places)
                end = own[j][1]
            here = t.starts([raw], [(lead, end)])[0]
        total.append(count + len(here) - int(np.searchsorted(here, begin)))
    return total, made


def token_counts(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``; columns of these names are replaced. One map, no shuffle."""

    def count(column: pa.Array) -> dict[str, pa.Array]:
        t = tokenizer(model_path)
        tokens, n_bytes = [], []
        for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0, PART):
            raw = ["".encode() if x is None else x.encode() for x in part.column(0).to_pylist()]
            n_bytes += map(len, raw)
            tokens += count_spliced(t, raw, chunk, overlap)[0]
        return {"n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}

    return add_columns(docs, text, count, COUNTS)


#: Tokens above which a document is over the limit.
LIMIT = 4096


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
