"""Offset-preserving SentencePiece encoding and decoding.

Normalisation goes through the model's compiled character map: at each position the longest prefix in the
map is replaced, and for every normalised byte the source byte it came from is recorded. Pieces, whose
lengths in normalised bytes are known, are projected through that alignment to spans of source bytes.

Segmentation itself is the library's, so ids equal its own; ``aligned`` adds the offsets, for every text that
``encode_documents`` is given. Where no key of the map can begin and spaces stay as they are, the alignment
is worked out for all bytes at once.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value = buf[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            value = buf[at : at + n]
            at += n
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if len(blob) >= 4 else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key of the map at this place, and what replaces it."""
        units = self.units
        if not units:
            return None
        hop = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = hop(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= hop(unit)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[begin : self.pool.index(b"\0", begin)]
        return found


class Codec:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[tuple[str, int]] = []
        spec: dict[int, object] = {}
        with open(path, "rb") as f:
            raw = f.read()
        for field, value in _fields(raw):
            if field == 1:
                one = dict(_fields(value))
                self.pieces.append((one.get(1, b"").decode(), one.get(3, NORMAL)))
            elif field == 3:
                spec = dict(_fields(value))
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.unknown = next((i for i, (_, kind) in enumerate(self.pieces) if kind == UNKNOWN), -1)
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in self.pieces])

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the offset of its source byte; one more for the end."""
        data = text.encode()
        out, src = bytearray(), []
        space = MARK.encode() if self.escape else b" "

        def put(piece: bytes, at: int) -> None:
            for b in [space if c == 32 else bytes([c]) for c in piece]:
                out.extend(b)
                src.extend([at] * len(b) if len(piece) == 1 or len(b) > 1 else [at])

        at, begun, blank = 0, False, self.squeeze
        while at < len(data):
            hit = self.map.longest(data, at)
            n = hit[0] if hit else len(re.match(b"[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*", data[at : at + 4])[0])
            piece = hit[1] if hit else data[at : at + n]
            if self.squeeze:
                while blank and piece.startswith(b" "):
                    piece = piece[1:]
            if piece:
                if not begun and self.dummy:
                    put(b" ", at)
                begun = True
                put(piece, at)
                blank = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], src[-len(space) :]
        return bytes(out), np.array([*src, len(data)])

    def alignment(self, text: str) -> tuple[int, np.ndarray]:
        """Number of normalised bytes and their source offsets, as ``normalise`` gives them."""
        if self.map.units or self.squeeze:
            norm, src = self.normalise(text)
            return len(norm), src
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            return 0, np.zeros(1, np.int64)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        src = np.repeat(begins, np.diff(begins, append=len(data)))
        if self.escape and (blank := data == 32).any():  # the mark has more bytes than the space
            src = np.repeat(src, np.where(blank, len(MARK.encode()), 1))
        dummy = (len(MARK.encode()) if self.escape else 1) * self.dummy
        src = np.concatenate([np.zeros(dummy, np.int64), src, [len(data)]])
        return len(src) - 1, src

    def aligned(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the pieces in bytes of the source text."""
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, src = self.alignment(text)
        own = np.array(ids)
        sizes = self.sizes[own]
        if (own == self.unknown).any():  # as long as what it stands for
            sizes = np.array([len(p.encode()) if i == self.unknown else k for i, p, k in zip(ids, self.sp.encode(text, out_type=str), sizes)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        if at[-1] != n:
            raise ValueError("pieces do not cover the normalised text")
        places = src[at]
        return places[:-1], places[1:]

    def encode(self, text: str) -> list[int]:
        """The ids that the library gives."""
        return self.sp.encode(text)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)

    def spans(self, text: str, ids: list[int] | None = None) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece in bytes of the source text."""
        ids = self.encode(text) if ids is None else ids
        begins, ends = self.aligned(text, ids)
        return list(zip(ids, begins.tolist(), ends.tolist()))

    def digests(self, texts: list[str], with_ids: bool = False) -> pd.DataFrame:
        many = self.sp.encode(texts, num_threads=1)
        places = [self.aligned(t, ids) for t, ids in zip(texts, many)]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out = pd.DataFrame({
            "n_tokens": [len(ids) for ids in many],
            "ids_sha256": [sha(",".join(map(str, ids))) for ids in many],
            "decoded_sha256": [sha(t) for t in self.sp.decode(many, num_threads=1)] if many else [],
            "spans_sha256": [hashlib.sha256(np.concatenate(x).astype("<i8").tobytes()).hexdigest() for x in places],
        })
        if with_ids:
            out["ids"] = [np.array(ids, np.int32) for ids in many]
            out["begins"], out["ends"] = [a for a, _ in places], [b for _, b in places]
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", chars: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (, ids, begins, ends).

    The spans are those of the pieces in bytes of the text as UTF-8; their digest is over all begins, then all
    ends, as little-endian 64-bit numbers. Null and empty texts have no tokens and digests of the empty string. Repeated rows give repeated results;
    other columns are ignored; an empty table gives no rows. A text is never cut, however long.
    """
    path = model or default_model()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            begin = 0
            while begin < len(texts):  # some MB of text at a time
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= chars):
                    size += len(texts[end])
                    end += 1
                out = own.digests(texts[begin:end], with_ids)
                out.insert(0, "doc_id", b["doc_id"].iloc[begin:end].array)
                yield out
                begin = end

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>, begins array<long>, ends array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(lean(run), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
