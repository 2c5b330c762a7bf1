"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

The model has one piece for each token, in rank order, with each byte as one character and minus the rank as
score, so that sentencepiece merges the pair of lowest rank first, as the rank file asks; its normalisation is
the identity. A text is split by the pattern; each match that is a token itself is that token, any other is
merged by the model. Decoding maps each id back to its bytes.

Defined cases: a null text counts as empty and has no ids; texts may be of any length, and a match longer than
CACHE_CHARS is merged without being kept; rows that repeat are encoded one by one; an empty table gives no rows. Of
other columns, whatever their names, none is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lucidgraph.llm.common import small_batches, table, worker_cache

#: Words, matches and decoded words kept in each Python worker, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 40
#: Patterns whose matches hold white space only as one leading space or alone: as in public_tokenizers.PATTERN.
_SPACE_LED = r"(?:'\w+\|)*(?: \?(?:\\p\{\w\}|\[\^\\s[^\]\s]*\])\+\|)+\\s\+\(\?!\\S\)\|\\s\+"
_SHIFT = 0x100  # byte b is the character 0x100 + b in a piece
_CHARS = {b: chr(_SHIFT + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [t for _, t in pairs]


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_CHARS)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(pieces: list[str]) -> bytes:
    """A serialised sentencepiece BPE model: the piece at place i has id i and score -i; one unknown piece ends it."""
    normal, unknown = 1, 2  # SentencePiece.Type
    out = [_field(1, _field(1, p.encode()) + _field(2, float(-i)) + _field(3, normal)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    bpe = 2  # TrainerSpec.ModelType
    out.append(_field(2, _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


def merger(pieces: list[str]):
    """A function from strings of piece characters to a list of ids for each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(pieces))
    return lambda strings: model.encode(strings, out_type=int, add_bos=False, add_eos=False, num_threads=1)


#: One word, with one space before it or none.
_WORD = re.compile(r" ?\S+").fullmatch


class ByteBpe:
    """Encodes and decodes by one vocabulary; keeps the ids of recent words, as decimal text joined by commas.

    In a text with single spaces and breaks alone, each match of the pattern lies within one word with the
    space before it, or is one break. So such a text is encoded word by word, any other match by match.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.merge = merger([as_piece(t) for t in tokens])
        self.bytes_of = {str(i): t for i, t in enumerate(tokens)}
        self.by_word = re.fullmatch(_SPACE_LED, pattern) is not None
        self.words: dict[str, str] = {}
        self.matches: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def _learn_matches(self, new: list[str]) -> None:
        merged = []
        for pre in new:
            known = self.whole.get(pre.encode())
            if known is None:
                merged.append(pre)
            else:
                self.matches[pre] = str(known)
        if merged:
            for pre, ids in zip(merged, self.merge([as_piece(m.encode()) for m in merged]), strict=True):
                self.matches[pre] = ",".join(map(str, ids))

    def _of_matches(self, matches: list[str]) -> list[str]:
        if len(self.matches) > CACHE_ENTRIES:
            self.matches.clear()
        known = self.matches
        self._learn_matches([m for m in dict.fromkeys(matches) if m not in known])
        out = list(map(known.__getitem__, matches))
        for m in {m for m in matches if len(m) > CACHE_CHARS}:
            del known[m]
        return out

    def _of_words(self, words: list[str]) -> list[str] | None:
        """words: each a break, or a word with the space before it, if any; None if one is anything else."""
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        known = self.words
        out = list(map(known.get, words))
        if None in out:
            new = list(dict.fromkeys([w for w, ids in zip(words, out, strict=True) if ids is None]))
            if any(w != "\n" and not _WORD(w) for w in new):
                return None
            parts = list(map(self.split, new))
            ids = iter(self._of_matches([m for p in parts for m in p]))
            for w, p in zip(new, parts, strict=True):
                known[w] = ",".join(islice(ids, len(p)))
            out = list(map(known.__getitem__, words))
            for w in new:
                if len(w) > CACHE_CHARS:
                    del known[w]
        return out

    def encode_parts(self, text: str) -> list[str]:
        """Ids of the text's parts in order, each in decimal and joined by commas."""
        if not text:
            return []
        if self.by_word and "\0" not in text:
            parts = self._of_words(text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))
            if parts is not None:
                return parts
        return self._of_matches(self.split(text))

    def encode(self, text: str) -> list[int]:
        parts = self.encode_parts(text)
        return list(map(int, ",".join(parts).split(","))) if parts else []

    def decode_parts(self, parts: list[str]) -> bytes:
        known = self.back
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = list(map(known.get, parts))
        if None in out:
            for i, b in enumerate(out):
                if b is None:
                    out[i] = b"".join(map(self.bytes_of.__getitem__, parts[i].split(",")))
                    if len(out[i]) <= CACHE_CHARS:
                        known[parts[i]] = out[i]
        return b"".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of[str(i)] for i in ids)


def _codec(shared, key: str, pattern: str) -> ByteBpe:
    """One codec a Python worker."""
    return worker_cache(key, lambda: ByteBpe(shared.value, pattern))


def _share(spark: SparkSession, path: str, pattern: str):
    small_batches(spark)
    tokens = read_ranks(path)
    key = "bytes-" + hashlib.sha256(pattern.encode() + b"\0".join(tokens)).hexdigest()
    return spark.sparkContext.broadcast(tokens), key


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>."""
    shared, key = _share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared, key, pattern)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "ids": [codec.encode(t or "") for t in b["_text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInPandas(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes binary: what the ids stand for."""
    shared, key = _share(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared, key, pattern)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "bytes": [codec.decode([] if i is None else i) for i in b["_ids"]]})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.selectExpr(f"`{id_col}` as _id", f"`{ids_col}` as _ids").mapInPandas(run, f"_id {kind}, bytes binary").withColumnRenamed("_id", id_col)


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: id, n_tokens, ids_sha256, decoded_sha256."""
    shared, key = _share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, sha = _codec(shared, key, pattern), hashlib.sha256
        for b in batches:
            n, hashed, back = [], [], []
            for t in b["_text"]:
                parts = codec.encode_parts(t or "")
                ids = ",".join(parts)
                n.append(ids.count(",") + 1 if ids else 0)
                hashed.append(sha(ids.encode()).hexdigest())
                back.append(sha(codec.decode_parts(parts)).hexdigest())
            yield pd.DataFrame({"_id": b["_id"], "n_tokens": n, "ids_sha256": hashed, "decoded_sha256": back})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInPandas(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
