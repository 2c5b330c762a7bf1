"""Packing of tokenised documents into sequences of fixed length by bin completion.

Documents are tokenised and ended by one id; only documents longer than a sequence are cut. Whole-length pieces
are sequences of their own. The others are dealt by hash into blocks of about BLOCK pieces and each block is packed
on its own: best-fit decreasing gives the first incumbent, then branch and bound goes through bins in order of
their largest piece, enumerates the fillings around it, of any number of pieces, least waste first, without those
that are seen to be dominated, prunes by the waste that an improvement may still have, and stops at the lower bound
or after NODES nodes. The SPARE emptiest bins of each block are opened again and packed together in another round,
until one block is left.

Defined cases: a null text counts as empty and is one piece of the end id; rows that repeat are packed one by one;
pieces of equal length are packed in any order; texts may be of any length, and only those longer than a sequence are
cut; an empty table gives an empty table. Columns of the documents other than id and text are not carried along.
Columns of pieces are, whatever their names, but for sequence_id and offset, in whose place the results stand.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import column, lean, small_batches, staged, table, worker_cache

LENGTH, END_ID = 4096, 1
#: Pieces in a block, bins of a block that are packed again, and search nodes for a block.
BLOCK, SPARE, NODES = 20_000, 8, 20_000
#: Sizes from which on a first filling is looked for directly; bins whose enumerations are held.
MANY_SIZES, OPEN = 256, 64
#: Words kept with their ids in each Python worker, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 800_000, 48


#: What a definition must say for words of plain characters to be split here instead of by the library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Characters that are their own NFC, whose lower case is one of them, and the split of these characters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: The printable character of each byte in byte-level vocabularies: itself, or the next free one from 256 on.
_ITSELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: b for b in _ITSELF} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_ITSELF))}


class WordTokenizer:
    """Encodes by the tokenizers library; remembers the ids of words between ASCII white space.

    For vocabularies that drop white space and let no token cross it: there a text's ids are those of its words.
    Words of plain characters go straight to the library's merges, where the definition splits as we do.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True
        said = json.loads(definition)
        self.direct = said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        self.merge = self.whole.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            ids = array("I", [t.id for t in self.merge(shown)]).tobytes()
            if len(piece) <= CACHE_BYTES:
                self.pieces[piece] = ids
        return ids

    def _learn(self, words: list[bytes]) -> None:
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        for w in words:
            text = w.decode()
            if self.direct and _PLAIN(text):
                self.known[w] = b"".join(map(self._piece, _PIECES(text.lower())))
            else:
                self.known[w] = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = text.encode().split()
        out = list(map(self.known.get, words))
        if None in out:
            new = list(dict.fromkeys([w for w, ids in zip(words, out, strict=True) if ids is None]))
            self._learn(new)
            out = list(map(self.known.__getitem__, words))
            for w in new:
                if len(w) > CACHE_BYTES:
                    del self.known[w]
        return b"".join(out)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared, key, end = docs.sparkSession.sparkContext.broadcast(definition), f"words-{zlib.crc32(definition.encode())}", end_id.to_bytes(4, "little")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = worker_cache(key, lambda: WordTokenizer(shared.value)).encode
        for b in batches:
            rows = []
            for doc, text in zip(b["_id"], b["_text"], strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype(np.int32)] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]).astype({"_id": b["_id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")).mapInPandas(lean(run, key), f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("_id", id_col)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Best-fit decreasing; each bin as sizes."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for size in sorted(sizes, reverse=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            k, room = len(bins), length
            bins.append([])
        bins[k].append(size)
        if left := room - size:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins


class _Stock:
    """A multiset of sizes with the largest size up to a bound at hand."""

    def __init__(self, sizes: list[int], length: int):
        self.count = [0] * (length + 1)
        self.bits = 0
        for s in sizes:
            self.add(s)

    def add(self, s: int) -> None:
        self.count[s] += 1
        self.bits |= 1 << s

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.bits &= ~(1 << s)

    def smallest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1

    def largest(self, bound: int) -> int:
        """0 if there is none."""
        return (self.bits & ((2 << bound) - 1)).bit_length() - 1 if bound > 0 and self.bits & ((2 << bound) - 1) else 0


def _quick_filling(stock: _Stock, room: int, steps: int = 400) -> tuple[int, ...] | None:
    """A filling without waste, largest pieces first; None if it isn't found soon."""
    chosen: list[int] = []
    small, left, bound = stock.smallest(), room, room
    while steps and left:
        steps -= 1
        s = stock.largest(min(bound, left))
        if left - small < s < left:  # nothing would fit beside it
            s = stock.largest(min(bound, left - small))
        if s:
            stock.take(s)
            chosen.append(s)
            left, bound = left - s, s
        elif chosen:
            s = chosen.pop()
            stock.add(s)
            left, bound = left + s, s - 1
        else:
            break
    for s in chosen:
        stock.add(s)
    return None if left else tuple(chosen)


def _dominated(stock: _Stock, filling: tuple[int, ...], waste: int) -> bool:
    """Whether a piece outside could stand, within the waste, for none, one, two or all of the pieces."""
    for s in filling:
        stock.take(s)
    sums = {a + b for a, b in combinations(filling, 2)} | ({sum(filling)} if len(filling) > 1 else set())
    if waste:
        sums |= {0} | {s + 1 for s in filling}
        hit = any(0 < stock.largest(s + waste - (s - 1 in filling)) >= s for s in sums)
    else:
        hit = any(stock.bits >> s & 1 for s in sums)
    for s in filling:
        stock.add(s)
    return hit


def fillings(stock: _Stock, room: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of a bin's room of any number of pieces, least waste first; None in place of each dominated one.

    While there are many sizes a first filling is looked for directly. Otherwise the sums that can be had from each
    size down are tabulated as bits, so that the enumeration has no dead ends. The stock must be the same whenever
    the next filling is asked for.
    """
    if not stock.largest(room):
        yield ()
        return
    if stock.count[room]:
        yield (room,)  # all others fit within this piece
        return
    first = None
    usable = stock.bits & ((2 << room) - 1)
    if usable.bit_count() > MANY_SIZES:
        first = _quick_filling(stock, room)
        if first:
            yield first
    sizes, bits = [], usable
    while bits:
        sizes.append(bits.bit_length() - 1)
        bits ^= 1 << sizes[-1]
    mask, reach = (2 << room) - 1, [1]
    for s in reversed(sizes):
        sums, many, step = reach[-1], min(stock.count[s], room // s), 1
        while many:
            step = min(step, many)
            sums |= sums << s * step & mask
            many, step = many - step, 2 * step
        reach.append(sums)
    reach.reverse()

    def of_sum(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        while reach[i] >> total & 1:
            s = sizes[i]
            for many in range(min(stock.count[s], total // s), 0, -1):
                if reach[i + 1] >> total - many * s & 1:
                    for rest in of_sum(i + 1, total - many * s):
                        yield (s,) * many + rest
            i += 1

    sums = reach[0] ^ 1
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for f in of_sum(0, total):
            if f != first:
                yield None if _dominated(stock, f, room - total) else f


def pack_sizes(sizes: list[int], length: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of sizes: bin completion with best-fit decreasing as first incumbent."""
    best = best_fit(sizes, length)
    total = sum(sizes)
    least = -(-total // length)
    if len(best) <= least:
        return best
    stock = _Stock(sizes, length)
    path: list[tuple[int, ...]] = []
    waste, used = 0, 0
    asked: list[int] = []  # of each bin, how many of its fillings were looked at
    open_: dict[int, Iterator] = {}  # enumerations of the last bins; those of earlier ones are begun anew

    def following() -> tuple[int, ...] | None:
        """Next filling of the bin at hand; () where there is none left."""
        k, top = len(path), stock.bits.bit_length() - 1
        stock.take(top)
        if k not in open_:
            open_[k] = islice(fillings(stock, length - top), asked[k], None)
            open_.pop(k - OPEN, None)
        found = next(open_[k], False)
        stock.add(top)
        asked[k] += 1
        return () if found is False else None if found is None else (top, *found)

    def back() -> None:
        nonlocal waste
        for s in path[-1]:
            stock.add(s)
        waste -= length - sum(path.pop())

    asked.append(0)
    while used < nodes + 4 * len(best) and len(best) > least:
        pick = following()
        used += 1
        if pick is None:
            continue
        spill = length - sum(pick)
        # An improvement has len(best) - 1 bins at most, so its waste is bounded; later fillings waste no less.
        if not pick or waste + spill > (len(best) - 1) * length - total:
            open_.pop(len(path), None)
            asked.pop()
            if not path:
                break
            back()
            continue
        for s in pick:
            stock.take(s)
        path.append(pick)
        waste += spill
        if stock.bits:
            asked.append(0)
        else:
            best = [list(p) for p in path]
            back()
    return best


def pack_pieces(pieces: DataFrame, length: int = LENGTH, block: int = BLOCK, size_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset; each piece fits a sequence."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    columns = [f"c{i}" for i in range(len(names))]  # so that none clashes with ours
    size_col = columns[names.index(size_col)]
    pieces = staged(pieces.select(*[column(c).alias(a) for c, a in zip(names, columns, strict=True)]).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long").add("_again", "boolean")
    named = lambda df: df.select(*[F.col(a).alias(c) for c, a in zip(names, columns, strict=True)], "sequence_id", "offset")

    def packer(round_: int, spare: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop(columns="_block")
            sizes = rows[size_col].to_numpy()
            waiting: dict[int, list[int]] = {}
            for i, s in enumerate(sizes.tolist()):
                waiting.setdefault(s, []).append(i)
            bins = sorted(pack_sizes(sizes.tolist(), length), key=sum)
            opened = min(spare, len(bins) // 2)  # so that each round has fewer bins
            sequence, offset, again = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.zeros(len(rows), bool)
            for k, content in enumerate(bins):
                at = 0
                for s in content:
                    i = waiting[s].pop()
                    sequence[i], offset[i], again[i] = round_ << 56 | int(key[0]) << 24 | k, at, k < opened
                    at += s
            return rows.assign(sequence_id=sequence, offset=offset, _again=again)

        return run

    full = pieces.filter(F.col(size_col) == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out, rest, round_ = full, pieces.filter(F.col(size_col) < length), 0
    while True:
        n = rest.count()
        blocks = -(-n // block)
        if not blocks:
            return named(out)
        dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(round_)), F.lit(blocks).cast("long")))
        packed = dealt.groupBy("_block").applyInPandas(packer(round_, SPARE if blocks > 1 else 0), schema)
        if blocks == 1:
            return named(out.unionByName(packed.drop("_again")))
        packed = staged(packed, "packed")
        out = out.unionByName(packed.filter("not _again").drop("_again"))
        rest, round_ = packed.filter("_again").select(*columns, "_row"), round_ + 1


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_pieces(tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False))
