"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only, steps, string_column

#: Pieces that one task packs; a group's last open sequences are what it can waste.
GROUP = 40_000
#: Chunks of text whose ids a worker keeps, of at most so many bytes each: about 45 bytes a chunk.
MOST_CHUNKS, CHUNK_BYTES = 400_000, 48
#: Text bytes of chunks that the tokenizer reads as one, and what stands there before a chunk that starts with a sign.
RUN, LEAD = 1 << 14, " a"
#: Text bytes per step.
STEP = 8 << 20


class ChunkEncoder:
    """Ids of whole texts by a tokenizer of the library, which is asked once for each distinct chunk.

    A text is cut where white space follows something else and where a sign other than an apostrophe follows an ASCII
    letter. A byte-level tokenizer with the usual split never has a token across such a place, and what it
    makes of a chunk depends on nothing outside. Texts that hold a special token are cut at white space only;
    other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and spec.get("normalizer") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cuts = plain and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        # Bytes of each token: a byte-level vocabulary spells one as a character, added tokens stand as they are.
        vocabulary, added = self.tokenizer.get_vocab(), set(self.special)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t.encode()) if t in added else len(t) for t in vocabulary]
        blank = np.zeros(256, bool)
        blank[[*range(0x09, 0x0E), 0x20]] = True
        # Last bytes of white space beyond ASCII: nothing is cut behind them, whatever they end here.
        maybe = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
        self.blank, self.before = blank, ~blank
        self.before[maybe] = False
        self.letter, self.sign = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        self.sign[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts, index of each text's first)."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        if not self.cuts:
            return texts, np.arange(len(texts) + 1)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw):
            signs = self.letter[raw[:-1]] & self.sign[raw[1:]]
            for token in self.special:
                for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)):
                    signs[ends[i] : max(ends[i], ends[i + 1] - 1)] = False
            cut[1:-1] = signs | self.before[raw[:-1]] & self.blank[raw[1:]]
        cut[ends[:-1]] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw)), np.searchsorted(at, ends)

    def _one_by_one(self, chunks: pa.Array) -> pa.Array:
        out, texts = [], chunks.to_pylist()
        for a in range(0, len(texts), 20_000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[a : a + 20_000], add_special_tokens=False)]
        return pa.array(out, pa.large_binary())

    def _joined(self, chunks: pa.Array, signs: np.ndarray) -> pa.Array | None:
        """The ids of chunks that run on without a token across, read many at a time; those that start with a sign get a
        letter before them. None if the tokens' bytes don't end where the chunks do."""
        led = pc.if_else(pa.array(signs), pc.binary_join_element_wise(pa.scalar(LEAD, pa.large_string()), chunks, pa.scalar("", pa.large_string())), chunks)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(led).to_numpy(zero_copy_only=False))])
        raw = b"".join(led.cast(pa.large_binary()).to_pylist())
        texts = [raw[ends[a] : ends[b]].decode() for a, b in steps(led, RUN)]
        found = [np.zeros(0, "<u4")]
        for a in range(0, len(texts), 64):
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[a : a + 64], add_special_tokens=False)]
        ids = np.concatenate(found)
        reached = np.concatenate([[0], np.cumsum(self.width[ids])])
        # Of each chunk: where what leads it begins, and where it begins itself.
        starts = np.append(np.stack([ends[:-1], ends[:-1] + len(LEAD) * signs], 1).ravel(), ends[-1])
        at = np.searchsorted(reached, starts)
        if reached[-1] != ends[-1] or (reached[at] != starts).any():
            return None
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)]).take(pa.array(np.arange(1, len(at), 2)))

    def _encoded(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk, as bytes."""
        if not self.cuts or not len(chunks):
            return self._one_by_one(chunks)
        ends = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        raw = np.frombuffer(chunks.buffers()[2], np.uint8)
        signs = self.sign[raw[ends[:-1]]]
        run_on = self.before[raw[ends[1:] - 1]] & (signs | self.blank[raw[ends[:-1]]])
        many = self._joined(chunks.filter(pa.array(run_on)), signs[run_on]) if run_on.any() else None
        if many is None:
            return self._one_by_one(chunks)
        rest = self._one_by_one(chunks.filter(pa.array(~run_on)))
        place = np.where(run_on, np.cumsum(run_on) - 1, len(many) + np.cumsum(~run_on) - 1)
        return pa.concat_arrays([many, rest]).take(pa.array(place))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, which has at least a row in a large_string array."""
        chunks, first = self._chunks(texts)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, value_set=self.known)
        unknown = pc.is_null(at).to_numpy(zero_copy_only=False)
        new = distinct.filter(pa.array(unknown))
        found = self._encoded(new)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown] = len(self.known) + np.arange(len(new))
        parts = pa.concat_arrays([self.known_ids, found]).take(pa.array(place))
        # What is kept are the chunks so far, or those of this step alone where that is too many.
        old, own, own_ids = ([], distinct, parts) if len(self.known) + len(new) > MOST_CHUNKS else ([(self.known, self.known_ids)], new, found)
        short = pc.less_equal(pc.binary_length(own), CHUNK_BYTES)
        self.known, self.known_ids = (pa.concat_arrays(x) for x in zip(*old, (own.filter(short), own_ids.filter(short))))
        flat = parts.take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] // 4
        ids = np.frombuffer(flat.buffers()[2], "<u4") if flat.buffers()[2] is not None else np.zeros(0, "<u4")
        bounds = ends[first]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and end_id, cut into at most `capacity`."""

    def run(batches):
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, at, piece, start, length, crc = string_column(batch.column(1)), [], [], [], [], []
            for low, high in steps(texts, STEP):
                for i, ids in enumerate(encoder.ids(texts.slice(low, high - low)), low):
                    size = len(ids) + 1  # with the end
                    cuts = [0, *range((size - 1) % capacity + 1, size + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        at.append(i)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b]))
                    crc[-1] = zlib.crc32(end, crc[-1])
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column(0), pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = only(docs, doc_id=id_col).schema[0].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class SquaresPacker:
    """Open bins by gap; each piece goes where the sum over gaps of squared counts becomes smallest, be that a new bin."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # of open bins by gap; index 0 and `capacity` stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece. In a tie an open bin goes before a new one, and the smallest gap before larger ones."""
        n, full = self.counts, self.capacity
        # One bin more of gap g adds 2 n[g] + 1, one less adds 1 - 2 n[g]; filled and new bins have no gap to count.
        entering = 2 * n[: full - size + 1] + 1
        entering[0] = 0
        here = n[size:]
        cost = np.where(here > 0, entering + 1 - 2 * here, entering[-1] + 1)  # what has no bin is never cheaper than a new one
        best = int(cost.argmin())
        if here[best] and cost[best] <= entering[-1]:
            gap = size + best
            number = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, number = full, self.bins
            self.bins += 1
        if gap > size:
            n[gap - size] += 1
            self.open[gap - size].append(number)
        return number, full - gap


def pack(pieces: DataFrame, capacity: int = 1024, group: int = GROUP) -> DataFrame:
    """pieces (with `length` from 1 to capacity) with sequence_id and offset.

    Pieces of full length are sequences of their own. The others are dealt into groups of about
    `group` by a hash of the row and packed within a group: those longer than half a sequence first, the longest
    before shorter ones, then the rest in the order of the hash. Each group has its own open
    sequences, so tasks need nothing from each other. Rows with equal columns are each packed.
    An empty table gives an empty result.
    """
    names = pieces.columns
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("bigint")})
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    turn = F.when(F.col("length") * 2 > capacity, F.col("length")).otherwise(0)
    rest = rest.repartition(groups, F.xxhash64(*names)).sortWithinPartitions(turn.desc(), F.xxhash64(*names), *names)

    def run(batches):
        packer, base = SquaresPacker(capacity), TaskContext.get().partitionId() << 33
        for pdf in batches:
            placed = [packer.place(size) for size in pdf.length.tolist()]
            yield pdf.assign(sequence_id=np.array([2 * (base + b) for b, _ in placed], np.int64), offset=np.array([o for _, o in placed], np.int64))

    return rest.mapInPandas(run, full.schema).unionByName(full)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text, as the tokenizers library gives them for the file `tokenizer`
    without special tokens added, and then end_id. One longer than capacity is cut
    into pieces of capacity ids, the first of which may be shorter. A null or empty text is
    end_id alone. Rows are packed each for itself, also those that repeat or have a null id.
    Other columns are ignored; an empty table gives an empty result.
    """
    pieces = materialise(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity)
