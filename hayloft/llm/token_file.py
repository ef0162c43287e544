"""Token ids in binary files: an adaptive context-mixing range coder over independent blocks.

Texts are tokenized with a public tokenizer, an end id is appended, and documents are written in
ascending id order. A file row is a chunk of whole documents: their ids and lengths and the coded ids,
cut into up to 1,024 blocks of equal length. Every block starts with fresh models and has its own
checksum, so blocks are coded side by side, one numpy lane each, and a damaged one is found.

Three predictors of the next id are mixed: order 2 and order 1 name the id that followed the same
context last and give it a probability learned for how often it has been right; order 0 gives every
id one, adaptively by its leading two hex digits. The weight between orders 2 and 1 moves to the one that
was right alone. A 64-bit range coder codes the mixture: first which predictor's id it is, if any, then
the id by order 0. All arithmetic is on integers, so reading does not depend on the machine.

Defined cases: null text is empty and holds only the end id; repeated ids are in order of their texts,
null first; rows without an id come first; an empty table gives empty files; a text of any length stays in
one chunk, which is then as large as the text; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayloft.llm.common import arrow_rows, coded, release, slices, split_words, stored, work_dir

END = 1
MAGIC = b"TID1"
LANES, BLOCK_IDS, CHUNK_IDS = 1024, 4096, 4_194_304
CONTEXTS = 4096  # entries of an order's table in a block
FULL = 4096  # probabilities are out of this
SPECIAL = "<|endoftext|>"
CACHED_WORDS = 200_000
ENCODED_AT_ONCE = 4_000  # words; the tokenizer keeps strings and places of all their pieces
BATCH_TEXTS = 1_000  # rows of an Arrow batch, which the JVM and the worker hold side by side


class Words:
    """Ids of space-delimited words, remembered within a worker up to a bound.

    The tokenizer drops white space before it cuts a text into pieces, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for work burn others
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SPECIAL)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.empty(0, np.uint16), np.empty(0, np.int32), np.empty(0, np.int32)

    def _add(self, new: list[str]) -> None:
        """Encode words in groups with a separator between them; its ids stay in the store, outside all words."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = [v for v in new if "<|" not in v and "|>" not in v]
        alone = [v for v in new if "<|" in v or "|>" in v]
        groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        coded_ids, starts, lengths, size = [self.ids], [self.starts], [self.lengths], len(self.ids)
        for one in encode([SPECIAL.join(g) for g in groups], add_special_tokens=False):
            ids = np.array(one.ids, np.uint16)
            bounds = np.concatenate([[-1], np.flatnonzero(ids == self.separator), [len(ids)]]).astype(np.int32)
            coded_ids.append(ids)
            starts.append(size + bounds[:-1] + 1)
            lengths.append(np.diff(bounds) - 1)
            size += len(ids)
        for v in alone:
            ids = np.array(self.tokenizer.encode(v, add_special_tokens=False).ids, np.uint16)
            coded_ids.append(ids)
            starts.append(np.array([size], np.int32))
            lengths.append(np.array([len(ids)], np.int32))
            size += len(ids)
        self.place.update(zip(plain + alone, range(len(self.lengths), len(self.lengths) + len(new))))
        self.ids, self.starts, self.lengths = (np.concatenate(x) for x in (coded_ids, starts, lengths))

    def lookup(self, values: list[str]) -> np.ndarray:
        new = [v for v in values if v not in self.place]
        if len(self.place) + len(new) > CACHED_WORDS and self.place:
            self.clear()
            new = values
        for k in range(0, len(new), ENCODED_AT_ONCE):
            self._add(new[k : k + ENCODED_AT_ONCE])
        return np.fromiter(map(self.place.__getitem__, values), np.int32, len(values))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of each text's ids."""
        raw, rows = split_words(text)
        distinct, place = coded(raw)
        known = self.lookup(distinct.to_pylist())
        word = known.take(place) if len(raw) else np.empty(0, np.int32)
        ends = np.searchsorted(rows, np.arange(1, len(text) + 1))
        word = np.insert(word, ends, len(self.starts))
        size = np.append(self.lengths, np.int32(1)).take(word)
        upto = np.cumsum(size, dtype=np.int64)
        at = np.append(self.starts, np.int32(len(self.ids))).take(word) - (upto - size)
        ids = np.append(self.ids, np.uint16(END)).take(np.repeat(at, size) + np.arange(upto[-1] if len(upto) else 0))
        bounds = np.concatenate([[0], upto[ends + np.arange(len(ends))]])
        return ids, np.diff(bounds)


class Model:
    """Predictors and mixer of all lanes; coder and decoder call it alike."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        # both orders in one array, order 2 in the first half: per context the id that came last, and above its 16 bits
        # 0 to 4 for how often it has been right
        orders = np.arange(2 * lanes).reshape(2, lanes)
        self.tables, self.states = orders * CONTEXTS, orders * 5
        self.seen = np.zeros(2 * lanes * CONTEXTS, np.int32)
        self.right = np.tile(np.array([0, 800, 2000, 3000, 3600], np.int32), 2 * lanes)
        self.weights = np.full((2, lanes), FULL // 2, np.int32)  # they add up to FULL
        even = np.arange(17, dtype=np.int16) * (FULL // 16)
        self.first = np.tile(even, (lanes, 1))
        self.second = np.tile(even, (lanes * 16, 1))
        self.last = np.zeros(lanes, np.uint32)
        self.last_but_one = np.zeros(lanes, np.uint32)
        self.hashes = np.empty((2, lanes), np.uint32)
        # where a cumulative table moves to after each digit, keeping every step at 16 or more
        self.pull = np.array([[16 * k + (FULL - 256 if k > d else 0) for k in range(17)] for d in range(16)], np.int16)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids named by orders 2 and 1, and their probabilities in the mixture."""
        two, one = self.hashes
        np.multiply(self.last, np.uint32(0x9E3779B1), out=one)
        np.multiply(self.last_but_one, np.uint32(0xC2B2AE35 * 0x27D4EB2F & 0xFFFFFFFF), out=two)
        two ^= self.last * np.uint32(0x85EBCA6B)
        self.at = self.tables + (self.hashes >> np.uint32(20))
        seen = self.seen.take(self.at)
        self.named, self.state = seen & 0xFFFF, seen >> 16
        self.slot = self.states + self.state
        self.chance = self.right.take(self.slot)
        m2, m1 = (self.weights * self.chance) >> 12
        same = self.named[0] == self.named[1]
        m2 += m1 * same
        m1 *= ~same
        return self.named[0], self.named[1], m2, m1

    def update(self, ids: np.ndarray) -> None:
        hit, old = self.named == ids, self.state > 0
        self.right[self.slot] = (self.chance + ((hit * np.int32(4064) - self.chance) >> 5)) * old
        self.seen[self.at] = ids | ((1 + np.minimum(self.state, 3) * (hit & old)) << 16)
        weight = self.weights[0]
        weight += ((np.where(hit[0], np.int32(FULL - 64), np.int32(64)) - weight) >> 4) * (hit[0] != hit[1])
        np.subtract(FULL, weight, out=self.weights[1])
        self.last_but_one = self.last
        self.last = ids.astype(np.uint32)


def _learn(table: np.ndarray, rows: np.ndarray, cells: np.ndarray, digit: np.ndarray, pull: np.ndarray) -> None:
    move = pull.take(digit, axis=0)
    move -= cells
    move >>= 5
    move += cells
    table[rows] = move


def _parts(two: np.ndarray, one: np.ndarray, m2: np.ndarray, m1: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the part that order 2, order 1 or none of them has in the mixture."""
    return np.where(two, 0, np.where(one, m2, both)), np.where(two, m2, np.where(one, m1, FULL - both))


LOW32 = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)
LEAST = np.uint64(2**32)


class Coder:
    """Interval of each lane. A span below 2**32 hands its 32 leading bits over, after a cut at the next
    multiple of 2**32 if it crosses one, so that no carry is left."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow_all(self, step: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.low += begin.astype(np.uint64) * step
        np.multiply(size.astype(np.uint64), step, out=self.span)

    def narrow(self, some: np.ndarray, step: np.ndarray, begin: np.ndarray, size: np.ndarray | int) -> None:
        self.low[some] += begin.astype(np.uint64) * step
        self.span[some] = step if isinstance(size, int) else size.astype(np.uint64) * step

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Lanes that hand over, and their leading bits."""
        some = np.flatnonzero(self.span < LEAST)
        low, span = self.low.take(some), self.span.take(some)
        crosses = (low ^ (low + span)) >= LEAST
        span = np.where(crosses, (~low + np.uint64(1)) & LOW32, span)
        self.low[some], self.span[some] = low << SHIFT, span << SHIFT
        return some, low >> SHIFT


def encode_blocks(ids: np.ndarray) -> bytes:
    """A chunk's ids as blocks: lane count and length, then words and checksum of each block, then the words."""
    lanes = max(1, min(LANES, -(-len(ids) // BLOCK_IDS)))
    length = -(-len(ids) // lanes)
    grid = np.zeros(lanes * length, np.uint16)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, length)
    sums = np.array([zlib.crc32(row.tobytes()) for row in grid], np.uint32)
    columns = np.ascontiguousarray(grid.T)
    del ids, grid  # two copies fewer while the models are held
    model, coder = Model(lanes), Coder(lanes)
    out, used = np.empty((lanes, length + 8), np.uint32), np.zeros(lanes, np.int64)

    def settle() -> None:
        some, words = coder.settle()
        out[some, used[some]] = words
        used[some] += 1

    for k, column in enumerate(columns):
        column = column.astype(np.int32)
        if k % 64 == 0 and used.max() + 256 > out.shape[1]:
            out = np.concatenate([out, np.empty((lanes, length + 256), np.uint32)], axis=1)
        c2, c1, m2, m1 = model.predict()
        two = (column == c2) & (m2 > 0)
        one = (column == c1) & (m1 > 0) & ~two
        both = m2 + m1
        none = ~(two | one)
        coder.narrow_all(coder.span >> np.uint64(12), *_parts(two, one, m2, m1, both))
        rest = np.flatnonzero(none)
        here = column.take(rest)
        digits = here >> 12, (here >> 8) & 15
        for table, row, digit in ((model.first, rest, digits[0]), (model.second, rest * 16 + digits[0], digits[1])):
            cells = table.take(row, axis=0)
            at = np.arange(len(row)) * 17 + digit
            begin = cells.take(at)
            coder.narrow(rest, coder.span.take(rest) >> np.uint64(12), begin, cells.take(at + 1) - begin)
            _learn(table, row, cells, digit, model.pull)
            if table is model.first:
                settle()
        coder.narrow(rest, coder.span.take(rest) >> np.uint64(8), here & 255, 1)
        settle()
        model.update(column)
    for shift in (SHIFT, np.uint64(0)):
        out[model.lane, used] = ((coder.low >> shift) & LOW32).astype(np.uint32)
        used += 1
    head = struct.pack("<4sII", MAGIC, lanes, length) + used.astype("<u4").tobytes() + sums.astype("<u4").tobytes()
    return head + b"".join(out[k, : used[k]].astype("<u4").tobytes() for k in range(lanes))


def decode_blocks(data: bytes, count: int) -> np.ndarray:
    """The ``count`` ids that ``encode_blocks`` got; raises if a block's checksum differs."""
    magic, lanes, length = struct.unpack_from("<4sII", data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    sizes = np.frombuffer(data, "<u4", lanes, 12).astype(np.int64)
    sums = np.frombuffer(data, "<u4", lanes, 12 + 4 * lanes)
    words = np.append(np.frombuffer(data, "<u4", int(sizes.sum()), 12 + 8 * lanes), np.zeros(4, np.uint32)).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    model, coder = Model(lanes), Coder(lanes)
    code = (words[at] << SHIFT) | words[at + 1]
    at = at + 2
    grid = np.empty((length, lanes), np.uint16)

    def settle() -> None:
        some, _ = coder.settle()
        code[some] = (code.take(some) << SHIFT) | words.take(at.take(some), mode="clip")
        at[some] += 1

    def place(some: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the code lies, out of 2 ** bits, and the size of one part."""
        step = coder.span.take(some) >> np.uint64(bits)
        return np.minimum((code.take(some) - coder.low.take(some)) // step, np.uint64((1 << bits) - 1)).astype(np.int16), step

    for k in range(length):
        c2, c1, m2, m1 = model.predict()
        step = coder.span >> np.uint64(12)
        v = np.minimum((code - coder.low) // step, np.uint64(FULL - 1)).astype(np.int32)
        both = m2 + m1
        two, none = v < m2, v >= both
        one = ~(two | none)
        coder.narrow_all(step, *_parts(two, one, m2, m1, both))
        ids = c2 * two + c1 * one
        rest = np.flatnonzero(none)
        value = np.zeros(len(rest), np.int64)
        for table in (model.first, model.second):
            row = rest if table is model.first else rest * 16 + value
            cells = table.take(row, axis=0)
            v, step = place(rest, 12)
            digit = (cells > v[:, None]).argmax(axis=1) - 1
            here = np.arange(len(row)) * 17 + digit
            begin = cells.take(here)
            coder.narrow(rest, step, begin, cells.take(here + 1) - begin)
            _learn(table, row, cells, digit, model.pull)
            value = value * 16 + digit
            if table is model.first:
                settle()
        v, step = place(rest, 8)
        coder.narrow(rest, step, v, 1)
        ids[rest] = value * 256 + v
        settle()
        model.update(ids)
        grid[k] = ids
    blocks = np.ascontiguousarray(grid.T)
    for k in range(lanes):
        if zlib.crc32(blocks[k].tobytes()) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    return blocks.reshape(-1)[:count]


SCHEMA = "part int, chunk long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, blocks binary"


def _chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        waiting = 0
        words = Words(path)  # of this task only: a reused worker should not keep tokenizer and words while it decodes

        def flush():
            nonlocal chunk, waiting
            ids = [np.concatenate(held)]
            held.clear()
            release()  # what the tokenizer has freed makes room for the models
            data = encode_blocks(ids.pop())
            row = [[part], [chunk], [waiting], [list(docs)], [list(lengths)], [data]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            chunk, waiting = chunk + 1, 0
            for x in (docs, lengths):
                x.clear()
            release()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "chunk", "n_ids", "doc_ids", "lengths", "blocks"])

        for batch in slices(batches, "text", 1_000_000):
            ids, sizes = words.encode(batch.column("text"))
            names, begin = batch.column("doc_id").to_pylist(), 0
            for name, size in zip(names, sizes.tolist()):
                if waiting and waiting + size > CHUNK_IDS:
                    yield flush()
                docs.append(name)
                lengths.append(size)
                held.append(ids[begin : begin + size].copy())  # not a view that keeps the slice
                begin, waiting = begin + size, waiting + size
        if waiting:
            yield flush()
        del words
        release()

    return run


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenize ``docs(doc_id, text)`` and write the ids as chunks in ascending id order."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    with arrow_rows(spark, BATCH_TEXTS):
        ordered.mapInArrow(_chunks(tokenizer), SCHEMA).write.parquet(path)


def starts(chunks: DataFrame) -> DataFrame:
    """``(part, chunk, base)``: ids before each chunk."""
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("p"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("chunk"))), F.lit(0))
    return chunks.select("part", "chunk", inside.alias("c")).join(parts, "part").select("part", "chunk", (F.col("p") + F.col("c")).alias("base"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
            ids = decode_blocks(batch.column("blocks")[k].as_py(), batch.column("n_ids")[k].as_py()).astype("<u4")
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(memoryview(ids[a:b])) for a, b in zip(ends - lengths, ends)]
            count = len(lengths)
            arrays = [pa.array([batch.column(c)[k].as_py()] * count, t) for c, t in (("part", pa.int32()), ("chunk", pa.int64()))]
            arrays += [batch.column("doc_ids").slice(k, 1).flatten(), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "doc_id", "offset", "n_tokens", "ids_crc32"])
            release()


def read_documents(spark, path: str) -> DataFrame:
    """Decode the files: ``(doc_id, start, n_tokens, ids_crc32)`` for each document.

    What a document's ids give is stored: a plan that is run again, or replanned, does not decode again.
    """
    chunks = spark.read.schema(SCHEMA).parquet(path)
    with arrow_rows(spark, 1):  # a chunk is megabytes
        decoded = stored(chunks.mapInArrow(_documents, "part int, chunk long, doc_id long, offset long, n_tokens long, ids_crc32 long"), "decoded")
    placed = decoded.join(starts(chunks.select("part", "chunk", "n_ids")), ["part", "chunk"])
    return placed.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write to the shared scratch folder and read back."""
    path = work_dir(docs.sparkSession, "token-files")
    write(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)
