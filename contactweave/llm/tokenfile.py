"""Token-ID files in Simple-8b words.

A shard file holds the ids of a run of documents in ascending document order.
Ids are coded in blocks of ``BLOCK`` ids; every block starts at a 64-bit word and
the index holds each block's first word, so a reader decodes all blocks of a file
at once with array operations.

A word's top four bits select how its other 60 bits are cut: selectors 0 to 13
are 1x60, 2x30, 3x20, 4x15, 5x12, 6x10, 7x8, 8x7, 10x6, 12x5, 15x4, 20x3, 30x2 and
60x1 (count x width).  Selector 15 is an escape: the word after it is one raw
64-bit id.  Within a block a coder takes the selector with the largest count that
fits; a block's last word may hold fewer ids than its count.

File: magic ``S8BT0001``; int64 n_docs, n_ids, n_blocks, n_words; then int64
doc_id and uint8 null flag and int64 id count per document; int64 first word per
block; uint64 words.  All little-endian.

Files are written by executors into the shared folder through the file system of
its URI, under a temporary name first and then renamed: a task that is run again
writes the same bytes to the same name.

Defined results: null texts hold the end id alone; null document ids come first;
repeated ids go by their texts' hashes, equal rows in any order; an empty table
gives no files.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactweave.llm.base import bounded_batches, shared_folder, written

MAGIC = b"S8BT0001"
BLOCK = 1024
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
WIDTHS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.uint64)
ESCAPE = 15
#: Bits that each 16-bit id needs.
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
#: Blocks that are coded or decoded at a time, which bounds the working memory.
CHUNK = 256
#: Most distinct parts of words whose ids a worker remembers, about 200 bytes each.
CACHED_PARTS = 500_000


def _fit(ids: np.ndarray) -> np.ndarray:
    """For every row and position, the selector of largest count whose ids all
    fit and are in the row; ``ESCAPE`` where one id needs more than 60 bits.
    Positions past a row's end count as zeros."""
    rows, n = ids.shape
    if int(ids.max()) < len(_BITS):
        bits = _BITS[ids]
    else:
        bits = np.zeros(ids.shape, np.uint8)
        for k in range(int(ids.max()).bit_length()):
            bits += ids >= np.uint64(1) << np.uint64(k)
    best = np.where(bits > 60, ESCAPE, 0).astype(np.uint8)
    alive = bits <= 60
    widest, span = bits.copy(), 1
    for s in range(1, len(COUNTS)):
        while span < COUNTS[s]:
            shifted = np.zeros_like(bits)
            if span < n:
                shifted[:, : n - span] = bits[:, span:]
            np.maximum(widest, shifted, out=widest)
            span += 1
        fits = alive & (widest <= WIDTHS[s])
        if not fits.any():
            break
        best[fits] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of a vector of unsigned 64-bit ids."""
    coder = Coder()
    coder.add(ids)
    return coder.finish()


class Coder:
    """Codes ids as they come, a chunk of blocks at a time: what is held is words,
    and fewer ids than a chunk has."""

    def __init__(self):
        self.n_ids = self.n_words = self.n_waiting = 0
        self.waiting: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []

    def add(self, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.n_waiting += len(ids)
        self.waiting.append(ids)
        if self.n_waiting >= CHUNK * BLOCK:
            held = np.concatenate(self.waiting) if len(self.waiting) > 1 else ids
            whole = len(held) // BLOCK * BLOCK
            for at in range(0, whole, CHUNK * BLOCK):
                self._code(held[at : min(whole, at + CHUNK * BLOCK)])
            self.waiting, self.n_waiting = [held[whole:].copy()], len(held) - whole

    def _code(self, ids: np.ndarray) -> None:
        words, offsets = encode_blocks(ids)
        self.words.append(words)
        self.offsets.append(offsets + self.n_words)
        self.n_words += len(words)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n_waiting:
            self._code(np.concatenate(self.waiting))
            self.waiting, self.n_waiting = [], 0
        return np.concatenate([np.zeros(0, np.uint64), *self.words]), np.concatenate([np.zeros(0, np.int64), *self.offsets])


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` of a chunk, all of whose blocks advance together."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, np.uint64)
    grid[: len(ids)] = ids
    grid = grid.reshape(n_blocks, BLOCK)
    length = np.full(n_blocks, BLOCK)
    length[-1] = len(ids) - (n_blocks - 1) * BLOCK
    selector = _fit(grid)
    step = np.append(COUNTS, [0, 1])[selector]
    # Follow each block's words side by side: at[b] is block b's next id.
    at, live, starts, owners = np.zeros(n_blocks, np.int64), np.arange(n_blocks), [], []
    while len(live):
        starts.append(at[live])
        owners.append(live)
        at[live] += step[live, at[live]]
        live = live[at[live] < length[live]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")  # starts ascend within a block as they are
    start, owner = start[order], owner[order]
    chosen = selector[owner, start]
    padded = np.zeros(n_blocks * BLOCK + 60, np.uint64)
    padded[: n_blocks * BLOCK] = grid.reshape(-1)
    flat = owner * BLOCK + start
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        who = chosen == s
        if s == ESCAPE:
            words[place[who] + 1] = grid[owner[who], start[who]]
            continue
        at_id, room, body = flat[who], BLOCK - start[who], np.zeros(int(who.sum()), np.uint64)
        for k in range(COUNTS[s]):
            value = padded[at_id + k]
            value[room <= k] = 0  # the next block's
            body |= value << (np.uint64(k) * WIDTHS[s])
        words[place[who]] |= body
    first = np.searchsorted(owner, np.arange(n_blocks))
    return words, place[first].astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids that ``encode`` coded."""
    return np.concatenate([np.zeros(0, np.uint64), *decoded_chunks(words, offsets, n_ids)])


def decoded_chunks(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> Iterator[np.ndarray]:
    ends = np.append(offsets[CHUNK::CHUNK], len(words))
    for at, end in zip(range(0, len(offsets), CHUNK), ends.tolist()):
        first, own = offsets[at : at + CHUNK], words[int(offsets[at]) : end]
        plain = not (own >> np.uint64(60) > np.uint64(len(COUNTS) - 1)).any()
        yield (decode_plain if plain else decode_blocks)(own, first - first[0], min(n_ids - at * BLOCK, CHUNK * BLOCK))


def decode_plain(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """``decode`` of a chunk without escapes, ``words`` being its own: where a word's
    ids go follows from the counts before it, so each selector is one step."""
    n_blocks = len(offsets)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    before = np.cumsum(COUNTS[chosen])
    before -= COUNTS[chosen]
    block = np.repeat(np.arange(n_blocks), np.diff(offsets, append=len(words)))
    at = before - before[offsets][block] + block * (BLOCK + 60)
    out = np.zeros(n_blocks * (BLOCK + 60), np.uint64)
    for s in np.unique(chosen):
        who = np.flatnonzero(chosen == s)
        value, to, mask = words[who], at[who], (np.uint64(1) << WIDTHS[s]) - np.uint64(1)
        for k in range(COUNTS[s]):
            out[to + k] = (value >> (np.uint64(k) * WIDTHS[s])) & mask
    return out.reshape(n_blocks, -1)[:, :BLOCK].reshape(-1)[:n_ids]


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """``decode`` of a chunk, all of whose blocks advance together, as an escape's
    second word is known only from the words before it."""
    n_blocks = len(offsets)
    out = np.zeros((n_blocks, BLOCK + 60), np.uint64)
    length = np.full(n_blocks, BLOCK)
    if n_blocks:
        length[-1] = n_ids - (n_blocks - 1) * BLOCK
    at, word, live = np.zeros(n_blocks, np.int64), np.array(offsets, np.int64), np.arange(n_blocks)
    while len(live):
        value = words[word[live]]
        chosen = (value >> np.uint64(60)).astype(np.int64)
        for s in np.unique(chosen):
            who = live[chosen == s]
            if s == ESCAPE:
                out[who, at[who]] = words[word[who] + 1]
                at[who] += 1
                word[who] += 2
                continue
            v = value[chosen == s]
            mask = (np.uint64(1) << WIDTHS[s]) - np.uint64(1)
            lanes = np.arange(COUNTS[s])
            out[who[:, None], at[who][:, None] + lanes] = (v[:, None] >> (lanes.astype(np.uint64) * WIDTHS[s])) & mask
            at[who] += COUNTS[s]
            word[who] += 1
        live = live[at[live] < length[live]]
    return out[:, :BLOCK].reshape(-1)[:n_ids]


def pack(doc_ids: list[int | None], counts: list[int], ids: Coder) -> bytes:
    words, offsets = ids.finish()
    head = np.array([len(doc_ids), ids.n_ids, len(offsets), len(words)], "<i8")
    return b"".join(
        (
            MAGIC,
            head.tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<i8").tobytes(),
            offsets.astype("<i8").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """(doc ids, id counts, ids in chunks) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, n_words = np.frombuffer(data, "<i8", 4, 8)
    at = 40
    docs = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    at += 9 * n_docs
    counts = np.frombuffer(data, "<i8", n_docs, at)
    at += 8 * n_docs
    offsets = np.frombuffer(data, "<i8", n_blocks, at)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * n_blocks)
    return [None if z else int(d) for d, z in zip(docs, null)], counts, decoded_chunks(words, offsets, int(n_ids))


class _Known(dict):
    """What ``work`` gives for a string, remembered for at most ``most`` strings."""

    def __init__(self, work: Callable[[str], bytes], most: int):
        self.work, self.most = work, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.work(key)
        return value


class Encoder:
    """Whole-text ids.

    Texts of printable Latin-1 characters and ASCII white space are lower-cased
    and cut here as the vocabulary file's normalizer and pre-tokenizer do it; the
    parts go to the library's model once and are remembered.  All other texts go
    through the whole tokenizer.  ``fast`` tells whether the short way gave the
    tokenizer's own ids on a trial of character pairs; if not, it isn't used.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        latin = [c for c in map(chr, range(33, 256)) if c.isprintable()]
        pre = self.tokenizer.pre_tokenizer
        table = str.maketrans({c: "".join(x for x, _ in pre.pre_tokenize_str(c)) for c in latin})
        tokenize = self.tokenizer.model.tokenize
        self.parts = _Known(lambda part: array("I", [t.id for t in tokenize(part.translate(table))]).tobytes(), CACHED_PARTS)
        klass = lambda f: "[" + "".join(re.escape(c) for c in latin if f(unicodedata.category(c)[0])) + "]"
        self.cut = re.compile(klass("L".__eq__) + "+|'(?:s|t|re|ve|m|ll|d)|" + klass("N".__eq__) + "|" + klass(lambda k: k not in "LN") + "+").findall
        self.odd = re.compile(r"[^\x20\x09-\x0D" + "".join(map(re.escape, latin)) + "]").search
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        trial = [a + b for a in latin[::3] for b in latin] + ["don't we", "IT'LL\n\tgo", "A1b22\u00bd'RE", "\u00c9T\u00c9. a", "x---y##"]
        self.fast = all(self._short(w) == self._long(w) for w in trial)
        self.parts.clear()

    def _short(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.cut(text.lower())))

    def _long(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def ids(self, texts: list[str | None], end: int) -> list[bytes]:
        """Each text's ids and then ``end``, as little-endian unsigned 32-bit."""
        tail, out = array("I", [end]).tobytes(), []
        for t in texts:
            if not t:
                out.append(tail)
                continue
            short = self.fast and not self.odd(t) and not any(m in t for m in self.marks)
            out.append((self._short(t) if short else self._long(t)) + tail)
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """The process's encoder of a vocabulary file, which tasks share."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _put(folder: str, name: str, data: bytes) -> None:
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    files.move(temporary, f"{base}/{name}")


def _get(folder: str, name: str) -> bytes:
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/{name}", compression=None) as f:
        return f.read()


MANIFEST = "shard int, file int, name string, n_docs bigint, n_ids bigint"


def write_files(docs: DataFrame, folder: str, vocabulary: str, end: int, id_col: str, text_col: str, file_ids: int = 1 << 22) -> DataFrame:
    """Write ``docs`` and return the manifest: one row per file, in order of
    (shard, file).  A shard is a range of document ids; it is cut into files of
    about ``file_ids`` ids.  A task holds a file's words, about 2.5 bytes an id, and
    ids of one chunk."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, n_files = encoder_of(vocabulary), None, 0
        doc_ids, counts, coder = [], [], Coder()

        def flush() -> pa.RecordBatch:
            nonlocal n_files, doc_ids, counts, coder
            name = f"ids-{shard:06d}-{n_files:04d}.s8b"
            _put(folder, name, pack(doc_ids, counts, coder))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": pa.array([n_files], pa.int32()), "name": [name], "n_docs": [len(doc_ids)], "n_ids": [coder.n_ids]})
            n_files, doc_ids, counts, coder = n_files + 1, [], [], Coder()
            return row

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column("shard")[0].as_py() if shard is None else shard
            for d, x in zip(b.column("doc_id").to_pylist(), encoder.ids(b.column("text").to_pylist(), end)):
                doc_ids.append(d)
                counts.append(len(x) // 4)
                coder.add(np.frombuffer(x, "<u4"))
                if coder.n_ids >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "print").sortWithinPartitions("doc_id", "print")
    manifest = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(write, MANIFEST)
    return written(manifest, "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    Files' starts come from running sums of the manifest (a row per file)."""
    spark = manifest.sparkSession
    n_files = manifest.count()
    order = W.orderBy("shard", "file").rowsBetween(W.unboundedPreceding, 0)
    placed = manifest.withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids")).select("name", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                doc_ids, counts, ids = unpack(_get(folder, name))
                raw, ends = b"".join(x.astype("<u4").tobytes() for x in ids), np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, min(n_files, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartition(parts, "name").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(docs: DataFrame, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write all texts' ids and return what the files say of each document."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, vocabulary, end, id_col, text_col), folder)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
