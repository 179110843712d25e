"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order, in blocks whose keys are prefix
compressed. After the blocks come a sparse index (the first key and the place of
each block), a Bloom filter of all keys and a footer of fixed length that says where
both are. A lookup reads the footer, asks the filter, finds the block by binary
search and reads that block alone.

    shard:  block* index bloom footer
    block:  (varint shared, varint unshared, varint value bytes, unshared key bytes, value)*
    value:  ids as little-endian unsigned integers of ``width`` bytes
    index:  (varint key bytes, key, varint block offset, varint block bytes)*
    bloom:  bits, of which every key sets HASHES
    footer: FOOTER, with the CRC-32 of index and bloom, the width and MAGIC

Shards are cut by range partitioning, so their order is that of the ids. A task
writes to a name of its own and then moves the file: a task that is run again
replaces the file by the same bytes.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.memory import held
from lumenweave.llm.vocab import public_path
from lumenweave.session import cut, text_batches

MAGIC = b"LWTOKEN1"
#: index offset and bytes, bloom offset and bytes, documents, ids, CRC-32, width, magic
FOOTER = struct.Struct("<QQQQQQIB8s")
BLOCK_BYTES, BITS_PER_KEY, HASHES = 64 << 10, 10, 7
#: Words whose ids a process remembers, and as many older ones.
WORDS_KEPT = 500_000
#: With this in a text, which may be of a special token, its letters are left as they are.
SPECIAL = b"<|"
STOPS = (b".", b",")
#: In a tokenizer's pattern: runs of letters, and runs of what is neither letter, number nor white space.
WORD_RUNS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
META = "part int, name string, n_docs long, n_ids long, first binary"


def key_of(value: int | str | None) -> bytes:
    """Bytes that sort as the ids do; null sorts before all."""
    if value is None:
        return b"\x00"
    return b"\x01" + (struct.pack(">Q", value + (1 << 63)) if isinstance(value, int) else value.encode())


def value_of(key: bytes, integer: bool) -> int | str | None:
    if key == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if integer else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, n_bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % n_bits for i in range(HASHES)]


def write_shard(out, entries: Iterator[tuple[bytes, bytes]], width: int) -> tuple[int, int]:
    """Writes entries in ascending key order to a binary stream; returns how many, and how many ids."""
    index, keys, block = [], [], bytearray()
    offset = n_ids = 0
    first = last = b""

    def flush() -> None:
        nonlocal offset
        if block:
            out.write(bytes(block))
            index.append((first, offset, len(block)))
            offset += len(block)
            block.clear()

    for key, value in entries:
        if len(block) >= BLOCK_BYTES:
            flush()
        shared = len(os.path.commonprefix((last, key))) if block else 0
        if not block:
            first = key
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        block += value
        last = key
        keys.append(key)
        n_ids += len(value) // width
    flush()
    where = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in index)
    bloom = np.zeros(max(8, len(keys) * BITS_PER_KEY), bool)
    for key in keys:
        bloom[_bits(key, len(bloom))] = True
    bits = struct.pack("<Q", len(bloom)) + np.packbits(bloom).tobytes()
    out.write(where + bits)
    out.write(FOOTER.pack(offset, len(where), offset + len(where), len(bits), len(keys), n_ids, zlib.crc32(where + bits), width, MAGIC))
    return len(keys), n_ids


class Shard:
    """An open shard: ``scan()`` reads it from front to back, ``get()`` looks a key up."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, crc, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        tail = self._read(at, n + bloom_n)
        if magic != MAGIC or bloom_at != at + n or zlib.crc32(tail) != crc:
            raise ValueError("this is no whole shard")
        self.index, p = [], 0
        while p < n:
            k, p = _read_varint(tail, p)
            key, p = tail[p : p + k], p + k
            o, p = _read_varint(tail, p)
            b, p = _read_varint(tail, p)
            self.index.append((key, o, b))
        self.firsts = [k for k, _, _ in self.index]
        self.n_bits = struct.unpack_from("<Q", tail, n)[0]
        self.bloom = tail[n + 8 :]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        data, p, key = self._read(at, n), 0, b""
        while p < n:
            shared, p = _read_varint(data, p)
            more, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + more]
            p += more
            yield key, data[p : p + size]
            p += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from self._block(at, n)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def get(self, value: int | str | None) -> np.ndarray | None:
        """The ids of the first document under this id, or None."""
        key = key_of(value)
        if not all(self.bloom[b >> 3] & 128 >> (b & 7) for b in _bits(key, self.n_bits)):
            return None
        # a key that is repeated may begin at the end of the block before the one that it starts
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        for first, offset, n in self.index[at : at + 2]:
            if first <= key:
                for k, v in self._block(offset, n):
                    if k == key:
                        return self.ids(v)
        return None


class WholeIds:
    """Encodes whole texts to the bytes of their ids, with any tokenizer."""

    def __init__(self, tok):
        self.tok = tok
        self.width = 2 if tok.get_vocab_size() <= 1 << 16 else 4

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer does what :class:`WordIds` relies on, by its file: it makes white space one, lower-cases, and then takes runs of letters apart from all else.

    A tokenizer that isn't known to do so is given whole texts.
    """
    many = lambda x, key: [] if x is None else x.get(key, [x])
    normal, before = many(spec.get("normalizer"), "normalizers"), many(spec.get("pre_tokenizer"), "pretokenizers")
    known = {"NFC", "Replace", "Lowercase"}
    lower = bool(normal) and normal[-1]["type"] == "Lowercase" and {x["type"] for x in normal} <= known
    split = bool(before) and before[0]["type"] == "Split" and before[0].get("behavior") == "Removed" and before[0].get("invert") and WORD_RUNS in before[0]["pattern"].get("Regex", "")
    return lower and bool(split) and all(x["type"] == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in before[1:])


class WordIds:
    """Encodes texts to the bytes of their ids.

    The tokenizer's pattern never crosses white space, so the ids of a text are
    those of its words between ASCII white space. Each word is encoded once, in
    company of others, and remembered: the latest words and the ones before them.
    It also lower-cases, and ends a word of letters before a full stop or comma;
    so such words are remembered in one form.
    """

    def __init__(self, tokenizer):
        self.tok = tokenizer
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 200):
            part = [w.decode() for w in words[lo : lo + 200]]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, f"<u{self.width}")
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
            ends = np.searchsorted(at, np.cumsum([len(w) + 1 for w in part]))
            for w, a, b in zip(words[lo : lo + 200], [0, *ends.tolist()], ends.tolist(), strict=False):
                self.known[w] = ids[a:b].tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [(b if SPECIAL in b else b.lower()).split() for b in map(str.encode, texts)]
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        missing = {w for words in split for w in words if w not in self.known}
        ended = [w for w in missing if w[-1:] in STOPS and w[-2:-1].isalpha()]
        missing.difference_update(ended)
        missing.update(x for w in ended for x in (w[:-1], w[-1:]) if x not in self.known)
        self.known.update((w, self.older[w]) for w in missing if w in self.older)
        self._learn([w for w in missing if w not in self.known])
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1:]]
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def encoder(tokenizer: str) -> WordIds | WholeIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    path = public_path(tokenizer)
    with open(path, encoding="utf-8") as f:
        by_words = splits_words(json.load(f))
    return (WordIds if by_words else WholeIds)(Tokenizer.from_file(path))


def word_ids(tokenizer: str) -> WordIds | WholeIds:
    """The encoder of this process: the tasks of a Python worker share what it remembers."""
    return held(("word ids", tokenizer), lambda: encoder(tokenizer))


def _text_groups(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, some MB of text at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size > most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


@dataclass
class Manifest:
    """What was written: the shards in the order of their ids, each with the number of ids before it."""

    folder: str
    shards: list[tuple[str, int, int, int]]  # name, documents, ids, ids before
    integer: bool
    firsts: list[bytes]  # the first key of each shard


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Manifest:
    """Encodes every whole text, appends ``end_id`` and writes the ids in ascending id order under ``folder``.

    ``folder`` is one that driver and executors share. Null texts count as empty
    and have the end id only. A null id sorts first. Rows that repeat an id stand
    next to each other, by text. An empty table writes no shard. Only the figures
    of each shard go to the driver.
    """
    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    integer = kind in ("tinyint", "smallint", "int", "bigint")
    if not integer and kind != "string":
        raise TypeError(f"{id_col} is {kind}; an id is an integer or a string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_ids(tokenizer)
        width = encode.width
        end = end_id.to_bytes(width, "little")
        entries = ((key_of(i), v + end) for ids, texts in _text_groups(batches) for i, v in zip(ids, encode(texts), strict=True))
        one = next(entries, None)
        if one is None:
            return
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, own = f"part-{part:06d}.lwt", f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            n_docs, n_ids = write_shard(out, (e for es in ([one], entries) for e in es), width)
        fs.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [n_docs], "n_ids": [n_ids], "first": [one[0]]})

    shards, before, firsts = [], 0, []
    for r in sorted(cut(rows.mapInArrow(write, META)).collect()):  # a row for each shard
        shards.append((r.name, r.n_docs, r.n_ids, before))
        before += r.n_ids
        firsts.append(bytes(r.first))
    return Manifest(folder, shards, integer, firsts)


def read_token_shards(spark: SparkSession, manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """One row per document, read back: ``id_col, start, n_tokens, ids_crc32``; ``start`` counts the ids before it."""
    folder, integer = manifest.folder, manifest.integer
    shards = spark.createDataFrame([(n, s) for n, _, _, s in manifest.shards], "name string, start long").repartition(max(1, len(manifest.shards)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        kind = pa.int64() if integer else pa.string()
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    shard, rows = Shard(file), []
                    for key, value in shard.scan():
                        ids = shard.ids(value)
                        rows.append((value_of(key, integer), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield as_batch(rows)
                            rows = []
                    if rows:
                        yield as_batch(rows)

    return shards.mapInArrow(read, f"`{id_col}` {'long' if integer else 'string'}, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: Manifest, value: int | str | None) -> np.ndarray | None:
    """The ids of the first document under an id: the manifest says which shard may hold it, whose filter is asked and one block read."""
    fs, base = pafs.FileSystem.from_uri(manifest.folder)
    key = key_of(value)
    # a key that is repeated may begin at the end of the shard before the one that it starts
    at = max(0, bisect.bisect_left(manifest.firsts, key) - 1)
    for (name, *_), first in zip(manifest.shards[at : at + 2], manifest.firsts[at : at + 2], strict=True):
        if first <= key:
            with fs.open_input_file(f"{base}/{name}") as file:
                if (ids := Shard(file).get(value)) is not None:
                    return ids
    return None
