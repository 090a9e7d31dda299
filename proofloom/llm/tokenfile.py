"""Token ids in a binary format of separately compressed documents.

A data set is two folders. ``dictionary`` has one row: the zstandard dictionary
trained on serialized id arrays, its SHA-256, and how ids are stored. ``shards``
has one row per shard: a self-contained byte string (layout below) beside the
columns that find it. Parquet is only the container, because Spark's writers
reach every store and commit whole tasks or nothing.

Shard, little-endian:

    4s magic "PLTK", u16 version, u16 bytes an id, 32s SHA-256 of the dictionary,
    u64 documents n, then n i64 doc ids, n u8 whether the id is null,
    n u64 ids in the document, n+1 u64 offsets into the payload, payload

Each document is one zstandard frame, so that one is read without the others.
Documents stand in ascending doc_id order, null ids first and rows of one
doc_id in the order of their frames.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches, trim, worker_cache

MAGIC, VERSION = b"PLTK", 1
HEAD = "<4sHH32sQ"
END_ID = 2
SHARD_BYTES = 4 << 20
BUCKET_DOCS = 4096
BATCH_BYTES = 3 << 20  # a batch looks each of its pieces up once
#: Documents the dictionary is trained on, those of the least keyed hash, and its size in bytes. The documented bound of a sample.
DICT_DOCS, DICT_BYTES = 1000, 64 << 10
CACHED_UNITS = 300_000
FEW_BUCKETS = 100_000


def _plain(c: str) -> bool:
    """Neither white space nor anything that a tokenizer might take for it."""
    return "!" <= c <= "~" or c.isalnum()


#: Latin letters, marks that end a word, and single line ends: pieces whose split into units is plain.
_UNIT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+|[.,;:!?%$&#*|(){}\[\]\"<>=+/~^_@-]+|\n(?=\S)")
_SIMPLE = re.compile(rf"(?:{_UNIT.pattern})+")
#: Most pieces: a word and what follows it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+)([.,;:!?%$&#*|(){}\[\]\"<>=+/~^_@-]*)")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or from U+0100 on in the order of the bytes that are not printable."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by the tokenizers library, asking it only once for each unit of the pieces between single spaces.

    A byte-level split never joins what stands before a white-space run to what
    stands after its start, so a text may be cut before a single space between
    two other characters. Pieces of Latin letters and common marks go to the
    library's model unit by unit; others as they stand, those at doubtful
    characters joined to their neighbours.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = json.loads(self.tokenizer.to_str())["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a word with its marks holds no added token: those here have a mark before a letter, and a word has none
        self.byte_level &= not any(re.search(r"\s", x) or _WORD.search(x) and _WORD.search(x).start() == 0 for x in self.added)
        self.letters = _byte_letters()
        self.units: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), 2048):
            for e in self.tokenizer.encode_batch_fast(pieces[at : at + 2048], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        out = self.units.get(unit)
        if out is None:
            plain = unit.isascii() and unit != "\n"
            letters = unit.replace(" ", self.letters[32]) if plain else unit.encode().decode("latin-1").translate(self.letters)
            out = self.units[unit] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return out

    def _known(self, pieces: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """The ids of each piece after a space, and the pieces at doubtful characters, which have none."""
        found: dict[str, bytes] = {}
        odd, rest = set(), []
        unit, get, word = self._unit, self.units.get, _WORD.fullmatch
        for p in pieces:
            if p.isascii() and p.isalpha():
                p_ = " " + p
                found[p] = get(p_) or unit(p_)
            elif m := word(p):
                core, tail = m.groups()
                core = " " + core
                ids = get(core) or unit(core)
                found[p] = ids + (get(tail) or unit(tail)) if tail else ids
            elif not p or not (_plain(p[0]) and _plain(p[-1])):
                odd.add(p)
            elif _SIMPLE.fullmatch(p) and not any(x in p for x in self.added):
                units = _UNIT.findall(p)
                units[0] = " " + units[0]
                found[p] = b"".join(map(unit, units))
            else:
                rest.append(p)
        found.update(zip(rest, self._encode([" " + p for p in rest])))
        return found, odd

    def _firsts(self, pieces: list[str]) -> list[bytes]:
        """The ids of what stands before a text's first space."""
        out: list[bytes | None] = []
        rest = []
        for p in pieces:
            m = _WORD.fullmatch(p)
            out.append(self._unit(m[1]) + (self._unit(m[2]) if m[2] else b"") if m else None)
            if not m:
                rest.append(p)
        found = self._encode(rest)
        return [next(found) if x is None else x for x in out]

    def __call__(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.byte_level:  # another kind of tokenizer: whole texts
            return list(self._encode(batch))
        split = [t.split(" ") for t in batch]
        seen: set[str] = set()
        for s in split:
            seen.update(s[1:])
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        known, odd = self._known(seen)  # a table for the batch alone: small enough to be quick
        out = []
        for s, first in zip(split, self._firsts([s[0] for s in split])):
            if len(s) == 1:
                out.append(first)
            elif s[0] and _plain(s[0][-1]) and (not odd or odd.isdisjoint(s[1:])):
                out.append(first + b"".join(map(known.__getitem__, s[1:])))
            else:
                out.append(b"".join(self._encode(self._joined(s))))
        return out

    @staticmethod
    def _joined(pieces: list[str]) -> list[str]:
        out = [[pieces[0]]]
        for p in pieces[1:]:
            last = out[-1][-1]
            if last and p and _plain(last[-1]) and _plain(p[0]):
                out.append([" " + p])
            else:
                out[-1].append(" " + p)
        return ["".join(x) for x in out]


def encoder(path: str) -> Encoder:
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def pack(doc_ids: list[int | None], sizes: list[int], frames: list[bytes], id_bytes: int, digest: bytes) -> bytes:
    """The bytes of one shard."""
    n = len(frames)
    return b"".join([
        struct.pack(HEAD, MAGIC, VERSION, id_bytes, digest, n),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array(sizes, "<u8").tobytes(),
        np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(),
        *frames,
    ])


class Shard:
    """Documents of a shard's bytes; ``ids(k)`` decompresses the k-th alone."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, version, self.id_bytes, digest, n = struct.unpack_from(HEAD, blob)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at, arrays = struct.calcsize(HEAD), []
        for kind, count in (("<i8", n), ("u1", n), ("<u8", n), ("<u8", n + 1)):
            arrays.append(np.frombuffer(blob, kind, count, at))
            at += arrays[-1].nbytes
        doc_ids, null, self.sizes, self.offsets = arrays
        self.doc_ids = [None if z else int(x) for x, z in zip(doc_ids, null)]
        self.payload = memoryview(blob)[at:]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(self.payload[self.offsets[k] : self.offsets[k + 1]])
        return np.frombuffer(raw, f"<u{self.id_bytes}").astype("<u4")


def _stored(raw: bytes, id_bytes: int, end_id: int) -> bytes:
    return np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype(f"<u{id_bytes}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, id_bytes: int, end_id: int, dict_docs: int = DICT_DOCS, dict_bytes: int = DICT_BYTES) -> bytes:
    """A dictionary from the serialized ids of ``dict_docs`` documents; empty (plain frames) if they are too few to train on."""
    order = F.xxhash64("doc_id", F.lit(17))
    last = docs.select(order.alias("h")).orderBy("h").limit(dict_docs).agg(F.max("h")).first()[0]
    # dict_docs beginnings of texts at most: what the ids of 64 KB take
    rows = docs.filter(order <= F.lit(last)).select(F.substring("text", 1, 64 << 10)).limit(dict_docs).collect() if last is not None else []
    samples = [_stored(x, id_bytes, end_id)[: 64 << 10] for x in Encoder(tokenizer)([r[0] or "" for r in rows])]
    try:
        return zstandard.train_dictionary(min(dict_bytes, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every row of ``docs``, close it with ``end_id`` and write the data set to ``path``.

    Null text: the empty text, whose only id is the end. Null doc_id and
    repeated rows are written like others. Empty input: no shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    id_bytes = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(own, tokenizer, id_bytes, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dictionary, digest.hex(), id_bytes, end_id)], "dictionary binary, sha256 string, id_bytes int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    n = own.count() // BUCKET_DOCS + 1
    # a doc_id that many rows have is several bounds; rows without one come first, in buckets of their own
    bounds = np.array(own.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], np.int64)
    nulls = own.filter("doc_id is null").count() // BUCKET_DOCS + 1 if n > 1 else 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer)
        pack_up = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            ids = [_stored(x, id_bytes, end_id) for x in run([t or "" for t in b.column(1).to_pylist()])]
            frames = [pack_up.compress(x) for x in ids]
            buckets = buckets_of(b.column(0), np.array([zlib.crc32(x) for x in frames], np.int64), bounds, nulls)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), b.column(0), pa.array([len(x) // id_bytes for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["bucket", "doc_id", "n", "frame"])
        trim()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())])
        at, shard, start, held, size = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, start, held, size
            ids = [x[0] for x in held if x[0] is not None]
            row = (at, shard, min(ids, default=None), max(ids, default=None), start, sum(x[1] for x in held), pack(*map(list, zip(*held)), id_bytes, digest))
            shard, start, held, size = shard + 1, start + row[5], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            for k, doc, count, frame in zip(*(c.to_pylist() for c in b.columns)):
                if held and (k != at or size >= SHARD_BYTES):
                    yield flush()
                if k != at:
                    at, shard, start = k, 0, 0
                held.append((doc, count, frame))
                size += len(frame)
        if held:
            yield flush()

    dealt = own.mapInArrow(encode, "bucket int, doc_id long, n long, frame binary").repartitionById(nulls + len(bounds) + 1, F.col("bucket"))
    out = dealt.sortWithinPartitions("bucket", "doc_id", "frame").mapInArrow(shards, "bucket int, shard int, first_doc long, last_doc long, local_start long, n_ids long, blob binary")
    out.write.parquet(f"{path}/shards")


def buckets_of(doc_ids: pa.Array, digests: np.ndarray, bounds: np.ndarray, nulls: int) -> np.ndarray:
    """The bucket of each row: a number that ascends with doc_id, null ids first.

    A doc_id that is a bound once or more may go to any of the buckets next to
    these bounds, by its digest, so that one id with very many rows is split.
    """
    missing = np.asarray(doc_ids.is_null())
    ids = doc_ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return np.where(missing, digests % nulls, nulls + low + digests % (high - low + 1))


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a data set; start counts the ids of all documents before it.

    ``digest``: ids_crc32 instead of ids, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    found, dictionary = spark.read.parquet(f"{path}/shards"), _dictionary(spark, path)
    starts = found.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("bucket_start"))
    few = starts.limit(FEW_BUCKETS + 1).collect()
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, blob in zip(b.column(0).to_pylist(), b.column(1)):
                s = Shard(blob.as_py(), dictionary)
                sizes = s.sizes.astype(np.int64)
                first = start + np.cumsum(sizes) - sizes
                for at in range(0, len(s), 256):
                    own = range(at, min(at + 256, len(s)))
                    got = [zlib.crc32(s.ids(k).tobytes()) if digest else s.ids(k).tobytes() for k in own]
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[at : at + 256], pa.int64()), pa.array(first[at : at + 256]), pa.array(sizes[at : at + 256]), pa.array(got, kind)], ["doc_id", "start", "n_tokens", last])

    if len(few) <= FEW_BUCKETS:  # 16 bytes each: sent to every task, so that the shards stay where they are
        starts = F.broadcast(spark.createDataFrame(few, starts.schema))
    placed = found.select("bucket", "local_start", "blob").join(starts, "bucket").select((F.col("local_start") + F.col("bucket_start")).alias("start"), "blob")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: the shards' ranges prune the rest, and only their own frames are decompressed."""
    dictionary, wanted = _dictionary(spark, path), set(doc_ids)
    reach = F.lit(False)
    for d in wanted:
        reach |= (F.col("first_doc") <= d) & (F.col("last_doc") >= d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                s = Shard(blob, dictionary)
                own = [k for k, d in enumerate(s.doc_ids) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[k] for k in own], pa.int64()), pa.array([s.ids(k).tobytes() for k in own], pa.binary())], ["doc_id", "ids"])

    return spark.read.parquet(f"{path}/shards").filter(reach).select("blob").mapInArrow(run, "doc_id long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return read(spark, path, digest=True)


def written(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> str:
    """Write to a new path in the shared folder, and return it."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return path
