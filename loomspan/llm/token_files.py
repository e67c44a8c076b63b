"""Token ids in flat unsigned-integer files with 64-bit document offsets.

A dataset is a folder with, for every partition p in ascending document order,
``p.bin`` (ids, unsigned 16-bit where the vocabulary fits, else 32-bit, little
endian), ``p.idx`` (int64 offsets into it, one more than documents) and
``p.keys`` (Arrow, the document keys). Partition bases, the ids before each
partition, are prefix sums over the partition totals, in ``manifest.json``.
Files are written under a temporary name and moved, so a retried or a
speculative task leaves whole files, and read through memory maps.

The folder must be one that all executors share. Documents are dealt by key
range, and texts of one key (or without any) by how they begin, into as many
files as their bytes ask for. A task writes and reads a file piece by piece
and keeps 8 bytes a document, so its memory does not depend on the number of
documents.

Defined results: a null text is an empty one and has only the end id; null
keys come first; texts of any length are encoded whole; rows with equal keys are ordered by text; an empty table
gives no files but a manifest and no rows; extra columns do not matter.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspan.llm.common import documents, fresh_folder, map_batches

CACHED_CHUNKS = 1_200_000
#: Bytes of text a file takes, about; characters by which texts of one key are dealt.
PART_BYTES, HEAD = 32 << 20, 200

# Fixed value: ASCII marks that begin neither a contraction nor a special token.
MARK = re.compile(rb"[.,;:!?&#*$%](?<=[a-z].)")


# Fixed value: the word pattern of the tokenizer for which chunks are known to be safe.
CLIP_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class Layout:
    dtype: str
    end_id: int | None


def _store(folder: str):
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def _put(store, path: str, data: bytes) -> None:
    partial = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(partial) as out:
        out.write(data)
    store.move(partial, path)


def splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer lower-cases, drops white space and starts pre-tokens at marks, as ``ChunkCoder.chunks`` takes for granted."""
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [n.get("type") for n in normal.get("normalizers", [normal])]
    pieces = before.get("pretokenizers", [before])
    first = pieces[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    known = first.get("pattern", {}).get("Regex") == CLIP_WORDS
    return "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"} and drops and known


class ChunkCoder:
    """Ids of texts, by way of a bounded cache of white-space-free chunks.

    Where the tokenizer's own file says that it drops white space and no merge
    crosses it, a text's ids are its chunks' ids in order. Chunks that the
    cache lacks are encoded by the library in one batch. The cache has two
    generations of half its bound: when the young one is full it becomes the
    old one, and chunks that are met again come back from there. Texts of any
    other tokenizer are encoded whole.
    """

    def __init__(self, spec: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code, self.known, self.old = np.dtype(dtype).char, {}, {}
        self.chunked = splits_at_blanks(json.loads(spec))

    @staticmethod
    def chunks(text: str | None) -> list[bytes]:
        """White-space-free pieces that no pre-token spans.

        A mark after a letter begins a pre-token, and case does not matter, so
        most words share a piece whatever their case and what follows them.
        """
        if not text:
            return []
        raw = text.encode()
        return raw.split() if b"<|" in raw else MARK.sub(rb" \g<0>", raw.lower()).split()

    def coded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.chunked:
            return self.coded([t or "" for t in texts])
        if len(self.known) > CACHED_CHUNKS // 2:
            self.old, self.known = self.known, {}
        known, old, made = self.known, self.old, []
        missing: dict[bytes, bytes] = {}
        for text in texts:
            chunks = self.chunks(text)
            ids = list(map(known.get, chunks))
            if None in ids:
                for c in (c for c, i in zip(chunks, ids) if i is None):
                    missing[c] = old.get(c)
            made.append((chunks, ids))
        fresh = [c for c, i in missing.items() if i is None]
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            missing.update(zip(some, self.coded([c.decode() for c in some])))
        known.update(missing)
        return [b"".join([missing[c] if i is None else i for c, i in zip(chunks, ids)] if None in ids else ids) for chunks, ids in made]


_CODERS: dict[tuple[str, str], ChunkCoder] = {}


def coder_for(spec: str, dtype: str) -> ChunkCoder:
    """The coder of this Python worker; its cache outlives the task."""
    if (spec, dtype) not in _CODERS:
        _CODERS.clear()
        _CODERS[spec, dtype] = ChunkCoder(spec, dtype)
    return _CODERS[spec, dtype]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> dict:
    """Encode and write ``docs`` in ascending ``key`` order (ties by text), about ``part_bytes`` of text a file; returns the manifest."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    parsed = json.loads(spec)
    largest = max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"]), end_id or 0])
    layout = Layout("<u2" if largest < 1 << 16 else "<u4", end_id)
    shipped = docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file: its size does not follow the data
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # files are as many as the text asks for; rows of one key, or without any, are dealt by how their texts begin, equal ones by chance
    n_parts = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) / part_bytes))
    dealt = rows.withColumn("tie", F.when(F.col("text").isNull() | (F.length("text") < HEAD), F.xxhash64(F.monotonically_increasing_id())))
    rows = dealt.repartitionByRange(n_parts, "key", F.substring("text", 1, HEAD), "tie").sortWithinPartitions("key", "text").drop("tie")

    def run(batches):
        coder, part = coder_for(shipped.value, layout.dtype), TaskContext.get().partitionId()
        end = b"" if layout.end_id is None else np.array([layout.end_id], layout.dtype).tobytes()
        width, offsets, keys, total = np.dtype(layout.dtype).itemsize, [0], [], 0
        store, path = _store(folder)
        name, mark = f"{path}/part-{part:06d}", uuid.uuid4().hex
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, min(1000, batch.num_rows - at))
                out = out or store.open_output_stream(f"{name}.bin.{mark}")
                for coded in coder.encode(some.column(1).to_pylist()):
                    out.write(coded + end)
                    total += (len(coded) + len(end)) // width
                    offsets.append(total)
                keys.append(some.column(0))
        if out is None:
            return
        out.close()
        store.move(f"{name}.bin.{mark}", f"{name}.bin")
        _put(store, f"{name}.idx", np.array(offsets, "<i8").tobytes())
        sink = pa.BufferOutputStream()
        table = pa.table({"key": pa.chunked_array(keys)})
        with pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        _put(store, f"{name}.keys", sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(offsets) - 1]), pa.array([total])], names=["part", "docs", "ids"])

    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    # one row per partition comes back: its number is that of the files
    parts = sorted(map_batches(rows, run, "part long, docs long, ids long").collect())
    bases = np.concatenate([[0], np.cumsum([p["ids"] for p in parts], dtype=np.int64)])
    manifest = {
        "dtype": layout.dtype,
        "end_id": end_id,
        "parts": [{"name": f"part-{p['part']:06d}", "base": int(b), "docs": p["docs"], "ids": p["ids"]} for p, b in zip(parts, bases)],
    }
    _put(store, f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


class Numbers:
    """A flat file of numbers: a memory map on a local store, ranged reads on any other."""

    def __init__(self, store, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        local = isinstance(store, fs.LocalFileSystem)
        self.map = (np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)) if local else None
        self.file = None if local else store.open_input_file(path)

    def part(self, start: int, stop: int) -> np.ndarray:
        if self.map is not None:
            return self.map[start:stop]
        width = self.dtype.itemsize
        self.file.seek(start * width)
        return np.frombuffer(self.file.read((stop - start) * width), self.dtype)


def _pieces(store, path: str, dtype: str):
    """(keys, offsets, ids) of a file's documents, a batch of its keys at a time; offsets count from the batch's first id."""
    ids, offsets, at = Numbers(store, f"{path}.bin", dtype), Numbers(store, f"{path}.idx", "<i8"), 0
    with store.open_input_file(f"{path}.keys") as file:
        keys = pa.ipc.open_file(file)
        for k in range(keys.num_record_batches):
            column = keys.get_batch(k).column(0)
            own = np.array(offsets.part(at, at + len(column) + 1))
            at += len(column)
            yield column, own, ids.part(int(own[0]), int(own[-1]))


def read(spark: SparkSession, folder: str, key_type: str = "long") -> DataFrame:
    """Per document of the files: key, start, n_tokens and ids_crc32."""
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/manifest.json") as file:
        manifest = json.loads(file.read())
    dtype = manifest["dtype"]
    names = spark.createDataFrame([(p["name"], p["base"]) for p in manifest["parts"]], "name string, base long")
    if manifest["parts"]:
        names = names.repartition(len(manifest["parts"]))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _store(folder)
                for keys, offsets, ids in _pieces(store, f"{path}/{name}", dtype):
                    own = (offsets - offsets[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1], own[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(offsets[:-1] + base, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                        names=["key", "start", "n_tokens", "ids_crc32"],
                    )

    return map_batches(names, run, f"key {key_type}, start long, n_tokens long, ids_crc32 long")


def documents_of(folder: str):
    """Driver-side view of a small dataset: (key, ids) in order."""
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/manifest.json") as file:
        manifest = json.loads(file.read())
    for part in manifest["parts"]:
        for keys, offsets, ids in _pieces(store, f"{path}/{part['name']}", manifest["dtype"]):
            own = (offsets - offsets[0]).tolist()
            for k, a, b in zip(keys.to_pylist(), own[:-1], own[1:]):
                yield k, ids[a:b].tolist()


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    write(documents(spark, sf_dir), folder, word_bpe_path(), end_id=2)
    return read(spark, folder).withColumnRenamed("key", "doc_id")
