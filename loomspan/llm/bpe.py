"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is a list of part ids beside a list of the merge ranks of
adjacent parts. The encoder scans the ranks for the minimum, joins that pair,
deletes the boundary between them and refreshes the two neighbouring ranks,
until no pair has a rank. Words over ``SHORT`` bytes keep the same order of
merges with a heap over a linked list, so a very long word costs n log n.

Texts are cut into chunks at spaces before a non-space, where no pre-token can
begin earlier or end later; a chunk's ids depend on the chunk alone and are
kept in a bounded cache. The tables come from a tokenizer file whose path is a
parameter; the driver reads it and broadcasts its merges (a fixed size).

Defined results: a null text is an empty one and has no ids; ties, repeated
rows and extra columns, whatever their names, do not matter (each row is coded
alone); texts of any length are coded whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from loomspan.llm.common import BATCH_ROWS, documents, map_batches, whole_row

SHORT = 128
CACHED_CHUNKS = 120_000
CACHED_PIECES = 320_000
LONGEST_CACHED = 64
NO_RANK = 1 << 60

# Unicode's White_Space characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the pre-tokenizer's pattern, with the class above for its \s.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """What a tokenizer file says, in the form the coder uses."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank_of, self.joined = {}, []
        for rank, (left, right) in enumerate(map(lambda m: m.split(" ") if isinstance(m, str) else m, spec["model"]["merges"])):
            self.rank_of[vocab[left] << 32 | vocab[right]] = rank
            self.joined.append(vocab[left + right])


class Cache(dict):
    """A memo of ``make(key)`` in two generations of half its bound.

    When the young one is full it becomes the old one; keys that are met again
    come back from there.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST_CACHED:
                return found
        self[key] = found
        return found


class Coder:
    def __init__(self, tables: Tables):
        self.tables = tables
        self.piece = regex.compile(PIECE)
        self.unsafe = re.compile(r" (?!\S)")
        self.safe_gap = re.compile(r" (?=\S)")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.pieces = Cache(self._piece_ids, CACHED_PIECES)
        self.after_space = Cache(lambda chunk: self._chunk_ids(" " + chunk), CACHED_CHUNKS)
        self.token = [tables.bytes_of.get(i, b"") for i in range(max(tables.bytes_of) + 1)]

    def merge_short(self, ids: list[int]) -> list[int]:
        rank_of, joined = self.tables.rank_of, self.tables.joined
        ranks = [rank_of.get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            ids[at] = joined[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of.get(ids[at] << 32 | ids[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = rank_of.get(ids[at - 1] << 32 | ids[at], NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        rank_of, joined, n = self.tables.rank_of, self.tables.joined, len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = joined[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank_of.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _piece_ids(self, piece: str) -> bytes:
        ids = [self.tables.first[b] for b in piece.encode()]
        return array("I", self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)).tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        pieces, made = self.pieces, []
        for k, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if k % 2:
                made.append(array("I", [self.tables.special[part]]).tobytes())
            else:
                made += map(pieces.__getitem__, self.piece.findall(part))
        return b"".join(made)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = self.safe_gap.split(text) if self.unsafe.search(text) else text.split(" ")
        return self._chunk_ids(chunks[0]) + b"".join(map(self.after_space.__getitem__, chunks[1:]))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, array("I", ids))).decode("utf-8", "replace")


def code(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (little-endian uint32) and ``decoded`` to the rows, in place of columns of these names."""
    return _map(docs, tokenizer, text, lambda raw, back: (raw, back), "token_ids binary, decoded string")


def _map(docs: DataFrame, tokenizer: str, text: str, shape, columns: str) -> DataFrame:
    names = [x.split()[0] for x in columns.split(",")]
    keep = [c for c in docs.columns if c not in names]
    rows = _coded(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text")), tokenizer, shape, columns)
    return rows.select("row.*", *names)


def _coded(source: DataFrame, tokenizer: str, shape, columns: str) -> DataFrame:
    """(row, text) to (row, what ``shape`` makes of ids and decoded text)."""
    tables = source.sparkSession.sparkContext.broadcast(Tables(tokenizer))
    added = [x.strip().split(" ") for x in columns.split(",")]
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}

    def run(batches):
        coder = Coder(tables.value)  # its caches end with the task
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = coder.encode(value.as_py() or "")
                rows.append(shape(raw, coder.decode(raw)))
            new = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["row", *(name for name, _ in added)])

    schema = source.select("row").schema
    for name, kind in added:
        schema = schema.add(name, kind)
    return map_batches(source, run, schema, BATCH_ROWS)


def digests(raw: bytes, back: str):
    return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def code_digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """As ``code``, but ids and decoded text leave the task as their digests."""
    return _map(docs, tokenizer, text, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    out = code_digests(documents(spark, sf_dir), byte_bpe_path())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: adds the token ids (in place of a column of that name); the text is what they decode to."""
    rows = docs.select(whole_row(docs, "text").alias("row"), "text")
    out = _coded(rows, byte_bpe_path(), lambda raw, back: (raw, back), "token_ids binary, decoded string")
    own = [F.col("decoded").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "token_ids"]
    return out.select(*own, "token_ids")
