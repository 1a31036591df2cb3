"""Byte-level BPE encoding and decoding by forced-boundary splitting, and token counts by distinct pre-token.

A pair of bytes that stands next to each other inside no vocabulary token can never be merged over: between such bytes a cut is certain. Each
pre-token is cut there, the fragments are encoded independently and their ids concatenated; a fragment is bounded by the vocabulary and not by the
text, so a very long pre-token costs no more a byte than a short one. Cutting happens within pre-tokens, as the pre-token pattern looks at
characters on both sides of a place. Added tokens inside a text are taken as the tokenizers library takes them by default: as their ids.

Defined results: a null text counts as empty and has no ids; repeated rows are handled each for itself; ids and pre-tokens of whole texts count;
a null doc_id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from kindred.llm.arrow import column, giving_back, slices, texts
from kindred.llm.counts import frequent_from
from kindred.plans.scratch import Scratch

#: Fixed value: the pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each of a worker's two generations of cached pre-tokens, and characters of the longest one in them.
CACHE, CACHED_CHARS = 200_000, 64


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Bpe:
    """A tokenizers file of kind byte-level BPE."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or stand alone are not supported")
        symbol = byte_symbols()
        raw = lambda token: bytes(symbol[c] for c in token)
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.model = Tokenizer.from_buffer(blob).model
        self.stand_in = {b: c for c, b in symbol.items()}
        self.joint = bytearray(1 << 16)
        for t in ids:
            for a, b in zip(t, t[1:]):
                self.joint[a << 8 | b] = 1
        self.pattern = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens and added tokens in order. No pre-token equals an added token unless it is one."""
        if self.splits is None or not any(a in text for a in self.added):
            return self.pattern.findall(text)
        out = []
        for part in self.splits.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out += self.pattern.findall(part)
        return out

    def cut(self, piece: bytes) -> list[bytes]:
        """Fragments between forced boundaries."""
        out, start, joint = [], 0, self.joint
        for i in range(1, len(piece)):
            if not joint[piece[i - 1] << 8 | piece[i]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def encode_piece(self, piece: str) -> list[int]:
        if piece in self.added:
            return [self.added[piece]]
        return [t.id for f in self.cut(piece.encode()) for t in self.model.tokenize(f.decode("latin-1").translate(self.stand_in))]

    def encode(self, text: str) -> bytes:
        """The text's ids as 32-bit integers."""
        young, out = self.young, []
        for piece in self.pre_tokens(text):
            ids = young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    ids = array("i", self.encode_piece(piece)).tobytes()
                if len(piece) <= CACHED_CHARS:
                    if len(young) >= CACHE:
                        self.old, self.young = young, {}
                        young = self.young
                    young[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[bytes, Bpe] = {}


def loaded(blob) -> Bpe:
    """The tokenizer of a broadcast file, once a worker."""
    if blob.value not in _LOADED:
        _LOADED.clear()
        _LOADED[blob.value] = Bpe(blob.value)
    return _LOADED[blob.value]


def _file(spark, path: str):
    """The tokenizer file, of a few MB whatever the corpus, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text read back from the ids)."""
    blob = _file(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(blob)
        for batch in slices(batches, "text"):
            rows = [bpe.encode(t) for t in texts(batch, "text")]
            ends = [0]
            for r in rows:
                ends.append(ends[-1] + len(r) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(rows))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            decoded = [bpe.decode(list(memoryview(r).cast("i"))) for r in rows]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of ``encode_decode``'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Pre-tokens, the most frequent ones, that are joined by broadcast: keys of CACHED_CHARS characters or a digest, some 50 MB.
COMMON = 500_000
#: How the table of frequencies is written: words repeat, so a larger dictionary pays.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def pre_token_frequencies(docs: DataFrame, blob, scratch: Scratch) -> DataFrame:
    """uid, doc_id, n_bytes, pieces, counts: each document's distinct pre-tokens and how often it has them, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(blob)
        for batch in slices(batches, "text"):
            size, pieces, counts, ends = [], [], [], [0]
            for t in texts(batch, "text"):
                seen = Counter(bpe.pre_tokens(t))
                size.append(len(t.encode()))
                pieces += seen
                counts += seen.values()
                ends.append(len(pieces))
            at = pa.array(ends, pa.int32())
            listed = [pa.ListArray.from_arrays(at, pa.array(pieces, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, "uid"), column(batch, "doc_id"), pa.array(size, pa.int64()), *listed], ["uid", "doc_id", "n_bytes", "pieces", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    return scratch.cut(rows.mapInArrow(run, "uid long, doc_id long, n_bytes long, pieces array<string>, counts array<long>"), **PACKED)


def _key(piece: str):
    """The pre-token, or for a longer one a digest (of another length, so that the two can't be mistaken for each other)."""
    return F.when(F.length(piece) > CACHED_CHARS, F.concat(F.lit("#"), F.sha2(piece, 256))).otherwise(F.col(piece))


def vocabulary(table: DataFrame, blob, scratch: Scratch) -> DataFrame:
    """key, n (occurrences in all documents), tokens: each distinct pre-token's pieces are counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(blob)
        for batch in slices(batches, "piece"):
            n = [len(bpe.encode_piece(p)) for p in texts(batch, "piece")]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "n"), pa.array(n, pa.int64())], ["key", "n", "tokens"])

    pieces = table.select(F.inline(F.arrays_zip(F.col("pieces").alias("piece"), F.col("counts").alias("times")))).groupBy("piece").agg(F.sum("times").alias("n"))
    return scratch.cut(pieces.select(_key("piece").alias("key"), "n", "piece").mapInArrow(count, "key string, n long, tokens long"), compression="zstd")


def count_tokens(docs: DataFrame, tokenizer: str, scratch: Scratch, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens. No ids are made: pieces per distinct pre-token are joined to each document's pre-token frequencies and summed.

    The most frequent pre-tokens are joined by broadcast, a table of at most ``common`` short keys; all others by a shuffle on the key. So no pre-token is
    a hot key, however long it is.
    """
    blob = _file(docs.sparkSession, tokenizer)
    table = pre_token_frequencies(docs, blob, scratch)
    words = vocabulary(table, blob, scratch)
    often = F.broadcast(words.where(F.col("n") >= max(2, frequent_from(words, common))).select("key", "tokens"))
    said = table.select("uid", F.inline(F.arrays_zip(F.col("pieces").alias("piece"), F.col("counts").alias("times")))).select("uid", _key("piece").alias("key"), "times")
    # Occurrences of common pre-tokens are summed before they leave the task: a row a document.
    near = said.join(often, "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("tokens")).alias("total"))
    far = said.join(often, "key", "left_anti").join(words.select("key", "tokens"), "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("tokens")).alias("total"))
    nothing = F.lit(None).cast("long")
    both = table.select("uid", "doc_id", "n_bytes", F.lit(0).cast("long").alias("total"))
    for part in (near, far):
        both = both.unionByName(part.select("uid", nothing.alias("doc_id"), nothing.alias("n_bytes"), "total"))
    return both.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("total").alias("n_tokens")).drop("uid")


def op6_bpe_forced_boundaries(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "tokens")).withColumn("over_limit", F.col("n_tokens") > 512)
