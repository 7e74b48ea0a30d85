"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own, in the bucket of its binary length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table

CONTEXT = 1024
END = 0
#: Words of up to LONG characters whose ids a Python worker keeps; when so many are new, those not seen since the last time
#: are forgotten.
CACHE, LONG = 200_000, 64
#: White space as the tokenizer's pattern has it, and letters it takes as such.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Words cut off where no token can cross: after letters that another ASCII character follows, and before white space.
SEGMENT = rf"[ \n]?[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
SPECIAL = "<|endoftext|>"


class Encoder(dict):
    """Ids of words as little-endian bytes, encoded on first sight.

    Words go through the vocabulary's rank file, if it lies beside, which is faster on short strings and gives the same
    ids; those that hold a special token's string, and all where there is no such file, go through the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        import re
        from pathlib import Path

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        ranks = Path(vocabulary.removesuffix(".json") + ".tiktoken")
        self.ranked = self.fast(ranks) if ranks.exists() else lambda word: self.tokenizer.encode(word, add_special_tokens=False).ids
        self.segments = re.compile(SEGMENT).findall
        self.old: dict[str, bytes] = {}

    @staticmethod
    def fast(path):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        import struct

        out = self.old.get(word)
        if out is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids if SPECIAL in word else self.ranked(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) > LONG:
            return out
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.segments(text)))


def shared_encoder(vocabulary: str) -> Encoder:
    """One encoder for all tasks of a Python worker, kept where a reloaded function finds it."""
    import sys
    import types

    kept = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]


def lengths(n: int, context: int = CONTEXT) -> list[int]:
    """Binary lengths of n ids: as many of the context's as fit, then the powers of two of the rest, falling."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset), with the ids if asked for.

    A document's ids end with END; a null or empty text is that id alone. Each piece is a sequence of its own, at
    offset 0: its length is a power of two of at most the context, which must be one itself, so nothing is padded and no
    sequence crosses documents. Pieces of equal length share a bucket (the exponent), and the sequence ids number the
    pieces bucket by bucket, from 0, in the order of (doc_id, start): so any run of ids within a bucket makes a batch of
    equal lengths, and ids depend on the rows alone, not on how they are dealt. Repeated rows are packed each; a null
    doc_id comes first; other columns are not read; an empty table gives an empty result.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = shared_encoder(vocabulary or default_vocabulary())
        end = np.array([END], dtype="<u4").tobytes()

        def flush(rows: list, ids: list) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype("int32") for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

        rows, ids = [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(encoder.encode(text.as_py() or "") + end)
                total, start = len(data) // 4, 0
                for n in lengths(total, context):
                    piece = data[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, zlib.crc32(piece), total))
                    if with_ids:
                        ids.append(bytes(piece))
                    start += n
                if len(rows) >= 20_000:
                    yield flush(rows, ids)
                    rows, ids = [], []
        if rows:
            yield flush(rows, ids)

    kept = cut(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pieces, schema))
    bucketed = kept.withColumn("bucket", F.log2("length").cast("int")).withColumn("offset", F.lit(0).cast("long"))
    return numbered(bucketed, [F.col(c).asc_nulls_first() for c in ("bucket", "doc_id", "start", "doc_tokens", "ids_crc32")], "sequence_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return pack(table(spark, sf_dir, "documents")).select(*columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of pack, which says what becomes of nulls, repeats and empty tables."""
    return pack(docs)
