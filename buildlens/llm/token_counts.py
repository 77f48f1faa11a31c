"""Token counts with a digest cache.

The cache is a Parquet table (tokenizer string, digest string, n_tokens bigint). A document's
key is the SHA-256 of its content (null normalised to empty; nothing else is changed, since
any change could alter the count) together with the SHA-256 of the tokenizer file. Known
digests are joined, only distinct misses are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.shared import Memo, join_facts, kept, map_arrow, whole, written

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"
#: Pieces whose counts each Python worker remembers.
MEMO = 800_000

_crossing = re.compile(r"\s ")


class PieceCounter:
    """Counts tokens of whole texts, encoding each distinct piece between single spaces once.

    The byte-level pre-tokenizer always starts a new pre-token at a space that follows a
    character other than white space, so such a text falls into pieces that are encoded
    independently. Texts with a space after white space, or with a special string, go to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        pre = self.tok.pre_tokenizer
        self.by_piece = (
            self.tok.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space
        )
        self.memo = Memo(None, MEMO)
        self.memo.make_all = self.piece_lengths

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_lengths(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece with a space before it."""
        return self.lengths([" " + p for p in pieces])

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_piece or _crossing.search(t) or any(s in t for s in self.special):
                out[i] = self.lengths([t])[0]
                continue
            head, *tail = t.split(" ")
            out[i] = sum(self.memo.all(tail)) + (self.lengths([head])[0] if head else 0)
        return out


def piece_counter(path: str) -> PieceCounter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokens", path), lambda: PieceCounter(path))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, text) to cache rows."""

    def run(batch):
        n = piece_counter(path).count(batch.column("text").to_pylist())
        digests = batch.column("digest")
        return pa.RecordBatch.from_arrays(
            [pa.array([version] * len(n), pa.string()), digests.cast(pa.string()), pa.array(n, pa.int64())],
            names=["tokenizer", "digest", "n_tokens"],
        )

    return map_arrow(misses.select("digest", "text"), run, CACHE_SCHEMA, keeps=True)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs(doc_id, text, ...)``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null doc_ids each give a
    row of their own. An empty table gives an empty result. Other columns are ignored, so
    names that clash with the result's do no harm. ``cache_path`` may not exist yet; it is
    created, and rows are appended to it.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    keyed = docs.select("doc_id", whole().alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("digest")
    )
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    known = cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if known.isEmpty():
        misses = distinct
    else:
        misses = distinct.join(known.select("digest"), "digest", "left_anti")
    encode_misses(misses, tokenizer_path, version).write.mode("append").parquet(cache_path)
    counts = (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache_path)
        .where(F.col("tokenizer") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    rows = written(keyed.select("doc_id", "n_bytes", "digest"), "token-digests")
    return join_facts(rows, counts, ["digest"]).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
