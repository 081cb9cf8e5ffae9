"""Token counts of documents with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.session import materialize

#: Where the vocabulary lies by default; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public byte-level BPE vocabularies cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run without blanks longer than this is counted in pieces, which bounds the merging time of a text.
PIECE = 20_000


def encoder(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def pieces(text: str) -> list[str]:
    """The text in pieces of at most ``PIECE`` characters, cut before a blank where there is one."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        cut = at + PIECE if cut <= at else cut
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            counts = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``docs`` and ``n_tokens`` of ``text`` (0 if null or empty), written once.

    The vocabulary is read by the driver and broadcast: its size (under 2 MB) does not
    depend on the data.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*columns).dtypes)
    counted = docs.select(*columns, F.col(text).alias("__text")).mapInArrow(_count(shared), f"{fields}, n_tokens long")
    return materialize(counted, "tokens")
