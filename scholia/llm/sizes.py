"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import spread


def default_tokenizer() -> str:
    """Where the installed public tokenizers keep their byte-level vocabulary; any file of ranks may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Fixed value: how byte-level tokenizers of this family cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, *keep) of each document; null and empty texts have 0 tokens.

    ``tokenizer`` is the path of a file of ranks, which the executors read.
    """
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("_text"), *keep)
    kinds = dict(src.dtypes)
    names = ["doc_id", "n_tokens", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            counts = [0 if not t else len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *b.columns[2:]], names=names)

    return spread(src).mapInArrow(run, ", ".join(f"{n} {'bigint' if n == 'n_tokens' else kinds[n]}" for n in names))
