"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.runtime import cut

#: Rank file of a byte-level BPE; every executor must find it under this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary splits text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, columns: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(row, columns, n_tokens): the size of every text, written once to the shared folder.

    ``row`` is a number of its own for every row, also for equal ones; null and empty texts have
    0 tokens; whole texts are counted, however long.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            kept = [name for name in b.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(name) for name in kept), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *columns, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_text") + ", n_tokens bigint"
    return cut(rows.mapInArrow(count, schema))
