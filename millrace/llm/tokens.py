"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
DIRECTORY = "/opt/tokenizers"


@functools.cache
def encoding(directory: str, vocabulary: str):
    """The tokenizer of one vocabulary file, once per process; its split pattern is in the public tokenizers' package."""
    import public_tokenizers
    import tiktoken

    with open(os.path.join(directory, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PART = 1 << 20


def count(text: str | None, tokenizer) -> int:
    """Tokens of a text; null has none.  Long texts are counted in parts that end before a blank, where the split pattern always splits a word."""
    if not text:
        return 0
    if len(text) <= 2 * PART:
        return len(tokenizer.encode_ordinary(text))
    total, begin = 0, 0
    while begin < len(text):
        end = begin + PART
        if end < len(text):
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace()):
                end += 1
        total += len(tokenizer.encode_ordinary(text[begin:end]))
        begin = end
    return total


def counted(rows: DataFrame, text: str, directory: str = DIRECTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows' other columns with ``tokens`` (long), the number of tokens of ``text``."""
    keep = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(directory, vocabulary)
        for batch in batches:
            n = [count(x, tokenizer) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    return rows.select(*keep, text).mapInArrow(run, f"{schema}, tokens long")
