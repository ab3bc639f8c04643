"""Token counts of texts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrow import map_blocks
from quillspark.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of byte-level BPE vocabularies, where the vocabulary's package gives none.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once in each worker."""
    if path not in _encoders:
        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text, 0 of a null; a text that the encoder refuses (lone surrogates) counts as bytes."""
    if not text:
        return 0
    try:
        return len(encoder(path).encode_ordinary(text))
    except (UnicodeEncodeError, ValueError):
        return len(text.encode("utf-8", "replace"))


_COUNTED = pa.schema([("id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())])


def token_counts(documents: DataFrame, id_col: str, text_col: str, source_col: str, path: str = VOCABULARY) -> DataFrame:
    """``id, source, n_tokens`` of every row; the source as it is named once case and white space are off."""

    def kernel(ids: list, sources: list, texts: list) -> list:
        return [ids, sources, [count(t, path) for t in texts]]

    rows = spread(documents.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.trim(F.col(source_col).cast("string"))).alias("source"), F.col(text_col).cast("string").alias("text")))
    return map_blocks(rows, "text", kernel, "id bigint, source string, n_tokens bigint", _COUNTED)
