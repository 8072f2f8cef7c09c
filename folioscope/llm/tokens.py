"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter, never part of this package.  A ``.tiktoken``
file (base64 of the bytes, a blank, the rank) is read as byte-level BPE, a
``.json`` file with the ``tokenizers`` library.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Vocabulary used unless another path is given.
VOCABULARY = os.environ.get("FOLIOSCOPE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte-level BPE vocabularies of 50k tokens split a text first (fixed pattern).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; loaded once per worker."""
    if path in _LOADED:
        return _LOADED[path]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        count = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    else:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("folioscope", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        count = lambda texts: [len(own.encode_ordinary(x)) for x in texts]
    _LOADED[path] = count
    return count


def _measure(path: str, other: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = iter(count([t for t in texts if t]))
            own = [next(sizes) if t else (None if t is None else 0) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.int64())], [*other, "tokens"])

    return run


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``; null texts have null, empty ones 0."""
    ship_package(df.sparkSession)
    picked = df.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(_measure(path, keep), f"{schema}, tokens bigint")
