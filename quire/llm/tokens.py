"""Sizes of texts in tokens of a public tokenizer.

The tokenizer is byte-level BPE for many languages, file ``byte_bpe_multi_50k.tiktoken``; the folder is a parameter.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose token counts a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000


@functools.cache
def encoding(folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE):
    import tiktoken

    with open(os.path.join(folder, file), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens, exactly as encoding the whole text would.

    No piece of the pattern reaches from one word over a space into the next, unless white space stands in a run, so
    words are counted one by one and remembered. A text with such runs is encoded as a whole.
    """

    def __init__(self, folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE):
        self.encode = encoding(folder, file).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.split(" ")
        known, total = self.known, 0
        for i, word in enumerate(words):
            if not word or word[0].isspace():
                return len(self.encode(text))
            if i:
                word = " " + word
            n = known.get(word)
            if n is None:
                n = len(self.encode(word))
                if len(word) < 40:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total


def with_tokens(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """Rows (id, *keep, n_tokens); a null or empty text has 0 tokens."""
    keep = keep or []
    d = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(folder, file)
        for b in batches:
            n = pa.array([counter.count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return d.mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))
