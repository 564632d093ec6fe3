"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import spread

#: Folder of the public vocabulary files, described in its README.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary(folder: str = TOKENIZER_DIR, file: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, bytes]:
    """The split pattern that the folder's module states (read, not run) and the content of the rank file."""
    with open(os.path.join(folder, "__init__.py")) as source:
        named = {t.id: node.value for node in ast.parse(source.read()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)}
    with open(os.path.join(folder, file), "rb") as lines:
        return ast.literal_eval(named["PATTERN"]), lines.read()


def encoder(pattern: str | None = None, lines: bytes | None = None):
    """The byte-level BPE of a ``vocabulary``, by default that of ``TOKENIZER_DIR``."""
    import tiktoken

    if pattern is None or lines is None:
        pattern, lines = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, text_col: str, out_col: str = "tokens", folder: str = TOKENIZER_DIR, file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``docs`` without the text, with its size in tokens; a null or empty text has 0 tokens. The first other column spreads the rows over tasks. The vocabulary
    (under a megabyte) is read where the query is built and travels with it, so executors need no copy of its folder; it is loaded once per task."""
    kept = [c for c in docs.columns if c != text_col]
    pattern, lines = vocabulary(folder, file)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(pattern, lines)
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            known: dict[str, int] = {}
            sizes = []
            for text in texts:
                if text not in known:
                    known[text] = len(enc.encode_ordinary(text)) if text else 0
                sizes.append(known[text])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(sizes, pa.int64())], [*kept, out_col])

    schema = docs.select(*kept, F.lit(0).cast("bigint").alias(out_col)).schema
    return spread(docs.select(*kept, text_col), kept[0]).mapInArrow(count, schema)
