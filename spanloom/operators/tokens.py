"""Token tables of the rule tokenizer, in the form that token alignment reads."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tokenizer import Rules, rule_tokens

#: Rows of a batch that the table is given out in.
ROWS = 200_000


def rule_token_table(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, tok, start): all tokens with their code-point offsets, without a shuffle; a null or empty text has none.

    The pattern runs in the JVM; Python only adds up lengths, a whole batch at a time.
    """
    cut = docs.where(F.length(text) > 0).select(key, rule_tokens(text, rules).alias("tok"))
    schema = StructType([cut.schema[key], *StructType.fromDDL("idx int, tok string, start int").fields])

    def run(batches):
        for batch in batches:
            own = batch.column("tok")
            sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            toks = own.flatten()
            rows = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            lengths = pc.utf8_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(lengths) - lengths
            start = before - before[first[rows]] if len(rows) else before
            idx = np.arange(len(rows)) - first[rows]
            out = pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array(idx, pa.int32()), toks, pa.array(start, pa.int32())], names=[key, "idx", "tok", "start"])
            for at in range(0, len(rows), ROWS):
                yield out.slice(at, ROWS)

    return cut.mapInArrow(run, schema)


def whole_texts(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_sha256, n_chars) of each text put together again from its tokens, without a shuffle.

    tokens: a rule_token_table as it was given out: a text's tokens follow one another in one partition, and idx 0 begins the next one. A text is
    hashed batch by batch, never held whole. n_chars is the end of its last token.
    """
    schema = StructType([tokens.schema[key], *StructType.fromDDL("text_sha256 string, n_chars long").fields])

    def run(batches):
        open_key, digest, end = None, None, 0
        for batch in batches:
            tok, start = batch.column("tok"), batch.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = start + pc.utf8_length(tok).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(batch.column("idx").to_numpy(zero_copy_only=False) == 0)
            keys, hashes, sizes = [], [], []

            def give() -> None:
                keys.append(open_key)
                hashes.append(digest.hexdigest())
                sizes.append(end)

            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(tok)], strict=True):
                if a == b:
                    continue
                if start[a] == 0:
                    if digest is not None:
                        give()
                    open_key, digest = batch.column(key)[a], hashlib.sha256()
                digest.update("".join(tok.slice(a, b - a).to_pylist()).encode())
                end = int(ends[b - 1])
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.schema.field(key).type), pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], names=[key, "text_sha256", "n_chars"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_key.as_py()], open_key.type), pa.array([digest.hexdigest()], pa.string()), pa.array([end], pa.int64())], names=[key, "text_sha256", "n_chars"])

    return tokens.select(key, "idx", "tok", "start").mapInArrow(run, schema)
