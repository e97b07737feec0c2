"""Vectors from text by feature hashing: the default embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.constants import EMBEDDING_DIM


def _vectorised(dim: int):
    @F.arrow_udf("array<double>")
    def vectors(tokens: pa.Array) -> pa.Array:
        rows = len(tokens)
        coded = tokens.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # A token's slot and sign come from the first 32 bits of its MD5, taken once per distinct token of the batch.
        numbers = np.array([int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") for token in coded.dictionary.to_pylist()], "i8")
        signs = np.where(numbers // dim % 2 == 0, 1.0, -1.0)
        row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        counts = np.bincount(row * dim + (numbers % dim)[codes], weights=signs[codes], minlength=rows * dim).astype("f8").reshape(rows, dim)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        scaled = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * dim + 1, dim), pa.int32()), pa.array(scaled.ravel()))

    return vectors


def hash_vector(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Signed token counts per slot, scaled to unit length: ``ARRAY<DOUBLE>``; all 0 without tokens.

    The text is cut into tokens by built-in functions; counting runs on the flat arrays of an Arrow batch of them.
    """
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda token: token != "")
    return _vectorised(dim)(tokens)
