"""Embeddings with a pluggable provider; the default hashes words and needs no network."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from repoloom.session import spread

DIMENSIONS = 64
#: Characters of a text that a provider is given, and texts per request.
CHARACTERS, BATCH = 100_000, 100
Provider = Callable[[list[str]], list[list[float]]]


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Signed word hashes, scaled to unit length; a text without words is the zero vector. Same words, same vector."""
    out = []
    for text in texts:
        v = np.zeros(dimensions, np.float32)
        for word in text.lower().split():
            h = zlib.crc32(word.encode("utf-8", "replace"))
            v[h % dimensions] += 1.0 if h & 0x8000_0000 else -1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return out


def embed(rows: DataFrame, text_col: str, provider: Provider = hashed, out: str = "embedding") -> DataFrame:
    """``rows`` with a vector per text; a null or blank text has a null vector. One request per ``BATCH`` texts."""
    fields = [f for f in rows.schema.names if f != out]
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            have = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list[list[float] | None] = [None] * len(texts)
            for k in range(0, len(have), BATCH):
                part = have[k : k + BATCH]
                for i, v in zip(part, provider([texts[j][:CHARACTERS] for j in part]), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*fields, out])

    source = spread(rows.select(*fields), fields[0])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + f", {out} array<float>"
    return source.mapInArrow(run, schema)
