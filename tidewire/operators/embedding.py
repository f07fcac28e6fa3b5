"""Vectors of texts by an encoder that the caller brings, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]


def embedded(texts: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """(key as text, ``embedding``): each text's vector, null for a null text.

    ``make_encoder`` runs once in each task, so a model is loaded where it is used; it gets at most ``batch`` texts at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            values = b.column("text").to_pylist()
            held = [k for k, t in enumerate(values) if t is not None]
            out: list = [None] * len(values)
            for k in range(0, len(held), batch):
                encoder = encoder or make_encoder()
                part = held[k : k + batch]
                for at, v in zip(part, np.asarray(encoder([values[i] for i in part]), np.float32)):
                    out[at] = v
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return texts.selectExpr(f"cast({key} as string) as key", f"{text} as text").mapInArrow(encode, f"{key} string, embedding array<float>")


def hashed_words(dim: int = 384) -> Encoder:
    """An encoder without a model: words and word pairs hashed to signed places, unit length.  The empty text is the zero vector."""
    import xxhash

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            words = text.lower().split()
            for gram in (*words, *map(" ".join, zip(words, words[1:]))):
                h = xxhash.xxh3_64_intdigest(gram)
                row[h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode
