"""Texts to vectors with a pluggable encoder, in batches that are halved where they fail."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], "np.ndarray"]
#: Texts given to the encoder at a time; calls that may fail in one batch before it is given up.
BATCH, RETRIES = 64, 16


def hashed(dim: int = 64) -> Encoder:
    """Encoder without a model: signed feature hashing of words and their parts, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            for w in re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t).lower()):
                h = xxhash.xxh64_intdigest(w)
                row[h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def batched(texts: list[str], encoder: Encoder, batch: int = BATCH, retries: int = RETRIES) -> list[np.ndarray | None]:
    """A vector for each text, None where it failed alone or when the batch's ``retries`` were spent."""

    def run(part: list[str], left: list[int]) -> list[np.ndarray | None]:
        try:
            v = encoder(part)
            if len(v) == len(part):
                return list(v)
        except Exception:  # whatever a foreign encoder raises; the halves are tried
            pass
        left[0] -= 1
        if len(part) == 1 or left[0] <= 0:
            return [None] * len(part)
        mid = len(part) // 2
        return run(part[:mid], left) + run(part[mid:], left)

    return [v for at in range(0, len(texts), batch) for v in run(texts[at : at + batch], [retries])]


def embed(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """(id, vector) of (id long, text); null texts and texts whose encoding fails have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["text"].notna()]
            v = batched(b["text"].tolist(), encoder)
            keep = [i for i, x in enumerate(v) if x is not None]
            yield pd.DataFrame({"id": b["id"].to_numpy()[keep], "vector": [np.asarray(v[i], np.float32) for i in keep]})

    return rows.select("id", "text").mapInPandas(run, "id long, vector array<float>")
