"""Embedders by name: functions from rows (id, content) to (id, embedding), with the length of their vectors as `dim`."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..schema import EmbeddingError
from .vectors import hash_embedded


class HashEmbedder:
    """Hash embeddings; nothing to load."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __call__(self, rows: DataFrame) -> DataFrame:
        return hash_embedded(rows, dim=self.dim)


class StaticEmbedder:
    """The mean of the vectors of a text's tokens, of length one: a static model, read from a folder that every executor reaches.

    The folder holds tokenizer.json (of the tokenizers library) and vectors.npy (a row for each token); no model is part of
    this repository. Files are opened once in each Python worker; a text without tokens has a zero vector.
    """

    def __init__(self, folder: str) -> None:
        files = [Path(folder) / name for name in ("tokenizer.json", "vectors.npy")]
        if not all(f.is_file() for f in files):
            raise EmbeddingError(f"no static model (tokenizer.json, vectors.npy) in {folder!r}")
        json.loads(files[0].read_text())
        self.folder, self.dim = folder, int(np.load(files[1], mmap_mode="r").shape[1])

    def __call__(self, rows: DataFrame) -> DataFrame:
        folder, dim = self.folder, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tokenizers import Tokenizer

            library, table = Tokenizer.from_file(f"{folder}/tokenizer.json"), np.load(f"{folder}/vectors.npy", mmap_mode="r")
            library.no_padding()
            library.no_truncation()
            for batch in batches:
                out = np.zeros((batch.num_rows, dim), np.float32)
                for k, found in enumerate(library.encode_batch([t or "" for t in batch.column("content").to_pylist()], add_special_tokens=False)):
                    if found.ids:
                        mean = table[found.ids].mean(0)
                        out[k] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-9)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["id", "embedding"])

        chosen = rows.select("id", "content")
        return chosen.mapInArrow(run, StructType([chosen.schema["id"], StructField("embedding", ArrayType(FloatType()))]))


class LazyEmbedder:
    """An embedder that is made when the first rows come; with a known dim, asking for it makes nothing."""

    def __init__(self, make: Callable[[], Callable[[DataFrame], DataFrame]], dim: int | None = None) -> None:
        self._make, self._dim, self._made = make, dim, None

    @property
    def loaded(self) -> bool:
        return self._made is not None

    def _get(self):
        if self._made is None:
            self._made = self._make()
        return self._made

    @property
    def dim(self) -> int:
        return self._get().dim if self._dim is None else self._dim

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self._get()(rows)


def embedder(name: str = "auto", dim: int = 128, folder: str | None = None) -> Callable[[DataFrame], DataFrame] | None:
    """hash; static (of a folder, loaded at first use); null: none, keyword search only; auto: static if a folder is given, else hash. Unknown names are hash."""
    if name == "null":
        return None
    if name == "static" and folder is None:
        raise EmbeddingError("a static embedder needs the folder of its model")
    if name in ("static", "auto") and folder is not None:
        return LazyEmbedder(lambda: StaticEmbedder(folder))
    return HashEmbedder(dim)
