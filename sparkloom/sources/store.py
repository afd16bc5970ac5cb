"""Layers of knowledge and logs as JSON lines, one folder for each layer; layers go by the short names below.

What belongs together is committed as a batch: its layers are written to a folder
that no reader looks at, and become part of their layers all at once when the batch's
manifest, which names them, is put in place by a rename. A run that stops before that
has written nothing; it writes the same batch anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .folders import removed

#: Layers and their folders.
LAYERS = {
    "k1": "schema_extraction.jsonl",
    "k2": "domain_analysis.jsonl",
    "k3": "field_analysis.jsonl",
    "k4": "column_analysis.jsonl",
    "k5": "table_analysis.jsonl",
    "k6": "er_analysis.jsonl",
    "questions": "questions.jsonl",
    "sql_results": "sql_results.jsonl",
    "diagnosis_trace": "diagnosis_trace.jsonl",
    "corpus_manifest": "corpus_manifest.jsonl",
}
#: Layers of our own: accepted samples of a batch, and answers of a model by the prompt's digest.
OWN = {"training": "training.jsonl", "answers": "answers.jsonl"}
#: Folder of batches; readers of a folder pass over names that start so.
BATCHES = "_batches"


class JsonStore:
    """save overwrites, append adds, commit adds to several layers at once; all are Spark writes, so a lost task is run again and no half file is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, layer: str) -> str:
        if layer not in LAYERS and layer not in OWN:
            raise ValueError(f"unknown layer {layer}")
        return f"{self.folder}/{(LAYERS | OWN)[layer]}"

    def _files(self, path: str) -> tuple:
        """(file system, path) as Spark's own file access has them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        files, p = self._files(path)
        return files.exists(p)

    def save(self, layer: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").json(self.path(layer))

    def append(self, layer: str, rows: DataFrame) -> None:
        rows.write.mode("append").json(self.path(layer))

    def commit(self, batch: str, layers: dict[str, DataFrame]) -> None:
        """Add rows to several layers, all of them or none. A batch that is committed already stays as it is."""
        if batch in self.batches():
            return
        for layer, rows in layers.items():
            self.path(layer)
            rows.write.mode("overwrite").json(f"{self.folder}/{BATCHES}/{batch}/{layer}")
        files, ready = self._files(f"{self.folder}/{BATCHES}/{batch}/manifest.ready")
        out = files.create(ready, True)
        out.write(bytearray(json.dumps(sorted(layers)).encode()))
        out.close()
        self._placed(ready, self._files(f"{self.folder}/{BATCHES}/{batch}/manifest.json")[1])

    def _placed(self, source, target) -> None:
        if not source.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(source, target):
            raise OSError(f"{target} can't be put in place")

    def batches(self) -> list[str]:
        """Committed batches, by name."""
        files, p = self._files(f"{self.folder}/{BATCHES}")
        found = files.listStatus(p) if files.exists(p) else []
        names = [x.getPath().getName() for x in found]
        return sorted(n for n in names if self._there(f"{self.folder}/{BATCHES}/{n}/manifest.json"))

    def published(self, batch: str, now: bool = False) -> bool:
        """Whether a batch's samples were published; ``now`` notes that they are."""
        path = f"{self.folder}/{BATCHES}/{batch}/published"
        if now:
            files, p = self._files(path)
            files.create(p, True).close()
        return now or self._there(path)

    def restart(self) -> None:
        """Forget all batches."""
        removed(self.spark, f"{self.folder}/{BATCHES}")

    def batch(self, batch: str, layer: str, schema: str | StructType) -> DataFrame:
        """The rows that a batch has for a layer."""
        path = f"{self.folder}/{BATCHES}/{batch}/{layer}"
        return self.spark.read.schema(schema).json(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def _paths(self, layer: str) -> list[str]:
        own = [self.path(layer)]
        return [p for p in own + [f"{self.folder}/{BATCHES}/{b}/{layer}" for b in self.batches()] if self._there(p)]

    def exists(self, layer: str) -> bool:
        return bool(self._paths(layer))

    def load(self, layer: str, schema: str | StructType) -> DataFrame:
        """The rows of a layer, committed batches with it; none where it was never written."""
        paths = self._paths(layer)
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)

    def layers(self) -> list[str]:
        return [n for n in LAYERS if self.exists(n)]

    def clear(self, *layers: str) -> None:
        for n in layers:
            removed(self.spark, self.path(n))
            for b in self.batches():
                removed(self.spark, f"{self.folder}/{BATCHES}/{b}/{n}")


class MemoryStore:
    """The same protocol in the session."""

    def __init__(self) -> None:
        self.rows: dict[str, DataFrame] = {}
        self.parts: dict[str, dict[str, DataFrame]] = {}
        self.told: set[str] = set()

    def save(self, layer: str, rows: DataFrame) -> None:
        if layer not in LAYERS and layer not in OWN:
            raise ValueError(f"unknown layer {layer}")
        if layer in self.rows:
            self.rows[layer].unpersist()
        self.rows[layer] = rows.cache()

    def append(self, layer: str, rows: DataFrame) -> None:
        self.save(layer, self.rows[layer].unionByName(rows) if layer in self.rows else rows)

    def commit(self, batch: str, layers: dict[str, DataFrame]) -> None:
        if batch not in self.parts:
            self.parts[batch] = dict(layers)
            for layer, rows in layers.items():
                self.append(layer, rows)

    def batches(self) -> list[str]:
        return sorted(self.parts)

    def published(self, batch: str, now: bool = False) -> bool:
        if now:
            self.told.add(batch)
        return batch in self.told

    def restart(self) -> None:
        self.told.clear()
        for layer in {n for b in self.parts.values() for n in b}:
            self.clear(layer)
        self.parts.clear()

    def batch(self, batch: str, layer: str, schema: str | None = None) -> DataFrame:
        return self.parts[batch][layer]

    def exists(self, layer: str) -> bool:
        return layer in self.rows

    def load(self, layer: str, schema: str | None = None) -> DataFrame:
        return self.rows[layer]

    def layers(self) -> list[str]:
        return [n for n in LAYERS if n in self.rows]

    def clear(self, *layers: str) -> None:
        for n in layers:
            if n in self.rows:
                self.rows.pop(n).unpersist()
