"""Latest state per path as a table of levels, compacted while a stream writes it.

A batch becomes one segment of partial states at level 0; ``fan`` segments of one level
are merged into one of the next.  A manifest names the segments of a generation.  Writing
it is what commits a batch, so readers see whole generations only, and those who read an
older one keep its segments for ``retain`` more generations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import sync
from shelfmark.schemas import CHANGES

_MANIFEST = "generation long, last_batch long, segments array<struct<name: string, level: int>>"


class ChangeStateTable:
    """A change state in ``folder``; one writer, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = 4, retain: int = 2):
        self._spark, self._folder, self._fan, self._retain = spark, folder.rstrip("/"), fan, retain
        self._schema = sync.partial_state(spark.createDataFrame([], CHANGES)).schema

    # ---- reading

    def generations(self) -> list[int]:
        """Committed generations that are still kept, oldest first."""
        return sorted(int(name) for name in self._names("manifests"))

    def manifest(self, generation: int | None = None) -> dict:
        """``generation, last_batch, segments`` of one generation, the newest by default."""
        if generation is None:
            known = self.generations()
            if not known:
                return {"generation": -1, "last_batch": -1, "segments": []}
            generation = known[-1]
        row = self._spark.read.schema(_MANIFEST).parquet(f"{self._folder}/manifests/{generation:012d}").collect()[0]
        return {"generation": row.generation, "last_batch": row.last_batch, "segments": [(s.name, s.level) for s in row.segments]}

    def partials(self, generation: int | None = None) -> DataFrame:
        """The partial states of one generation, several rows a path."""
        return self._segments([name for name, _ in self.manifest(generation)["segments"]])

    def read(self, generation: int | None = None) -> DataFrame:
        """Latest state per path."""
        return sync.state_of(self.partials(generation))

    # ---- writing

    def writer(self) -> Callable[[DataFrame, int], None]:
        """Batch writer for ``changes.run_to_end``; a batch that comes again changes nothing."""
        return self.append

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add one batch of changes, merge levels that are full, and commit both as one generation."""
        now = self.manifest()
        if batch_id <= now["last_batch"]:
            return
        generation = now["generation"] + 1
        segments = [*now["segments"], (self._write(sync.partial_state(batch), generation, 0), 0)]
        level = 0
        while len(full := [s for s in segments if s[1] == level]) >= self._fan:
            merged = self._write(sync.merge_states(self._segments([name for name, _ in full])), generation, level + 1)
            segments = [s for s in segments if s[1] != level] + [(merged, level + 1)]
            level += 1
        row = [(generation, batch_id, segments)]
        self._spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/manifests/{generation:012d}")
        self._clean()

    def _write(self, partial: DataFrame, generation: int, level: int) -> str:
        name = f"{generation:012d}-{level}"  # left over from a failed try, it is replaced
        partial.write.mode("overwrite").parquet(f"{self._folder}/segments/{name}")
        return name

    def _segments(self, names: list[str]) -> DataFrame:
        if not names:
            return self._spark.createDataFrame([], self._schema)
        parts = [self._spark.read.schema(self._schema).parquet(f"{self._folder}/segments/{name}") for name in names]
        return reduce(DataFrame.unionByName, parts)

    def _clean(self) -> None:
        """Remove manifests older than the kept generations, and segments none of those names."""
        known = self.generations()
        kept = known[-1 - self._retain :]
        held = {name for g in kept for name, _ in self.manifest(g)["segments"]}
        for name in self._names("segments"):
            if name not in held:
                self._remove(f"segments/{name}")
        for g in known:
            if g not in kept:
                self._remove(f"manifests/{g:012d}")

    # ---- the store

    def _path(self, inside: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{inside}")
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()), path

    def _names(self, inside: str) -> list[str]:
        """Folders whose writing has ended."""
        store, path = self._path(inside)
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path)]
        return [n for n in names if store.exists(self._path(f"{inside}/{n}/_SUCCESS")[1])]

    def _remove(self, inside: str) -> None:
        store, path = self._path(inside)
        store.delete(path, True)
