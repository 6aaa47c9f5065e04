"""Dataset aliases: which table a control means by a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Alias → DataFrame, with what is known about each dataset.

    One DataFrame object per alias, so a dataset used twice in a plan is the same
    scan to Spark and its exchanges can be reused.
    """

    def __init__(self, frames: dict[str, DataFrame] | None = None):
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}
        self._hashes: dict[str, str] = {}
        self._unique: dict[str, frozenset] = {}
        for alias, frame in (frames or {}).items():
            self.add(alias, frame)

    @classmethod
    def of_parquet(cls, spark: SparkSession, paths: dict[str, str]) -> Catalog:
        return cls({alias: spark.read.parquet(path) for alias, path in paths.items()})

    @classmethod
    def of_manifests(cls, spark: SparkSession, manifests: dict[str, dict]) -> Catalog:
        """The catalog of landed evidence; manifests carry its size and hash."""
        catalog = cls()
        for alias, manifest in manifests.items():
            catalog.add(
                alias,
                spark.read.parquet(manifest["parquet_path"]),
                rows=manifest.get("row_count"),
                sha256_hash=manifest.get("sha256_hash"),
            )
        return catalog

    def add(
        self,
        alias: str,
        frame: DataFrame,
        rows: int | None = None,
        sha256_hash: str | None = None,
        unique: tuple[str, ...] = (),
    ) -> Catalog:
        """``unique`` names columns no two rows agree on, as a grouped frame has:
        a join on them meets no hot key, so the frame need not be counted."""
        self._frames[alias] = frame
        self._unique[alias] = frozenset(c.lower() for c in unique)
        if rows is not None:
            self._rows[alias] = rows
        if sha256_hash is not None:
            self._hashes[alias] = sha256_hash
        return self

    def __contains__(self, alias: str) -> bool:
        return alias in self._frames

    def aliases(self) -> list[str]:
        return list(self._frames)

    def frame(self, alias: str) -> DataFrame:
        return self._frames[alias]

    def sha256_hash(self, alias: str) -> str | None:
        return self._hashes.get(alias)

    def rows_per_key(self, alias: str, keys: list[str]) -> int | None:
        """Upper bound for the rows one join key can hold: 1 when the keys are
        unique, else the dataset's row count where its manifest or the caller tells
        it. None when it is not known; nothing is counted for it."""
        unique = self._unique.get(alias)
        if unique and unique <= {k.lower() for k in keys}:
            return 1
        return self._rows.get(alias)

    def with_frame(self, alias: str, frame: DataFrame) -> Catalog:
        """The same catalog, but for one dataset's rows."""
        view = self.for_analysis()
        view._frames = {**self._frames, alias: frame}
        view._rows = {a: n for a, n in self._rows.items() if a != alias}
        return view

    def for_analysis(self) -> Catalog:
        """The same datasets, with all that is known of them."""
        view = Catalog()
        view._frames, view._rows, view._hashes = self._frames, self._rows, self._hashes
        view._unique = self._unique
        return view
