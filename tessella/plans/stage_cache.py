"""Stages whose results are kept by what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.sinks import exists


def fingerprint(value: Any) -> str:
    """SHA-256 of a value's JSON text with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class StageCache:
    """Results as Parquet below one folder, each under its name and the fingerprint of parameters and earlier stages.

    A result counts once its write was committed. `runtime` names parameters that don't change results;
    `redo` names the stage from which on all are made anew.
    """

    def __init__(self, spark: SparkSession, folder: str, runtime: Iterable[str] = (), redo: str | None = None) -> None:
        self.spark, self.folder, self.runtime, self.redo = spark, folder.rstrip("/"), frozenset(runtime), redo
        self.forced = False
        self.keys: dict[str, str] = {}
        self.made: list[str] = []

    def stage(self, name: str, params: dict[str, Any], make: Callable[..., DataFrame], *after: str) -> DataFrame:
        """The result of `make` on the results of the stages `after`, made or read back."""
        told = {k: v for k, v in params.items() if k not in self.runtime}
        self.keys[name] = fingerprint({"name": name, "params": told, "after": [self.keys[x] for x in after]})
        path = self.path(name)
        self.forced |= name == self.redo
        if self.forced or not exists(self.spark, f"{path}/_SUCCESS"):
            make(*(self.read(x) for x in after)).write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.read(name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.keys[name][:16]}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
