"""Sending an object of this package to every task, whether or not the workers have the package."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast whose classes travel along. The caller has checked the object's size."""

    def __init__(self, spark: SparkSession, value: Any):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: list[Any] = []

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_value": []}

    def close(self) -> None:
        """Frees it everywhere; what was computed with it has been written before."""
        self._sent.destroy()

    @property
    def value(self) -> Any:
        if not self._value:
            self._value.append(pickle.loads(self._sent.value))
        return self._value[0]
