"""Values of this subpackage's classes for all tasks.

A broadcast pickles by reference, and workers have no copy of the classes; the
bytes sent here carry the classes along.  Callers state the bound of what they send.
"""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import SparkSession


def send(spark: SparkSession, value: Any) -> Broadcast[bytes]:
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast[bytes]) -> Any:
    return pickle.loads(sent.value)
