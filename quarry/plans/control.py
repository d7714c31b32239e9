"""Requests that supersede each other: a newer one of a client ends its older one's jobs."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession


class Requests:
    """Runs requests of clients under job tags. run() ends the client's older request; what was ended raises in its own thread."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.latest = spark, threading.Lock(), {}

    def run(self, client: str, seq: int, work):
        """work(), under a tag of its own; None, without working, if a newer request of the client is there."""
        tag = f"request-{client}-{seq}"
        with self.lock:
            before = self.latest.get(client, -1)
            if seq <= before:
                return None
            self.latest[client] = seq
        if before >= 0:
            self.spark.sparkContext.cancelJobsWithTag(f"request-{client}-{before}")
        self.spark.sparkContext.addJobTag(tag)
        try:
            return work()
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, client: str) -> None:
        with self.lock:
            seq = self.latest.get(client, -1)
        self.spark.sparkContext.cancelJobsWithTag(f"request-{client}-{seq}")
