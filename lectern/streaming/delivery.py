"""A durable log of a stream's batches, and how far each consumer has come in it.

Every batch is written once, as a table of its own number, before any consumer sees it. A consumer is served in order from the first batch after its
last receipt; one that fails keeps its place and is served again with the next batch, by redeliver() or after a restart, while the others go on.
Receipts are empty files, made after a consumer has returned: after a loss in between, a consumer gets the same number with the same rows again,
so one that writes by batch number has every row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Sink = Callable[[DataFrame, int], None]


class DeliveryLog:
    """The log below a folder that driver and executors share; any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *parts: str):
        where = self._hadoop.Path("/".join([self.path, *parts]))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _numbers(self, *parts: str) -> list[int]:
        store, where = self._at(*parts)
        if not store.exists(where):
            return []
        names = (f.getPath().getName().rpartition("=")[2] for f in store.listStatus(where))
        return sorted(int(n) for n in names if n.lstrip("-").isdigit())

    def write(self, batch: DataFrame, number: int) -> None:
        """Keeps a batch. One that is tried again replaces what is there under its number."""
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")

    def rows(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/batch={number}")

    def batches(self) -> list[int]:
        """Numbers of the kept batches that were written to their end."""
        done = lambda n: (lambda at: at[0].exists(at[1]))(self._at("rows", f"batch={n}", "_SUCCESS"))
        return [n for n in self._numbers("rows") if done(n)]

    def last(self, sink: str) -> int | None:
        """The last batch that a consumer has, or None if it has not subscribed yet."""
        return max(self._numbers("receipts", sink), default=None)

    def receipt(self, sink: str, number: int) -> None:
        store, where = self._at("receipts", sink, str(number))
        store.create(where, True).close()
        for old in self._numbers("receipts", sink):
            if old < number:
                store.delete(self._at("receipts", sink, str(old))[1], False)

    def subscribe(self, sink: str, before: int) -> None:
        """Notes a new consumer, which is to get batches from number before + 1 on. One that is known keeps its place."""
        if self.last(sink) is None:
            self.receipt(sink, before)

    def unsubscribe(self, sink: str) -> None:
        store, where = self._at("receipts", sink)
        store.delete(where, True)

    def prune(self, sinks) -> list[int]:
        """Deletes batches that all of the named consumers have; returns their numbers. A consumer that has not subscribed keeps nothing back."""
        places = [n for s in sinks if (n := self.last(s)) is not None]
        gone = [n for n in self.batches() if places and n <= min(places)]
        for n in gone:
            store, where = self._at("rows", f"batch={n}")
            store.delete(where, True)
        return gone

    def serve(self, sinks: dict[str, Sink], failures: list | None = None) -> dict[str, int]:
        """Gives every consumer what it has not had yet, in order; returns how many batches each still waits for.

        A failure ends the turn of its consumer only; it is noted in failures as (consumer, batch, message).
        """
        there, left = self.batches(), {}
        for name, sink in list(sinks.items()):
            last = self.last(name)
            waits = [n for n in there if last is not None and n > last]
            while waits:
                try:
                    sink(self.rows(waits[0]), waits[0])
                except Exception as wrong:  # noqa: BLE001  a consumer's failure is its own
                    if failures is not None:
                        failures.append((name, waits[0], str(wrong)))
                    break
                self.receipt(name, waits.pop(0))
            left[name] = len(waits)
        return left
