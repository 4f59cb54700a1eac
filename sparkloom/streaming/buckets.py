"""State of many keys a call: keys are dealt into buckets by a hash, and a bucket is what Spark groups by.

A call of a Python processor and each step of its state cost milliseconds, whatever
they hold, so one for each key makes a stream's time grow with its keys. A bucket's
keys lie in one value of Spark's state, as columns, with one timer: that at which
the first of them is due. A batch reads and writes the buckets that it has rows of;
more buckets make that less, and fewer make fewer calls. Their number is part of the
checkpoint: give the same one when a query goes on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

BUCKETS = 4096
#: microseconds and nulls survive the way through JSON
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


class Bucket(StatefulProcessor):
    """Columns ``COLUMNS`` of a bucket's keys in one value, and the one timer that they need."""

    COLUMNS: dict[str, str]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("keys", ", ".join([f"{name} array<{kind}>" for name, kind in self.COLUMNS.items()] + ["timer long"]))

    def read(self) -> tuple[list[tuple], int | None]:
        """The rows, and the timer that is set."""
        found = self.state.get() if self.state.exists() else None
        return (list(zip(*found[:-1], strict=True)), found[-1]) if found else ([], None)

    def write(self, rows: list[tuple], timer: int | None, was: int | None) -> None:
        """Rows that stay, the timer to set, and the one that is set."""
        if was is not None and was != timer:
            self.handle.deleteTimer(was)
        if rows:
            self.state.update((*map(list, zip(*rows, strict=True)), timer))
            if was != timer:
                self.handle.registerTimer(timer)
        elif was is not None:
            self.state.clear()

    def close(self) -> None:
        pass
