"""What a run says, on the terminal and in a file, with the memory of the driver and the executors."""

from __future__ import annotations

import resource
import time
from pathlib import Path

from pyspark.sql import SparkSession

GIB = 1 << 30


class RunLog:
    """Lines with the time, in <folder>/logs/run_<start>.log and on the terminal. A folder that isn't local has no file."""

    def __init__(self, folder: str):
        local = folder.removeprefix("file://")
        self.path = None if "://" in local else Path(local, "logs", f"run_{time.strftime('%Y%m%d_%H%M%S')}.log")
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)

    def say(self, line: str) -> None:
        text = f"{time.strftime('%H:%M:%S')} {line}"
        print(text, flush=True)
        if self.path:
            with self.path.open("a", encoding="utf-8") as file:
                file.write(text + "\n")

    def memory(self, spark: SparkSession, when: str) -> None:
        """The driver's peak, and of each executor what its storage memory has free of how much."""
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024 / GIB
        status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        rows, each = [], status.iterator()
        while each.hasNext():
            pair = each.next()
            rows.append(f"{pair._1()} {int(pair._2()._2()) / GIB:.2f} of {int(pair._2()._1()) / GIB:.2f} GiB free")
        self.say(f"memory {when}: driver's Python {peak:.2f} GiB at most; executors {', '.join(sorted(rows))}")
