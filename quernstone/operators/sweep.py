"""How good and how fast searches are: recall against exact search, time and queries per second over their parameters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """One row: recall_1 and recall_k, the shares of the exact nearest rows that were found. Both: qid, id, rank."""
    both = exact.filter(F.col("rank") <= k).select("qid", "id", F.col("rank").alias("_want")).join(found.filter(F.col("rank") <= k).select("qid", "id", F.col("rank").alias("_got")), ["qid", "id"], "left")
    share = lambda n: F.count_if((F.col("_want") <= n) & (F.col("_got") <= n)) / F.greatest(F.count_if(F.col("_want") <= n), F.lit(1))
    return both.agg(share(1).alias("recall_1"), share(k).alias("recall_k"))


def measure(ways: dict[str, Callable[[], DataFrame]], exact: DataFrame, queries: int, k: int = 10) -> list[dict]:
    """Of each way to search: name, recall_1, recall_k, seconds for the whole batch, queries per second, and how many times as fast as
    the first way it is. A way is run once to be timed; its result is then held against the exact one."""
    out: list[dict] = []
    for name, search in ways.items():
        start = time.perf_counter()
        found = search().persist()
        found.count()
        seconds = time.perf_counter() - start
        r = recall(found, exact, k).first()
        found.unpersist()
        out.append({"name": name, "recall_1": r.recall_1, "recall_k": r.recall_k, "seconds": seconds, "qps": queries / seconds, "speed_up": (out[0]["seconds"] if out else seconds) / seconds})
    return out
