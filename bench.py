"""Headline queries, timed: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3): median of that many runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cardflow import queries as q  # noqa: E402
from cardflow.plans import lifecycle  # noqa: E402
from cardflow.session import local_session  # noqa: E402
from cardflow.sources import fixtures as fx  # noqa: E402
from cardflow.streaming.state import streaming_ledger  # noqa: E402

HEADLINE = (
    "order_lifecycle", "order_lifecycle_raw", "ledger_results", "ledger_results_pooled",
    "account_balances", "order_state", "fraud_screen", "decode_accounts", "account_onboarding",
    "order_flow",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stream_ledger(spark: SparkSession, sf_dir: str, work: str) -> float:
    """Ledger as a stream over parquet files, until the input is used up."""
    events = lifecycle.ledger_feed(fx.orders(spark, sf_dir), fx.topups(spark, sf_dir))
    landing = f"{work}/events"
    events.repartitionByRange(8, "event_ts").write.parquet(landing)
    source = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
    start = time.perf_counter()
    query = (
        streaming_ledger(source).writeStream.format("noop").outputMode("append")
        .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    catalog = q.all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            drain(catalog[name](spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    work = tempfile.mkdtemp(prefix="cardflow-bench-")
    seconds["streaming_ledger"] = round(stream_ledger(spark, sf_dir, work), 3)
    events = fx.table(spark, sf_dir, "events").agg(F.count("*")).first()[0]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "events": events,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
