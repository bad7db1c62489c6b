"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vigilstream.operators import windows
from vigilstream.plans import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [*(f"{r.name}_top" for r in windows.RANKINGS), "rate_per_minute", "correlation", "reputation", "ioc_frame_match", "pcap_chain"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = queries.queries()
    every["dst_ip_top"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # the session's start isn't timed
    took = {}
    for name in HEADLINE:
        began = time.time()
        every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    began = time.time()
    every["all_tops"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    together = round(time.time() - began, 3)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    total = sum(took.values())
    rate = round(events * len(took) / total)
    print(json.dumps({"metric": "headline queries, total", "value": round(total, 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "events_per_sec": rate, "all_rankings_together": together, "events_per_sec_together": round(events * (len(windows.RANKINGS) + 1) / together)}))


if __name__ == "__main__":
    main()
