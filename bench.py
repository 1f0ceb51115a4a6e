"""Times of headline queries and store operations; prints one JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["latest_snapshot", "point_get", "multi_get", "kway_merge", "segment_metadata", "sparse_index", "index_seek", "segment_prune", "manifest_live", "range_scan", "snapshot_join", "record_round_trip"]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidelog import catalog
    from tidelog.store import Options, Store

    work = tempfile.mkdtemp(prefix="bench-")
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map={
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.checkpoint.dir": f"file://{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse",
    }).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run, times: int = 3) -> None:
        each = []
        for _ in range(times):
            began = time.perf_counter()
            run()
            each.append(time.perf_counter() - began)
        took[name] = round(sorted(each)[len(each) // 2], 3)

    def noop(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    noop(catalog.QUERIES["latest_snapshot"](spark, SF_DIR))  # compiles the code once
    for name in HEADLINE:
        timed(name, lambda: noop(catalog.QUERIES[name](spark, SF_DIR)))

    options = Options(data_dir=f"{work}/stores", compact=False)
    log = catalog.events_log(spark, SF_DIR)
    with Store.create(spark, "bench", options) as store:
        quarter = F.floor(F.col("seq") * 4 / (log.agg(F.max("seq")).first()[0] + 1))
        for k in range(4):
            timed(f"bulk_load_{k}", lambda k=k: store.apply(log.where(quarter == k), "seq"), 1)
        key = bytes(log.first()["key"].encode())
        timed("store_get", lambda: store.get(key))
        keys = spark.createDataFrame([(f"{u}/click",) for u in range(1000)], "key string")
        timed("store_multi_get_1000", lambda: noop(store.multi_get(keys)))
        timed("store_snapshot", lambda: noop(store.snapshot()))
        timed("store_compaction", store.compact, 1)
        timed("store_snapshot_compacted", lambda: noop(store.snapshot()))
        timed("store_put_100", lambda: [store.put(b"bench/%d" % k, b"v") for k in range(100)], 1)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
