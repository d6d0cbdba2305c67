"""Run the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one JSON line.

Every query runs once untimed (JIT, Python workers, file cache) and once timed; ``first_run`` keeps the
untimed run's seconds. ``rates`` relates the work of a query to its seconds.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from genotiles.queries.catalog import CATALOG
from genotiles.session import SQL_DEFAULTS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "grid_bins", "label_bins", "nested_labels", "exact_bins", "build_examples",
    "pearson_by_track", "spearman_by_track", "example_statistics", "median_correlations",
    "score_poisson_multinomial", "score_topk_reweight", "tmm_factors", "final_tracks_by_content",
    "tile_sequences", "predict_signal", "collapsed_runs", "overlapping_windows", "split_members",
)


# Input rows a query works on, per second: (query, table, rows per input row, unit).
RATES = (
    ("grid_bins", "events", 1, "intervals/s"),
    ("label_bins", "orders", 5, "sample-tracks/s"),
    ("nested_labels", "orders", 5, "sample-tracks/s"),
    ("build_examples", "orders", 3, "sample-tracks/s"),
    ("pearson_by_track", "lineitem", 1, "rows/s"),
    ("spearman_by_track", "lineitem", 1, "rows/s"),
    ("median_correlations", "lineitem", 1, "rows/s"),
)


def run(name: str, spark: SparkSession) -> float:
    """Seconds to plan a query and compute every row and column, keeping none."""
    started = time.perf_counter()
    df: DataFrame = CATALOG[name].build(spark, SF_DIR)
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("genotiles-bench")
    settings = {
        **SQL_DEFAULTS,
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else list(HEADLINE)
    first = {name: run(name, spark) for name in names}
    seconds = {name: run(name, spark) for name in names}
    rates = {}
    for name, table, factor, unit in RATES:
        if name in seconds:
            rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
            rates[name] = {"value": round(rows * factor / seconds[name]), "unit": unit}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "first_run": first, "rates": rates,
    }))


if __name__ == "__main__":
    main()
