"""python -m pairlift -i <files> -ws <size> ...: runs to the end of the input and prints what it did."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from pairlift.config import from_args
from pairlift.plans.scratch import new_folder
from pairlift.streaming.engine import Engine


def main(args: list[str] | None = None) -> int:
    config = from_args(args)
    print(config.describe())
    spark = SparkSession.builder.appName("pairlift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, config, new_folder(spark, "pairlift"))
    began = time.monotonic()
    engine.run(config.input)
    meta = engine.meta()
    print(f"Duration\t{round(1000 * (time.monotonic() - began))}")
    for name, value in engine.counters(meta).items():
        print(f"{name}\t{value}")
    print(f"Results\t{engine.path}/topk")
    return 0


if __name__ == "__main__":
    sys.exit(main())
