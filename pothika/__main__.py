"""python -m pothika PAGES CATALOGUE OUT [--config FILE]: the whole run over tables of pages and a catalogue, to one CSV report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import report
from .plans import run
from .session import cut
from .sources import readers


def main() -> None:
    args = argparse.ArgumentParser(prog="pothika", description=__doc__)
    args.add_argument("pages", help="table of read pages (Parquet)")
    args.add_argument("catalogue", help="list of works: Parquet, or CSV with a header")
    args.add_argument("out", help="folder of the report")
    args.add_argument("--config", help="JSON file of settings over the defaults")
    a = args.parse_args()
    settings = readers.settings(a.config)
    spark = SparkSession.builder.appName("pothika").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sheet = spark.read.option("header", True).csv(a.catalogue) if a.catalogue.lower().endswith(".csv") else spark.read.parquet(a.catalogue)
    catalog = sheet if "pos" in sheet.columns else readers.catalogue(sheet).withColumn("pos", F.col("pos").cast("int")).withColumn("script", F.lit(None).cast("string"))
    works = cut(run.works_of_run(spark.read.parquet(a.pages), catalog, s=settings))
    readers.write_report(run.report_of_run(works), a.out)
    print(report.summary(works).first().asDict())


if __name__ == "__main__":
    main()
