"""python -m neumes run QUERY FOLDER [OUT]: a query over a folder of tables, shown or written as Parquet.

python -m neumes report FOLDER OUT MODEL...: a report on the predictions in files
<page>__<gt or model>.kern, the first model being the one to compare with.
"""

import argparse

from pyspark.sql import SparkSession

from .plans import QUERIES
from .report import report


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="neumes", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("folder")
    run.add_argument("out", nargs="?")
    told = commands.add_parser("report")
    told.add_argument("folder")
    told.add_argument("out")
    told.add_argument("models", nargs="+")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("neumes").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "report":
        print(report(spark, given.folder, given.models, given.out))
        return
    result = QUERIES[given.query](spark, given.folder)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(50, truncate=80)


if __name__ == "__main__":
    main()
