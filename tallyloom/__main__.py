"""python -m tallyloom: check, install or uninstall a tree, or report on packages."""

import sys

from pyspark.sql import SparkSession

from .plans.commands import parse_arguments, run

if __name__ == "__main__":
    parse_arguments(sys.argv[1:])  # help and errors need no session
    sys.exit(run(SparkSession.builder.appName("tallyloom").getOrCreate(), sys.argv[1:]))
