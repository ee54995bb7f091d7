"""A database that other processes open by its address."""

import subprocess
import sys

from tesspan.sources.embedded import DRIVER, embedded_database

ROWS = [(1, None, 'a"b,c', True, None), (2, "", "x\ny ", False, 2.5), (None, "it's", "back\\slash", None, 1e-17)]
READ = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.read.jdbc(sys.argv[1], "T", properties={"driver": sys.argv[2]}).collect()
print("READ", sorted(map(repr, map(tuple, rows))))
"""


def test_other_processes_read_what_was_put_in(spark):
    rows = spark.createDataFrame(ROWS, "k int, a string, b string, c boolean, d double").repartition(2)
    url = embedded_database(spark, {"T": (rows, "K INTEGER, A VARCHAR(9), B VARCHAR(20), C BOOLEAN, D DOUBLE")})
    here = spark.read.jdbc(url, "T", properties={"driver": DRIVER})
    assert sorted(map(repr, map(tuple, here.collect()))) == sorted(map(repr, ROWS))
    there = subprocess.run([sys.executable, "-c", READ, url, DRIVER], capture_output=True, text=True, timeout=120)
    assert f"READ {sorted(map(repr, ROWS))}" in there.stdout


def test_a_table_without_rows(spark):
    url = embedded_database(spark, {"T": (spark.createDataFrame([], "k int"), "K INTEGER")})
    assert spark.read.jdbc(url, "T", properties={"driver": DRIVER}).count() == 0
