"""Word tables for sentiment and entities. They are inputs, read like any other table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope.functions.text import tokens

# A small seed lexicon on the usual scale from -4 to 4.
SEED = """
good 1.9
great 3.1
excellent 2.7
love 3.2
like 1.5
nice 1.8
happy 2.7
best 3.2
better 1.9
thanks 1.9
helpful 1.8
funny 1.9
kind 2.4
bad -2.5
terrible -2.1
awful -2.0
hate -2.7
worst -3.1
worse -2.1
sad -2.1
angry -2.3
stupid -2.4
scam -2.7
spam -1.5
wrong -2.1
problem -1.7
"""


def seed_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, float(v)) for w, v in (line.split() for line in SEED.split("\n") if line)]
    return spark.createDataFrame(rows, "token string, valence double")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The public tab-separated layout: token, mean, deviation, raw ratings.

    Read as text because tokens may hold quotes and other marks a CSV reader would interpret. A
    repeated token keeps its last line, as in the public loader; files come in the order of their
    names. A word list is small, so each file is read whole, which keeps its lines in order.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value")
    )
    cells = lines.select("file", "line", F.split(F.trim("value"), "\t").alias("c"))
    rows = cells.where(F.size("c") >= 2).select(
        "file", "line", F.col("c")[0].alias("token"), F.col("c")[1].cast("double").alias("valence")
    )
    return rows.groupBy("token").agg(F.max_by("valence", F.struct("file", "line")).alias("valence"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated phrase and label; a repeated phrase keeps its first label by name.

    Phrases are tokenised like the texts they are looked up in.
    """
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    phrase = F.array_join(tokens(F.col("c")[0]), " ")
    rows = cells.where(F.size("c") >= 2).select(phrase.alias("phrase"), F.col("c")[1].alias("label"))
    return rows.groupBy("phrase").agg(F.min("label").alias("label"))
