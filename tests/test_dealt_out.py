"""Work on the texts of a table with one row group isn't one task's."""

from pyspark.sql import functions as F
from spanloom.operators.dictionary import dealt_out
from spanloom.plans import inputs

SMALL = "/root/testdata/sf0.001"


def test_word_pairs_of_one_row_group_come_from_several_tasks(spark):
    assert inputs.docs(spark, SMALL).select(F.spark_partition_id()).distinct().count() == 1
    assert inputs.word_pairs(spark, SMALL).select(F.spark_partition_id()).distinct().count() > 1


def test_every_row_stays(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (3, None)], "doc_id long, text string")
    assert sorted(map(repr, dealt_out(docs).collect())) == sorted(map(repr, docs.collect()))
