"""Lines are parsed once for each row."""

from pyspark.sql import functions as F

from seqlattice.sources import text


def test_tags_are_split_once(spark):
    lines = spark.createDataFrame([(["CB:Z:a:b", "NH:i:1", "bad", "CB:Z:c", "NH:i:2", "UB:Z:"],), ([],), (None,)], "f array<string>")
    tags = lines.select(text.parse_tags(F.col("f")).alias("tags"))
    assert [r["tags"] for r in tags.collect()] == [{"CB": "c", "NH": "2", "UB": ""}, {}, None]
    assert tags._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_checked_alignments_are_not_parsed_again(spark):
    fields = ["r", "0", "chr1", "5", "255", "4M", "*", "0", "0", "ACGT", "IIII", "NH:i:1"]
    lines = spark.createDataFrame([("f", 1, "\t".join(fields))], "file string, line_no long, value string")
    table = text.parse_sam(lines)
    assert "split(" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert table.first()["tags"] == {"NH": "1"} and table.first()["qual"] == "IIII"
