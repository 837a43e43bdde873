"""Contract operators on small tables."""

from pyspark.sql import functions as F

from cellweave.operators import contracts


def test_all_broken_rules_are_told(spark):
    rows = [("spatial", None, " ", "x"), (None, "s", None, None), ("bulk", None, "fish", "0" * 64)]
    d = spark.createDataFrame(rows, "dataset_type string, section_id string, species string, sha256 string")
    got = [r.p for r in d.select(contracts.problems(contracts.dataset_rules(["spatial", "bulk"])).alias("p")).collect()]
    assert got == [["spatial_without_section", "blank_species", "bad_digest"], ["unknown_type"], []]


def test_sidecar_findings_stay_one_row_a_cell(spark):
    cells = spark.createDataFrame([(i, "s") for i in range(6)], "sample int, stage string")
    side = [(0, "7", False, "s"), (1, "7", False, "s"), (1, "8", False, "s"), (2, "7", True, "s"), (3, "x", None, "s"), (4, "7", False, "t"), (9, "7", False, "s")]
    got = {r["sample"]: (r.embryo_id, r.problem) for r in contracts.sidecar_findings(cells, spark.createDataFrame(side, "sample int, embryo_id string, removed boolean, stage string"), ["stage"]).collect()}
    assert got == {0: ("embryo_7", None), 1: (None, "repeated"), 2: (None, "removed"), 3: (None, "bad_embryo"), 4: (None, "field_differs"), 5: (None, "unmatched")}


def test_differences_of_published_and_replayed_tables(spark):
    s = "k int, v double"
    a, b = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 4.0)], s), spark.createDataFrame([(1, 1.0 + 1e-13), (2, None), (3, None), (5, 5.0)], s)
    assert {tuple(r) for r in contracts.published_differences(a, b, ["k"], ["v"]).collect()} == {(3, "differs"), (4, "not_recomputed"), (5, "not_published")}
    assert contracts.replay_differences(a, a).isEmpty()
    twice = contracts.replay_differences(a.union(a.where("k = 2")), a).collect()
    assert [(r.k, r.side, r.times) for r in twice] == [(2, "first", 1)]


def test_indexes_into_files_laid_end_to_end(spark):
    files = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "file string, n long")
    got = {r["index"]: (r.file, r.row) for r in contracts.file_rows(spark.range(-1, 6).withColumnRenamed("id", "index"), files).collect()}
    assert got == {-1: (None, None), 0: ("a", 0), 1: ("a", 1), 2: ("c", 0), 3: ("c", 1), 4: ("c", 2), 5: (None, None)}
    assert {r.file for r in contracts.file_rows(spark.range(2).withColumnRenamed("id", "index"), files.where("false")).collect()} == {None}


def test_published_lists_against_their_origin(spark):
    scores = spark.createDataFrame([("s", g, v) for g, v in zip("abcd", [3.0, 2.0, 2.0, 1.0], strict=True)], "s string, g string, v double")
    got = contracts.top_origin(spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "a")], "s string, g string"), scores, ["s"], "g", "v", 2).first()
    assert (got.listed, got.found, got.same) == (2, 1, False)


def test_vocabulary_text_that_is_no_object_is_null(spark):
    d = spark.createDataFrame([('{"a": 1, "b": 2}',), ("[1]",), (None,)], "t string").select(contracts.vocabulary(F.col("t")).alias("v"))
    assert [r.v for r in d.collect()] == [{"a": 1, "b": 2}, None, None]
