import os

import pytest

from mojiweave.llm import common, line_dedup, near_dup, substring_dedup


def folders(spark):
    return {x for x in os.listdir(common.shared_dir(spark).removeprefix("file://")) if x.startswith("mw-")}


@pytest.mark.parametrize("work,left", [(line_dedup.dedup_lines, 1), (substring_dedup.remove_repeats, 1), (near_dup.near_duplicates, 1), (near_dup.drop_near_duplicates, 1)])
def test_an_operator_leaves_what_its_result_reads(spark, docs_of, work, left):
    before = folders(spark)
    out = work(docs_of(["a line that is said twice here", "a line that is said twice here\nand its own", None]))
    assert len(folders(spark) - before) <= left
    assert out.count() >= 2


def test_an_operator_that_fails_leaves_nothing(spark):
    @common.scratch("kept")
    def work():
        common.materialize(spark.range(3), "kept")
        raise KeyError("no")

    before = folders(spark)
    with pytest.raises(KeyError):
        work()
    assert folders(spark) == before


def test_few_rows_join_without_the_others_being_shuffled(spark):
    rows = spark.range(2000).selectExpr("id AS k", "CAST(id AS STRING) AS v")
    few = common.materialize(spark.range(0, 4000, 500).selectExpr("id AS k", "id * 2 AS x"), "few")
    got = common.with_few(rows, few, ["k"])
    assert got.columns == ["k", "v", "x"]
    assert sorted(map(tuple, got.collect())) == [(k, str(k), 2 * k if k % 500 == 0 else None) for k in range(2000)]
