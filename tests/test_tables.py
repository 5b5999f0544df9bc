from syllabix.functions.joins import fits_broadcast, lookup_join, null_safe_join
from syllabix.sources import tables
from syllabix.sources.tables import CONSTRUCT_LOOKUP, POST_SURVEY_QUESTIONS, drop_index_column, read_table, write_table

import pytest


def test_csv_with_line_breaks_and_missing_tokens(spark, tmp_path):
    (tmp_path / "lookup.csv").write_text(
        "source,survey_order,origin,question,id,construct,scale_values,scale_flipped,scale_min,scale_max\n"
        'pre,1,x,"First line\nsecond ""quoted"" line",a_1,anxiety,6,FALSE,NA,high\n'
        "pre,NA,,plain,a_2,anxiety,6,TRUE,low,high\n"
    )
    rows = read_table(spark, str(tmp_path / "lookup.csv"), CONSTRUCT_LOOKUP, "csv", multiline=True).orderBy("id").collect()
    assert [r.id for r in rows] == ["a_1", "a_2"]
    assert rows[0].question == 'First line\nsecond "quoted" line'
    assert rows[0].scale_min is None and rows[0].scale_flipped is False
    assert rows[1].survey_order is None and rows[1].origin is None


def test_quoted_empty_fields_are_missing_and_lines_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('question,construct_label\n"",x\n"NA",\nplain,"y ""z"""\n')
    rows = read_table(spark, str(tmp_path / "a.csv"), POST_SURVEY_QUESTIONS, "csv").collect()
    assert [tuple(r) for r in rows] == [(None, "x"), (None, None), ("plain", 'y "z"')]


def test_csv_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), fmt="csv")


def test_csv_round_trip_keeps_text_and_lists_become_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ' padded "x"\nnext ', ["a", "b"]), (2, None, [])], "id int, text string, names array<string>")
    write_table(df, str(tmp_path / "out"), "csv")
    back = {r.id: r for r in read_table(spark, str(tmp_path / "out"), "id int, text string, names string", "csv", multiline=True).collect()}
    assert back[1].text == ' padded "x"\nnext ' and back[1].names == '["a","b"]'
    assert back[2].text is None


def test_drop_index_column(spark):
    assert drop_index_column(spark.createDataFrame([(1, "a")], "`...1` int, page string")).columns == ["page"]


def test_missing_keys_match_missing_keys(spark):
    left = spark.createDataFrame([(1, None), (2, "x")], "a int, k string")
    right = spark.createDataFrame([(None, 10), ("y", 20)], "k string, v int")
    rows = {r.a: r.v for r in null_safe_join(left, right, ["k"], "left").collect()}
    assert rows == {1: 10, 2: None}


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        null_safe_join(df, df, ["k"])


def test_broadcast_only_below_measured_limits(spark, monkeypatch):
    from syllabix.functions import joins

    df = spark.range(1000).selectExpr("id AS k", "id AS v")
    assert fits_broadcast(df) and not fits_broadcast(df, max_rows=999) and not fits_broadcast(df, max_bytes=1000)
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins.fits_broadcast, "__defaults__", (10, 10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(spark.range(50).selectExpr("id AS k"), df, ["k"])
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    lines = ["id,name,score", '1,"a, b",2.5', '2,"open,3.5', "3,short", "4,d,abc", "", "5,,NA", '6,"",1', "7,x,1,extra", "x,y,2"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("id,name,score\n8,z,9.5\nbad,z,9\n")
    found = tables.read_with_rejects(spark, str(tmp_path), "id int, name string, score double")
    rows = sorted((r.id, r.name, r.score) for r in found.rows.collect())
    assert rows == [(1, "a, b", 2.5), (5, None, None), (6, None, 1.0), (8, "z", 9.5)]
    rejects = {(r.file[-5:], r.line): (r.reason, r.record) for r in found.rejects.collect()}
    assert rejects == {
        ("a.csv", 3): ("quotes do not pair", lines[2]), ("a.csv", 4): ("not 3 fields", lines[3]),
        ("a.csv", 5): ("score is no double", lines[4]), ("a.csv", 9): ("not 3 fields", lines[8]),
        ("a.csv", 10): ("id is no int", lines[9]), ("b.csv", 3): ("id is no int", "bad,z,9")}
    # Without headers and the blank line every line is accounted for.
    assert len(rows) + len(rejects) == len(lines) - 2 + 2
    assert {r.column: (r.missing, r.unreadable) for r in found.counts.collect()} == {"id": (0, 2), "name": (2, 0), "score": (1, 1)}


def test_lines_are_numbered_over_parts_of_a_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text("id\n" + "".join(f"{i}\n" for i in range(2, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        lines = tables.numbered_lines(spark, str(tmp_path)).filter("line > 1").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(lines) == 4999 and all(int(r.record) == r.line for r in lines)


def test_rejects_of_an_empty_file(spark, tmp_path):
    (tmp_path / "none.csv").write_text("id\n")
    found = tables.read_with_rejects(spark, str(tmp_path), "id int")
    assert found.rows.count() == found.rejects.count() == 0 and found.counts.collect() == [("id", 0, 0)]
