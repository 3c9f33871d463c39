from __future__ import annotations

import pytest

from tessella.sources import files as FS


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    rows = [(1, 'a "quoted" one'), (2, "two\nlines, and a comma"), (3, None), (4, ""), (5, " blanks ")]
    df = spark.createDataFrame(rows, "i long, t string")
    FS.write_csv(df, str(tmp_path / "x"), rows_a_file=2)
    assert sorted(tuple(r) for r in FS.read_csv(spark, str(tmp_path / "x"), "i long, t string").collect()) == rows


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("é".encode("latin1"))
    assert FS.encoding_of(spark, str(tmp_path)) == "latin1"
    (tmp_path / "a.csv").write_bytes("é".encode())
    assert FS.encoding_of(spark, str(tmp_path)) == "utf-8"


def test_helpers(spark, tmp_path):
    for n in ("r_1.csv", "r_3.csv", "r_2.csv"):
        (tmp_path / n).write_text("x")
    assert FS.latest(str(tmp_path / "r_*.csv")).endswith("r_3.csv")
    assert FS.latest(str(tmp_path / "r_*.csv"), spark).endswith("r_3.csv")
    with pytest.raises(FileNotFoundError):
        FS.latest(str(tmp_path / "none*"))
    with pytest.raises(FileNotFoundError):
        FS.latest(str(tmp_path / "none*"), spark)
    assert FS.derived_path("a/b.csv", "cleaned") == "a/b_cleaned.csv"
    assert FS.text_column(spark.createDataFrame([(1, "x")], "id int, Comment_Text string")) == "Comment_Text"
    with pytest.raises(ValueError):
        FS.text_column(spark.range(1))
    assert FS.file_profile(spark, str(tmp_path)).count() == 3
    names = spark.createDataFrame([(f"c{i}",) for i in range(5)], "name string")
    assert [r.name for r in FS.retained(names).collect()] == ["c4", "c3", "c2"]


def test_threshold_tree(spark):
    rows = [(0, "toxic", 0.5), (0, "threat", 0.25), (6, "toxic", 1.0)]
    df = spark.createDataFrame(rows, "lang_id int, label string, threshold double")
    assert sorted(tuple(r) for r in FS.thresholds_of_tree(FS.threshold_tree(df)).collect()) == sorted(rows)
