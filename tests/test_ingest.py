import math

import pytest
from pyspark.sql import functions as F

from featsieve import sources
from featsieve.operators import audit, target


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_files_are_stacked_and_labels_mapped(spark, tmp_path):
    """Labels differ in case and in the white space around them; two of them are in no mapping."""
    write(tmp_path / "in", "north.csv", "speed,weather,class\n3.5,dry, Calm\n4.25,wet,calm\t\n0.5,dry,STRASSE\n")
    write(tmp_path / "in", "south.csv", "speed,weather,class\n9.0,wet,gale\n7.5,,Stra\u00dfe\n1.0,dry,Breeze\n8.0,dry,gust\n")
    spec = {
        "name": "wind", "path": str(tmp_path / "in"), "target_col": "class", "benign_labels": [" QUIET "],
        "read_options": {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False},
        "target_mapping": {"case_insensitive": True, "mapping": {"CALM ": "quiet", "breeze": "quiet", "stra\u00dfe": "road"}, "default": "storm"}}
    ds = sources.load_dataset(spark, spec)
    assert {r["class"]: r["count"] for r in ds.df.groupBy("class").count().collect()} == {"quiet": 3, "road": 2, "storm": 2}
    assert ds.task == "multiclass" and ds.metadata["unmapped_labels"] == ["gale", "gust"]
    row = audit.audit_summary(ds.df, "class", "wind", ds.benign_labels).head()
    assert (row["benign_or_normal_count"], row["malicious_or_attack_count"], row["missing_values_total"]) == (3, 4, 1)
    facts = sources.loader_metadata(ds).head()
    assert (facts["loaded_rows"], facts["loaded_columns"], facts["task"]) == (7, 3, "multiclass")


def test_all_unmapped_labels_are_reported(spark):
    df = spark.createDataFrame([(f"kind{i:02d}",) for i in range(26)], "y string")
    _, facts = target.map_labels(df, "y", {"kind00": "a"}, default="b")
    assert facts["unmapped_labels"] == [f"kind{i:02d}" for i in range(1, 26)]
    with pytest.raises(ValueError, match="25 labels"):
        target.map_labels(df, "y", {"kind00": "a"})


def test_names_of_headerless_files_come_from_a_list(spark, tmp_path):
    write(tmp_path, "day_a.csv", "0.5,tcp,0\n0.75,udp,1\n")
    write(tmp_path, "day_b.csv", "1.5,udp,0\n")
    write(tmp_path, "fields.csv", "No,Title\n1,Mean Rate\n2, Protocol \n3,LABEL\n")
    spec = {"name": "h", "path": str(tmp_path), "loader": "headerless", "files": ["day_a.csv", "day_b.csv"], "names_file": "fields.csv", "names_field": "Title", "target_col": "label"}
    ds = sources.load_dataset(spark, spec)
    assert ds.df.columns == ["meanrate", "protocol", "label"] and ds.task == "binary"
    assert sorted(tuple(r) for r in ds.df.collect()) == [(0.5, "tcp", 0), (0.75, "udp", 1), (1.5, "udp", 0)]


def test_bad_integer_labels_become_zero_or_fail(spark, tmp_path):
    write(tmp_path, "a.csv", "1,1\n2,oops\n3,1.0\n")
    write(tmp_path, "names.csv", "Name\nx\nlabel\n")
    df = sources.read_headerless(spark, [f"{tmp_path}/a.csv"], f"{tmp_path}/names.csv")
    assert sorted(r["label"] for r in df.collect()) == [0, 1, 1]
    kept = sources.read_headerless(spark, [f"{tmp_path}/a.csv"], f"{tmp_path}/names.csv", default=None)
    assert kept.filter("label IS NULL").count() == 1


def test_swapped_columns_and_widths_are_rejected(spark, tmp_path):
    write(tmp_path, "a.csv", "x,label\n1,a\n")
    write(tmp_path, "b.csv", "label,x\na,1\n")
    with pytest.raises(ValueError, match="another order"):
        sources.read_tables(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    write(tmp_path, "c.csv", "x,label,z\n1,a,2\n")
    with pytest.raises(ValueError, match="differ in width"):
        sources.read_tables(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/c.csv"])


def test_discovery(spark, tmp_path):
    write(tmp_path / "in" / "deep", "a.csv", "x\n1\n")
    write(tmp_path / "in", "b.csv", "x\n1\n")
    assert len(sources.discover_files(spark, str(tmp_path / "in"), "*.csv")) == 1
    assert len(sources.discover_files(spark, str(tmp_path / "in"), "*.csv", recursive=True)) == 2
    with pytest.raises(FileNotFoundError):
        sources.discover_files(spark, str(tmp_path / "in"), "*.tsv")


def test_column_guards():
    assert sources.normalized_names([" A B ", "cD"]) == ["ab", "cd"]
    for names in (["x"], ["x", "x", "y"], ["x;", "y"]):
        with pytest.raises(ValueError):
            sources.check_columns(names, "y")


def test_unknown_label_without_default_raises(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    with pytest.raises(ValueError, match="no mapping for"):
        target.map_labels(df, "label", {"a": "1"})
    out, facts = target.map_labels(df, "label", {"a": "1"}, default="0")
    assert sorted(r[0] for r in out.collect()) == ["0", "0", "1"] and facts["unmapped_labels"] == ["b"]


def test_target_guards(spark):
    def resolve(labels, task="auto"):
        df = spark.createDataFrame([(v,) for v in labels], "y string")
        return target.resolve_task("d", "y", target.target_facts(df, "y").head(), task)

    assert resolve(["a", "b"]) == "binary" and resolve(["a", "b", "c"]) == "multiclass"
    for labels, task in ((["a", None, "b"], "auto"), (["a"], "auto"), (["a", "b", "c"], "binary"), (["a", "b"], "other")):
        with pytest.raises(ValueError):
            resolve(labels, task)


def test_audit_counts_missing_and_duplicates(spark):
    rows = [(1.0, "a", "n"), (1.0, "a", "n"), (math.nan, None, "m"), (None, None, "m"), (None, "a", "m"), (0.0, "z", "m"), (-0.0, "z", "m")]
    df = spark.createDataFrame(rows, "x double, c string, y string")
    row = audit.audit_summary(df, "y", "d").head()
    assert row["missing_values_total"] == 5 and row["duplicate_rows"] == 3 and row["benign_or_normal_count"] is None


def test_tokens_spare_the_target(spark):
    df = spark.createDataFrame([("?", "?"), ("a", "b")], "c string, y string")
    assert sorted((r["c"] or "", r["y"]) for r in target.null_tokens(df, ["?"], "y").collect()) == [("", "?"), ("a", "b")]


def test_change_guard_and_fingerprint(spark, tmp_path):
    schema = "dataset string, dataset_fingerprint string"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], schema)
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], schema)
    assert [r["dataset"] for r in sources.changed_since(old, new).collect()] == ["b"]
    write(tmp_path, "a.csv", "x\n1\n")
    first = sources.file_fingerprint(spark, str(tmp_path), "*.csv").head()["dataset_fingerprint"]
    write(tmp_path, "a.csv", "x\n12\n")
    assert sources.file_fingerprint(spark, str(tmp_path), "*.csv").head()["dataset_fingerprint"] != first


def test_moved_folder_is_the_same_data(spark, tmp_path):
    import os

    prints = []
    for folder in ("one", "two"):
        for name, text in (("a.csv", "x\n1\n"), ("deep/b.csv", "x\n2\n")):
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
            os.utime(path, (1_700_000_000, 1_700_000_000))
        prints.append(tuple(sources.file_fingerprint(spark, str(tmp_path / folder), "*.csv", True).head()))
    assert prints[0] == prints[1] and prints[0][1] == 2


def test_row_keys_do_not_collide(spark):
    from featsieve.functions import require_unique, with_row_key

    rows = [("x|=y", "z"), ("x", "y|=z"), ("x", None), ("x", ""), (None, "x"), ("x=", "1"), ("x=1", ""), ("x", "~"), ("a", "b"), ("a", "b"), ("a", "b")]
    df = spark.createDataFrame(rows, "p string, q string")
    keyed = with_row_key(df, copies_per_task=2)
    assert keyed.count() == keyed.select("row_key").distinct().count() == len(rows)
    require_unique(keyed, "row_key")
    for column in ("p", "q"):
        with pytest.raises(ValueError, match="row key"):
            require_unique(df, column)
