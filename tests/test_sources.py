import json
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from leafmill import DEFAULT_KEYS
from leafmill.operators.statistics import leaf_statistics
from leafmill.sinks import writers
from leafmill.sources import leaves, paths, tables

SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("a", T.DoubleType()),
        T.StructField("b", T.DoubleType()),
        T.StructField("status_flag", T.StringType()),
    ]
)
HEADER = "timestamp,a,b,status_flag\n"


def write(folder: str, path: str, text: str) -> None:
    full = os.path.join(folder, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as file:
        file.write(text)


@pytest.fixture()
def root(tmp_path):
    folder = str(tmp_path / "raw")
    rows = "2024-01-01 00:00:00,1.5,NA,normal\n2024-01-01 00:30:00,2.5,,alert\n2024-01-01 01:00:00,oops,4.0,null\n"
    for source in ("Source_A", "Source C", "a+b", "x{y}", "50%"):
        for level in ("01", "a_b"):
            write(folder, f"{source}/{level}/1/data.csv", HEADER + rows)
            write(folder, f"{source}/{level}/1/notes.txt", "not a leaf")
    write(folder, "labels.csv", "not a source folder")
    return folder


def test_keys_come_from_the_path_unchanged(spark, root):
    cells = leaves.read_leaves(spark, root, SCHEMA)
    found = {tuple(r) for r in cells.select(*DEFAULT_KEYS).distinct().collect()}
    assert found == {(s, h, "1") for s in ("Source_A", "Source C", "a+b", "x{y}", "50%") for h in ("01", "a_b")}
    assert cells.count() == 30


def test_only_asked_sources_are_listed(spark, root):
    asked = ["Source C", "x{y}", "gone"]
    cells = leaves.read_leaves(spark, root, SCHEMA, asked)
    assert {r[0] for r in cells.select("source").distinct().collect()} == {"Source C", "x{y}"}
    assert len(cells.inputFiles()) == 4
    assert leaves.present_sources(spark, root, asked) == (["Source C", "x{y}"], ["gone"])
    with pytest.raises(ValueError, match="no leaf files"):
        leaves.read_leaves(spark, root, SCHEMA, ["gone"])


def test_missing_texts_and_bad_cells(spark, root):
    cells = leaves.read_leaves(spark, root, SCHEMA, ["Source_A"]).where("hierarchy_1 = '01'")
    rows = cells.orderBy("timestamp").collect()
    assert [(r["a"], r["b"], r["status_flag"]) for r in rows] == [(1.5, None, "normal"), (2.5, None, "alert"), (None, 4.0, None)]
    assert [r["bad_cells"] for r in rows] == [[], [], ["a"]]
    assert leaves.accepted(cells).count() == 3 and leaves.rejects(cells).count() == 1
    assert "bad_cells" not in leaves.accepted(cells).columns


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    folder = str(tmp_path)
    write(folder, "01/1/1/data.csv", "x,y\n1,2\n3,oops\n5,6,999\n7\n")
    write(folder, "1/1/1/data.csv", 'extra,y,x\n"a, b",20,10\n')
    write(folder, "1/1/2/data.csv", "y\n40\n")
    write(folder, "1/1/3/data.csv", "p,q\n1,2\n")
    write(folder, "1/1/4/data.csv", "x,x\n1,2\n")
    write(folder, "1/1/5/data.csv", "")
    schema = T.StructType.fromDDL("x double, y double")
    cells = leaves.read_leaves(spark, folder, schema)
    good = {tuple(r) for r in leaves.accepted(cells).select("source", "hierarchy_2", "x", "y").collect()}
    assert good == {("01", "1", 1.0, 2.0), ("01", "1", 3.0, None), ("01", "1", 7.0, None), ("1", "1", 10.0, 20.0), ("1", "2", None, 40.0)}
    assert sorted(tuple(r["bad_cells"]) for r in leaves.rejects(cells).collect()) == [("_corrupt_row",), ("y",)]
    bad = leaves.bad_leaf_files(spark, folder, schema.names)
    assert {r["_file"].split("/")[-2] for r in bad.collect()} == {"3", "4"}


@pytest.mark.parametrize("listed", [0, 1000])
def test_headers_of_many_files(spark, tmp_path, monkeypatch, listed):
    from leafmill.sources import headers

    monkeypatch.setattr(headers, "BROADCAST_ROWS", listed)
    for i in range(6):
        write(str(tmp_path), f"s {i % 2}/1/{i}/data.csv", f"a,b\n{i},1\n" if i % 3 else f"b,a\n1,{i}\n")
    rows = leaves.read_leaves(spark, str(tmp_path), T.StructType.fromDDL("a double, b double")).collect()
    assert sorted((r["hierarchy_2"], r["a"], r["b"]) for r in rows) == [(str(i), float(i), 1.0) for i in range(6)]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_ten_headers_are_one_scan(spark, tmp_path):
    rng, names = random.Random(1), ["a", "b", "c", "d"]
    expected = []
    for i in range(60):
        own = names[: 1 + i % 4]
        rng.shuffle(own)
        lines = [",".join(own)]
        for j in range(5):
            values = {n: f"{i}.{j}{k}" for k, n in enumerate(own)}
            short = rng.random() < 0.2
            lines.append(",".join(values[n] for n in (own[:-1] if short else own)) or "0")
            row = {n: float(values[n]) for n in (own[:-1] if short else own)}
            expected.append((str(i), *[({own[0]: 0.0} if short and len(own) == 1 else row).get(n) for n in names]))
        write(str(tmp_path), f"s/1/{i}/data.csv", "\n".join(lines) + "\n\n")
    schema = T.StructType.fromDDL("a double, b double, c double, d double")
    cells = leaves.read_leaves(spark, str(tmp_path), schema)
    assert scans(cells) == 1 + 1  # the files, and the table of their headers
    assert len(leaves._headers(spark, str(tmp_path), None, DEFAULT_KEYS, "data.csv").variants) >= 8
    found = [tuple(r) for r in leaves.accepted(cells).select("hierarchy_2", *names).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert leaves.rejects(cells).count() == 0


def test_too_long_rows_where_headers_differ(spark, tmp_path):
    write(str(tmp_path), "s/1/1/data.csv", 'a,b,c\n1,2,3\n1,2,3,4\n1,2,3,4,5\n"x,y",2,3\n"x,y",2,"3,,3"\n,,,\n1\n')
    write(str(tmp_path), "s/1/2/data.csv", 'b\n7\n7,\n"7,7"\n7,8,9,10\n7,8,9\n')
    text = leaves.read_leaf_text(spark, str(tmp_path), columns=["a", "b"])
    found = sorted((tuple(r) for r in text.select("hierarchy_2", "a", "b", "_corrupt_row").collect()), key=str)
    assert found == sorted(
        [
            ("1", "1", "2", None), ("1", "1", "2", "1,2,3,4"), ("1", "1", "2", "1,2,3,4,5"), ("1", "x,y", "2", None), ("1", "x,y", "2", None),
            ("1", None, None, ",,,"), ("1", "1", None, None),
            ("2", None, "7", None), ("2", None, "7", "7,"), ("2", None, "7,7", None), ("2", None, "7", "7,8,9,10"), ("2", None, "7", "7,8,9"),
        ],
        key=str,
    )


def test_unknown_columns_are_inferred_for_all_leaves(spark, tmp_path):
    folder = str(tmp_path)
    write(folder, "A/1/1/data.csv", "x,y\n1,2\n3,n/a\n")
    write(folder, "B/1/1/data.csv", "x,z\n5,late\n")
    text = leaves.read_leaf_text(spark, folder)
    schema = leaves.measured_schema(text)
    assert {f.name: f.dataType.simpleString() for f in schema} == {"x": "double", "y": "double", "z": "string"}
    rows = leaves.typed_cells(text, schema).orderBy("x").collect()
    assert [(r["source"], r["x"], r["y"], r["z"]) for r in rows] == [
        ("A", 1.0, 2.0, None), ("A", 3.0, None, None), ("B", 5.0, None, "late"),
    ]


def test_subfolders_ignore_files(spark, root):
    assert paths.subfolders(spark, root) == sorted(["Source_A", "Source C", "a+b", "x{y}", "50%"])
    assert paths.subfolders(spark, root + "/nothing") == []


def test_json_artifacts(spark, tmp_path):
    for h in ("1", "02"):
        summary = {"mean_of_means": 1.5, "total_variance": 2.0}
        document = {"source": "A", "hierarchy_1": "1", "hierarchy_2": h, "summary_features": summary}
        write(str(tmp_path), f"outcomes_A/1/{h}/artifacts/statistics.json", json.dumps(document, indent=2))
    rows = tables.read_json_artifacts(spark, f"{tmp_path}/*/*/*/artifacts/*.json").orderBy("hierarchy_2").collect()
    assert [r["hierarchy_2"] for r in rows] == ["02", "1"]
    assert rows[0]["summary_features"]["mean_of_means"] == 1.5 and rows[0]["summary_features"]["std_of_means"] is None


def test_feature_files(spark, tmp_path):
    folder = str(tmp_path / "A" / "kind")
    write(folder, "1_01_kind.csv", ",x,y\n0,1.0,2.0\n1,9.0,9.0\n")
    write(folder, "1_2_kind.csv", ",x,y\n0,3.0,4.0\n")
    write(folder, "1_3_kind.csv", ",x,y\n")
    write(folder, "odd.csv", ",x,y\n0,5.0,6.0\n")
    write(folder, "1_4_kind.txt", ",x,y\n0,7.0,8.0\n")
    rows = tables.read_feature_files(spark, folder, "A", "kind").orderBy("hierarchy_2").collect()
    assert [tuple(r) for r in rows] == [("A", "1", "01", 1.0, 2.0), ("A", "1", "2", 3.0, 4.0)]
    assert rows[0].asDict().keys() == {*DEFAULT_KEYS, "kind_x", "kind_y"}


def test_feature_files_are_read_by_name(spark, tmp_path):
    folder = str(tmp_path / "A" / "kind")
    write(folder, "1_1_kind.csv", ",p,q\n0,2,200\n")
    write(folder, "1_2_kind.csv", "q,p\n100,1\n")
    write(folder, "01_2_kind.csv", "p,r\n3,text\n4,more\n")
    rows = tables.read_feature_files(spark, folder, "A", "kind").collect()
    found = {(r["hierarchy_1"], r["hierarchy_2"]): (r["kind_p"], r["kind_q"], r["kind_r"]) for r in rows}
    assert found == {("1", "1"): (2.0, 200.0, None), ("1", "2"): (1.0, 100.0, None), ("01", "2"): (3.0, None, "text")}


def test_features_of_all_sources(spark, tmp_path):
    base = str(tmp_path)
    write(base, "A/one/1_1_one.csv", "x\n1.0\n")
    write(base, "A/two/1_1_two.csv", "z\n2.0\n")
    write(base, "A/two/1_2_two.csv", "z\n3.0\n")
    write(base, "B/one/5_5_one.csv", "x\n4.0\n")
    df = tables.read_source_features(spark, base, ["A", "B", "gone"], ["one", "two", "none"])
    rows = sorted((tuple(r) for r in df.select(*DEFAULT_KEYS, "one_x", "two_z").collect()), key=str)
    assert rows == [("A", "1", "1", 1.0, 2.0), ("A", "1", "2", None, 3.0), ("B", "5", "5", 4.0, None)]
    with pytest.raises(ValueError, match="no features"):
        tables.read_source_features(spark, base, ["gone"], ["one"])


def test_labels(spark, tmp_path):
    write(str(tmp_path), "labels.csv", "source,hierarchy_1,hierarchy_2,label,weight\nA,01,1,1,0.5\nB,2,1,0,1.5\n")
    labels = tables.read_labels(spark, f"{tmp_path}/labels.csv")
    assert dict(labels.dtypes) == {
        "source": "string", "hierarchy_1": "string", "hierarchy_2": "string", "label": "int", "weight": "double",
    }
    assert {r["hierarchy_1"] for r in labels.collect()} == {"01", "2"}
    with pytest.raises(FileNotFoundError):
        tables.read_labels(spark, f"{tmp_path}/none.csv")
    write(str(tmp_path), "short.csv", "source,label\nA,1\n")
    with pytest.raises(ValueError, match="missing required columns"):
        tables.read_labels(spark, f"{tmp_path}/short.csv")


def test_split_csv(spark, tmp_path):
    write(str(tmp_path), "features.csv", "f_x,f_y\n0.5,1\n0.25,2\n")
    write(str(tmp_path), "metadata.csv", "source,hierarchy_1,hierarchy_2\nA,03,5\nA,3,1\n")
    write(str(tmp_path), "labels.csv", "label\n0\n1\n")
    rows = sorted(tuple(r) for r in tables.read_split_csv(spark, str(tmp_path)).collect())
    assert rows == [("A", "03", "5", 0.5, 1, 0), ("A", "3", "1", 0.25, 2, 1)]
    assert len(tables.read_split_csv(spark, str(tmp_path), labels_file=None).columns) == 5
    write(str(tmp_path), "labels.csv", "label\n0\n")
    with pytest.raises(ValueError, match="inconsistent sample counts"):
        tables.read_split_csv(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        tables.read_split_csv(spark, str(tmp_path), labels_file="none.csv")


def test_export_in_many_files_stays_aligned(spark, new_folder):
    df = spark.range(0, 250, 1, 4).select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("k"), (F.col("id") * 2.0).alias("f"), (F.col("id") % 3).alias("label")
    )
    writers.export_split_csv(df, ["k"], new_folder, ["label"], rows_per_file=40)
    rows = tables.read_split_csv(spark, new_folder, "features", "metadata", "labels").collect()
    assert len(rows) == 250 and all(r["f"] == 2.0 * int(r["k"]) and r["label"] == int(r["k"]) % 3 for r in rows)


def test_statistics_of_one_source_can_be_replaced(spark, new_folder):
    df = spark.createDataFrame([("A", "1", 1.0), ("A", "1", 3.0), ("B", "1", 5.0)], "source string, h string, x double")
    keys = ["source", "h"]
    writers.write_statistics(leaf_statistics(df, keys), new_folder)
    changed = df.where("source = 'B'").withColumn("x", F.lit(9.0))
    writers.write_statistics(leaf_statistics(changed, keys), new_folder)
    rows = tables.read_artifacts(spark, new_folder).orderBy("source").collect()
    assert [(r["source"], r["summary_features"]["mean_of_means"]) for r in rows] == [("A", 2.0), ("B", 9.0)]


def test_missing_sets_and_models(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_feature_set(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        tables.load_model(spark, str(tmp_path), "ver_1")
