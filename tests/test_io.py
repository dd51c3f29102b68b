"""Readers and writers: round trips through files in a scratch folder."""

import gzip
import hashlib
import json
import os

from pyspark.sql import functions as F

from litspark.sources import files as fs
from litspark.sources import sinks as sk


def test_headerless_and_headered_csv(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "list.csv")
    with open(p, "w") as f:
        f.write("a.txt\nb.txt\n")
    assert [r[0] for r in fs.read_headerless(spark, p, ["file_name"]).collect()] == ["a.txt", "b.txt"]
    q = os.path.join(tmpdir_run, "meta.csv")
    with open(q, "w", encoding="windows-1252") as f:
        f.write('file_name,title,year\n"a.txt","Caf\xe9 society",1990\n')
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    d = fs.read_csv_columns(spark, q, ["title"], encoding="windows-1252").collect()
    assert d[0]["title"] == "Caf\xe9 society"


def test_whole_texts_and_listed(spark, tmpdir_run):
    os.makedirs(os.path.join(tmpdir_run, "txt"))
    for n, body in (("a.txt", "one\ntwo"), ("b.txt", "three")):
        with open(os.path.join(tmpdir_run, "txt", n), "w") as f:
            f.write(body)
    d = {os.path.basename(r["path"]): r["text"] for r in fs.read_whole_texts(spark, os.path.join(tmpdir_run, "txt")).collect()}
    assert d == {"a.txt": "one\ntwo", "b.txt": "three"}
    lines = fs.read_whole_texts(spark, os.path.join(tmpdir_run, "txt"), lines=True).count()
    assert lines == 3
    listed = spark.createDataFrame([("b.txt",)], "file_name string")
    got = fs.read_listed_texts(spark, os.path.join(tmpdir_run, "txt"), listed).collect()
    assert [r["text"] for r in got] == ["three"]


def test_json_folders(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "tweets")
    for week in (1, 2, 5):
        os.makedirs(os.path.join(root, f"2020-week{week}"))
        for fi in range(3):
            with open(os.path.join(root, f"2020-week{week}", f"f{fi}.json"), "w") as f:
                for i in range(10):
                    key = "lang" if i % 2 else "language"
                    f.write(json.dumps({"id": week * 1000 + fi * 100 + i, "full_text": "t", key: "en" if i % 3 else "fr"}) + "\n")
    schema = "id long, full_text string, lang string, language string"
    d = fs.read_json_folders(spark, root, schema, num_rand_files=2, start_week=1, end_week=2, nrows=4)
    rows = d.collect()
    assert {r["id"] // 1000 for r in rows} <= {1, 2}
    assert all(r["language"] == "en" for r in rows)
    assert len({(r["id"] // 1000, (r["id"] // 100) % 10) for r in rows}) <= 4
    assert all(r["id"] % 100 < 4 for r in rows)


SCHEMA = "id long, full_text string, lang string, language string"


def _week(root, week, files):
    folder = os.path.join(root, week) if week else root
    os.makedirs(folder, exist_ok=True)
    for name, rows in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.writelines(json.dumps({"id": i, "full_text": "t" * 50, "lang": "en"}) + "\n" for i in rows)


def _chosen(names, n, seed=0):
    return sorted(names, key=lambda x: (hashlib.md5(f"{seed}:{x}".encode()).hexdigest(), x))[:n]


def test_json_files_that_are_not_chosen_are_not_opened(spark, tmpdir_run):
    names = [f"f{k} #%5B[{k}].json.gz" for k in range(6)]
    for w in (1, 2, 3):
        folder = os.path.join(tmpdir_run, f"2020-week{w}")
        os.makedirs(folder)
        for k, name in enumerate(names):
            rows = "".join(json.dumps({"id": w * 1000 + 10 * k + i, "full_text": "t", "lang": "en"}) + "\n" for i in range(5))
            with open(os.path.join(folder, name), "wb") as f:  # opening any other fails
                f.write(gzip.compress(rows.encode()) if w < 3 and name in _chosen(names, 2) else b"not a gzip file")
        with open(os.path.join(folder, "notes.txt"), "w") as f:
            f.write("no json")
    got = fs.read_json_folders(spark, tmpdir_run, SCHEMA, num_rand_files=2, start_week=1, end_week=2, nrows=3)
    assert sorted(r["id"] for r in got.collect()) == sorted(w * 1000 + 10 * names.index(x) + i for w in (1, 2) for x in _chosen(names, 2) for i in range(3))
    assert fs.read_json_folders(spark, tmpdir_run, SCHEMA, num_rand_files=2, start_week=7).count() == 0


def test_json_one_folder_and_all_files(spark, tmpdir_run):
    one, two = os.path.join(tmpdir_run, "one"), os.path.join(tmpdir_run, "two")
    files = {f"f{k}.json": range(10 * k, 10 * k + 4) for k in range(5)}
    _week(one, "", files)
    _week(one, "2020-week1", {"below.json": [999]})
    got = fs.read_json_folders(spark, one, SCHEMA, levels=1, nrows=2)
    assert sorted(r["id"] for r in got.collect()) == sorted(10 * k + i for k in range(5) for i in range(2))
    some = fs.read_json_folders(spark, one, SCHEMA, levels=1, num_rand_files=2, seed=4)
    assert sorted(r["id"] for r in some.collect()) == sorted(i for x in _chosen(files, 2, 4) for i in files[x])
    _week(two, "2020-week1", files)
    _week(two, "2020-week2", {"a.json": [100, 101]})
    assert fs.read_json_folders(spark, two, SCHEMA).count() == 22
    assert [r["id"] for r in fs.read_json_folders(spark, two, SCHEMA, start_week=2, nrows=1).collect()] == [100]


def test_json_file_in_several_splits_keeps_its_order(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "big")
    _week(root, "2020-week1", {"a.json": range(4000), "b.json": range(10000, 10050)})
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        d = fs.read_json_folders(spark, root, SCHEMA, nrows=1500)
        assert spark.read.schema(SCHEMA).json(f"{root}/*/a.json").rdd.getNumPartitions() > 5
        assert sorted(r["id"] for r in d.collect()) == [*range(1500), *range(10000, 10050)]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_embedding_text_and_dictionary(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "vec.txt")
    with open(p, "w") as f:
        f.write("cat 0.1 0.2\ndog 0.3 0.4\n")
    d = {r["word"]: r["vector"] for r in fs.read_embedding_text(spark, p).collect()}
    assert abs(d["dog"][1] - 0.4) < 1e-6
    q = os.path.join(tmpdir_run, "dict.txt")
    with open(q, "w") as f:
        f.write("culture\nsocial,network\nrole  model\n")
    terms = {r["term"]: r["multi"] for r in fs.read_dictionary(spark, q).collect()}
    assert terms == {"culture": False, "social network": True, "role  model": True}


def test_sinks_round_trip(spark, tmpdir_run):
    df = spark.createDataFrame([(1, 1975, 'say "hi"'), (2, 1990, "x"), (3, 2020, "y")], "id long, year int, t string")
    out = os.path.join(tmpdir_run, "dec")
    sk.write_with_decades(df, out, "year")
    back = spark.read.parquet(out)
    assert back.where("decade = 'all'").count() == 3
    assert {r["decade"] for r in back.collect()} == {"all", "1971_1981", "1982_1992"}
    q = os.path.join(tmpdir_run, "q")
    sk.write_quoted_csv(df, q)
    raw = "".join(open(os.path.join(q, f)).read() for f in os.listdir(q) if f.endswith(".csv"))
    assert '"say ""hi"""' in raw and '"1975"' in raw
    t = os.path.join(tmpdir_run, "lines")
    sk.write_text_list(df, "t", t)
    assert spark.read.text(t).count() == 3
    n = os.path.join(tmpdir_run, "named")
    sk.write_named_sets(df.withColumn("subject", F.lit("soc")), n, ["subject"])
    assert os.path.isdir(os.path.join(n, "subject=soc"))
    assert sk.removed_rows(df, F.col("year") < 2000, ["t"]).columns == ["id", "year"]
