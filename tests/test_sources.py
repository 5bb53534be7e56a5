from pyspark.sql import functions as F

from neumes.sources import scans, sinks


def test_manifest_and_resolution(spark, tmp_path):
    (tmp_path / "raw" / "jpg").mkdir(parents=True)
    (tmp_path / "raw" / "jpg" / "a.jpg").write_bytes(b"x")
    (tmp_path / "train_0.txt").write_text("data/jpg/a.jpg data/gt/a.kern 3\nshort line\ndata/syn/b.jpg  data/gt/b.kern 1\n")
    rows = scans.manifest(spark, str(tmp_path / "train_0.txt"))
    assert [(r.img, r.n, r.split, r.fold, r.is_synthetic) for r in rows.orderBy("img").collect()] == [("data/jpg/a.jpg", 3, "train", 0, False), ("data/syn/b.jpg", 1, "train", 0, True)]
    files = scans.listing(spark, str(tmp_path / "raw"), "*.jpg")
    found = {r.img: r.img_path for r in scans.resolved(rows, files, "img", [str(tmp_path / "raw")]).collect()}
    assert found["data/jpg/a.jpg"] == f"{tmp_path}/raw/jpg/a.jpg" and found["data/syn/b.jpg"] == f"{tmp_path}/raw/data/syn/b.jpg"
    assert scans.existing(scans.resolved(rows, files, "img", [str(tmp_path / "raw")]), files, ["img_path"]).count() == 1


def test_annotations(spark, tmp_path):
    good = "{'systems': [{'bounding_box': {'fromX': 0, 'toX': 5, 'fromY': 1, 'toY': 9}, '**kern': '4c'}]}"
    spark.createDataFrame([(1, good), (2, '{"systems": []}'), (3, "no literal"), (4, None)], "page_id long, annotation string").write.parquet(str(tmp_path / "a"))
    got = {r.page_id: r.systems for r in scans.annotations(spark, str(tmp_path / "a")).collect()}
    assert got[1][0].kern == "4c" and got[1][0].bounding_box.toY == 9 and got[2] == [] and got[3] is None and got[4] is None


def test_notation_and_predictions(spark, tmp_path):
    for name, text in (("p1__gt", "a\n"), ("p1__base", "b"), ("p2__gt", "c")):
        (tmp_path / f"{name}.kern").write_text(text)
    assert {r.page_id: r.text for r in scans.notation(spark, str(tmp_path)).collect()}["p1__gt"] == "a\n"
    got = {r.page: (r.gt, r.base) for r in scans.predictions(spark, str(tmp_path), ["base"]).collect()}
    assert got == {"p1": ("a\n", "b"), "p2": ("c", None)}


def test_csv_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", float("nan"), True), ("b", 2.0, False)], "page string, ser_x double, near boolean")
    sinks.write_csv(rows, str(tmp_path / "c"), ["page", "near", "ser_x"])
    back = scans.metric_table(spark, str(tmp_path / "c"), "page string, near int, ser_x double").orderBy("page").collect()
    assert [tuple(r) for r in back] == [("a", 1, None), ("b", 0, 2.0)]
    assert scans.csv_models(["page", "ser_x", "cer_y"]) == ["x", "y"]
    text = sinks.markdown(rows.where("page = 'b'"), "Pages")
    assert text.splitlines() == ["Pages", "", "| page | ser_x | near  |", "|------|-------|-------|", "| b    | 2.00  | False |"]
    assert sinks.markdown(rows.limit(0)) == "(none)\n"
    assert sinks.markdown(spark.range(3).selectExpr("id", "'x' AS long_name"), most=2) == "| id | long_name |\n|----|-----------|\n| 0  | x         |\n| 1  | x         |\n\nOnly the first 2 rows are shown.\n"
    sinks.write_lines(rows.select("page"), str(tmp_path / "t"), single=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]
    made = []
    build = lambda: made.append(1) or spark.createDataFrame([("a", 1)], "token string, id long")
    for _ in range(2):
        assert sinks.stored_vocabulary(spark, str(tmp_path / "v"), build).count() == 1
    assert made == [1]


def test_image_sizes(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0abc" * 2)) + chunk(b"IEND", b"")
    (tmp_path / "ok.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"none")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.valid) for r in scans.images(spark, str(tmp_path)).collect()}
    assert got == {"ok.png": (3, 2, True), "bad.png": (128, 128, False)}
    assert spark.createDataFrame([(bytearray(png),)], "x binary").select(scans.png_size(F.col("x")).alias("s")).first().s == (3, 2)


def test_split_files_as_a_source(spark, tmp_path):
    from neumes.sources import files

    files.register(spark)
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits" / "train_0.txt").write_text("a.jpg  a.txt 3\nshort\n\nb_SYN.jpg b.txt x\nc.jpg c.txt 12")
    (tmp_path / "splits" / "train_1.txt").write_text("d.jpg d.txt 1\n")
    (tmp_path / "splits" / "val_0.txt").mkdir()
    (tmp_path / "splits" / "val_0.txt" / "part-0").write_text("e.jpg e.txt 2\n")
    (tmp_path / "splits" / "val_0.txt" / "_SUCCESS").write_text("")
    (tmp_path / "splits" / "notes.md").write_text("x y 1\n")
    rows = spark.read.format("neumes_splits").load(str(tmp_path / "splits"))
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("a.jpg", "a.txt", 3, "train", 0, False), ("b_SYN.jpg", "b.txt", None, "train", 0, True), ("c.jpg", "c.txt", 12, "train", 0, False), ("d.jpg", "d.txt", 1, "train", 1, False), ("e.jpg", "e.txt", 2, "val", 0, False),
    ]
    assert [r.img for r in rows.where("split = 'train' AND fold = 1").collect()] == ["d.jpg"]
    assert sorted(r.img for r in rows.where("split IN ('val', 'test') AND n > 1").collect()) == ["e.jpg"]
    assert rows.where("split = 'none'").count() == 0
    assert spark.read.format("neumes_splits").option("with_n", "false").load(str(tmp_path / "splits" / "train_0.txt")).where("n IS NULL").count() == 3


def test_filters_choose_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from neumes.sources.files import SplitReader

    for name in ("train_0.txt", "train_1.txt", "val_0.txt"):
        (tmp_path / name).write_text("a b 1\n" * 10)
    reader = SplitReader({"path": str(tmp_path), "bytes": "1"})
    rest = [GreaterThan(("n",), 3), EqualTo(("n",), 4)]
    assert list(reader.pushFilters([EqualTo(("split",), "train"), rest[0], In(("fold",), (0, 7)), rest[1]])) == rest
    assert [p.paths for p in reader.partitions()] == [(f"{tmp_path}/train_0.txt",)]
    assert len(SplitReader({"path": str(tmp_path), "bytes": "1"}).partitions()) == 3 and len(SplitReader({"path": str(tmp_path)}).partitions()) == 1


def test_named_texts(spark, tmp_path):
    from neumes.sources import files

    files.register(spark)
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("p1__gt.kern", "a\nb\n"), ("sub/p2__gt.kern", "é"), ("p1__base.kern", None)], "name string, text string")
    rows.write.format("neumes_texts").mode("append").save(path)
    read = spark.read.format("neumes_texts")
    assert sorted((r.name, r.text) for r in read.load(path).collect()) == [("p1__base.kern", ""), ("p1__gt.kern", "a\nb\n"), ("p2__gt.kern", "é")]
    assert [r.text for r in read.option("pattern", r"([^/]+)__gt\.kern$").load(path).where("name = 'p2'").collect()] == ["é"]
    assert {r.page: (r.gt, r.base) for r in scans.predictions(spark, path, ["base"]).collect()}["p1"][0] == "a\nb\n"
    rows.limit(1).write.format("neumes_texts").mode("overwrite").save(path)
    assert sorted(p.name for p in (tmp_path / "t").rglob("*") if p.is_file()) == ["p1__gt.kern"]
