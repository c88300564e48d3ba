"""Consecutive ids on wide frames, and the stored catalogue."""

import pytest
from pyspark.sql import functions as F

from kbspark.operators import catalog as cat
from kbspark.sources import catalog_store as store
from kbspark.sources.manuals import shared_folder, store_images


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_are_consecutive_on_a_wide_frame(spark, adaptive):
    n, old = 400_000, spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 3).alias("text"))
        got = cat.sequential_ids(wide, "k", 100)
        row = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                      F.sum((F.col("id") != F.col("k") + 101).cast("int")).alias("wrong"), F.min(F.length("text")).alias("w")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert (row["n"], row["d"], row["lo"], row["hi"], row["wrong"], row["w"]) == (n, n, 101, 100 + n, 0, 384)


def _catalog(spark, rows):
    return spark.createDataFrame([(i, fp, f"{fp}_{i}.png", "image/png", None, None, a) for i, fp, a in rows],
                                 "image_row long, filepath string, filename string, content_type string, title string, description string, assistant_id long")


def test_only_touched_folders_are_rewritten(spark):
    catalog = _catalog(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "c d=%", 1), (5, "007", 1)])
    root = shared_folder(spark, "t-store")
    store.save_catalog(catalog, root)
    schema = catalog.select(*store.COLUMNS).schema
    before = {r["filepath"]: r["f"] for r in store.load_catalog(spark, root, schema).select("filepath", F.input_file_name().alias("f")).distinct().collect()}
    touched = spark.createDataFrame([("a",), ("c d=%",), ("unknown",)], "filepath string")
    store.replace_folders(spark, root, schema, touched, lambda c: c.where("assistant_id <> 1"))
    after = store.load_catalog(spark, root, schema)
    assert sorted((r["image_row"], r["filepath"]) for r in after.collect()) == [(2, "a"), (3, "b"), (5, "007")]
    files = {r["filepath"]: r["f"] for r in after.select("filepath", F.input_file_name().alias("f")).distinct().collect()}
    assert files["b"] == before["b"] and files["007"] == before["007"] and files["a"] != before["a"]


def test_a_failed_change_leaves_the_old_version(spark, monkeypatch):
    catalog = _catalog(spark, [(1, "a", 1), (2, "b", 1), (3, None, 1)])
    root = shared_folder(spark, "t-store")
    store.save_catalog(catalog, root)
    schema = catalog.select(*store.COLUMNS).schema
    touched = spark.createDataFrame([("a",), ("n",)], "filepath string")

    def rows():
        return sorted((r["image_row"], r["filepath"] or "") for r in store.load_catalog(spark, root, schema).collect())

    def fail(*_):
        raise OSError("lost between write and switch")

    def change(c):
        return c.where("filepath <> 'a' or filepath is null").unionByName(c.where("image_row = 1").withColumn("filepath", F.lit("n")).select(*c.columns))

    with monkeypatch.context() as m:
        m.setattr(store, "switch", fail)
        with pytest.raises(OSError):
            store.replace_folders(spark, root, schema, touched, change)
    assert rows() == [(1, "a"), (2, "b"), (3, "")]
    branch = store.replace_folders(spark, root, schema, touched, lambda c: c.where("filepath = 'b'"), publish=False)
    assert rows() == [(1, "a"), (2, "b"), (3, "")]
    assert sorted(r["image_row"] for r in store.load_catalog(spark, root, schema, branch).collect()) == [2, 3]
    store.replace_folders(spark, root, schema, touched, change)
    assert rows() == [(1, "n"), (2, "b"), (3, "")]
    assert store.remove_unused(spark, root, schema) == [1, 2]
    assert rows() == [(1, "n"), (2, "b"), (3, "")]


def test_a_change_published_meanwhile_is_not_lost(spark):
    catalog = _catalog(spark, [(1, "a", 1), (2, "b", 1)])
    root = shared_folder(spark, "t-store")
    store.save_catalog(catalog, root)
    schema = catalog.select(*store.COLUMNS).schema
    a, b = (spark.createDataFrame([(f,)], "filepath string") for f in "ab")

    def change(c):
        store.replace_folders(spark, root, schema, b, lambda d: d.where("filepath <> 'b'"))
        return c.where("filepath <> 'a'")

    with pytest.raises(RuntimeError):
        store.replace_folders(spark, root, schema, a, change)
    assert [r["image_row"] for r in store.load_catalog(spark, root, schema).collect()] == [1]


def test_the_last_image_of_a_path_stays(spark):
    images = spark.createDataFrame([(1, 1, "m", "x.png", b"old"), (2, 1, "m", "x.png", b"new"), (1, 2, "m", "y.png", b"y")],
                                   "doc_id long, img_idx int, filepath string, filename string, content binary")
    got = store_images(images, shared_folder(spark, "t-images")).collect()
    assert sorted((r["path"], bytes(r["content"])) for r in got) == [("m/m_x.png", b"new"), ("m/m_y.png", b"y")]
