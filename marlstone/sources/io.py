"""Readers and writers of other formats, and batches for training loops."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coco
from .paths import work_path


def _file(spark: SparkSession, source: str | bytes, name: str) -> str:
    """A path for a source; bytes are put into the shared folder, as executors read it."""
    if isinstance(source, str):
        return source
    from pyarrow import fs

    uri = work_path(spark, name)
    store, root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(source)
    return f"{uri}/{name}"


def from_parquet(spark: SparkSession, source: str | bytes) -> DataFrame:
    """Of a path, or of a file's bytes."""
    return spark.read.parquet(_file(spark, source, "rows.parquet"))


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """(n): the count of a Parquet folder's rows from the files' footers alone, pushed into the reader."""
    key, before = "spark.sql.sources.useV1SourceList", spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(key, "")  # the reader that takes aggregates is that of the second version
    try:
        df = spark.read.parquet(path).agg(F.count("*").alias("n"))
        df._jdf.queryExecution().optimizedPlan()  # fixed while the setting holds
        return df
    finally:
        spark.conf.set(key, before)


def from_csv(spark: SparkSession, path: str | bytes, schema: str | None = None) -> DataFrame:
    """With a header, of a path or a file's bytes; types are inferred, which reads the file twice, unless a schema is given."""
    path = _file(spark, path, "rows.csv")
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def to_coco(path: str, **parts: DataFrame) -> None:
    """One JSON document with a list for each of ``parts`` (images, annotations, categories)."""
    coco.write(path, parts)


def from_coco(spark: SparkSession, images_dir: str, annotations: str) -> DataFrame:
    """A row per image of a COCO file: its fields, and its annotations' boxes, categories and polygons as sequences."""
    lists = coco.read(spark, annotations)
    images = lists["images"].select("id", "file_name", "height", "width")
    names = lists["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    marks = lists["annotations"]
    marks = marks.select(F.col("image_id").alias("id"), F.col("id").alias("mark"), "bbox", "category_id", *(["segmentation"] if "segmentation" in marks.columns else []))
    marks = marks.join(names, "category_id", "left")
    cols = [c for c in ("bbox", "category_id", "category", "segmentation") if c in marks.columns]
    seqs = marks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("mark", *cols))).alias("s"))
    return images.join(seqs, "id", "left").select(F.concat(F.lit(images_dir.rstrip("/") + "/"), "file_name").alias("image"), "id", "height", "width", *(F.col("s")[c].alias(c) for c in cols))


def batches(df: DataFrame, size: int, drop_last: bool = False, columns: list[str] | None = None) -> Iterator[dict]:
    """Column batches of ``size`` rows; the next partition is fetched while one is read."""
    names = columns or df.columns
    rows: list = []
    for r in df.select(*names).toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == size:
            yield {c: [x[c] for x in rows] for c in names}
            rows = []
    if rows and not drop_last:
        yield {c: [x[c] for x in rows] for c in names}


def prefetched(items: Iterator, ahead: int = 2) -> Iterator:
    """The same items, made by a thread that is up to ``ahead`` in front; its errors are raised here."""
    ready: queue.Queue = queue.Queue(ahead)
    end, stop = object(), threading.Event()

    def put(x: object) -> None:
        while not stop.is_set():
            try:
                return ready.put(x, timeout=0.2)
            except queue.Full:
                pass

    def work() -> None:
        try:
            for x in items:
                put((x, None))
                if stop.is_set():
                    return
            put((end, None))
        except BaseException as e:  # noqa: BLE001
            put((end, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        while True:
            x, error = ready.get()
            if error:
                raise error
            if x is end:
                return
            yield x
    finally:
        stop.set()


def tensorflow_loader(df: DataFrame, size: int, transform=None, drop_last: bool = False):
    """An iterable over tensor batches where tensorflow is installed."""
    try:
        import tensorflow as tf
    except ImportError as e:
        raise RuntimeError("tensorflow is not installed") from e
    for b in prefetched(batches(df, size, drop_last)):
        out = {k: tf.constant(v) for k, v in b.items()}
        yield transform(out) if transform else out


def torch_loader(df: DataFrame, size: int, transform=None, drop_last: bool = False):
    """An iterable over tensor batches where torch is installed."""
    try:
        import torch
    except ImportError as e:
        raise RuntimeError("torch is not installed") from e
    for b in prefetched(batches(df, size, drop_last)):
        out = {k: torch.as_tensor(v) if isinstance(v[0], (int, float, list)) else v for k, v in b.items()}
        yield transform(out) if transform else out
