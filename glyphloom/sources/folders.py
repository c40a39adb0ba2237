"""Small files and folders in whatever store holds an index, through Spark's file system layer."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    place, store = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, store = _store(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Object stores: a rename there is a copy and a deletion, but an object appears when its stream is
#: closed, and the store itself refuses to create one that exists.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "obs"}


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that appears whole and at once, or raise FileExistsError.

    On a file system the text goes to a file of its own, which is then renamed without overwriting;
    on an object store it is put under its name on condition that there is nothing.
    """
    place, store = _store(spark, path)
    put = _put_if_absent if store.getScheme() in OBJECT_STORES else _rename_draft
    try:
        put(spark, store, place, text)
    except Py4JJavaError as e:
        cause = e.java_exception
        while cause is not None:
            if any(name in cause.getClass().getName() for name in _TAKEN):
                raise FileExistsError(path) from None
            cause = cause.getCause()
        raise


#: Java exceptions that say that a name is taken.
_TAKEN = ("FileAlreadyExistsException", "PathExistsException", "RemoteFileChangedException")


def _put_if_absent(spark: SparkSession, store, place, text: str) -> None:
    """The condition holds when the stream is closed: a client that cannot ask for that on S3 is refused."""
    builder = store.createFile(place).overwrite(False).recursive()
    option = builder.must if store.getScheme().startswith("s3") else builder.opt
    stream = option("fs.option.create.conditional.overwrite", True).build()
    # a stream that is closed after an error would put what it has got so far: one write, then the close
    stream.write(bytearray(text.encode()))
    stream.close()


def _rename_draft(spark: SparkSession, store, place, text: str) -> None:
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(place), options)
    except Py4JJavaError:
        store.delete(draft, False)
        raise


def remove(spark: SparkSession, path: str) -> None:
    place, store = _store(spark, path)
    store.delete(place, True)
