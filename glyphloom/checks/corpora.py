"""Input frames derived from the test tables, whole tables and whole texts.

Each document becomes one file, so no file grows with the corpus. Attributes of the rows
(language, source, labels) decide the kind of file and what happened to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread_scan

VOCABULARY = ["the", "and", "ion", "que", "sch", "ent", "eau", "ing", "ver", "ou"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_scan(rows) if name == "documents" else rows


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """documents with quality and toxic, null where a document has no label."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def by_lang(en: str, de: str, fr: str, es: str) -> Column:
    cases = F.when(F.col("lang") == "en", en).when(F.col("lang") == "de", de)
    return cases.when(F.col("lang") == "fr", fr).otherwise(es)


def fill(template: str) -> Column:
    """Concatenate a template, ``$name$`` standing for a column."""
    parts = []
    for i, piece in enumerate(template.split("$")):
        parts.append(F.col(piece).cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts)


def prose_files(docs: DataFrame) -> DataFrame:
    """Texts with a blank line after each sentence, under suffixes that end up as blocks."""
    return docs.select(
        "*",
        F.concat(
            F.lit("src/"), "source", F.lit("/d"), F.col("doc_id").cast("string"),
            by_lang(".go", ".py", ".js", ".kt"),
        ).alias("file_path"),
        by_lang("go", "python", "javascript", "kotlin").alias("language"),
        F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("content"),
        (F.col("doc_id") + 1000.5).alias("mtime"),
    )


PYTHON = """import os

@registered
def doc_$doc_id$(x):
    # $hashed$
    return $n_chars$

class Doc$doc_id$(Base):
    "About $source$."

    def size(self):
        return $n_chars$

    async def origin(self):
        return "$source$"

LIMIT = $n_chars$
SOURCE = "$source$"
LANG = "$lang$"
"""

SCRIPT = """import base from './base';

export default async function doc$doc_id$(a$t1$, b$t1$)$t2$ {
  /* $text$ */
  return "{";
}

export class Doc$doc_id$ extends Base {
  size()$t2$ {
    return $n_chars$; // }
  }

  static async origin(x$t1$) {
    if (x) {
      return `}`;
    }
  }
}

const f$doc_id$$t3$ = (a) => {
  return a;
};
"""

DART = """import 'dart:core';

abstract class Doc$doc_id$ extends Base {
  int size() {
    return $n_chars$;
  }

  Future<String> origin(String x) async {
    return '}';
  }
}

void doc$doc_id$(int a, int b) {
  // $slashed$
  return;
}
"""


def code_files(docs: DataFrame) -> DataFrame:
    """One source file per document that carries the whole text in a comment."""
    script = F.col("lang") == "es"
    parts = docs.select(
        "*",
        F.replace("text", F.lit("\n"), F.lit("\n    # ")).alias("hashed"),
        F.replace("text", F.lit("\n"), F.lit("\n  // ")).alias("slashed"),
        F.when(script, ": number").otherwise("").alias("t1"),
        F.when(script, ": string").otherwise("").alias("t2"),
        F.when(script, ": Fn").otherwise("").alias("t3"),
    )
    content = F.when(F.col("lang") == "en", fill(PYTHON)).when(F.col("lang") == "de", fill(DART))
    return parts.select(
        "doc_id", "lang", "source", "n_chars",
        F.concat(
            F.lit("code/"), "source", F.lit("/d"), F.col("doc_id").cast("string"),
            by_lang(".py", ".dart", ".js", ".ts"),
        ).alias("file_path"),
        by_lang("python", "dart", "javascript", "typescript").alias("language"),
        content.otherwise(fill(SCRIPT)).alias("content"),
        (F.col("doc_id") + 2000.5).alias("mtime"),
    )


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    columns = ["file_path", "language", "content", "mtime"]
    return prose_files(docs).select(*columns).unionByName(code_files(docs).select(*columns))


def path_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths with ignored, hidden, underscored and generated parts; size in characters."""
    number = F.col("doc_id").cast("string")
    place = (
        F.when(F.col("toxic") == 1, "web/node_modules/")
        .when(F.col("quality") == 0, ".hid/")
        .when(F.col("quality") == 1, "src/")
        .otherwise("lib/_priv/")
    )
    name = F.concat(by_lang("d", "d", ".d", "_d"), number, by_lang(".py", ".test.dart", ".js", ".md"))
    return labelled(spark, folder).select(
        F.concat(place, F.col("source"), F.lit("/"), name).alias("file_path"),
        F.col("n_chars").alias("size"),
    )


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The prose files before and after: es files arrive, toxic ones go, low-quality ones
    get more text, de ones are only touched, those of src7 turn binary."""
    files = prose_files(labelled(spark, folder))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    binary = F.col("source") == "src7"
    moved = poor | binary | (F.col("lang") == "de")
    old = files.where(F.col("lang") != "es")
    text = F.when(poor, F.concat("content", F.lit("\n\nnow\nwith\nmore"))).otherwise(F.col("content"))
    new = files.where(~toxic).withColumns(
        {
            "mtime": F.when(moved, F.col("mtime") + 1).otherwise(F.col("mtime")),
            "content": F.when(binary, F.concat(text, F.lit("\x00"))).otherwise(text),
        }
    )

    def canonical(df: DataFrame) -> DataFrame:
        raw = F.encode("content", "UTF-8")
        return df.select("file_path", raw.alias("content"), "mtime", F.octet_length(raw).cast("long").alias("size"))

    return canonical(old), canonical(new)


def byte_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as UTF-8 (en), with a BOM (de), as Latin-1 (fr) and with a NUL byte (es)."""
    utf8 = F.encode("text", "UTF-8")
    narrow = (F.col("lang") == "fr") & ~F.col("text").rlike(r"[^\x00-\xFF]")
    raw = (
        F.when(F.col("lang") == "de", F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), utf8))
        .when(narrow, F.encode(F.when(narrow, F.col("text")), "ISO-8859-1"))
        .when(F.col("lang") == "es", F.concat(utf8, F.lit(bytearray(b"\x00"))))
        .otherwise(utf8)
    )
    return table(spark, folder, "documents").select("doc_id", raw.alias("content"))


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector per label (query_id, embedding); widths are fixed, groups pre-aggregate."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return vectors.select(
        F.col("label").alias("query_id"), F.transform("v", lambda x: x["m"]).alias("embedding")
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
