"""One query per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from . import batches, bktree, bpe, htmltext, langid, lexical, merkle, packing, pii, quality, secretscan, urlrules, vafile, warc
from .oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_vector_approximation(spark, folder):
    return vafile.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op2_main_text(spark, folder):
    return htmltext.page_texts(table(spark, folder, "pages"))


@query
def op3_language(spark, folder):
    documents = table(spark, folder, "documents")
    model = langid.fit(langid.training_sample(documents))
    judged = langid.with_language(documents, model, keep=["doc_id"])
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_simhash(spark, folder):
    found = bktree.near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op5_quality(spark, folder):
    documents = table(spark, folder, "documents")
    return quality.judge_quality(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_byte_bpe(spark, folder):
    ranks = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.with_ids(table(spark, folder, "documents"), ranks, keep=["doc_id"]), ranks)


@query
def op7_personal_data(spark, folder):
    found = pii.with_spans(table(spark, folder, "documents"), keep=["doc_id"])
    spans = F.col("spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    base = of(*pii.BASE)
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query
def op8_url_rules(spark, folder):
    judged = urlrules.judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op9_best_fit(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query
def op10_warc_derivatives(spark, folder):
    responses = warc.response_records(table(spark, folder, "pages"))
    return warc.derivatives(responses, keep=["page_id"])


@query
def op11_secrets(spark, folder):
    ranks = secretscan.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = secretscan.with_spans(table(spark, folder, "documents"), ranks, keep=["doc_id"])
    spans = F.col("spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secretscan.BASE]
    base = of(*secretscan.BASE)
    return found.select("doc_id", *counts, F.sha2(secretscan.listed(base).cast("binary"), 256).alias("base_sha256"), secretscan.listed(spans).alias("spans"))


@query
def op12_ranked_search(spark, folder):
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_merkle_manifest(spark, folder):
    documents = table(spark, folder, "documents")
    fields = {c: F.col(c) for c in merkle.FIELDS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(changed, merkle.leaf_digest(list((fields | {"n_chars": F.col("n_chars") + 1}).values())))
    rows = documents.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), merkle.leaf_digest(list(fields.values())).alias("node"), tampered.alias("tampered"))
    manifest = merkle.write_manifest(rows, scratch_folder(spark))
    root = F.lit(manifest.root()).cast("string")
    leaf, own = merkle.hex_text(F.col("node")), merkle.hex_text(F.coalesce("tampered", "node"))
    leaves = manifest.paths(["key", "node", "tampered"])
    subroots = batches.few(manifest.subroots().withColumnRenamed("tree", "subroot_tree"))
    found = leaves.join(subroots, F.col("tree").eqNullSafe(F.col("subroot_tree")))
    found = found.select(F.col("key").alias("doc_id"), leaf.alias("leaf"), "subroot", root.alias("root"), F.sha2(merkle.partners(F.col("path")).cast("binary"), 256).alias("proof_sha256"), merkle.fold(own, F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
