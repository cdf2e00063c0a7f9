"""Registered queries of the corpus operators: ``(spark, sf_dir) -> DataFrame``
over the whole given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import decontaminate, hard_negatives, hmm, line_dedup, mixing, near_dedup, quality_model, quality_rules, secrets, spelling, substring_dedup, url_filter, warc
from tessera.llm.common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("text")


def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op3_near_dedup(spark, sf_dir):
    return near_dedup.groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_warc_derivatives(spark, sf_dir):
    """Pages as WARC response records, taken apart and derived from."""
    derived = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return derived.drop("record")


def op5_quality_rules(spark, sf_dir):
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def _fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op6_quality_classifier(spark, sf_dir):
    """Learns from the labelled documents of four of five folds and scores all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    out = quality_model.scored(docs, quality_model.fit_labelled(docs, labels.where(_fold(F.col("key")) != 0)))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op7_url_filter(spark, sf_dir):
    """Pages by url; a page is bad where the label of its id says toxic or not
    of quality."""
    bad = F.greatest("toxic", 1 - F.col("quality"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.verdicts(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op8_mix_sources(spark, sf_dir):
    return mixing.planned(table(spark, sf_dir, "documents")).drop("copies")


def op9_line_dedup(spark, sf_dir):
    """Documents by source as host."""
    out = line_dedup.cleaned(table(spark, sf_dir, "documents"), host="source", marks=True)
    return out.select("row.doc_id", "row.source", "n_lines", "n_dropped", "text")


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scanned(docs, secrets.trained(docs))


def op11_spelling_variants(spark, sf_dir):
    """Words with planted typing errors, grouped under their commoner forms."""
    return spelling.variants(table(spark, sf_dir, "documents"), damage=97)


def op12_hard_negatives(spark, sf_dir):
    """Where the id is divisible by 7 the label counts as wrong by one."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors, label=label)


def op13_lm_scores(spark, sf_dir):
    """Learns from the documents of six of seven folds and scores all."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    out = hmm.scored(docs, train=F.coalesce(fold != 2, F.lit(True)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries():
    return {n: f for n, f in globals().items() if n.startswith("op")}
