"""The registered queries of this package, thin digests of the operators' results, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, class_lm, decontamination, language_id, near_dedup, pieces, preference, prefix_trie, quality, repair, token_counts, url_filter, warc
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op10_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("failed_rules")


def op5_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    records = warc.read_archives(warc.write_archives(pages, warc.archive_folder(pages)))
    return records.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def learnable(folds, held_out):
    """Whether crc32 of the id's text leaves another remainder than the held-out one."""
    return F.crc32(F.col("doc_id").cast("string")) % folds != held_out


def op2_token_counts(spark, sf_dir):
    counted = token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("*", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_class_lm(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model, counts = class_lm.train(documents.where(learnable(7, 2)))
    return class_lm.score(documents, model, counts, {"doc_id": F.col("doc_id"), "held_out": ~learnable(7, 2)}).select("row.*", "*").drop("row")


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents.where(learnable(3, 1)))
    judged = language_id.classify(documents, model, {"doc_id": F.col("doc_id"), "held_out": ~learnable(3, 1)})
    return judged.select("row.*", "lang_pred", "score")


# The conversation that imitates control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark, sf_dir):
    columns = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(chat.as_chain(rows))).withColumnRenamed("tree", "conv_id")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark, sf_dir):
    filters = url_filter.build(spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA))
    return url_filter.judge(table(spark, sf_dir, "pages"), filters)


def op9_near_dedup(spark, sf_dir):
    classes = near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damaged(rows), rows)


def op12_prefix_trie(spark, sf_dir):
    conv = F.col("conv_id")
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string")) % 9, conv - conv % 5)


def op13_preference_quality(spark, sf_dir):
    columns = {"doc_id": F.col("doc_id"), "held_out": ~learnable(3, 1)}
    return preference.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable(3, 1), columns)


QUERIES = {
    query.__name__: query
    for query in (
        op1_decontamination,
        op2_token_counts,
        op3_class_lm,
        op4_sentencepiece,
        op5_warc,
        op6_language_id,
        op7_chat_format,
        op8_url_filter,
        op9_near_dedup,
        op10_quality_rules,
        op11_conversation_repair,
        op12_prefix_trie,
        op13_preference_quality,
    )
}
