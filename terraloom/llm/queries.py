"""The registered queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import bpe, compression_quality, conversation_repair, decontamination, document_tree, genetic_packing, ppm, prob_minhash, quality_rules, sharding, suffix_dedup, token_counts, token_files
from terraloom.llm.oracles import CONVERSATION_REPAIR, DECONTAMINATION, DOCUMENT_TREE, QUALITY_RULES, SHARDING, SUFFIX_DEDUP
from terraloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from terraloom.session import scratch_root

SHARDS = 8
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
PACKED_END_ID = 0
PREDICT_FROM = 0.3


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Tokens of every text under the unigram model of the multilingual vocabulary."""
    return token_counts.counted(table(spark, sf_dir, "documents"), MULTI_RANKS)


@query("op2_sharding", SHARDING)
def op2_sharding(spark, sf_dir):
    """All documents in eight contiguous shards of near-equal bytes."""
    out = sharding.sharded(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    """Every text's ids written to Simple-8b files and read back."""
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER, END_ID)
    return token_files.digests(spark, path)


@query("op4_ppm_scores")
def op4_ppm_scores(spark, sf_dir):
    """Every text's probability under a byte model and a word model of the documents that are not held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    scores = ppm.scored(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_suffix_dedup", SUFFIX_DEDUP)
def op5_suffix_dedup(spark, sf_dir):
    """Bytes of every text that repeat an earlier string of 100 bytes, removed."""
    left = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = left.withColumn("kept", F.coalesce("kept", F.lit(b"")))
    removed = F.expr("aggregate(sequence(1, cast(size(spans) / 2 as int)), 0L, (n, i) -> n + spans[2 * i - 1] - spans[2 * i - 2])")
    n_removed = F.when(F.size("spans") > 0, removed).otherwise(F.lit(0).cast("long"))
    return left.select(
        "doc_id",
        (F.octet_length("kept") + n_removed).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_compression_quality")
def op6_compression_quality(spark, sf_dir):
    """Quality of every text, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = compression_quality.scored(docs, model, ("doc_id", held_out.alias("held_out")))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    """Every text encoded by the multilingual ranks and decoded again."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), MULTI_RANKS)


@query("op8_quality_rules", QUALITY_RULES)
def op8_quality_rules(spark, sf_dir):
    """Rule counts of every document, and what is kept after its host's verdict; the host is the source."""
    return quality_rules.judged(table(spark, sf_dir, "documents"), host="source").drop("host", "host_rejected")


@query("op9_near_duplicates")
def op9_near_duplicates(spark, sf_dir):
    """The class of near copies of every document."""
    return prob_minhash.classes(table(spark, sf_dir, "documents"))


@query("op10_decontamination", DECONTAMINATION)
def op10_decontamination(spark, sf_dir):
    """Words of documents that benchmark windows hit."""
    found = decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query("op11_document_tree", DOCUMENT_TREE)
def op11_document_tree(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return document_tree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_genetic_packing")
def op12_genetic_packing(spark, sf_dir):
    """Every document's pieces in sequences of at most 2048 tokens."""
    return genetic_packing.packed(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PACKED_END_ID)


@query("op13_conversation_repair", CONVERSATION_REPAIR)
def op13_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and the repaired lines of every conversation, of which about a quarter of the turns are damaged first."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.Repair(conversation_repair.damaged(conversations), of=conversations).audits()


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
