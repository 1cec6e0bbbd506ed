"""The operators as queries over the corpus tables: name -> callable(spark, folder) -> DataFrame."""

import public_tokenizers
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm import chat, decontam, langid, lexical, lines, packing, passages, prefix_trie, sharding, simhash, sketches, token_counts, warc
from riskflow.llm.tables import read
from riskflow.session import fresh_dir

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark, folder):
    archive = fresh_dir(spark, "warc")
    warc.write_archive(read(spark, folder, "pages"), archive)
    return warc.read_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                    "refers_to", "verified")


@query
def op2_line_dedup(spark, folder):
    """With the ratio of its SQL, ten times the operator's own."""
    docs = read(spark, folder, "documents").select("doc_id", "source", "text", "n_chars")
    return lines.drop_boilerplate(docs, max_ratio=0.1, dropped="lines_dropped")


@query
def op2_template_lines(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "source", "text", "n_chars")
    return lines.drop_boilerplate(docs, dropped="lines_dropped")


@query
def op3_chat(spark, folder):
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.segments(turns.unionByName(own)))


@query
def op4_token_counts(spark, folder):
    return token_counts.token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     public_tokenizers.PATTERN)


@query
def op5_fingerprints(spark, folder):
    return sketches.compare_with_next(read(spark, folder, "documents"))


@query
def op6_sharding(spark, folder):
    placed = sharding.shard(read(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "moved")


@query
def op7_simhash(spark, folder):
    found = simhash.groups(read(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_packing(spark, folder):
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op9_langid(spark, folder):
    docs = read(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op10_decontam(spark, folder):
    return decontam.matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op11_passages(spark, folder):
    return passages.removed(read(spark, folder, "documents"))


def _shared_openings(turns):
    """Turns of the conversations c that take their first crc32(c) % 9 ones from conversation c - c % 5, and all ids."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    plain = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    ranked = plain.select("conv_id", F.row_number().over(order).alias("turn"), "role", "text")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    ids = plain.select("conv_id").distinct()
    heads = ranked.where("turn <= 8").withColumnRenamed("conv_id", "base")
    opened = (ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base")
              .where(F.col("turn") <= taken).select("conv_id", "turn", "role", "text"))
    return ranked.where(F.col("turn") > taken).unionByName(opened), ids


@query
def op12_prefix_trie(spark, folder):
    return prefix_trie.trie(*_shared_openings(read(spark, folder, "conversations")))


@query
def op13_search(spark, folder):
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
