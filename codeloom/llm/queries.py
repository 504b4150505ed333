"""The corpus operators applied to the given tables, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    bpe,
    decontam,
    hnsw,
    licenses,
    packing,
    phrases,
    quality,
    simhash,
    slots,
    toolcalls,
    urls,
    warc,
    whitening,
)
from codeloom.llm.common import table
from codeloom.llm.sql_checks import CHECKS as CHECKS


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(quality.held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def license_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text``: the documents laid out as files by source, language and number;
    every second one with a licence notice is a licence file in one of its directories."""
    k, has = F.col("doc_id"), F.coalesce(F.col("text").rlike(licenses.NOTICE_LINE), F.lit(False))
    top = F.coalesce("source", F.lit("none"))
    module = F.concat_ws("/", top, F.coalesce("lang", F.lit("none")), F.concat(F.lit("m"), k % 97))
    place = F.when(k % 3 == 0, top).when(k % 3 == 1, F.concat_ws("/", top, F.coalesce("lang", F.lit("none"))))
    path = F.when(has & (k % 2 == 0), F.concat(place.otherwise(module), F.lit("/LICENSE."), k)).otherwise(
        F.concat(module, F.lit("/f"), k, F.lit(".txt"))
    )
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(license_tree(spark, sf_dir))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )


def op5_hnsw_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", packing.ids_crc32().alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontam.Decontamination(docs, table(spark, sf_dir, "benchmark")).report(docs)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


TOOLS = (
    toolcalls.Tool("search", (toolcalls.Param("query", "string"), toolcalls.Param("limit", "integer", False))),
    toolcalls.Tool("convert", (toolcalls.Param("amount", "number"), toolcalls.Param("unit", "string"))),
    toolcalls.Tool("lookup", (toolcalls.Param("ids", "array"), toolcalls.Param("exact", "boolean", False))),
)


def call_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls from the assistants' turns and results from all others, by projection and with
    whole texts: a call depends on the first one of its eight turns and some on the one
    before, and one in thirteen repeats an earlier identifier. A user's turn answers the
    turn before it, one in eleven under an identifier that no call has, and a system turn
    has none."""
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 7 + F.col("turn"))
    k, turn = F.col("k"), F.col("turn")
    # the text as a JSON string
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    quoted = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("string")
    name = F.when(k % 4 == 0, "search").when(k % 4 == 1, "convert").when(k % 4 == 2, "lookup").otherwise("wipe")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    arguments = (
        F.when(k % 35 == 0, text('{"query":', quoted, "} tail"))
        .when(k % 6 == 0, text('{"query":', quoted, ',"limit":', n, "}"))
        .when(k % 6 == 1, text('{ "limit": ', n, ', "query": ', quoted, " }"))
        .when(k % 6 == 2, text('{"unit":', quoted, ',"amount":', n, ".5}"))
        .when(k % 6 == 3, text('{"ids":[', n, ",", quoted, '],"exact":true}'))
        .when(k % 6 == 4, text('{"query":[', quoted, "]}"))
        .otherwise(text('{"query":', quoted))
    )
    call = lambda t: F.concat(F.lit("c"), t)
    after = F.array_compact(
        F.array(
            F.when(turn % 8 > 1, call(turn - turn % 8 + 1)),
            F.when(turn % 4 == 3, call(turn - 2)),
            F.when((F.col("conv_id") % 50 == 7) & (turn == 1), F.lit("c5")),
        )
    )
    again = (k % 13 == 0) & (turn > 2)
    calls = rows.filter("role = 'assistant'").select(
        "conv_id", call(F.when(again, turn - 2).otherwise(turn)).alias("call_id"), "turn", name.alias("name"),
        arguments.alias("arguments"), after.alias("after"),
    )
    answered = F.when(k % 11 == 0, F.concat(F.lit("x"), turn)).otherwise(call(turn - 1))
    results = rows.filter("role is null or role <> 'assistant'").select(
        "conv_id", F.when(F.col("role") == "user", answered).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = call_tables(spark, sf_dir)
    return toolcalls.tool_calls(calls, results, TOOLS)


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.train(urls.seed_labels(pages))).withColumnRenamed("id", "page_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    # the operator gives exact digits; here they are a long, and an error beyond it
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_hnsw_neardup": op5_hnsw_neardup,
    "op6_cost_packing": op6_cost_packing,
    "op7_tool_calls": op7_tool_calls,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_byte_bpe": op13_byte_bpe,
}
