"""The operators of this folder over whole test tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.llm import ball_tree, chat, collocations, decontaminate, hosts, licenses, main_text, neardup, oracle, packing, quality, secrets, sharding, suffix_dedup
from tallywind.llm.tables import land, table

#: The rules of the contract, longest first only by their effect.
URL_RULES = (
    hosts.Rule("allow", "com", "/"), hosts.Rule("block", "example.com", "/en/"), hosts.Rule("allow", "www.example.com", "/en/"),
    hosts.Rule("block", "net", "/es/"), hosts.Rule("block", "net", "/fr/"),
)


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    spans = decontaminate.find_spans(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    # Equal rows were judged once; each gets its line.
    rows = spans.withColumn("copy", F.explode_outer(F.expr("sequence(1, copies)")))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.withColumn("copy", F.explode_outer(F.expr("sequence(1, copies)"))).select(
        "doc_id", "n_sentences", F.size("found").cast("long").alias("n_known"),
        F.array_join(F.transform("found", lambda f: f["sentence_id"]), ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    # The rank file and the added tokens are those of byte_bpe_50k.json: equal ids, a third of the time.
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)
    return packed.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    features = quality.vote(quality.add_features(documents))
    judged = quality.judge(land(features.select(F.col("doc.doc_id"), *[c for c in features.columns if c != "doc"])))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.base_failed().alias("base_failed"), (F.col("good") & ~quality.base_failed()).alias("kept"), "posterior",
    )


def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.cluster(table(spark, folder, "documents"), shingle_words=3, percent=85, keep=["doc_id"])
    return found.select(
        "doc.doc_id", "n_shingles", "component_id", F.col("doc.doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, folder, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"), ["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{secrets.KINDS[k].name}") for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
        secrets.digest(F.col("all_spans")).alias("spans"),
        F.array_join(F.transform("all_spans", lambda s: F.when(s["live"], "live").otherwise("example")), ",").alias("verdicts"),
    )


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.rotate(table(spark, folder, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return views.select("conv_id", "part", "speaker", "n_turns", "n_own", "text", spans.alias("masks"))


def op9_hosts(spark: SparkSession, folder: str) -> DataFrame:
    # The tables have no labels of pages; those of the documents with the same numbers stand in for them.
    outcomes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.expr("cast(quality = 1 AND toxic = 0 AS int)").alias("good")
    )
    judged = hosts.judge(table(spark, folder, "pages"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), best=50)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.mine(table(spark, folder, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_neardup": op5_neardup,
    "op6_sharding": op6_sharding,
    "op7_secrets": op7_secrets,
    "op8_chat": op8_chat,
    "op9_hosts": op9_hosts,
    "op10_main_text": op10_main_text,
    "op11_search": op11_search,
    "op12_collocations": op12_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: The others need a tokenizer, EM, sketches, Spark's hash or an HTML parser; tests compare them with brute force.
SQL: dict[str, str] = {
    "op1_decontaminate": oracle.DECONTAMINATE,
    "op2_licenses": oracle.licenses_sql(),
    "op8_chat": oracle.CHAT,
    "op9_hosts": oracle.HOSTS,
    "op11_search": oracle.SEARCH,
    "op12_collocations": oracle.COLLOCATIONS,
    "op13_suffix_dedup": oracle.REPEATS,
}
