"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from togglelog.llm import (
    hard_negatives,
    jaccard_join,
    kd_shards,
    lang_id,
    mixing,
    packing,
    permutation_index,
    quality_lines,
    substring_dedup,
    token_rollup,
    tool_calls,
    training_order,
    turn_repair,
)
from togglelog.llm.storage import new_path, written


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_frequency(spark, sf_dir):
    """Statistics and verdicts of every document; hosts are sources."""
    return quality_lines.line_quality(table(spark, sf_dir, "documents")).drop("removed_lines")


def language(spark, sf_dir):
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = lang_id.train(docs.where(third != 1).select("text", "lang"), tokenizer("piece_bpe_32k.model"))
    held_out = F.coalesce(third == 1, F.lit(False)).alias("held_out")
    return lang_id.predict(docs.select("doc_id", held_out, "text"), model).drop("text")


def substring(spark, sf_dir):
    """Words of every document that lie in windows of 35 words met elsewhere, removed."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def mixture(spark, sf_dir):
    """Words taken of every document when sources are mixed by weights 5, 2, 1."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def packed(spark, sf_dir):
    """Pieces of every document in sequences of at most 2048 tokens."""
    found = packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep_cache=True)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def near_duplicates(spark, sf_dir):
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


def training_shards(spark, sf_dir):
    """Sequences of all documents in a random order, written to shards in the shared folder."""
    path = new_path(spark, "shards")
    return training_order.materialise(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), key=20)


# Tools of the conversations below.
TOOLS = {
    "count": {"properties": {"text": "string", "chars": "integer"}, "required": ["text", "chars"]},
    "echo": {"properties": {"text": "string"}, "required": ["text"]},
    "search": {"properties": {"text": "string", "exact": "boolean"}, "required": ["text", "exact"]},
}


def tool_messages(spark, sf_dir):
    """Conversations read as tool use: an assistant's turn calls a tool with its text, the user's turn
    after it is the result, and each call depends on the assistant's turn before."""
    turns = table(spark, sf_dir, "conversations")
    chars = F.length("text")
    tool = F.element_at(F.array(*map(F.lit, sorted(TOOLS))), F.pmod(chars, F.lit(3)) + 1)
    arguments = F.when(tool == "echo", F.to_json(F.struct("text"))).otherwise(
        F.to_json(F.struct("text", chars.alias("chars")))
    )

    def identifier(turn):
        return F.concat_ws("-", F.lit("call"), "conv_id", turn)

    calls = turns.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.lit("call").alias("kind"),
        identifier(F.col("turn")).alias("call_id"),
        tool.alias("name"),
        arguments.alias("arguments"),
        identifier(F.col("turn") - 2).alias("after"),
        F.lit(None).cast("string").alias("content"),
    )
    nothing = F.lit(None).cast("string")
    results = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.lit("result").alias("kind"),
        identifier(F.col("turn") - 1).alias("call_id"),
        nothing.alias("name"),
        nothing.alias("arguments"),
        nothing.alias("after"),
        F.col("text").alias("content"),
    )
    return calls.unionByName(results)


def linked_calls(spark, sf_dir):
    """Calls and results of all conversations, linked, ordered, validated and serialised."""
    found = tool_calls.link_tool_calls(tool_messages(spark, sf_dir), TOOLS)
    digests = {"errors": F.concat_ws("; ", "errors"), "json_md5": F.md5("json")}
    return found.withColumns(digests).drop("json")


def neighbours(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def rollup(spark, sf_dir):
    """Token totals after four batches of changes to documents, two of them sent twice.

    All documents come with their counts by two public tokenizers, word-49k and byte-50k. Documents of fewer
    than 50 words are deleted under both. Counts of word-49k are then revised to include an end token.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counts = token_rollup.count_tokens(docs, tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counts = written(counts.withColumn("revised", F.col("word_tokens") + 1), "counts")

    def change(rows, version, kind, tokens, old=None):
        old = F.lit(None).cast("long") if old is None else F.col(old)
        return rows.select(
            "source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(kind).alias("kind"),
            F.col(tokens).alias("tokens"), old.alias("old_tokens"),
        )

    short = counts.where("words < 50")
    batches = {
        "1-words": change(counts, "word-49k", "insert", "word_tokens"),
        "2-bytes": change(counts, "byte-50k", "insert", "byte_tokens"),
        "3-short": change(short, "word-49k", "delete", "word_tokens").union(change(short, "byte-50k", "delete", "byte_tokens")),
        "4-ended": change(counts.where("words >= 50"), "word-49k", "revise", "revised", "word_tokens"),
    }
    path = new_path(spark, "rollup")
    for name in [*batches, "3-short", "1-words"]:
        token_rollup.apply_batch(spark, path, name, batches[name])
    return token_rollup.totals(spark, path)


def negatives(spark, sf_dir):
    """Five hard negatives for each of five positives of every row whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label")
    label = F.when(F.col("vec_id") % 7 == 0, (label + F.lit(1).cast("long")) % 10).otherwise(label)
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, every_row=True)


def repaired(spark, sf_dir):
    """Faults of every damaged conversation, and its cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    rows = turn_repair.ordered_rows(turn_repair.damaged(conversations))
    figures = written(turn_repair.repair(rows), "figures")
    digests = turn_repair.repaired_digests(rows, figures).withColumnRenamed("conv_id", "_digest_of")
    found = figures.join(digests, figures["conv_id"].eqNullSafe(F.col("_digest_of"))).withColumnRenamed("conv_id", "_conv")
    everyone = conversations.select("conv_id").distinct()
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return everyone.join(found, everyone["conv_id"].eqNullSafe(F.col("_conv")), "left").select(
        everyone["conv_id"],
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        *[F.coalesce(c, value).alias(c) for c, value in nothing.items()],
    )


def sharded(spark, sf_dir):
    """Every document in one of eight shards of near equal bytes."""
    found = kd_shards.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def pipeline(spark, sf_dir):
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": line_frequency,
    "op2_language": language,
    "op3_substring": substring,
    "op4_training_shards": training_shards,
    "op5_linked_calls": linked_calls,
    "op6_neighbours": neighbours,
    "op7_mixture": mixture,
    "op8_packed": packed,
    "op9_near_duplicates": near_duplicates,
    "op10_rollup": rollup,
    "op11_hard_negatives": negatives,
    "op12_turn_repair": repaired,
    "op13_kd_shards": sharded,
    "pipeline": pipeline,
}
