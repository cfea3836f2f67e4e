"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.decontaminate import contaminated
from loomtext.llm.language import identify, train
from loomtext.llm.licenses import find_licenses
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.packing import pack_tokens
from loomtext.llm.periodic_runs import periodic_runs
from loomtext.llm.pii import KINDS, find_personal_data, span_list
from loomtext.llm.prefix_trie import numbered, spliced, trie_nodes, turn_keys
from loomtext.llm.quality import apply_line_rules
from loomtext.llm.sampled_pieces import sample_segmentations
from loomtext.llm.secret_scan import scan
from loomtext.llm.spark_tools import checkpointed
from loomtext.llm.substrings import remove_repeats
from loomtext.llm.token_counts import count_tokens
from loomtext.llm.words import WORD, read_table


def op1_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), path="source")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("personal", lambda span: span.base)

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda span: span.kind == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", "personal", base.alias("base")).select(
        "doc_id", *map(counted, KINDS), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("personal")).alias("spans")
    )


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_line_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", *[f"quality.{name}" for name in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines", "bad_punctuation", "bad_navigation", "bad_boilerplate", "lost_chars",
        )],
        F.sha2("quality.cleaned", 256).alias("cleaned_sha256"),
    )


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "unique.n_words", "unique.n_removed", F.sha2("unique.kept", 256).alias("kept_sha256"))


def op8_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(fold != 2))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous"
    )


def op9_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sample_segmentations(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return drawn.select(
        "doc_id", "draw", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "log_prob", "log_inclusion", "decodes"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_positional_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, labels = F.transform("base", lambda x: x.start), F.transform("base", lambda x: x.label)
    by_template = F.transform("notices", lambda x: x.label)

    def listed(names: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    return found.select("doc_id", "licenses.n_words", "licenses.base", "licenses.notices").select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(labels).alias("base_labels"), listed(F.concat(labels, by_template)).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x.score)), F.lit(0.0)).alias("score"),
    )


def op12_bitmap_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = turn_keys(read_table(spark, sf_dir, "conversations"))
    return trie_nodes(*spliced(checkpointed(numbered(keys))))


def op13_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = h % 10 == 0

    @F.arrow_udf("string")
    def repeating(texts: pa.Array, draws: pa.Array) -> pa.Array:
        """The words from a certain one on, replaced by repeats of the first of them."""
        result = []
        for text, g in zip(texts.to_pylist(), draws.to_pylist(), strict=True):
            own = WORD.findall(text or "")
            if own:
                a = g % len(own)
                period = 1 + (len(own) - a) // (3 + g % 8)
                own[a:] = [own[a + i % period] for i in range(len(own) - a)]
            result.append(" ".join(own))
        return pa.array(result, pa.string())

    # Only the chosen texts go to Python here.
    planted = repeating(F.when(chosen, F.col("text")), F.floor(h / 10))
    found = periodic_runs(docs.withColumn("text", F.when(chosen, planted).otherwise(F.col("text"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")

    def steeper(best: Column, r: Column) -> Column:
        """Of two runs the one with more periods, compared without division; the first of equal ones."""
        return F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)

    top = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), steeper)
    return found.select("doc_id", "periodic.runs", "periodic.collapsed").select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_forest_secrets, op2_best_fit_packing, op3_weak_supervision, op4_spaced_seeds, op5_tensored_minhash, op6_line_rules, op7_difference_cover,
        op8_output_codes, op9_gumbel_pieces, op10_token_counts, op11_positional_licenses, op12_bitmap_trie, op13_basic_factors,
    )}
