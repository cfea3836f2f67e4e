"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables as t
from catalog.models import digest_model, picky_model, token_model
from loomtext import plans
from loomtext.defaults import CONTEXT_CHARS, SEED, TASK_SUMMARY_2_3
from loomtext.operators import align, articles, compare, corpus, evaluate, lexicon, mixture, numerals, ordering, prompts, sessions
from loomtext.operators import split as splits
from loomtext.operators.apply import apply_model, apply_model_capped, apply_model_once

Query = Callable[[SparkSession, str], DataFrame]

# Sizes of the sampling operators, small enough to bite on the test tables.
HEAD = 500
SAMPLE = 300
NUMERAL_CAP = 100
ORIGINALS = 1000
WIDE_CHARS = (10, 2000)
# Parameters of the reports.
MARKERS = "äöüß"
SEQUENCE_BOUNDS = (256, 512, 1024)
BATCH, ACCUMULATION = 2, 8
MAX_TOKENS = 20


def length_filter(spark, sf):
    return corpus.keep_lengths(t.corpus(spark, sf), CONTEXT_CHARS).select("doc_id", F.length("text").alias("n"))


def cpt_corpus(spark, sf):
    return corpus.head_corpus(t.corpus(spark, sf), ["doc_id"], limit=None)


def cpt_corpus_head(spark, sf):
    return corpus.head_corpus(t.corpus(spark, sf), ["doc_id"], limit=HEAD)


def cpt_corpus_eos(spark, sf):
    return plans.pretraining_corpus(t.corpus(spark, sf), ["doc_id"])


def article_paragraphs(spark, sf):
    return articles.article_paragraphs(t.chunks(spark, sf))


def align_articles(spark, sf):
    return align.common_articles(t.chunks(spark, sf))


def align_paragraphs(spark, sf):
    return align.zip_paragraphs(t.chunks(spark, sf))


def align_pairs(spark, sf):
    return align.align_pairs(t.chunks(spark, sf))


def align_pairs_wide(spark, sf):
    return align.align_pairs(t.chunks(spark, sf), chars=WIDE_CHARS)


def align_split(spark, sf):
    return plans.aligned_pairs(t.chunks(spark, sf), chars=WIDE_CHARS)


def align_report(spark, sf):
    return align.align_report(t.chunks(spark, sf))


def pair_gate(spark, sf):
    pairs = t.turn_pairs(spark, sf)
    return pairs.select("conv_id", "turn", align.gate(pairs).alias("ok"))


def hash_split(spark, sf):
    return splits.hash_split(t.turn_pairs(spark, sf)).select("conv_id", "turn", "split")


def split_report(spark, sf):
    return splits.split_report(splits.hash_split(t.turn_pairs(spark, sf)))


def lexicon_mine(spark, sf):
    return lexicon.mine(t.turn_pairs(spark, sf), t.LEXICON).select("conv_id", "turn", "fr", "fk")


def lexicon_augment(spark, sf):
    pairs = t.turn_pairs(spark, sf).select("conv_id", "turn", "ru", "ky")
    return lexicon.substitute(lexicon.mine(pairs, t.LEXICON), t.LEXICON)


def numeral_candidates(spark, sf):
    return numerals.candidates(t.part_pairs(spark, sf))


def numeral_augment(spark, sf):
    return numerals.variants(numerals.candidates(t.part_pairs(spark, sf)), ["k"], cap=NUMERAL_CAP)


def sample_n(spark, sf):
    return ordering.sample_n(t.corpus(spark, sf).select("doc_id"), SAMPLE, ["doc_id"], SEED)


def _mixture(spark, sf, shuffle=False, **limits):
    return plans.augmented_mixture(t.all_pairs(spark, sf), ["kind", "k", "turn"], lexicon=t.LEXICON, shuffle=shuffle, **limits)


def augment_mixture(spark, sf):
    """Every candidate and every original pair, shuffled."""
    return _mixture(spark, sf, shuffle=True)


def augment_mixture_all(spark, sf):
    """The same rows as they come."""
    return _mixture(spark, sf)


def mixture_report(spark, sf):
    """Of a mixture with limits."""
    return mixture.mixture_report(_mixture(spark, sf, numeral_cap=NUMERAL_CAP, originals=ORIGINALS))


def augmentation_report(spark, sf):
    return plans.augmentation_report(
        t.all_pairs(spark, sf), ["kind", "k", "turn"], lexicon=t.LEXICON, numeral_cap=NUMERAL_CAP, originals=ORIGINALS,
    )


def sft_translate_examples(spark, sf):
    return prompts.translation_examples(t.turn_pairs(spark, sf).select("conv_id", "turn", "ru", "ky"))


def sft_summary_pairs(spark, sf):
    return plans.summary_examples(t.summaries(spark, sf), keep=("doc_id",))


def sft_hand_pairs(spark, sf):
    """The variant for hand-written sets: no filter, another task line."""
    return plans.summary_examples(t.summaries(spark, sf), bounds=None, task=TASK_SUMMARY_2_3, keep=("doc_id",))


def _contexts(spark, sf):
    return corpus.keep_lengths(t.corpus(spark, sf), CONTEXT_CHARS)


def prompt_zero_shot(spark, sf):
    return _contexts(spark, sf).select("doc_id", prompts.zero_shot_prompt("text").alias("prompt"))


def prompt_few_shot(spark, sf):
    return _contexts(spark, sf).select("doc_id", prompts.few_shot_prompt("text", t.SHOTS).alias("prompt"))


def prompt_variants(spark, sf):
    variants = {
        "grounded": prompts.summary_prompt("text"),
        "corrupt": prompts.corrupt_prompt("text"),
        "raw": prompts.chat_prompt("text", raw=True),
        "chat": prompts.chat_prompt("text", raw=False),
    }
    rows = [F.struct(F.lit(name).alias("variant"), prompt.alias("prompt")) for name, prompt in variants.items()]
    return _contexts(spark, sf).select("doc_id", F.inline(F.array(*rows)))


def request_prompts(spark, sf):
    prompt = prompts.translate_prompt("direction", "text")
    return t.requests(spark, sf).select("conv_id", "turn", prompt.alias("prompt"))


def heldout_pick(spark, sf):
    picked = compare.pick_positions(t.corpus(spark, sf), ["doc_id"], [5, 6, 7], limit=8)
    return picked.select("doc_id", "pos")


def heldout_all(spark, sf):
    return compare.pick_positions(t.corpus(spark, sf), ["doc_id"], None, limit=5).select("doc_id", "pos")


def _shot_arms():
    return {
        "zero": (prompts.zero_shot_prompt("text"), digest_model),
        "one": (prompts.few_shot_prompt("text", t.SHOTS), digest_model),
    }


def ab_outputs(spark, sf):
    return compare.run_arms(_contexts(spark, sf), _shot_arms()).drop("text")


def ab_picked(spark, sf):
    arms = {
        "grounded": (prompts.summary_prompt("text"), digest_model),
        "corrupt": (prompts.corrupt_prompt("text"), digest_model),
    }
    return plans.compare_arms(t.corpus(spark, sf), ["doc_id"], 8, [5, 6, 7], arms).drop("text")


def ab_stored(spark, sf):
    """Two stored output sets, one row per (context, arm), shown side by side."""
    stored = prompt_variants(spark, sf).select(
        "doc_id", F.col("variant").alias("arm"), F.md5("prompt").alias("output")
    )
    return compare.side_by_side(stored, "doc_id", ["grounded", "corrupt"])


def apply_model_all(spark, sf):
    return apply_model(t.corpus(spark, sf), "text", digest_model).drop("text")


def apply_model_dedup(spark, sf):
    return apply_model_once(t.corpus(spark, sf), "text", digest_model).drop("text")


def capped_answers(spark, sf):
    answered = apply_model_capped(t.corpus(spark, sf), "text", token_model, MAX_TOKENS, echoes=True)
    return answered.select("doc_id", "output.answer", "output.cut", "output.tokens")


def ab_identical(spark, sf):
    return evaluate.identical_outputs(ab_stored(spark, sf), "out_grounded", "out_corrupt")


def heldout_anti(spark, sf):
    return evaluate.held_out(t.benchmark(spark, sf), t.corpus(spark, sf)).select("item_id")


def contamination(spark, sf):
    return evaluate.contamination(t.benchmark(spark, sf), t.corpus(spark, sf), "item_id", "doc_id")


def containment(spark, sf):
    return evaluate.containment(t.benchmark(spark, sf), t.corpus(spark, sf), "item_id")


def copy_rate(spark, sf):
    return evaluate.copy_rate(t.summaries(spark, sf), "summary", "text").select("doc_id", "grams", "copied")


def fabricated_numbers(spark, sf):
    return evaluate.fabricated_numbers(t.summaries(spark, sf), "summary", "text").select("doc_id", "invented")


def marker_language(spark, sf):
    return evaluate.marker_language(t.table(spark, sf, "documents"), "lang", MARKERS)


def length_profile(spark, sf):
    return evaluate.length_profile(t.table(spark, sf, "documents"), "lang", CONTEXT_CHARS)


def ratio_profile(spark, sf):
    pairs = t.summaries(spark, sf).select(F.lit("doc").alias("law"), F.col("doc_id").cast("string").alias("article"), "summary", "text")
    return evaluate.ratio_profile(splits.hash_split(pairs), "split", "summary", "text")


def seq_overflow(spark, sf):
    return evaluate.overflow(t.corpus(spark, sf), SEQUENCE_BOUNDS)


def step_budget(spark, sf):
    return evaluate.step_budget(cpt_corpus(spark, sf), BATCH, ACCUMULATION)


def lexicon_coverage(spark, sf):
    return evaluate.lexicon_coverage(t.turn_pairs(spark, sf), t.LEXICON)


def _no_nulls(*names):
    return [F.coalesce(name, F.lit("")).alias(name.split(".")[-1]) for name in names]


def apply_model_errors(spark, sf):
    answered = apply_model(t.corpus(spark, sf), "text", picky_model, catch=True)
    return answered.select("doc_id", *_no_nulls("output.value", "output.error"))


def serve_requests(spark, sf):
    answered = plans.serve_requests(t.requests(spark, sf), digest_model)
    return answered.select("conv_id", "turn", *_no_nulls("value", "error"))


def session_direction(spark, sf):
    return sessions.directions(t.session_lines(spark, sf))


def session_take_while(spark, sf):
    return sessions.take_while(t.session_lines(spark, sf))


def session_requests(spark, sf):
    return sessions.translator_requests(t.session_lines(spark, sf))


def serve_sessions(spark, sf):
    return plans.serve_sessions(t.session_lines(spark, sf), digest_model).select("session", "seq", "direction", "value")


def serve_chat(spark, sf):
    return plans.serve_chat(t.session_lines(spark, sf), digest_model).select("session", "seq", "answer")


ALL: list[Query] = [
    length_filter, cpt_corpus, cpt_corpus_head, cpt_corpus_eos,
    article_paragraphs, align_articles, align_paragraphs, align_pairs, align_pairs_wide, align_split, align_report,
    pair_gate, hash_split, split_report,
    lexicon_mine, lexicon_augment, numeral_candidates, numeral_augment, sample_n, augment_mixture, mixture_report,
    sft_translate_examples, sft_summary_pairs, sft_hand_pairs,
    prompt_zero_shot, prompt_few_shot, prompt_variants, request_prompts,
    heldout_pick, heldout_all, ab_outputs, ab_picked, ab_stored, apply_model_all, apply_model_errors, serve_requests,
    session_direction, session_take_while, session_requests, serve_sessions, serve_chat,
    augment_mixture_all, apply_model_dedup, ab_identical, heldout_anti, contamination, copy_rate, fabricated_numbers, marker_language,
    length_profile, seq_overflow, step_budget, lexicon_coverage,
    containment, ratio_profile, augmentation_report, capped_answers,
]


def registry() -> dict[str, Query]:
    return {query.__name__: query for query in ALL}
