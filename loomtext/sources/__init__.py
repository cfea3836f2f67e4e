from loomtext.sources.lines import read_lines
from loomtext.sources.readers import (
    CORPUS_ORDER,
    corpus_bucket,
    read_corpus,
    read_law_chunks,
    read_pairs,
    read_prompt_answers,
    read_summary_split,
)
from loomtext.sources.writers import write_jsonl, write_split_jsonl, write_training_text

__all__ = [
    "CORPUS_ORDER",
    "corpus_bucket",
    "read_corpus",
    "read_law_chunks",
    "read_lines",
    "read_pairs",
    "read_prompt_answers",
    "read_summary_split",
    "write_jsonl",
    "write_split_jsonl",
    "write_training_text",
]
