from loomtext.plans.augmentation import augmentation_report, augmented_mixture
from loomtext.plans.comparison import compare_arms
from loomtext.plans.examples import summary_examples, translation_texts
from loomtext.plans.parallel import aligned_pairs
from loomtext.plans.pretraining import pretraining_corpus
from loomtext.plans.serving import serve_chat, serve_requests, serve_sessions

__all__ = [
    "aligned_pairs",
    "augmentation_report",
    "augmented_mixture",
    "compare_arms",
    "pretraining_corpus",
    "serve_chat",
    "serve_requests",
    "serve_sessions",
    "summary_examples",
    "translation_texts",
]
