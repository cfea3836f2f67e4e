"""Secrets in texts: pattern candidates, false positives removed by a random
forest (operator 1).

Patterns propose candidates generously.  A forest over their length, character
transitions, dictionary coverage, path and neighbouring words, trained on
labelled findings, decides which are secrets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.spark_tools import checkpointed, smallest_marks

# Formats that issuers document; a match is a labelled finding of a secret.
ISSUED_FORMS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|"
    r"AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"
)
ISSUED = re.compile(ISSUED_FORMS)
# An issued form, a value after an assigned name, or a run of key characters with
# a digit.  A value in quotes goes up to the quote that ends it, others are whole
# runs of any length.  Names begin where a run does, and the possessive repeats
# take runs whole, so the search is linear.
KEY_RUN = r"[A-Za-z0-9+/_.~-]{8,}+={0,2}"
CANDIDATE = re.compile(
    rf"(?<![A-Za-z0-9_-])(?P<issued>{ISSUED_FORMS})(?![A-Za-z0-9_-])"
    r"|(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}"
    rf"(?P<quote>[\"'])?(?P<value>(?(quote)(?:(?:(?!(?P=quote))\S){{8,}}+(?=(?P=quote))|{KEY_RUN})|{KEY_RUN}))"
    r"|(?<![A-Za-z0-9+/_-])(?P<bare>(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2})(?![A-Za-z0-9+/_=-])"
)


def candidate_values(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of every candidate.  A stop that ends a sentence is no
    part of a value; ``name`` is what the value is assigned to, or empty."""
    for match in CANDIDATE.finditer(text):
        kind = "issued" if match["issued"] is not None else "bare" if match["bare"] is not None else "value"
        start, end = match.span(kind)
        if kind == "value" and match["quote"] is None and text[end:end + 1] in ("", " ", "\n", "\r", "\t"):
            end = start + len(text[start:end].rstrip("."))
            if end - start < 8:
                continue
        yield start, end, match["name"] or ""


NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth", "credential")
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567|abcdef|\.\.\.")
DICTIONARY = (
    "the", "and", "ing", "ion", "ent", "for", "tion", "that", "with", "have", "this", "from", "they", "will", "would", "there",
    "their", "what", "about", "which", "when", "make", "like", "time", "just", "know", "take", "people", "into", "year", "your",
    "good", "some", "could", "them", "other", "than", "then", "look", "only", "come", "over", "think", "also", "back", "after",
    "work", "first", "well", "even", "want", "because", "these", "give", "most", "der", "die", "und", "ein", "sch", "ung", "keit",
    "les", "des", "que", "ment", "est", "los", "las", "cion", "mente", "user", "name", "data", "file", "test", "config", "value",
    "default", "server", "version", "index", "page", "http", "www", "com", "html", "image", "static", "build", "release", "master",
)
WORDS = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
FEATURES = (
    "length", "transitions", "entropy", "digit_share", "upper_share", "distinct_share", "hex_only", "digits_only", "coverage",
    "longest_letters", "in_path", "in_url", "in_mail", "test_path", "assigned", "secret_name", "quoted", "secret_word_near",
    "hash_word_near", "placeholder", "words_around",
)
NEAR = 40


def char_class(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


def describe(text: str, start: int, end: int, name: str, path: str) -> list[float]:
    """The features of the candidate text[start:end], in the order of FEATURES."""
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    classes = [char_class(char) for char in value]
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]
    near = (before + " " + after).lower()
    folded = value.lower()
    return [
        float(n),
        sum(a != b for a, b in zip(classes, classes[1:])) / max(n - 1, 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        classes.count(0) / n,
        classes.count(2) / n,
        len(counts) / n,
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        float(value.isdigit()),
        sum(len(word) for word in WORDS.findall(folded)) / n,
        float(max(map(len, re.findall(r"[A-Za-z]+", value)), default=0)),
        float(value.count("/") >= 2 or before.endswith("/")),
        float(re.search(r"https?://\S*$", before) is not None),
        float(after.startswith("@") or before.endswith("@")),
        float(re.search(r"(?i)test|spec|fixture|example|docs?/|readme", path) is not None),
        float(bool(name)),
        float(any(word in name.lower().replace("-", "_") for word in NAMES)),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(any(word in near for word in NAMES)),
        float(re.search(r"sha-?(?:1|256|512)|md5|checksum|digest|commit|integrity|etag", near) is not None),
        float(PLACEHOLDER.search(value) is not None),
        float(len(re.findall(r"[A-Za-z]{2,}", near))),
    ]


def finding_label(text: str, start: int, end: int, name: str) -> int:
    """1 for a secret, 0 for none, -1 if the rules cannot tell.

    Issued formats and values assigned to a secret's name are secrets; numbers,
    plain words, checksums and placeholders are not."""
    value = text[start:end]
    before = text[max(0, start - NEAR):start].lower()
    if PLACEHOLDER.search(value) or value.isdigit() or re.fullmatch(r"[A-Za-z]+|[a-z]+(?:[-_./][a-z0-9]+)+", value):
        return 0
    if re.search(r"sha-?(?:1|256|512)|md5|checksum|commit|integrity", before):
        return 0
    if ISSUED.fullmatch(value):
        return 1
    if name and any(word in name.lower().replace("-", "_") for word in NAMES):
        return 1 if any(map(str.isdigit, value)) else -1
    return -1


def find_candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, start, end, label, features) of every candidate in every whole
    text, in code points.  A null text has none."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value, where in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                content = value.as_py() or ""
                for start, end, assigned in candidate_values(content):
                    rows.append((name, start, end, finding_label(content, start, end, assigned), describe(content, start, end, assigned, where.as_py() or "")))
            ids, starts, ends, labels, features = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            flat = pa.array(np.array(features, dtype=np.float64).ravel(), pa.float64())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(labels, pa.int32()),
                 pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "start", "end", "label", "features"],
            )

    kind = docs.select(doc_id).dtypes[0][1]
    source = docs.select(F.col(doc_id), F.col(text), (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    return source.mapInArrow(found, f"doc_id {kind}, start int, end int, label int, features array<double>")


def train(findings: DataFrame, sample_rows: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest on labelled findings (label 0 or 1, features), or None if they
    are of one kind only.  At most ``sample_rows`` distinct findings are used, as
    many of each kind (all, if it has fewer), those of the smallest hashes of
    their features.  Copies count once.
    """
    marked = findings.where("label IN (0, 1)").select("label", "features", F.xxhash64(F.lit(seed), "features").alias("mark"))
    smallest = smallest_marks(marked, "label", "mark", max(1, sample_rows // 2))
    last = {row.kind: row.last for row in smallest.groupBy("kind").agg(F.max("mark").alias("last")).collect()}
    if len(last) < 2:
        return None
    # The bound of a label is the mark of one of its findings, so both labels are drawn.
    bound = F.create_map(*[F.lit(part) for pair in sorted(last.items()) for part in pair])
    drawn = marked.where(F.col("mark") <= bound[F.col("label")]).groupBy("label", "mark").agg(F.first("features").alias("features"))
    sample = drawn.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    # One partition of a bounded sample: the same trees whatever the input's partitions.
    return forest.fit(sample.coalesce(1).sortWithinPartitions(vector_to_array("features"), "label"))


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, findings: DataFrame | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, start, end, probability, secret) for every candidate.

    ``secret`` is true for a probability above ``threshold``; the others are the
    false positives the forest removes.  ``findings`` (label, features) trains
    it; by default the candidates that the labelling rules can tell.  If those
    are all alike, each candidate has their label as its probability, and 0
    if there are none.

    A null or empty text has no candidates, a null id is kept.  Repeated rows
    have their findings repeated, an empty table none.  Columns other than
    id, text and path are not read.  A text is held whole, one at a time.
    """
    # The search is the costly part: its few rows are stored, and all passes of the training read these.
    candidates = checkpointed(find_candidates(docs, doc_id, text, path))
    labelled = candidates if findings is None else findings
    model = train(labelled)
    if model is None:
        usual = labelled.where("label IN (0, 1)").agg(F.max("label").cast("double").alias("label")).first().label
        scored = candidates.withColumn("probability", F.lit(float(usual or 0.0)))
    else:
        vectors = candidates.withColumn("features", array_to_vector("features"))
        scored = model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "probability", (F.col("probability") > threshold).alias("secret"))
