"""Language identification by error-correcting output codes (operator 8).

Every language has a codeword of bits.  One linear classifier on character
n-grams predicts each bit; decoding weighs each bit's loss and takes the nearest
codeword, and a runner-up almost as near marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.hashing import mixed
from loomtext.llm.spark_tools import checkpointed, smallest_marks
from loomtext.llm.words import releasing

UNDETERMINED = "und"


def codewords(n_classes: int, max_bits: int = 31) -> np.ndarray:
    """One row of +1/-1 per class.

    Up to five classes get the exhaustive code: every way to part the classes
    in two, once.  More classes get the best of many drawn codes by the
    smallest distance between two rows.
    """
    if n_classes <= 1:
        return np.ones((n_classes, 1), dtype=np.int8)
    if n_classes <= 5:
        splits = [[1, *(1 - 2 * ((code >> bit) & 1) for bit in range(n_classes - 1))] for code in range(1, 1 << (n_classes - 1))]
        return np.array(splits, dtype=np.int8).T
    bits = min(max_bits, 1 << (n_classes - 1), max(15, int(np.ceil(10 * np.log2(n_classes)))))
    rng, best, best_distance = np.random.default_rng(7), None, -1
    for _ in range(500):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n_classes, bits))
        distances = (bits - code.astype(int) @ code.T.astype(int)) // 2
        distance = int(distances[~np.eye(n_classes, dtype=bool)].min())
        if distance > best_distance and (np.abs(code.sum(axis=0)) < n_classes).all():
            best, best_distance = code, distance
    return best


def gram_buckets(text: str, dimensions: int) -> np.ndarray:
    """The buckets of the 1- to 3-grams of a text: letters in lower case, every
    run of other characters as one blank."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters(points)
    points = np.where(letters, points, np.uint32(32)).astype(np.uint64)
    points = points[letters | np.concatenate(([True], letters[:-1]))]
    if points.size < 3:
        return np.zeros(0, dtype=np.int64)
    one, two = points[1:-1], points[:-1] * np.uint64(1 << 21)
    grams = np.concatenate((one, (two[:-1] + one) | np.uint64(1 << 62), (two[:-1] + one + points[2:] * np.uint64(1 << 42)) ^ np.uint64(1 << 63)))
    return (mixed(grams) >> np.uint64(40)).astype(np.int64) % dimensions


def sliced_buckets(text: str, dimensions: int, slice_chars: int = 1 << 19) -> Iterator[np.ndarray]:
    for start in range(0, max(len(text), 1), slice_chars):
        yield gram_buckets(text[start:start + slice_chars], dimensions)


def gram_shares(text: str, dimensions: int) -> np.ndarray:
    """The share of every bucket in the grams of a whole text."""
    counts = np.zeros(dimensions)
    for buckets in sliced_buckets(text, dimensions):
        counts += np.bincount(buckets, minlength=dimensions)
    return (counts / max(counts.sum(), 1.0)).astype(np.float32)


_LETTER_TABLE: dict[str, np.ndarray] = {}


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, by the Unicode database."""
    if "table" not in _LETTER_TABLE:
        _LETTER_TABLE["table"] = np.array([chr(point).isalpha() for point in range(0x110000)])
    return _LETTER_TABLE["table"][points]


def has_letter(text: str | None) -> bool:
    return any(char.isalpha() for char in text or "")


@dataclass
class CodeModel:
    """Languages, their codewords, and one weight column and bias per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (dimensions, bits): summed over the grams of a text and divided by their number
    bias: np.ndarray
    bit_weight: np.ndarray  # trust in each bit, from its training error

    def margins(self, text: str, slice_chars: int = 1 << 19) -> np.ndarray:
        """The signed output of every bit.  A very long text counts as slices, so
        the grams across their borders are left out."""
        total, grams = np.zeros(self.bias.size), 0
        for buckets in sliced_buckets(text, self.weights.shape[0], slice_chars):
            total += self.weights[buckets].sum(axis=0, dtype=np.float64)
            grams += buckets.size
        return total / max(grams, 1) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """The nearest codeword, its share of belief, and its lead over the next.

        The loss of a bit is logistic, weighed by the trust in the bit."""
        losses = np.logaddexp(0.0, -self.code * margins) @ self.bit_weight / self.bit_weight.sum()
        order = np.argsort(losses, kind="stable")
        belief = np.exp(-(losses - losses.min()) * self.bias.size)
        best = int(order[0])
        lead = float(losses[order[1]] - losses[best]) if order.size > 1 else 1.0
        return best, float(belief[best] / belief.sum()), lead

    def predict(self, text: str | None, min_lead: float) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False
        best, score, lead = self.decode(self.margins(text))
        return self.languages[best], score, lead < min_lead


def fit(languages: list[str], shares: np.ndarray, steps: int = 200) -> CodeModel:
    """Logistic regression of every bit by accelerated gradient steps.

    ``languages[i]`` is the label of the text with the gram shares ``shares[i]``.
    Shares are divided by the root of their mean, so frequent grams don't drown
    the others.
    """
    names = sorted(set(languages))
    code = codewords(len(names))
    dimensions = shares.shape[1]
    scale = np.zeros(dimensions, dtype=np.float32)
    mean = shares.mean(axis=0) if len(languages) else scale
    scale[mean > 0] = 1.0 / np.sqrt(mean[mean > 0])
    shares = shares * scale
    target = code[[names.index(name) for name in languages]].astype(np.float32)
    bits = code.shape[1]
    weights, bias = np.zeros((dimensions, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    if len(names) > 1:
        # Every language weighs the same, however many texts the sample has of it.
        counts = np.array([languages.count(name) for name in languages], dtype=np.float32)
        row_weight = (1.0 / (counts * len(names)))[:, None]
        step = 4.0 / max(float((shares**2).sum(axis=1).max()) + 1.0, 1e-9)
        old_w, old_b = weights, bias
        for number in range(steps):
            push = number / (number + 3)
            at_w, at_b = weights + push * (weights - old_w), bias + push * (bias - old_b)
            pull = target / (1.0 + np.exp(np.clip(target * (shares @ at_w + at_b), -30, 30))) * row_weight
            old_w, old_b = weights, bias
            weights, bias = at_w + step * (shares.T @ pull), at_b + step * pull.sum(axis=0)
    wrong = (target * (shares @ weights + bias) <= 0).mean(axis=0) if languages else np.zeros(bits)
    return CodeModel(names, code, (weights * scale[:, None]).astype(np.float32), bias.astype(np.float64), 1.0 - np.minimum(wrong, 0.49))


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 2400, max_languages: int = 64,
    dimensions: int = 4096, steps: int = 200,
) -> CodeModel:
    """Fit on a bounded sample of whole texts: at most ``sample_rows`` distinct
    texts in all (one of each language at least), as many of each language (all,
    if it has fewer), those of the smallest hashes.  Copies count once.

    Rows with a letterless or null text or a null language are left out.
    Without a usable row the model knows no language and every text is
    undetermined.  Gram shares are computed where the rows are; the driver
    receives ``sample_rows`` x ``dimensions`` numbers.
    """

    @F.arrow_udf("binary")
    def shares_of(texts: pa.Array) -> pa.Array:
        return pa.array([gram_shares(text.as_py(), dimensions).tobytes() for text in texts], pa.binary())

    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    marked = usable.withColumn("mark", F.xxhash64(F.lit(17), "text"))
    smallest = checkpointed(smallest_marks(marked, "lang", "mark", sample_rows))
    found = [row.kind for row in smallest.select("kind").distinct().limit(max_languages + 1).collect()]
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not found:
        return fit([], np.zeros((0, dimensions), dtype=np.float32), steps)
    each = max(1, sample_rows // len(found))
    last = {row.kind: row.last for row in smallest.where(F.col("rank") <= each).groupBy("kind").agg(F.max("mark").alias("last")).collect()}
    bound = F.create_map(*[F.lit(part) for name in found for part in (name, last[name])])
    drawn = marked.where(F.col("mark") <= bound[F.col("lang")]).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    sample = drawn.select("lang", "mark", shares_of("text").alias("shares"))
    rows = sorted((row.lang, row.mark, bytes(row.shares)) for row in sample.collect())
    if missing := set(found) - {row[0] for row in rows}:
        raise RuntimeError(f"no text drawn of {sorted(missing)}")
    shares = np.frombuffer(b"".join(row[2] for row in rows), dtype=np.float32).reshape(len(rows), dimensions)
    return fit([row[0] for row in rows], shares, steps)


def identify(docs: DataFrame, model: CodeModel, text: str = "text", min_lead: float = 0.02, out: str = "language") -> DataFrame:
    """Add a struct ``out`` (lang_pred, score, ambiguous) from the whole text.

    A text that is null or has no letter is undetermined (``und``, score 0, not
    ambiguous).  ``score`` is the belief in the chosen codeword against the
    others, from 0 to 1; a lead under ``min_lead`` marks a text as ambiguous.
    Equal losses go to the first language in order of name.  Rows are
    independent: repeated rows agree, an empty table stays empty, extra columns
    are kept, and one named like ``out`` is replaced.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: dimensions x bits

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    @releasing
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [shared.value.predict(text.as_py(), min_lead) for text in batch]
            names, scores, doubts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())],
                names=["lang_pred", "score", "ambiguous"],
            )

    return docs.withColumn(out, identified(F.col(text)))
