"""Language identification (8) and secret scans (1): held-out accuracy and odd input."""

import time

import numpy as np
from helpers import clashing, empty, odd
from pyspark.ml.linalg import Vectors

from loomtext.llm import language, secret_scan
from loomtext.llm.queries import op1_forest_secrets, op8_output_codes


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 20):
        code = language.codewords(n).astype(int)
        least = min((code.shape[1] - code[i] @ code[j]) // 2 for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 3)


def test_held_out_accuracy(spark, small):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op8_output_codes(spark, small).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_languages_of_odd_documents(spark):
    model = language.train(odd(spark))
    rows = language.identify(clashing(odd(spark)), model).select("text", "language.*").collect()
    assert len(rows) == 14
    assert all((r.lang_pred == "und") == (not language.has_letter(r.text)) for r in rows)
    nothing = language.train(empty(spark))
    assert {r.language.lang_pred for r in language.identify(odd(spark), nothing).collect()} == {"und"}


def test_slices_of_a_long_text_agree():
    text = "der die das und nicht " * 400
    whole, cut = language.gram_shares(text, 512), sum(np.bincount(b, minlength=512) for b in language.sliced_buckets(text, 512, 1000))
    assert np.abs(whole - cut / cut.sum()).max() < 0.01


def test_forest_removes_false_positives(spark, small):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op1_forest_secrets(spark, small).collect()
    for row in rows:
        value = text[row.doc_id][row.start:row.end]
        if value.startswith("AKIA"):
            assert row.secret
        if value.isdigit():
            assert not row.secret
    assert any(r.secret for r in rows) and not all(r.secret for r in rows)


def test_forest_generalises_to_findings_it_has_not_seen(spark):
    rng = np.random.default_rng(1)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'token = "{key()}" set') for i in range(150)] + [(200 + i, f"number {10**15 + i * 7919} of words") for i in range(150)]
    rows += [(500 + i, f"the leaked value {key()} stands here") for i in range(20)]
    got = {r.doc_id: r.secret for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] for i in range(150)) and not any(got[200 + i] for i in range(150))
    assert np.mean([got[500 + i] for i in range(20)]) > 0.8


def test_secrets_of_odd_documents(spark):
    assert secret_scan.scan(clashing(odd(spark))).where("secret").count() == 0
    assert secret_scan.scan(empty(spark)).count() == 0


def test_languages_of_many_copies_are_drawn(spark):
    rows = [(f"das ist text nummer {chr(97 + i % 26)}{chr(97 + i // 26)}", "de") for i in range(60)] + [("this is the only one", "en")] * 4000
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), sample_rows=20, dimensions=256)
    assert model.languages == ["de", "en"]


def test_labels_of_many_copies_are_drawn(spark):
    rows = [(1, [1.0] * 21)] * 4000 + [(0, [0.0] * 20 + [float(i)]) for i in range(60)]
    model = secret_scan.train(spark.createDataFrame(rows, "label int, features array<double>"), sample_rows=20)
    assert model.numClasses == 2 and model.predict(Vectors.dense([1.0] * 21)) == 1.0


def test_candidates_are_whole_runs():
    key, late = "aB3" * 200, "k" * 100 + "7" * 30
    for text, kind, value in (
        (f"see {key} there", "bare", key), (f"see {late} there", "bare", late), (f"token = '{key}'", "value", key),
        (f"auth: {'a1.' * 325}zz", "value", "a1." * 325 + "zz"),
    ):
        assert [match[kind] for match in secret_scan.CANDIDATE.finditer(text)] == [value]


def _values(text):
    return [text[start:end] for start, end, _ in secret_scan.candidate_values(text)]


def test_candidates_of_awkward_forms():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJlMTIz"
    for text, values in (
        (f"Authorization: Bearer {jwt}", [jwt]), (f"see {jwt}.", [jwt]), (f"token={jwt} x", [jwt]),
        ('password = "P@ssw0rd!2024x"', ["P@ssw0rd!2024x"]), ("pwd: 'it\"s&12345#'", ['it"s&12345#']), ('secret="abc1234567', ["abc1234567"]),
        ("password: hunter2xyz. Next", ["hunter2xyz"]), ("password: hunter2xyz...", ["hunter2xyz"]), ("token: a.b....", []),
        ("x" * 100 + "key=abcdefgh1", ["abcdefgh1"]), ("9key := abcdefgh1", ["abcdefgh1"]), ("k => abcdefgh1", ["abcdefgh1"]),
        ("key = short", []), ("", []), ("id AKIA" + "A1" * 8, ["AKIA" + "A1" * 8]),
    ):
        assert _values(text) == values, text


def test_the_search_is_linear():
    for text in ("a" * 400_000, "a=" * 200_000, "a: '" * 100_000, "eyJ" * 130_000, "a1_" * 130_000 + "=", "'" * 400_000, "x = \"" + "y" * 400_000):
        begin = time.perf_counter()
        _values(text)
        assert time.perf_counter() - begin < 5


def test_planted_secrets_and_near_misses(spark):
    """Precision, and recall by kind.  A bare hexadecimal key is told from a
    checksum by the words around it alone, and is the kind the forest misses."""
    rng = np.random.default_rng(2)
    hexes, mixed = list("0123456789abcdef"), list("ABCDEFGHabcdefgh0123456789+/")
    key = lambda letters, n: "".join(rng.choice(letters, n))
    secret = [
        lambda: f'api_key = "{key(mixed, 32)}"', lambda: f"the access token is {key(mixed, 40)} today", lambda: f"AKIA{key(list('ABCDEFGH0123'), 16)}",
        lambda: f"password: '{key(mixed, 10)}!{key(mixed, 4)}1'", lambda: f"a secret value {key(hexes, 40)} leaked",
    ]
    other = [
        lambda: f"order number {rng.integers(10**17)}{rng.integers(10**3):03d} shipped", lambda: f"sha256 checksum {key(hexes, 64)} of the file", lambda: f"version = release-{rng.integers(9)}.{rng.integers(9)}.{rng.integers(9)}-final",
        lambda: "password = changeme12345", lambda: f"see docs/static/index-page-{rng.integers(99)}/build",
    ]
    rows, wanted = [], {}
    for k in range(1200):
        kind = int(rng.integers(5))
        made = (secret if k % 2 else other)[kind]()
        filler = " ".join(rng.choice(["the", "word", "und", "les", "of"], 12))
        rows.append((k, f"{filler} {made} {filler}"))
        wanted[k] = kind if k % 2 else None
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).where("secret").select("doc_id").distinct()
    hit = {r.doc_id for r in found.collect()}
    assert sum(wanted[k] is not None for k in hit) > 0.95 * len(hit)
    for kind in range(4):
        own = [k for k, other in wanted.items() if other == kind]
        assert sum(k in hit for k in own) > 0.95 * len(own), kind
