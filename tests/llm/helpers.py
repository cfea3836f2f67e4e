"""Plain-Python restatements and odd documents for the operators' tests."""

import hashlib
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = {  # columns an operator adds or uses inside, as extra input columns
    "doc": "1", "found": "1", "copy": "1", "places": "1", "spans": "1", "model": "1", "unique": "1", "quality": "1", "language": "1",
    "personal": "1", "key": "1", "tokens": "1", "item_id": "1", "n_tokens": "1", "mark": "1", "draw": "1", "ids": "1", "component_id": "1",
}
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def numbered(first, n):
    return " ".join(f"w{i}" for i in range(first, first + n))


def odd_rows():
    """Nulls in every column, empty, blank, very long and repeated texts."""
    long = numbered(0, 30_000)
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, numbered(0, 60), "en", "a", 1),
        (None, None, None, None, None), (4, numbered(0, 60), "en", "a", 1), (4, numbered(0, 60), "en", "a", 1),
        (5, numbered(0, 60), "de", "a", 1), (6, long, "en", "b", 1), (7, long, None, "b", 1), (8, "ab" * 40_000, "en", "b", 1),
        (9, "日本語 текст 🙂 \x00 end.", "fr", "b", 1), (10, "one", "fr", "b", 1), (11, numbered(7, 55), "fr", "b", 1),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(value) for name, value in CLASHES.items()})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed_words(rows, window=50):
    """(n_words, n_removed, sha256 of what is left) of every (id, text)."""
    first = {}
    for name, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), name)
    result = {}
    for name, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - window + 1):
            if name is not None and first[tuple(w[k:k + window])] < name:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        result[name, text] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return result


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(rows, percent=75):
    """{id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {name: shingles(text) for name, text in rows if name is not None}
    up = {name: name for name in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for name, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(name)
    for name, own in sets.items():
        for other in {o for shingle in own for o in holders[shingle] if o < name}:
            common = len(own & sets[other])
            if 100 * common >= percent * (len(own) + len(sets[other]) - common):
                a, b = sorted((root(name), root(other)))
                up[b] = a
    return {name: (len(own), root(name)) for name, own in sets.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, char in enumerate(reversed(digits)):
        x = int(char) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    """kind:start:end of the base rules, in the order of the contract."""
    spans = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(spans)
