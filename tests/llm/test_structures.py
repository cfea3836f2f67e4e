"""Licence scans, the prefix trie and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import clashing, empty, numbered, odd, odd_rows, words

from loomtext.llm import prefix_trie as trie
from loomtext.llm import queries
from loomtext.llm.licenses import BASE_PHRASES, TEMPLATES, Template, find_licenses
from loomtext.llm.periodic_runs import find_runs, periodic_runs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet").collect()


# Licence scans

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    own = LICENSE_WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(k, label) for k in range(len(own)) for label, phrase in BASE_PHRASES if own[k:k + len(phrase.split())] == phrase.split()]
    return len(own), places


def test_license_base_places_of_the_table(spark, small):
    got = {r.doc_id: r for r in queries.op11_positional_licenses(spark, small).collect()}
    docs = table(spark, small, "documents")
    assert len(got) == len(docs)
    for row in docs:
        n, places = base_places(row.text)
        own = got[row.doc_id]
        starts = [at for at, _ in places]
        labels = sorted({label for _, label in places})
        assert (own.n_words, own.n_base, own.first_word, own.last_word, own.base_labels) == (
            n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels)
        )
        assert set(labels) <= set(own.labels.split(",")) and own.labels == ",".join(sorted(set(own.labels.split(",")))) and 0 <= own.score <= 1


def _license_docs():
    rng = random.Random(7)
    rows, wanted = [], {}
    for k in range(400):
        body = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(40, 300))] + rng.choices(["the", "license", "of", "free", "version", "under"], k=12)
        rng.shuffle(body)
        t = TEMPLATES[k % len(TEMPLATES)]
        if k % 4 < 2:  # whole, or with a word more in the middle
            notice = t.text.split()
            if k % 4 == 1:  # but not inside a mandatory phrase
                longer = [[*notice[:i], "hereby", *notice[i:]] for i in range(1, len(notice))]
                notice = rng.choice([x for x in longer if all(phrase in " ".join(x) for phrase in t.phrases)])
            at = rng.randrange(len(body))
            body[at:at] = [word.upper() if k % 3 else word for word in notice]
            wanted[k] = t.label
        rows.append((k, " ".join(body)))
    return rows, wanted


def test_planted_notices_are_found_and_nothing_else(spark):
    rows, wanted = _license_docs()
    got = find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    found = {r.doc_id: {x.label for x in r.licenses.notices} for r in got.collect()}
    assert all(label in found[k] for k, label in wanted.items())
    assert all(not found[k] for k in found if k not in wanted)


def test_notices_need_their_phrases_and_say_where_they_stand(spark):
    templates = [Template("X", "alpha beta gamma delta", ("gamma delta",))]
    rows = [(1, "so alpha beta gamma delta it is"), (2, "alpha beta gamma x delta"), (3, "delta gamma beta alpha"), (4, "alpha " * 50), (5, "alpha-beta.GAMMA_delta")]
    got = find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=templates, base=(("ab", "alpha beta"),))
    found = {r.doc_id: [(x.label, x.start, x.end, x.score) for x in r.licenses.notices] for r in got.collect()}
    assert found == {1: [("X", 1, 5, 1.0)], 2: [], 3: [], 4: [], 5: [("X", 0, 4, 1.0)]}
    with pytest.raises(ValueError, match="bytes"):
        find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=[Template("Y", "y" * 25)])


def test_licenses_of_odd_documents(spark):
    got = find_licenses(clashing(odd(spark)))
    assert {"doc", "found", "item_id"} <= set(got.columns)
    seen = sorted((r.text or "", r.licenses.n_words) for r in got.collect())
    assert seen == sorted((text or "", len(LICENSE_WORD.findall((text or "").lower()))) for _, text, *_ in odd_rows())
    assert find_licenses(empty(spark)).count() == 0
    again = find_licenses(got, out="licenses").select("doc_id", "licenses.n_words")
    assert again.count() == len(odd_rows())


# Prefix trie


def trie_of(conversations):
    """Node rows of {conv_id: [(role, text), ...]} from a dictionary of prefixes."""
    nodes = defaultdict(list)
    for name, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(name)
    children, result = defaultdict(list), []
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(nodes, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[x] for x in below) or 1
        own = (len(nodes[prefix]) - 1) * len(words(prefix[-1][1])) if prefix else 0
        saved[prefix] = own + sum(saved[x] for x in below)
    for prefix, names in nodes.items():
        ends = sorted(name for name in names if len(conversations[name]) == len(prefix))
        result.append((
            min(names), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(names), len(children[prefix]), leaves[prefix],
            saved[prefix], sha(",".join(map(str, ends))),
        ))
    return sorted(result, key=str)


def in_order(rows):
    """{conv_id: turns} of (conv_id, turn, role, text) rows without equal turns."""
    result = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        result[row[0]].append((row[2] or "", row[3] or ""))
    return dict(result)


def rebuilt(conversations):
    result = {}
    for name, own in conversations.items():
        h = zlib.crc32(str(name).encode()) % 4
        result[name] = conversations.get(name - name % 20, [])[:h] + own[h:]
    return result


def _nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_trie_of_the_table(spark, small):
    rows = table(spark, small, "conversations")
    assert _nodes(queries.op12_bitmap_trie(spark, small)) == trie_of(rebuilt(in_order([(r.conv_id, r.turn, r.role, r.text) for r in rows])))


def _random_conversations(seed, n, longest, choices=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        length = rng.randrange(longest + 1)
        rows += [(c, t if t else None, rng.choice(["user", "user", None]), rng.choice(["a b", "c", None][:choices])) for t in range(length)]
    return rows


SCHEMA = "conv_id bigint, turn int, role string, text string"


@pytest.mark.parametrize(("conversations", "turns", "longest"), [(7, 3, 12), (1024, 4, 9), (5, 128, 6), (64, 1, 5)])
def test_trie_in_shards_and_blocks(spark, monkeypatch, conversations, turns, longest):
    monkeypatch.setattr(trie, "CONVERSATIONS", conversations)
    monkeypatch.setattr(trie, "TURNS", turns)
    rows = _random_conversations(conversations + turns, 60, longest)
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(20) for t in range(longest)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert _nodes(trie.prefix_trie(df)) == trie_of(in_order(rows))
    keys = trie.numbered(trie.turn_keys(df))
    assert _nodes(trie.trie_nodes(*trie.spliced(keys))) == trie_of(rebuilt(in_order(rows)))


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, 1, "user", "x"), (3, 2, None, None), (5, None, "user", "x"), (5, 1, "", ""), (9, 7, "user", "x " * 40_000)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert _nodes(trie.prefix_trie(df)) == trie_of(in_order(rows))
    # Equal turns of one number come in one order, wherever they are read.
    ties = [(c, 1, "user", text) for c, texts in ((1, "xyz"), (2, "zxy")) for text in texts]
    assert {r.n_convs for r in trie.prefix_trie(spark.createDataFrame(ties, SCHEMA)).collect()} == {2}
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


# Periodic runs


def runs_of(w, least=6, exponent=4):
    found = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            own = w[i:i + length]
            if length >= max(least, exponent * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(name, w):
    h = zlib.crc32(str(name).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def quick_runs(w):
    """``runs_of`` with the comparisons of each period made at once."""
    numbers: dict[str, int] = {}
    a = np.array([numbers.setdefault(x, len(numbers)) for x in w], dtype=np.int64)
    found = set()
    for q in range(1, a.size // 4 + 1):
        equal = np.concatenate(([0], a[q:] == a[:-q], [0])).astype(np.int8)
        begins, ends = np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)
        for i, length in zip(begins.tolist(), (ends - begins + q).tolist(), strict=True):
            own = w[i:i + length]
            if length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.add((i, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_the_table(spark, small):
    got = {r.doc_id: r for r in queries.op13_basic_factors(spark, small).collect()}
    docs = table(spark, small, "documents")
    assert len(got) == len(docs)
    seen = 0
    for row in docs:
        w = planted(row.doc_id, words(row.text))
        runs = quick_runs(w)
        seen += len(runs)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        own = got[row.doc_id]
        assert (own.n_runs, own.start, own.length, own.period) == (len(runs), *top), row.doc_id
        assert own.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert own.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and own.collapsed_sha256 == sha(collapsed(w, runs))
    assert seen > 100


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w, n = [], rng.randint(0, 60)
            while len(w) < n:
                unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 7))]
                w += unit * rng.randint(1, 8) if rng.random() < 0.6 else unit
                w = w[:len(w) - rng.randint(0, len(unit) - 1)]
            texts.append(w)
        bounds = np.cumsum([0] + [len(w) for w in texts])
        want = [(int(bounds[r]) + s, n, q) for r, w in enumerate(texts) for s, n, q in runs_of(w)]
        got = [tuple(map(int, run)) for run in find_runs(np.array(sum(texts, []), dtype=np.int64), bounds)]
        assert got == want


def test_runs_of_odd_documents(spark):
    extra = [(20, "a " * 50_000, "en", "a", 1), (21, "\x0ba\x0c b\x1cc d \r\n" * 9, "en", "a", 1), (22, " ".join(numbered(0, 4000) for _ in range(5)), "en", "a", 1)]
    df = clashing(odd(spark).union(spark.createDataFrame(extra, odd(spark).schema)))
    got = periodic_runs(df)
    assert "spans" in got.columns
    by_text = {r.text: r.periodic for r in got.collect()}
    for _, text, *_ in odd_rows() + extra:
        own, w = by_text[text], words(text)
        assert own.n_words == len(w)
        if len(w) < 1000:
            runs = runs_of(w)
            assert ([tuple(r) for r in own.runs], own.collapsed) == (runs, collapsed(w, runs))
    assert [tuple(r) for r in by_text["a " * 50_000].runs] == [(0, 50_000, 1)] and by_text["a " * 50_000].collapsed == "a"
    assert [tuple(r) for r in by_text[extra[2][1]].runs] == [(0, 20_000, 4000)]
    assert periodic_runs(empty(spark)).count() == 0
    assert periodic_runs(got).count() == len(odd_rows()) + 3
    with pytest.raises(ValueError, match="exponent"):
        find_runs(np.zeros(1, dtype=int), np.zeros(1, dtype=int), exponent=3)
