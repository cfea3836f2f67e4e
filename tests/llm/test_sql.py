"""The SQL twins against plain Python; the queries themselves are compared with
the same plain Python elsewhere."""

import hashlib

import duckdb
import pytest
from helpers import near_components, removed_words, words
from test_structures import collapsed, in_order, planted, quick_runs, rebuilt, sha, trie_of

from loomtext.llm.oracle import registry
from loomtext.llm.quality import LineRules, judge


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def _by_id(duck, name):
    return {row[0]: row[1:] for row in duck.execute(registry()[name]).fetchall()}


def _docs(duck):
    return duck.execute("select doc_id, text from documents").fetchall()


def test_near_duplicates(duck):
    groups = near_components(_docs(duck))
    assert _by_id(duck, "op5_tensored_minhash") == {name: (n, c, name == c) for name, (n, c) in groups.items()}


def test_line_rules(duck):
    wanted = {}
    for name, text in _docs(duck):
        row = judge(text, LineRules())
        wanted[name] = (*row[:12], hashlib.sha256(row[12].encode()).hexdigest())
    assert _by_id(duck, "op6_line_rules") == wanted


def test_repeats(duck):
    assert _by_id(duck, "op7_difference_cover") == {name: row for (name, _), row in removed_words(_docs(duck)).items()}


def test_trie(duck):
    rows = duck.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert sorted(duck.execute(registry()["op12_bitmap_trie"]).fetchall(), key=str) == trie_of(rebuilt(in_order(rows)))


def test_runs(duck):
    got = _by_id(duck, "op13_basic_factors")
    for name, text in _docs(duck):
        w = planted(name, words(text))
        runs = quick_runs(w)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert got[name] == (
            len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))
        )
