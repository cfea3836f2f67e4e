"""Sampled segmentations (9) and packing (2): exact round trips and distributions."""

import inspect
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import clashing, empty, odd

from loomtext.llm import packing, sampled_pieces, words
from loomtext.llm.sampled_pieces import LatticeStore, PieceModel, decode_pieces, encode_block, log_inclusion, sample_segmentations

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def store():
    return LatticeStore(PieceModel(PIECES, 20_000.0))


def _all_paths(store, text):
    """Log probability of every segmentation of a short text, by recursion."""
    model = store.model
    points = "".join(map(chr, np.where(model.points(text) > 0x10FFFF, 0, model.points(text))))
    piece = {model.bytes_of[i].decode().replace(" ", "▁"): w for i, w in zip(model.ids.tolist(), model.weights.tolist(), strict=True)}
    piece_id = {model.bytes_of[i].decode().replace(" ", "▁"): i for i in model.ids.tolist()}

    def paths(at):
        if at == len(points):
            yield (), 0.0
        for end in range(at + 1, min(len(points), at + model.longest) + 1):
            if points[at:end] in piece:
                for rest, weight in paths(end):
                    yield (piece_id[points[at:end]], *rest), weight + piece[points[at:end]]

    found = dict(paths(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: weight - total for ids, weight in found.items()}


def test_probabilities_and_frequencies(store):
    text = "the cat"
    exact = _all_paths(store, text)
    n, first, second = 4000, Counter(), Counter()
    for found in encode_block(store, [text] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2):
        (a, sa, la, *_), (b, sb, lb, *_) = found
        assert abs(la - exact[tuple(a)]) < 1e-4 and abs(lb - exact[tuple(b)]) < 1e-4 and sa > sb
        first[tuple(a)] += 1
        second[tuple(b)] += 1
    probability = {ids: math.exp(x) for ids, x in exact.items()}
    for ids, p in probability.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p / n) + 1e-3
        after = sum(q * p / (1 - q) for other, q in probability.items() if other != ids)
        assert abs(second[ids] / n - after) < 5 * math.sqrt(after / n) + 1e-3


def test_lattices_hold_the_edges_that_exist_and_no_others(store):
    """Work on a unit grows with its edges, not with its characters times the longest piece."""
    own = LatticeStore(store.model)
    texts = ["the", "segmentation", "xqzv", "of", "internationalisation"]
    encode_block(own, [" ".join(texts)], np.array([3], dtype=np.uint64), 2)
    pieces = {store.model.bytes_of[i].decode() for i in store.model.ids.tolist()}
    units = [f" {text}" for text in texts]
    edges = sum(unit[a:b] in pieces or b == a + 1 for unit in units for a in range(len(unit)) for b in range(a + 1, len(unit) + 1))
    assert own.used == sum(map(len, units)) and own.used_edges == edges


def test_a_worker_needs_little_memory_whatever_it_has_read(store):
    """Two workers share an executor with a JVM that takes most of it."""
    rng = random.Random(11)
    spelt = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 12)))
    texts = [" ".join(spelt() for _ in range(300)) for _ in range(400)]
    block_chars = inspect.signature(sample_segmentations).parameters["block_chars"].default
    tracemalloc.start()
    try:
        own = LatticeStore(store.model)
        for block in words.text_blocks(texts, block_chars):
            encode_block(own, block, np.arange(len(block), dtype=np.uint64), 2)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_blocks_and_stores_of_any_size_draw_alike(store):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "segmentation", "xqzv", "日本", "of", "zz" * 9]) for _ in range(rng.randrange(40))) for _ in range(60)]
    seeds = np.arange(len(texts), dtype=np.uint64)

    def drawn(block_chars, max_nodes):
        own, row, found = LatticeStore(store.model, max_nodes), 0, []
        for block in words.text_blocks(texts, block_chars):
            found += encode_block(own, block, seeds[row:row + len(block)], 2)
            row += len(block)
        paths = [path for one in found for path in one]
        return [len(one) for one in found], [path[0].tolist() for path in paths], [path[1:4] for path in paths]

    counts, ids, numbers = drawn(1 << 18, 1 << 19)
    for block_chars, max_nodes in ((1 << 16, 1 << 17), (300, 64), (1, 1)):
        assert drawn(block_chars, max_nodes) == (counts, ids, [pytest.approx(three) for three in numbers])


def _same(some, other):
    assert [len(one) for one in some] == [len(one) for one in other]
    for one, two in zip(sum(some, []), sum(other, []), strict=True):
        assert one[0].tolist() == two[0].tolist() and one[1:4] == pytest.approx(two[1:4]) and one[4] == two[4]


def test_noise_is_drawn_for_the_front_of_a_text_only(store, monkeypatch):
    """What stands before a late unit outweighs any noise, so it need not be drawn."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["thereof", "segmentation", "international", "of"]) for _ in range(3000)) for _ in range(4)]
    sizes, gumbel = [], sampled_pieces.gumbel
    monkeypatch.setattr(sampled_pieces, "gumbel", lambda bits: sizes.append(bits.size) or gumbel(bits))
    found = encode_block(store, texts, np.arange(4, dtype=np.uint64), 2)
    assert all(len(one) == 2 for one in found) and sum(sizes) < 3000


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_a_front_of_any_size_draws_alike(store, monkeypatch, k):
    rng = random.Random(14)
    choices = ["the", "segmentation", "xqzv", "日本", "1", "§", "zz" * 9]
    texts = ["", "a", "日", *(" ".join(rng.choice(choices) for _ in range(rng.randrange(300))) for _ in range(25))]
    seeds = np.arange(len(texts), dtype=np.uint64)
    found = encode_block(store, texts, seeds, k)
    for head in (1, 7, 1 << 30):
        monkeypatch.setattr(sampled_pieces, "HEAD", head)
        _same(found, encode_block(store, texts, seeds, k))


def test_short_units_need_no_logarithms(store, monkeypatch):
    texts = ["the segmentation of xqzv 日本 § internationalisation", "zz" * 20 + " of", "of " + "ab" * 4000]
    seeds = np.arange(3, dtype=np.uint64)
    found = [encode_block(LatticeStore(store.model), [text], seeds[i:i + 1], 3)[0] for i, text in enumerate(texts)]
    assert all(math.isfinite(path[2]) and path[4] for one in found for path in one)
    monkeypatch.setattr(store.model, "plain", 0)
    _same(found, encode_block(LatticeStore(store.model), texts, seeds, 3))


def test_the_trie_holds_every_beginning_of_a_piece_and_no_other(store):
    trie = store.model.trie
    pieces = {store.model.bytes_of[i].decode().replace(" ", "▁"): place for place, i in enumerate(store.model.ids.tolist())}
    begins = {piece[:n] for piece in pieces for n in range(1, len(piece) + 1)}
    for begin in [*begins, *(begin + end for begin in sorted(begins)[::50] for end in "ae▁本\n\U0010ffff")]:
        state = int(trie.root[ord(begin[0])])
        for char in begin[1:]:
            slot = trie.base[state] + trie.kind[ord(char)]
            state = int(trie.after[slot]) if trie.check[slot] == state else trie.base.size - 1
        assert (state < trie.base.size - 1) == (begin in begins) and trie.whole[state] == pieces.get(begin, -1)


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    import pyarrow as pa

    released, pool = [], pa.default_memory_pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: released.append(True) or pool)
    batches = words.releasing(lambda some: (2 * one for one in some))(iter([1, 2]))
    assert [next(batches), next(batches)] == [2, 4] and not released
    assert list(batches) == [] and released


def test_all_segmentations_come_out_once(store):
    exact = _all_paths(store, "ab c")
    (found,) = encode_block(store, ["ab c"], np.array([3], dtype=np.uint64), 500)
    assert {tuple(f[0]) for f in found} == set(exact) and len(found) == len(exact)
    assert all(f[3] == 0.0 for f in found)
    scores = [f[1] for f in found]
    assert scores == sorted(scores, reverse=True)


def test_inclusion_weights_are_unbiased(store):
    exact = _all_paths(store, "a the")
    n, sums = 3000, Counter()
    for found in encode_block(store, ["a the"] * n, np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), 3):
        for ids, _, log_prob, log_in, _ in found:
            sums[tuple(ids)] += math.exp(log_prob - log_in) / n
    for ids, log_prob in exact.items():
        assert abs(sums[ids] - math.exp(log_prob)) < 0.06
    assert log_inclusion(-500.0, 0.0) == -500.0 and log_inclusion(0.0, -math.inf) == 0.0


def test_round_trip_with_the_library(spark, small):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(100)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sample_segmentations(docs, PIECES).collect()
    assert all(library.decode(r.ids) == text[r.doc_id] and r.decodes for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)


def test_odd_documents_and_decoding(spark):
    docs = clashing(odd(spark)).drop("text").join(odd(spark).select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id", "text"])
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    drawn = decode_pieces(sample_segmentations(docs, PIECES), PIECES, out="back")
    rows = drawn.collect()
    assert all(r.back == text[r.doc_id] and r.decodes for r in rows) and {r.doc_id for r in rows} == set(text)
    again = {(r.doc_id, r.draw): r.ids for r in sample_segmentations(docs.repartition(5), PIECES).collect()}
    assert all(again[r.doc_id, r.draw] == r.ids for r in rows)
    assert sample_segmentations(empty(spark), PIECES).count() == 0


def _best_fit(sizes, context):
    """Best-fit decreasing by looking at every row."""
    rooms, rows = [], []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = [r for r in range(len(rooms)) if rooms[r] >= sizes[piece]]
        if not fitting:
            rooms.append(context)
            rows.append([])
            fitting = [len(rooms) - 1]
        row = min(fitting, key=lambda r: rooms[r])
        rooms[row] -= sizes[piece]
        rows[row].append(piece)
    return rooms


def test_segment_tree_packs_as_plain_best_fit():
    rng = random.Random(2)
    for context in (1, 2, 7, 64, 100):
        for _ in range(30):
            sizes = [rng.randint(1, context) for _ in range(rng.randrange(1, 120))]
            rows = packing.pack(np.array(sizes), context)
            assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
            assert sorted(context - sum(sizes[p] for p in row) for row in rows) == sorted(_best_fit(sizes, context))


def test_packing_is_lossless(spark, tmp_path):
    encoder, end = packing.load_encoder(RANKS)
    packing.write_packed(packing.pack_tokens(clashing(odd(spark)), RANKS, context=512, block_tokens=20_000), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    matrix, got = packing.id_matrix([bytes(r.ids) for r in rows], 512), {}
    for row, ids in zip(rows, matrix, strict=True):
        assert row.cu_seqlens[-1] == row.n_tokens and (ids[row.n_tokens:] == end).all()
        positions = packing.position_ids(row.position_resets, 512)
        for i, (name, start) in enumerate(zip(row.doc_ids, row.starts, strict=True)):
            part = slice(row.cu_seqlens[i], row.cu_seqlens[i + 1])
            assert positions[part].tolist() == list(range(part.stop - part.start))
            got.setdefault((name, start), Counter())[tuple(ids[part])] += 1
    expected = {}
    for row in odd(spark).collect():
        ids = [*encoder.encode_ordinary(row.text or ""), end]
        for start in range(0, len(ids), 512):
            expected.setdefault((row.doc_id, start), Counter())[tuple(ids[start:start + 512])] += 1
    assert got == expected
    assert packing.pack_tokens(empty(spark), RANKS).count() == 0
