"""Sampled SentencePiece segmentations without replacement (operator 9).

All segmentations of a text are the paths of a lattice.  Gumbel noise on the
paths turns the k best perturbed paths into k draws without replacement.  The
search is best-first: a region of paths is a prefix of units and what the next
unit must not be; its bound is the perturbed score of its best path, drawn from
the region's mass.  The region with the highest bound gives the next path and is
parted into what is left of it.

Pieces never cross certain places (a space after a non-space, characters that no
longer piece holds), so the lattice is a chain of small ones, one for each unit.
Equal units share one lattice, and all lattices and draws of a block of texts
are arrays.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.hashing import WORD_BASE, Powers, mixed, span_hashes
from loomtext.llm.words import releasing, text_blocks

SPACE = 0x2581  # stands for a space
OTHER_SPACE = 0x110000  # the character U+2581 itself, which no piece holds
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
_MASK = (1 << 64) - 1
MOST_NOISE = 38.0  # more than ``gumbel`` of any bits, but for the last of 2 ** 53
HEAD = 128  # units of a text whose regions are looked at first


def unit_interval(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64 random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gumbel(bits: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(unit_interval(bits)))


def drawn(seed: np.ndarray, *numbers) -> np.ndarray:
    """64 random bits for every combination; the same on every machine."""
    with np.errstate(over="ignore"):  # single numbers warn where arrays wrap
        for number in numbers:
            seed = mixed(np.bitwise_xor(seed, np.asarray(number).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return seed


def drawn_one(seed: int, *numbers: int) -> int:
    """``drawn`` for one combination, without the cost of arrays."""
    for number in numbers:
        bits = ((seed ^ number) * 0x9E3779B97F4A7C15 + 1) & _MASK
        bits = ((bits ^ (bits >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        bits = ((bits ^ (bits >> 27)) * 0x94D049BB133111EB) & _MASK
        seed = bits ^ (bits >> 31)
    return seed


def unit_one(bits: int) -> float:
    return ((bits >> 11) + 0.5) / (1 << 53)


def gumbel_one(bits: int) -> float:
    return -math.log(-math.log(unit_one(bits)))


class PieceTrie:
    """The beginnings of all pieces as states.  ``root`` gives the state of a
    first character; the state after another one stands in ``after`` at
    ``base`` + ``kind`` of that character, if ``check`` names the state there."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        begins, state = np.cumsum(sizes) - sizes, np.full(sizes.size, -1)
        parents, chars, ends, count = [], [], [], 0
        for place in range(int(sizes.max())):
            live = np.flatnonzero(sizes > place)
            keys, inverse = np.unique((state[live] + 1) << 21 | flat[begins[live] + place].astype(np.int64), return_inverse=True)
            state[live] = count + inverse
            parents.append((keys >> 21) - 1)
            chars.append(keys & (1 << 21) - 1)
            ends.append(live[sizes[live] == place + 1])
            count += keys.size
        parent, char = np.concatenate(parents), np.concatenate(chars)
        self.whole = np.full(count + 1, -1, dtype=np.int64)  # the piece of a state; the last state is that of no beginning
        self.whole[state[np.concatenate(ends)]] = np.concatenate(ends)
        self.root = np.full(0x110001, count, dtype=np.int32)
        self.root[char[parent < 0]] = np.flatnonzero(parent < 0)
        child = np.flatnonzero(parent >= 0)
        known, kinds = np.unique(char[child], return_inverse=True)
        self.kind = np.full(0x110001, known.size, dtype=np.int32)
        self.kind[known] = np.arange(known.size)
        self.none = known.size  # the kind of characters that go on no beginning
        self._place(parent[child], kinds, child, count)

    def _place(self, owners: np.ndarray, kinds: np.ndarray, states: np.ndarray, count: int) -> None:
        """Every state takes a base where the places of its next states are free,
        those with the most next states first."""
        room = 1 << int(2 * owners.size).bit_length()
        self.base = np.zeros(count + 1, dtype=np.int64)
        self.check, self.after = np.full(room + self.none + 1, -1, dtype=np.int64), np.zeros(room + self.none + 1, dtype=np.int64)
        claim, failed = np.empty_like(self.check), np.empty(count, dtype=bool)
        degree = np.frexp(np.bincount(owners, minlength=count))[1][owners]  # by powers of 2
        turn = 0
        for group in np.unique(degree)[::-1]:
            left = np.flatnonzero(degree == group)
            while left.size:
                who, turn = owners[left], turn + 1
                slots = (drawn(np.uint64(turn), who) & np.uint64(room - 1)).astype(np.int64) + kinds[left]
                claim[slots] = who
                failed[who] = False
                failed[who[(claim[slots] != who) | (self.check[slots] >= 0)]] = True
                done = ~failed[who]
                self.check[slots[done]], self.after[slots[done]] = who[done], states[left[done]]
                self.base[who[done]] = slots[done] - kinds[left[done]]
                left = left[~done]


class PieceModel:
    """Pieces, their weights and the trie of a SentencePiece model file."""

    def __init__(self, path: str, temperature: float):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path} normalises text or has no byte pieces")
        lattice = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)]
        if any(chr(SPACE) in piece.lstrip(chr(SPACE)) for _, piece, _ in lattice):
            raise ValueError(f"{path} has pieces that cross a space")
        self.bytes_of = [p.piece.replace(chr(SPACE), " ").encode() for p in proto.pieces]
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
        self.byte_size = np.array(list(map(len, self.bytes_of)))
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.spelt = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)  # all pieces, one after the other
        self.ids = np.array([i for i, _, _ in lattice], dtype=np.int32)
        pieces = [piece for _, piece, _ in lattice]
        flat, sizes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32), np.array(list(map(len, pieces)))
        self.longest = int(sizes.max())
        self.length_of = np.ones(len(proto.pieces), dtype=np.int64)
        self.length_of[self.ids] = sizes
        self.powers, self.trie = Powers(WORD_BASE), PieceTrie(flat, sizes)
        scores = np.array([score for _, _, score in lattice])
        lowest = scores[scores > -1e8].min()
        self.weights = np.maximum(scores, lowest) / temperature  # marked-out pieces weigh as the rarest
        # What edges can be: the pieces, and last a byte fallback.
        self.fallback = len(lattice)
        self.edge_ids, self.edge_weights = np.append(self.ids, np.int32(0)), np.append(self.weights, lowest / temperature)
        # Units of fewer characters have masses and chances that floats can hold without logarithms.
        self.plain = 600 / (0.7 + max(0.0, self.edge_weights.max()) - min(0.0, self.edge_weights.min()))
        self.edge_shares = np.exp(np.clip(self.edge_weights, -600, 600))
        self.joins = np.zeros(0x110001, dtype=bool)  # characters that some longer piece holds
        self.joins[flat[np.repeat(sizes > 1, sizes)]] = True

    def points(self, text: str) -> np.ndarray:
        """The characters of the lattice: a space in front, spaces marked."""
        points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.where(points == SPACE, np.uint32(OTHER_SPACE), np.where(points == 0x20, np.uint32(SPACE), points))

    def spell(self, ids: Sequence[int]) -> tuple[bytes, np.ndarray]:
        """The bytes of the pieces, and how many stand before each and in all."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.byte_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.spelt[np.repeat(self.byte_start[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes(), ends

    def decode(self, ids: Sequence[int]) -> str:
        return self.spell(ids)[0].decode("utf-8", "replace").removeprefix(" ")


@dataclass
class Lattices:
    """The lattices of distinct units, node after node.

    The edges of a node, from the shortest on, are ``count`` places from
    ``start``: characters to the next node (0: the unit ends), piece (a byte
    fallback is minus the character, less one), the log chance of taking it from
    there, and the chance of it or a shorter one, which is 1 for the last."""

    model: PieceModel
    first: np.ndarray  # the first node of every unit
    size: np.ndarray  # the nodes of every unit
    single: np.ndarray  # whether a unit has one path only
    start: np.ndarray
    count: np.ndarray
    hop: np.ndarray
    piece: np.ndarray
    log_chance: np.ndarray
    upto: np.ndarray

    @classmethod
    def empty(cls, model: PieceModel, nodes: int, edges: int) -> Lattices:
        return cls(model, *[np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, bool)], *[np.zeros(nodes, dtype=np.int32) for _ in range(2)],
                   *[np.zeros(edges, dtype=kind) for kind in (np.int32, np.int32, np.float32, np.float32)])

    @classmethod
    def build(cls, model: PieceModel, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Lattices:
        first = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        if not n:
            return cls.empty(model, 0, 0)
        trie, at = model.trie, np.arange(n)
        chars = points[np.repeat(starts - first, sizes) + at]
        left = np.repeat(first + sizes, sizes) - at
        # The pieces from every node by their length, searched in the trie until it
        # ends; what stands after a unit goes on no beginning.
        width = min(model.longest, int(sizes.max()))
        found = np.full((n, width), -1, dtype=np.int16 if model.fallback < 1 << 15 else np.int32)
        state = trie.root[chars].astype(np.int64)
        found[:, 0] = single = trie.whole[state]
        found[single < 0, 0] = model.fallback
        where = at + np.repeat(np.arange(sizes.size), sizes)
        kinds = np.full(n + sizes.size, trie.none, dtype=np.int64)
        kinds[where] = trie.kind[chars]
        places = at * width
        for extra in range(1, width):
            slot = trie.base[state] + kinds[where + extra]
            going = np.flatnonzero(trie.check[slot] == state)
            places, where, state = places[going], where[going], trie.after[slot[going]]
            found.reshape(-1)[places + extra] = trie.whole[state]
        # Nodes as near to the end of their unit have their edges side by side.
        order = np.argsort(left.astype(np.uint16) if sizes.max() < 1 << 16 else left, kind="stable")
        found = found.take(order, axis=0).reshape(-1)
        edges = np.flatnonzero(found >= 0)
        found, row = found[edges].astype(np.int64), edges // width
        hop = edges - row * width + 1
        counts = np.bincount(row, minlength=n)
        ends = np.cumsum(counts)
        begins, total = ends - counts, int(ends[-1])
        owner, near = order[row], left[order]
        hop *= hop < near[row]
        after = np.where(hop > 0, owner + hop, n)
        piece = model.edge_ids[found]
        falls = np.flatnonzero(found == model.fallback)
        piece[falls] = -1 - chars[owner[falls]].astype(np.int32)
        cuts = np.searchsorted(near, np.arange(1, int(sizes.max()) + 2)).tolist()
        levels = [(slice(begins[low], ends[high - 1]), order[low:high], begins[low:high] - begins[low], counts[low:high])
                  for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
        if sizes.max() < model.plain:
            mass, chance = np.ones(n + 1), model.edge_shares[found]
            for these, nodes, heads, _ in levels:
                chance[these] *= mass[after[these]]
                mass[nodes] = np.add.reduceat(chance[these], heads)
            chance /= mass[owner]
            scores = np.log(chance)
        else:
            mass, scores = np.zeros(n + 1), model.edge_weights[found]
            for these, nodes, heads, many in levels:
                scores[these] += mass[after[these]]
                best = np.maximum.reduceat(scores[these], heads)
                mass[nodes] = best + np.log(np.add.reduceat(np.exp(scores[these] - np.repeat(best, many)), heads))
            scores -= mass[owner]
            chance = np.exp(scores)
        chance = np.cumsum(chance)
        upto = (chance - np.repeat(np.concatenate(([0.0], chance[ends[:-1] - 1])), counts)).astype(np.float32)
        upto[ends - 1] = 1.0
        start, count = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
        start[order], count[order] = begins, counts
        single = np.add.reduceat(count, first) == sizes
        return cls(model, first, sizes, single, start, count, hop.astype(np.int32), piece, scores.astype(np.float32), upto)

    def sample(self, units: np.ndarray, seeds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One path for each unit: log chances, pieces, and where each unit's begin.
        They are looked up in ``order``; if that sorts them, memory is read in turn."""
        chance, counts = np.zeros(units.size), np.zeros(units.size, dtype=np.int64)
        owners, pieces = [], []
        active, node, seeds, total, step = order, self.first[units[order]], seeds[order], np.zeros(order.size), 0
        while active.size:
            edge = self.start.take(node).astype(np.int64)
            u = unit_interval(drawn(seeds, step))
            beyond = np.flatnonzero(self.upto.take(edge) < u)
            further, u = edge[beyond], u[beyond]
            while beyond.size:
                further += 1
                edge[beyond] = further
                more = np.flatnonzero(self.upto.take(further) < u)
                beyond, further, u = beyond[more], further[more], u[more]
            step += 1
            total += self.log_chance.take(edge)
            chance[active], counts[active] = total, step  # for good if the unit ends here
            owners.append(active)
            pieces.append(self.piece.take(edge))
            hop = self.hop.take(edge)
            going = np.flatnonzero(hop)
            active, node, seeds, total = active[going], node[going] + hop[going], seeds[going], total[going]
        begins = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(begins[-1], dtype=np.int64)
        for step, (active, found) in enumerate(zip(owners, pieces, strict=True)):
            flat[begins[active] + step] = found
        return chance, flat, begins

    def more_paths(self, node: int, end: int, than: int) -> bool:
        """Whether more than so many paths lead from a node to the end of its unit."""
        # Every edge beyond the first of a node adds at least one path.
        if int(self.count[node:end].sum()) - (end - node) >= than:
            return True
        paths = [1.0]  # from the end backwards
        for at in range(end - 1, node - 1, -1):
            start = int(self.start[at])
            hops = self.hop[start:start + int(self.count[at])].tolist()
            paths.append(sum(paths[len(paths) - hop if hop else 0] for hop in hops))
        return paths[-1] > than

    def lengths(self, pieces: np.ndarray) -> list[int]:
        return np.where(pieces < 0, 1, self.model.length_of[np.maximum(pieces, 0)]).tolist()

    def edges_along(self, node: int, lengths: list[int]) -> list[int]:
        """The edges of the given lengths, one after the other, to the end of the unit."""
        edges = []
        for place, length in enumerate(lengths, 1):
            start, hop = int(self.start[node]), length if place < len(lengths) else 0
            edges.append(start + self.hop[start:start + int(self.count[node])].tolist().index(hop))
            node += length
        return edges

    def log_chance_of(self, node: int, lengths: list[int]) -> float:
        total = 0.0
        for edge in self.edges_along(node, lengths):
            total += float(self.log_chance[edge])
        return total

    def sample_other(self, unit: int, excluded: list[list[int]], seed: int) -> tuple[float, list[int]]:
        """A path of a unit that is none of the excluded ones, in proportion to
        the chances; there must be one."""
        node, step, lengths, total = int(self.first[unit]), 0, [], 0.0
        live, end = excluded, int(self.first[unit] + self.size[unit])
        while True:
            left = end - node
            sums, options, mass, start = [], [], 0.0, int(self.start[node])
            here = slice(start, start + int(self.count[node]))
            for hop, log_chance in zip(self.hop[here].tolist(), self.log_chance[here].tolist(), strict=True):
                length = hop or left
                after = [path for path in live if path[len(lengths)] == length]
                rest, gone = node + length, 0.0
                if after:
                    if not self.more_paths(rest, end, len(after)):
                        continue
                    gone = sum(math.exp(self.log_chance_of(rest, path[len(lengths) + 1:])) for path in after)
                mass += math.exp(log_chance) * max(1.0 - gone, 1e-15)
                sums.append(mass)
                options.append((length, log_chance, after))
            u = unit_one(drawn_one(seed, 1_000_003, step)) * mass
            length, log_chance, live = options[min(bisect_left(sums, u), len(options) - 1)]
            total += log_chance
            lengths.append(length)
            if length == left:
                return total, lengths
            node, step = node + length, step + 1

    def pieces_of(self, unit: int, lengths: list[int]) -> np.ndarray:
        return self.piece[self.edges_along(int(self.first[unit]), lengths)].astype(np.int64)


class LatticeStore:
    """Lattices that one block after another shares, up to a number of nodes;
    beyond it the store starts anew.  Only time and memory depend on what it
    holds: about 50 bytes a node, in every Python worker of an executor."""

    def __init__(self, model: PieceModel, max_nodes: int = 1 << 18):
        self.model, self.max_nodes = model, max_nodes
        self._clear(max_nodes)

    def _clear(self, nodes: int) -> None:
        self.lattices = Lattices.empty(self.model, nodes, 3 * nodes)
        self.used = self.used_edges = 0
        self.known, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # hashes of units, in order, and their numbers

    def _add(self, new: Lattices) -> None:
        all_, nodes, edges = self.lattices, slice(self.used, self.used + new.start.size), slice(self.used_edges, self.used_edges + new.piece.size)
        all_.count[nodes] = new.count
        all_.start[nodes] = new.start + self.used_edges
        for name in ("hop", "piece", "log_chance", "upto"):
            held = getattr(all_, name)
            if held.size < edges.stop:
                held = np.concatenate((held, np.zeros(edges.stop - held.size + held.size // 4, dtype=held.dtype)))
                setattr(all_, name, held)
            held[edges] = getattr(new, name)
        for name, values in (("first", new.first + self.used), ("size", new.size), ("single", new.single)):
            setattr(all_, name, np.concatenate((getattr(all_, name), values)))
        self.used, self.used_edges = nodes.stop, edges.stop

    def units(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of every unit, after building the lattices of new ones."""
        hashes = span_hashes(points.astype(np.uint64) + np.uint64(1), starts, starts + sizes, self.model.powers)
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._numbers(distinct)
        needed = int(sizes[sample[number < 0]].sum())
        if self.used + needed > self.lattices.start.size:
            self._clear(max(self.max_nodes, int(sizes[sample].sum())))
            number = self._numbers(distinct)
        fresh = np.flatnonzero(number < 0)
        if fresh.size:
            number[fresh] = self.known.size + np.arange(fresh.size)
            self._add(Lattices.build(self.model, points, starts[sample[fresh]], sizes[sample[fresh]]))
            at = np.searchsorted(self.known, distinct[fresh])
            self.known, self.number = np.insert(self.known, at, distinct[fresh]), np.insert(self.number, at, number[fresh])
        return number[inverse]

    def _numbers(self, distinct: np.ndarray) -> np.ndarray:
        if not self.known.size:
            return np.full(distinct.size, -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, distinct), self.known.size - 1)
        return np.where(self.known[at] == distinct, self.number[at], -1)


@dataclass
class Draw:
    """One independent path for each of many units: its log chance and pieces.
    What departs from it gains, in front of the first ``HEAD`` units of a text, the
    log chance of any other path of the unit and Gumbel noise; ``seeds`` and
    ``single`` (units that have no other path) give that of later units."""

    number: int
    seeds: np.ndarray
    single: np.ndarray
    chances: np.ndarray
    pieces: np.ndarray
    begins: np.ndarray
    head: np.ndarray

    @classmethod
    def all_of(cls, lattices: Lattices, units: np.ndarray, seeds: np.ndarray, heads: np.ndarray, k: int) -> list[Draw]:
        """``k`` draws; the gains of the units ``heads`` only."""
        n, order = units.size, np.argsort(units)
        own = np.concatenate([drawn(seeds, number) for number in range(k)])
        chances, pieces, begins = lattices.sample(np.tile(units, k), own, (order[:, None] + n * np.arange(k)).reshape(-1))
        single, draws = lattices.single[units], []
        for number in range(k):
            draw = cls(number, seeds, single, chances[number * n:(number + 1) * n], pieces, begins[number * n:(number + 1) * n + 1], heads)
            draw.head = draw.gains(heads)
            draws.append(draw)
        return draws

    def gains(self, units: np.ndarray | slice) -> np.ndarray:
        with np.errstate(divide="ignore"):
            others = np.log(-np.expm1(np.minimum(self.chances[units], 0.0)))
        others[self.single[units]] = -np.inf
        return others + gumbel(drawn(self.seeds[units], 99, self.number))

    def part(self, first: int, last: int, head: slice) -> Draw:
        units = slice(first, last)
        return Draw(self.number, self.seeds[units], self.single[units], self.chances[units], self.pieces, self.begins[first:last + 1], self.head[head])

    def highest(self, first: int, before: float, n: int) -> list[tuple[float, int]]:
        """The n highest masses with noise among the regions that depart at a unit
        from ``first`` on, and these units; ``before`` is the log chance of all
        before ``first``.  Units after the head are looked at only if noise may
        outweigh what stands before them."""
        for gains in (self.head[first:], None):
            gains = self.gains(slice(first, self.chances.size)) if gains is None else gains
            upto = first + gains.size
            ends = before + np.cumsum(self.chances[first:upto])
            masses = ends - self.chances[first:upto] + gains
            found = np.argpartition(masses, -n)[-n:] if gains.size > n else np.arange(gains.size)
            if upto == self.chances.size or gains.size >= n and ends[-1] + MOST_NOISE < masses[found].min():
                break
        return list(zip(masses[found].tolist(), (first + found).tolist(), strict=True))


@dataclass
class Path:
    """One segmentation of a text: up to a unit its own, from there on as drawn."""

    score: float  # perturbed
    log_prob: float
    chances: list[float]  # log chances and pieces of the units that are its own
    lead: list[np.ndarray]
    draw: Draw

    def parts(self) -> list[np.ndarray]:
        begins = self.draw.begins
        return [*self.lead, self.draw.pieces[begins[len(self.lead)]:begins[-1]]]

    def first(self, units: int) -> tuple[list[float], list[np.ndarray]]:
        """The log chances and pieces of the first units."""
        own, begins = len(self.lead), self.draw.begins[:units + 1].tolist()
        return (self.chances[:units] + self.draw.chances[own:max(units, own)].tolist(),
                self.lead[:units] + [self.draw.pieces[begins[unit]:begins[unit + 1]] for unit in range(own, units)])


def below(top: float, mass: float) -> float:
    """A perturbed mass, given that it is less than ``top``: -log(exp(-top) + exp(-mass))."""
    return min(top, mass) - math.log1p(math.exp(-abs(top - mass)))


def search(lattices: Lattices, units: np.ndarray, draws: list[Draw], seed: int, k: int) -> tuple[list[Path], float]:
    """The k best perturbed paths of one text and the bound of the next.

    ``draws[r]`` has independent draws of all its units; path r takes from it
    what follows the unit where it departs.
    """
    paths: list[Path] = []
    regions: list[tuple[float, int, int]] = []  # a heap of minus the bound, the path and the unit where it departs
    excluded: dict[tuple[int, int], list[list[int]]] = {}
    top, parent, depart = gumbel_one(drawn_one(seed, 77)), -1, -1
    while True:
        number = len(paths)
        draw, chances, lead = draws[number], [], []
        if parent >= 0:
            key, unit = (parent, depart), int(units[depart])
            chances, lead = paths[parent].first(depart + 1)
            if key not in excluded:
                excluded[key] = [lattices.lengths(lead[depart])]
            chances[depart], lengths = lattices.sample_other(unit, excluded[key], drawn_one(seed, number, depart))
            lead[depart] = lattices.pieces_of(unit, lengths)
            # What is left of the region also excludes the path just found.
            excluded[key].append(lengths)
            left = _region(lattices, unit, sum(chances[:depart]), excluded[key], top, drawn_one(seed, 88, number))
            if left > -math.inf:
                heapq.heappush(regions, (-left, parent, depart))
        before = sum(chances)
        paths.append(Path(top, before + float(draw.chances[depart + 1:].sum()), chances, lead, draw))
        # Every later unit may depart; regions share no path.  No more than k are taken in all.
        for mass, unit in draw.highest(depart + 1, before, k):
            if mass > -math.inf:
                heapq.heappush(regions, (-below(top, mass), number, unit))
        if not regions:
            return paths, -math.inf
        top = -regions[0][0]
        if len(paths) == k:
            return paths, top
        _, parent, depart = heapq.heappop(regions)


def _region(lattices: Lattices, unit: int, before: float, excluded: list[list[int]], top: float, bits: int) -> float:
    first = int(lattices.first[unit])
    if not lattices.more_paths(first, first + int(lattices.size[unit]), len(excluded)):
        return -math.inf
    gone = sum(np.exp(sum(lattices.log_chance[lattices.edges_along(first, lengths)])) for lengths in excluded)
    return below(top, before + math.log(max(1.0 - float(gone), 1e-15)) + gumbel_one(bits))


def log_inclusion(log_prob: float, threshold: float) -> float:
    """The log chance that a segmentation is among the k, given the threshold."""
    if threshold == -np.inf:
        return 0.0
    x = log_prob - threshold
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


def encode_block(store: LatticeStore, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple]]:
    """For each text, up to k of (ids, perturbed score, log probability, log inclusion, decodes)."""
    model = store.model
    lengths = np.array([len(text) + 1 if text else 0 for text in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    points = model.points(" ".join(filter(None, texts))) if lengths.any() else np.zeros(0, dtype=np.uint32)
    opens = np.zeros(points.size, dtype=bool)
    if points.size:
        space, joins = points == SPACE, model.joins[points]
        opens[1:] = (space[1:] & ~space[:-1]) | ~joins[1:] | ~joins[:-1]
        opens[np.concatenate(([0], ends[:-1]))[lengths > 0]] = True
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, points.size))
    unit = store.units(points, starts, sizes)
    lattices = store.lattices
    cuts = np.searchsorted(starts, np.concatenate(([0], ends)))
    counts = np.diff(cuts)
    place = np.arange(starts.size) - np.repeat(cuts[:-1], counts)
    unit_seeds = drawn(np.repeat(seeds, counts), place)
    heads = np.flatnonzero(place < HEAD)
    draws = Draw.all_of(lattices, unit, unit_seeds, heads, k)
    searched, head_cuts, cuts = [], np.searchsorted(heads, cuts).tolist(), cuts.tolist()
    for row in range(len(texts)):
        first, last, head = cuts[row], cuts[row + 1], slice(head_cuts[row], head_cuts[row + 1])
        searched.append(search(lattices, unit[first:last], [draw.part(first, last, head) for draw in draws], int(seeds[row]), k))
    # All paths of the block are spelt together.
    parts = [[path.parts() for path in paths] for paths, _ in searched]
    ids, ends = _with_bytes(model, np.concatenate([np.zeros(0, dtype=np.int64), *[part for row in parts for path in row for part in path]]))
    data, byte_ends = model.spell(ids)
    result, at, before, byte = [], 0, 0, 0
    for text, row, (paths, threshold) in zip(texts, parts, searched, strict=True):
        found, own = [], f" {text}".encode() if text else b""
        for path, some in zip(paths, row, strict=True):
            at += sum(map(len, some))
            end = int(ends[at])
            stop = int(byte_ends[end])
            found.append((ids[before:end], path.score, path.log_prob, log_inclusion(path.log_prob, threshold), data[byte:stop] == own))
            before, byte = end, stop
        result.append(found)
    return result


def _with_bytes(model: PieceModel, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids, with every fallback spelt in byte pieces, and how many ids
    stand before each piece and in all."""
    falls = np.flatnonzero(pieces < 0)
    points = -1 - pieces[falls]
    points[points == OTHER_SPACE] = SPACE
    sizes = np.ones(pieces.size, dtype=np.int64)
    many = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    sizes[falls] = many
    ends = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.repeat(pieces.astype(np.int32), sizes)
    spelt = model.byte_id[np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)]
    ids[np.repeat(ends[falls] - np.cumsum(many) + many, many) + np.arange(spelt.size)] = spelt
    return ids, ends


def sample_segmentations(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", k: int = 2, temperature: float = 4096.0,
    seed: int = 0, block_chars: int = 1 << 16,
) -> DataFrame:
    """(key, draw, ids, score, log_prob, log_inclusion, decodes): up to ``k``
    different segmentations of every text, drawn without replacement.

    A segmentation weighs exp of the sum of its pieces' scores / ``temperature``.
    ``draw`` counts from 0 by falling perturbed ``score``; ``log_inclusion`` is
    the log chance of being among the k given the next score, the weight for
    unbiased sums.  ``decodes`` tells that the ids give back the text exactly.
    A text with fewer segmentations has fewer rows; a null or empty text has one
    row without ids.  Draws depend on the key, the text's place in no file, and
    ``seed`` alone: repeated rows repeat their draws, rows of one key and
    different texts are drawn alike but apart, and a null key is a key.  An
    empty table gives an empty result; other columns are not read.  Ties have
    probability zero.  Texts are whole; blocks of ``block_chars`` bound memory, and a longer text is a
    block of its own.
    """
    kinds = [("draw", pa.int32()), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("log_prob", pa.float64()),
             ("log_inclusion", pa.float64()), ("decodes", pa.bool_())]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = LatticeStore(PieceModel(vocabulary, temperature))
        for batch in batches:
            keys, bits = batch.column(0), batch.column(1).to_numpy().view(np.uint64)
            row = 0
            for block in text_blocks((t.as_py() for t in batch.column(2)), block_chars):
                seeds = mixed(bits[row:row + len(block)] ^ np.uint64(0xC2B2AE3D27D4EB4F))
                rows = [(row + r, number, *values) for r, found in enumerate(encode_block(store, block, seeds, k)) for number, values in enumerate(found)]
                row += len(block)
                owners, draws, ids, *rest = zip(*rows, strict=True)
                offsets = np.concatenate(([0], np.cumsum([i.size for i in ids]))).astype(np.int32)
                columns = [pa.array(draws, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                columns += [pa.array(values, kind) for values, (_, kind) in zip(rest, kinds[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owners)), *columns], names=["key", *[name for name, _ in kinds]])

    kind = docs.select(key).dtypes[0][1]
    source = docs.select(F.col(key), F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(text))
    ddl = f"key {kind}, draw int, ids array<int>, score double, log_prob double, log_inclusion double, decodes boolean"
    return source.mapInArrow(releasing(sampled), ddl).withColumnRenamed("key", key)


def decode_pieces(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text that a list of piece ids spells; null ids give null."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = PieceModel(vocabulary, 1.0)
        for batch in batches:
            yield pa.array([None if row.as_py() is None else model.decode(row.as_py()) for row in batch], pa.string())

    return encoded.withColumn(out, decoded(F.col(ids)))
