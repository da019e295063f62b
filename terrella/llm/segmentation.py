"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations without replacement.

The lattice of a text has an edge for every vocabulary piece that matches at a place, and byte pieces for a character
that no piece covers.  A piece costs ``PIECE_COST`` and its unigram weight (for a BPE vocabulary minus the logarithm of
its rank).  As no piece crosses from a word to the next, a task builds the lattice of each distinct word once, and
backward sums turn it into a chain of conditional choices whose paths have exactly the lattice's probabilities.

Gumbel top-k draws the k paths whose log-probability plus independent Gumbel noise is greatest, which is sampling
without replacement.  It is found by best-first (A*) search over sets of paths, without ever listing paths: a set's
greatest perturbed value is drawn from its total probability, truncated at its parent's; the best set gives up one path
drawn from it, and the rest splits into the sets that first differ from that path at each of its edges.  With kappa the
perturbed value of the best set left over, a path of log-probability phi was included with probability
1 - exp(-exp(phi - kappa)), its inclusion score.  The documents of a group take each round of the search together.

Draws come from a counter-based generator keyed by seed and row key, so a row's samples do not depend on where it is
processed.  Decoding gives the text back exactly, for any text: U+2581 itself is encoded as bytes.

Defined results: a null or empty text has the empty segmentation as its only sample; a text with fewer than k
segmentations gives all it has, with inclusion 1; rows that repeat a key and text get equal samples; an empty table
gives an empty result.  The vocabulary file's path is a parameter; it is read on the driver and sent along.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm.common import tune, with_added
from terrella.llm.vectors import mix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PIECE_COST = 4.0
#: Documents that are searched together, and characters from which on a group is closed.
GROUP = 128
GROUP_CHARS = 500_000
#: Characters of distinct words beyond which a task starts its lattice anew.
KEPT_CHARS = 1_200_000
#: Places further than this from their word's end are handled one after another, as only few words are so long.
LONG = 256
_NONE = np.zeros(0, np.int64)
_SPREAD = 0x9E3779B97F4A7C15
_ODD = np.uint64(_SPREAD)
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SWAP = str.maketrans({" ": SPACE, SPACE: " "})


@dataclass
class Vocabulary:
    pieces: list[str]
    weights: np.ndarray
    kinds: np.ndarray  # 0 piece, 1 byte, 2 control or unknown
    keys: np.ndarray = None  # trie: node << 21 | code point
    nexts: np.ndarray = None
    shift: int = 0
    ids: np.ndarray = None  # piece at a trie node, or -1
    bytes_at: np.ndarray = None
    raw: pa.LargeBinaryArray | None = None  # the bytes of each piece

    def build(self) -> Vocabulary:
        trie: dict[int, int] = {}
        at_node = [-1]
        for i, piece in enumerate(self.pieces):
            if self.kinds[i] or not piece:
                continue
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} crosses a word boundary")
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                node = trie.setdefault(key, len(at_node))
                if node == len(at_node):
                    at_node.append(-1)
            at_node[node] = i
        # An open-addressing table of the transitions, with at most a quarter of its places taken.
        self.shift = 64 - (4 * len(trie)).bit_length()
        size = 1 << (64 - self.shift)
        self.keys, self.nexts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for key, node in trie.items():
            at = (key * _SPREAD & (1 << 64) - 1) >> self.shift
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.nexts[at] = key, node
        self.ids = np.array(at_node, np.int64)
        self.bytes_at = np.full(256, -1, np.int64)
        for i, piece in enumerate(self.pieces):
            if self.kinds[i] == 1:
                self.bytes_at[int(piece[3:5], 16)] = i
        if (self.bytes_at < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        return self

    def step(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which transitions exist, and the nodes those lead to."""
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(self.shift)).astype(np.int64)
        have = self.keys[at]
        left = np.flatnonzero((have != key) & (have >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            have[left] = self.keys[at[left]]
            left = left[(have[left] != key[left]) & (have[left] >= 0)]
        ok = have == key
        return ok, self.nexts[at[ok]]

    def decode(self, ids) -> str:
        """The text of a sequence of piece ids."""
        return self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
        """The UTF-8 of sequences of ids laid end to end, each with the dummy prefix, and where each ends."""
        if self.raw is None:
            raw = [bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind else p.replace(SPACE, " ").encode() for p, kind in zip(self.pieces, self.kinds.tolist(), strict=True)]
            self.raw = pa.array(raw, pa.large_binary())
        if not len(ids):
            return b"", [0] * len(ends)
        _, offsets, flat = self.raw.take(pa.array(ids)).buffers()
        offsets = np.frombuffer(offsets, np.int64, len(ids) + 1)
        return flat.slice(0, int(offsets[-1])).to_pybytes() if offsets[-1] else b"", offsets[ends].tolist()

    def decoded(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of :meth:`decode`."""
        return self.joined(ids, np.array([len(ids)]))[0][1:]


def load(path: str = DEFAULT_MODEL, piece_cost: float = PIECE_COST) -> Vocabulary:
    """Read a SentencePiece model on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)], np.int8)
    scores = np.array([sp.get_score(i) for i in range(n)])
    ranked = bool((scores == np.round(scores)).all())  # a BPE vocabulary has ranks for scores
    weights = -np.log1p(-scores) if ranked else scores
    weights[kinds == 1] = weights[kinds == 0].min()
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], weights - piece_cost, kinds).build()


def uniforms(state: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the states of a counter-based generator."""
    return ((mix(state) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Lattice:
    """Edges and conditional probabilities of the lattices of distinct words, laid end to end; it grows by :meth:`add`."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._at_place = {"first": np.int32, "count": np.int32, "best": np.int32, "top": np.float64}
        self._at_edge = {"src": np.int32, "dst": np.int32, "piece": np.int32, "end": bool, "open": bool, "p": np.float64}
        self._at_type = {"starts": np.int64, "ends": np.int64}
        for names in (self._at_place, self._at_edge, self._at_type):
            for name, kind in names.items():
                setattr(self, name, np.zeros(0, kind))
        self.clear()

    def clear(self) -> None:
        """Forget all words; the room that they took is used again."""
        self.size = self.edges = self.types = 0
        #: Type number of a word, with and without the U+2581 before it.
        self.index: dict[bool, dict[str, int]] = {True: {}, False: {}}
        self.bare = np.zeros(0, np.int64)  # byte pieces of characters without a piece
        self.bare_first, self.bare_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _append(self, names: dict, at: int, arrays: dict) -> None:
        for name in names:
            have, more = getattr(self, name), arrays[name]
            if at + len(more) > len(have):
                room = np.empty(max(2 * len(have), at + len(more)), names[name])
                room[:at] = have[:at]
                setattr(self, name, have := room)
            have[at : at + len(more)] = more

    def numbers(self, words: list[str], bare: bool) -> np.ndarray:
        """The types of distinct words; words that are new are added."""
        index = self.index[bare]
        out = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [words[x] for x in missing.tolist()]
            out[missing] = np.arange(self.types, self.types + len(new))
            self.add([SPACE + w for w in new] if bare else new)
            index.update(zip(new, out[missing].tolist(), strict=True))
        return out

    def add(self, units: list[str]) -> None:
        vocab = self.vocab
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        n = len(points)
        end_of = np.repeat(ends, sizes)
        back = end_of - np.arange(n)
        # Every place has an edge of one character, a piece or bare; slots tell the longer ones of a place apart, by length.
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        single, many, longer = np.full(n, -1, np.int64), np.ones(n, np.int64), []
        while len(at):
            key = node << 21 | points[at + depth]
            ok, node = vocab.step(key)
            at = at[ok]
            depth += 1
            ids = vocab.ids[node]
            hit = ids >= 0
            x = at[hit]
            if depth == 1:
                single[x] = ids[hit]
            elif len(x):
                longer.append((depth, x, many[x], ids[hit]))
                many[x] += 1
            alive = back[at] > depth
            at, node = at[alive], node[alive]
        alone = np.flatnonzero(single < 0)
        chars = {c: vocab.bytes_at[np.frombuffer(c.translate(_SWAP).encode("utf-8", "replace"), np.uint8)] for c in set(map(text.__getitem__, alone.tolist()))}
        raw = [chars[text[p]] for p in alone.tolist()]
        raw_sizes = np.array([len(x) for x in raw], np.int64)
        # Places by their distance from the word's end, so that sums of later places come first; the edges of a place
        # stay together.
        at = np.argsort(back.astype(np.uint16) if sizes.max() < 1 << 16 else back, kind="stable")
        count, back = many[at], back[at]
        places = np.cumsum(count) - count  # where each place's edges begin
        first = np.empty(n, np.int64)
        first[at] = places
        src = np.repeat(at, count)
        piece, dst = np.zeros(len(src), np.int64), src + 1
        piece[places] = np.maximum(single[at], 0)
        for depth, x, slot, ids in longer:
            e = first[x] + slot
            piece[e] = ids
            dst[e] += depth - 1
        weight = vocab.weights[piece]
        if len(alone):
            # A bare character is one edge; its number, -1 - k, says which.
            weight[first[alone]] = raw_sizes * vocab.weights[vocab.bytes_at[0]]
            piece[first[alone]] = -1 - len(self.bare_size) - np.arange(len(alone))
            self.bare_first = np.concatenate([self.bare_first, len(self.bare) + np.cumsum(raw_sizes) - raw_sizes])
            self.bare_size, self.bare = np.concatenate([self.bare_size, raw_sizes]), np.concatenate([self.bare, *raw])
        end = dst == end_of[src]
        goal = np.where(end, n, dst)  # there is nothing to add behind a word's end
        beta, p, likely, top = np.zeros(n + 1), np.empty(len(src)), np.empty(len(src), bool), np.empty(n)
        far = int(np.searchsorted(back, LONG, "right"))
        spot = np.append(np.flatnonzero(np.diff(back, prepend=0)), n)
        spot = spot[spot <= far]
        bounds = np.append(places, len(src))[spot]
        for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spot[:-1].tolist(), spot[1:].tolist(), strict=True):
            v = weight[a:b] + beta[goal[a:b]]
            begin, times = places[i:j] - a, count[i:j]
            most = np.maximum.reduceat(v, begin)
            v -= np.repeat(most, times)
            e = np.exp(v, out=v)
            sums = np.add.reduceat(e, begin)
            beta[at[i:j]] = most + np.log(sums)
            np.divide(e, np.repeat(sums, times), out=p[a:b])
            np.equal(e, 1.0, out=likely[a:b])
            top[i:j] = 1.0 / sums
        if far < n:
            a = int(places[far])
            self._far(a, far, places, at, goal, weight, beta, p)
            top[far:] = np.maximum.reduceat(p[a:], places[far:] - a)
            likely[a:] = p[a:] == np.repeat(top[far:], count[far:])
        # Most draws end with a place's likeliest edge.
        best = np.flatnonzero(likely)
        if len(best) > n:
            best = best[np.flatnonzero(np.diff(src[best], prepend=-1))]
        by_place = {name: np.empty(n, kind) for name, kind in self._at_place.items()}
        by_place["first"][at], by_place["count"][at], by_place["best"][at], by_place["top"][at] = places + self.edges, count, best + self.edges, top
        self._append(self._at_place, self.size, by_place)
        self._append(self._at_edge, self.edges, {"src": src + self.size, "dst": dst + self.size, "piece": piece, "end": end, "open": np.repeat(count > 1, count), "p": p})
        self._append(self._at_type, self.types, {"starts": ends - sizes + self.size, "ends": ends + self.size})
        self.size, self.edges, self.types = self.size + n, self.edges + len(src), self.types + len(units)

    @staticmethod
    def _far(a: int, i: int, places: np.ndarray, at: np.ndarray, goal: np.ndarray, weight: np.ndarray, beta: np.ndarray, p: np.ndarray) -> None:
        """Sums and probabilities of places more than LONG from their word's end, one after another without arrays."""
        sums, low = beta.tolist(), places[i:].tolist()
        high, where = [*low[1:], len(goal)], at[i:].tolist()
        to, w, out = goal[a:].tolist(), weight[a:].tolist(), [0.0] * (len(goal) - a)
        exp, log = math.exp, math.log
        for x, y, place in zip(low, high, where, strict=True):
            v = [w[e] + sums[to[e]] for e in range(x - a, y - a)]
            top = max(v)
            v = [exp(z - top) for z in v]
            total = sum(v)
            sums[place] = top + log(total)
            out[x - a : y - a] = [z / total for z in v]
        p[a:] = out

    def choose(self, at: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The edge that a draw picks at each place: the likeliest first, then the others in order."""
        e = self.best[at]
        far = np.flatnonzero(draw >= self.top[at])
        if len(far):
            spot = at[far]
            rest, x, last, best = draw[far] - self.top[spot], self.first[spot], self.first[spot] + self.count[spot] - 1, e[far]
            last = np.where(last == best, last - 1, last)
            while len(far):
                skip = x == best
                x = x + skip
                rest = rest - self.p[x]
                done = (rest < 0) | (x >= last)
                e[far[done]] = np.minimum(x[done], last[done])
                go = ~done
                far, rest, x, last, best = far[go], rest[go], x[go] + 1, last[go], best[go]
        return e

    def walk(self, at: np.ndarray, states: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from each of the places ``at`` to its word's end: all edges in order, and the size of each path.

        The draw at a place depends on the walk's state and the place alone.
        """
        who = np.flatnonzero(ends - at <= LONG)
        size = np.zeros(len(at), np.int64)
        here, steps = at[who], []
        while len(who):
            e = self.choose(here, uniforms(states[who] + here.view(np.uint64) * _ODD))
            steps.append((who, e))
            over = self.end[e]
            size[who[over]] = len(steps)
            more = np.flatnonzero(~over)
            who, here = who[more], self.dst[e[more]].astype(np.int64)
        long = {}
        for k in np.flatnonzero(ends - at > LONG).tolist():
            a, b = int(at[k]), int(ends[k])
            spots = np.arange(a, b)
            e = self.choose(spots, uniforms(states[k] + spots.astype(np.uint64) * _ODD))
            to, x, seen = (self.dst[e].astype(np.int64) - a).tolist(), 0, []
            while x < b - a:
                seen.append(x)
                x = to[x]
            long[k] = e[seen]
            size[k] = len(seen)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        for k, (who, e) in enumerate(steps):
            out[first[who] + k] = e
        for k, e in long.items():
            out[first[k] : first[k] + len(e)] = e
        return out, size

    def pieces(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a sequence of edges, and how many of them each edge has."""
        ids = self.piece[edges]
        sizes = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, sizes
        number = -1 - ids[bare].astype(np.int64)
        sizes[bare] = self.bare_size[number]
        out = np.repeat(ids, sizes)
        ends = np.cumsum(sizes)
        n = sizes[bare]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[bare] - n, n) + inner] = self.bare[np.repeat(self.bare_first[number], n) + inner]
        return out, sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _log_exponential(state: np.ndarray) -> np.ndarray:
    return np.log(-np.log(uniforms(state)))


@dataclass
class _Round:
    """The paths of one round of the search: those of document d are edges[first[d] : first[d + 1]], and so are their words."""

    edges: np.ndarray
    owners: np.ndarray
    first: np.ndarray
    phi: np.ndarray


def top_k(lattice: Lattice, types: np.ndarray, bounds: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """The k segmentations (edges, log-probability, perturbed log-probability, inclusion) of each of many sequences of words.

    Document d has the words types[bounds[d] : bounds[d + 1]] (one at least) and the key keys[d].  All documents take
    each round of the search at once.  Perturbed values are kept as logarithms of arrival times, minus the Gumbel
    values: the least comes first.
    """
    n_docs = len(keys)
    starts, ends = lattice.starts[types], lattice.ends[types]
    # A draw's counter is the round and the character's place in the document.
    length = ends - starts
    place = np.cumsum(length) - length
    doc_of = np.repeat(np.arange(n_docs), np.diff(bounds))
    place -= place[bounds[:-1]][doc_of]
    base = keys[doc_of] + (place - starts).astype(np.uint64) * _ODD
    other = mix(keys ^ np.uint64(0xA0761D6478BD642F))  # the key of exponential draws
    heaps: list[list[tuple]] = [[(float(t), 0, None, 0, ())] for t in _log_exponential(other)]
    found: list[list[tuple]] = [[] for _ in range(n_docs)]
    serial = 0
    for number in range(k):
        live = [d for d in range(n_docs) if heaps[d]]
        if not live:
            break
        popped = [heapq.heappop(heaps[d]) for d in live]
        shift, again = (np.uint64(x & (1 << 64) - 1) for x in (((number + 1) << 44) * _SPREAD, (number << 44) * _SPREAD + 7))
        heads, head_owners, whole = [], [], np.empty(len(live), np.int64)
        begin = starts.copy()
        skip = np.zeros(len(types), bool)
        draws = uniforms(other[live] + again).tolist()
        for row, (d, (_, _, parent, t, banned)) in enumerate(zip(live, popped, strict=True)):
            if parent is None:
                heads.append(_NONE), head_owners.append(_NONE)
                whole[row] = bounds[d]
                continue
            a = int(parent.first[d])
            edge, o = int(parent.edges[a + t]), int(parent.owners[a + t])
            spot = int(lattice.src[edge])  # the first free edge is another one than the banned ones
            low = int(lattice.first[spot])
            choices = [e for e in range(low, low + int(lattice.count[spot])) if e not in banned]
            share = np.cumsum(lattice.p[choices])
            e = choices[min(int(np.searchsorted(share, draws[row] * share[-1], "right")), len(choices) - 1)]
            heads.append(np.append(parent.edges[a : a + t], e)), head_owners.append(np.append(parent.owners[a : a + t], o))
            if lattice.end[e]:
                skip[o] = True
            begin[o] = lattice.dst[e]
            whole[row] = o
        stop = bounds[1:][live]
        mine = _ranges(whole, stop - whole)
        mine = mine[~skip[mine]]
        walked, size = lattice.walk(begin[mine], base[mine] + shift, ends[mine])
        owner = np.repeat(mine, size)
        cut = np.searchsorted(owner, np.append(whole, len(types)))
        cut[1:-1] = np.searchsorted(owner, stop[:-1])
        edges, owners = walked, owner
        if any(map(len, heads)):
            edges = np.concatenate([x for row in range(len(live)) for x in (heads[row], walked[cut[row] : cut[row + 1]])])
            owners = np.concatenate([x for row in range(len(live)) for x in (head_owners[row], owner[cut[row] : cut[row + 1]])])
        sizes = np.array([len(h) for h in heads], np.int64) + np.diff(cut)
        ends_at = np.cumsum(sizes)
        p = lattice.p[edges]
        logp = np.log(p)
        before = np.cumsum(logp)
        total = before[ends_at - 1]
        offset = np.concatenate([[0.0], total[:-1]])
        first = np.zeros(n_docs + 1, np.int64)
        first[live] = ends_at - sizes
        path = _Round(edges, owners, first, total - offset)
        for row, d in enumerate(live):
            found[d].append((edges[ends_at[row] - sizes[row] : ends_at[row]], float(path.phi[row]), -popped[row][0]))
        # What is left of each set: paths that first differ at edge t, t + 1, ...
        free = np.array([x[3] for x in popped], np.int64)
        left = sizes - free
        at = _ranges(ends_at - left, left)
        every = slice(None) if len(at) == len(edges) else at  # the same places, without a copy
        rest = 1.0 - p[every]
        open_ = lattice.open[edges[every]]
        row_first = np.cumsum(left) - left
        for row, x in enumerate(popped):
            if x[4]:
                rest[row_first[row]] -= lattice.p[list(x[4])].sum()
                open_[row_first[row]] = lattice.count[lattice.src[edges[at[row_first[row]]]]] > len(x[4]) + 1
        mass = before[every] - logp[every] - np.repeat(offset, left) + np.log(np.maximum(rest, 1e-300))
        # The counter of a draw is the edge's number in its path.
        origin = other[live] + shift - (ends_at - sizes).astype(np.uint64) * _ODD
        late = np.where(open_, _log_exponential(np.repeat(origin, left) + at.view(np.uint64) * _ODD) - mass, np.inf)
        for row, (a, n) in enumerate(zip(row_first.tolist(), left.tolist(), strict=True)):
            mine, (time, _, _, t, banned) = late[a : a + n], popped[row]
            for _ in range(k - number):  # no more of them can ever be needed
                j = int(mine.argmin())
                if mine[j] == np.inf:
                    break
                edge = int(edges[at[a + j]])
                serial += 1
                heapq.heappush(heaps[live[row]], (float(np.logaddexp(time, mine[j])), serial, path, t + j, (*banned, edge) if j == 0 else (edge,)))
                mine[j] = np.inf
    out = []
    for d in range(n_docs):
        kappa = -heaps[d][0][0] if heaps[d] else -np.inf
        out.append([(e, phi, g, float(-np.expm1(-np.exp(min(phi - kappa, 700.0)))) if np.isfinite(kappa) else 1.0) for e, phi, g in found[d]])
    return out


def units_of(text: str) -> list[str]:
    """The words of a text with the dummy prefix, spaces written as U+2581."""
    if not text:
        return []
    return _UNITS.findall(SPACE + (text.translate(_SWAP) if SPACE in text else text.replace(" ", SPACE)))


def _words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """The distinct words of texts, the number among them of each word of each text, and how many words each text has.

    Where single spaces alone part the words in all of the texts, they come without the U+2581 before each.
    """
    if not any(SPACE in t or "  " in t or t[:1] == " " or t[-1:] == " " for t in texts):
        with suppress(UnicodeEncodeError):  # half of a surrogate pair, which Arrow does not take
            lists = pc.split_pattern(pa.array([t for t in texts if t], pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            sizes = np.zeros(len(texts), np.int64)
            sizes[[bool(t) for t in texts]] = lists.value_lengths().to_numpy()
            return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes, True
    units = [units_of(t) for t in texts]
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(units)), np.int64)
    return list(number), at, np.array([len(u) for u in units], np.int64), False


@dataclass
class Samples:
    """Samples of some rows, by row and rank; the ids of sample i are ids[ends[i - 1] : ends[i]]."""

    number: list[int]
    rank: list[int]
    log_prob: list[float]
    perturbed: list[float]
    inclusion: list[float]
    ids: np.ndarray
    ends: np.ndarray


def sample_rows(lattice: Lattice, rows: list[tuple], k: int, seed: int) -> Samples:
    """Up to k samples of each of the rows of (key, text)."""
    words, at, sizes, bare = _words([text or "" for _, text in rows])
    keys = np.array([xxhash.xxh3_64_intdigest(f"{seed}|{key}") for key, _ in rows], np.uint64)
    full = np.flatnonzero(sizes)
    types = lattice.numbers(words, bare)[at]
    bounds = np.concatenate([[0], np.cumsum(sizes[full])])
    drawn = iter(top_k(lattice, types, bounds, keys[full], k) if len(full) else ())
    empty = -_log_exponential(mix(keys ^ np.uint64(0xA0761D6478BD642F)))
    out: list[list] = [[] for _ in range(5)]
    paths = []
    for number, n_words in enumerate(sizes.tolist()):
        for rank, (edges, phi, g, inclusion) in enumerate(next(drawn) if n_words else [(_NONE, 0.0, float(empty[number]), 1.0)], 1):
            paths.append(edges)
            for col, x in zip(out, (number, rank, phi, g, inclusion), strict=True):
                col.append(x)
    ids, n_ids = lattice.pieces(np.concatenate(paths) if paths else _NONE)
    ends = np.concatenate([[0], np.cumsum(n_ids)])[np.cumsum([len(x) for x in paths])] if paths else _NONE
    return Samples(*out, ids, ends)


def sample_group(vocab: Vocabulary, rows: list[tuple], k: int, seed: int) -> Iterator[tuple]:
    """(row number, rank, ids, log-probability, perturbed, inclusion) for rows of (key, text)."""
    s = sample_rows(Lattice(vocab), rows, k, seed)
    for x, ids in enumerate(np.split(s.ids, s.ends[:-1])):
        if s.number:
            yield s.number[x], s.rank[x], ids, s.log_prob[x], s.perturbed[x], s.inclusion[x]


def _groups(texts: list, keys: list) -> Iterator[tuple[int, list[tuple]]]:
    start, chars, rows = 0, 0, []
    for n, (key, text) in enumerate(zip(keys, texts, strict=True)):
        rows.append((key, text))
        chars += len(text or "")
        if len(rows) >= GROUP or chars >= GROUP_CHARS:
            yield start, rows
            start, chars, rows = n + 1, 0, []
    if rows:
        yield start, rows


def sample(docs: DataFrame, vocab: Vocabulary, k: int = 2, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows a document: id, rank, ids, log_prob, perturbed, inclusion and exact (decoding gives the text back)."""
    spark = docs.sparkSession
    tune(spark, 1000)
    shared = spark.sparkContext.broadcast(vocab)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        lattice = Lattice(v)
        for batch in stream:
            keys, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for start, rows in _groups(texts, keys):
                if lattice.size > KEPT_CHARS:
                    lattice.clear()
                s = sample_rows(lattice, rows, k, seed)
                raw, ends = v.joined(s.ids, s.ends)
                exact, a = [], 0
                for x, b in zip(s.number, ends, strict=True):
                    exact.append(raw[a + 1 : b] == (rows[x][1] or "").encode("utf-8", "replace"))
                    a = b
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], s.ends]).astype(np.int32)), pa.array(s.ids.astype(np.int32, copy=False)))
                arrays = [pa.array([keys[start + x] for x in s.number], pa.int64()), pa.array(s.rank, pa.int32()), lists, *(pa.array(c, pa.float64()) for c in (s.log_prob, s.perturbed, s.inclusion)), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "rank", "ids", "log_prob", "perturbed", "inclusion", "exact"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "id bigint, rank int, ids array<int>, log_prob double, perturbed double, inclusion double, exact boolean")


def encode(docs: DataFrame, path: str = DEFAULT_MODEL, text_col: str = "text", as_col: str = "ids") -> DataFrame:
    """The columns of ``docs`` and the vocabulary's own (deterministic) segmentation, which replaces a column of its name;
    the file must be on all executors."""
    tune(docs.sparkSession, 1000)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in stream:
            ids = sp.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=batch.schema.names)

    return _replaced(docs, text_col, as_col, run, "array<int>")


def decode(rows: DataFrame, vocab: Vocabulary, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """The columns of ``rows`` and the text that the ids stand for, which replaces a column of its name; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return _replaced(rows, ids_col, as_col, run, "string")


def _replaced(df: DataFrame, from_col: str, as_col: str, run, kind: str) -> DataFrame:
    kept = df.select(*(df[c] for c in df.columns if c != as_col))
    src = df.select(*(df[c] for c in kept.columns), df[from_col].alias(as_col))
    return src.mapInArrow(run, with_added(kept, **{as_col: kind}))


def vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """The vocabulary at ``path``, else at the session's ``spark.terrella.piece.model``, else the default file."""
    return load(path or spark.conf.get("spark.terrella.piece.model", DEFAULT_MODEL))
