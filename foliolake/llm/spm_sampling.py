"""SentencePiece encoding and decoding: sampled segmentations without replacement.

A vocabulary file gives pieces and ranks; the lattice of a text has an edge for every piece at every place.
Ranks become probabilities by Zipf's law, ``p ~ 1 / (rank + 1) ** power``, because merge files carry no
likelihoods. Characters that no piece spells are one edge of byte pieces. A text is normalized as the file
asks of such models: a space is put before it, and the mark of the file stands for a space.

Gumbel top-k: every segmentation has its log probability plus Gumbel noise, and the ``draws`` largest are a
sample without replacement. They are found by a best-first (A*) search on the tree of partial
segmentations. The backward sums over the lattice make the search exact: the noisy maximum below a node is
drawn from the node's own mass, so it is both bound and heuristic. The maximum goes straight down to its
leaf; all siblings left behind at one place form one node with their joint mass, whose noise is drawn below
the bound of the path. The best of these nodes starts the next segmentation. The inclusion score of a
segmentation is the probability that its noise exceeds the bound that the search ended with.

Noise is a hash of (row key, draw, place), so a row gives the same segmentations wherever it is computed.
No piece spells a space after another character, so lattices of space-led chunks are independent. Each distinct
chunk of some megabytes of text is built once; segmentations are drawn on arrays over slices of that text.

Defined results: null and empty texts have one segmentation, the empty one, with inclusion 1. A text with
fewer segmentations than draws gives all of them. A null key seeds like -1; repeated rows give equal rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.words import hash_ranges, mix, text_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DRAWS = 2
POWER = 1.0
#: Bytes of text that are segmented at once, and that share the lattice of their distinct chunks.
SLICE = 3 << 18
LATTICE = 2 * SLICE
_MARK = "▁"
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_FILTER = 20  # bits of the first look-up
_FINE = 2.0**32
_LONG = 512  # bytes of a chunk that is worked on alone
_SHORT = 48  # bytes of a chunk whose probabilities are no smaller than a double can hold


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


class Vocabulary:
    """Pieces of a model file by length, with their log probabilities."""

    def __init__(self, model: str, power: float = POWER):
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=model)
        size = file.get_piece_size()
        names = [file.id_to_piece(i) for i in range(size)]
        plain = [
            i for i in range(size)
            if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i)) and names[i]
        ]
        self.byte_ids = np.array([file.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        ranks = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-file.get_score(i), i)))}
        mass = np.log(np.sum(1.0 / np.arange(1, len(plain) + 257) ** power))
        self.byte_log = -power * np.log(len(plain) + 256.0) - mass
        spelled = [b"" for _ in range(size)]
        for i in plain:
            spelled[i] = names[i].replace(_MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            spelled[i] = bytes([b])
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled])
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(spelled[i]) for i in plain}):
            ids = np.array([i for i in plain if len(spelled[i]) == length])
            letters = np.stack([np.frombuffer(spelled[i], np.uint8) for i in ids]).astype(np.uint64) + np.uint64(1)
            hashes = (letters * _powers(_BASE, length)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            seen = np.zeros(1 << _FILTER, bool)
            seen[(hashes >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
            logs = np.array([-power * np.log(ranks[i] + 1.0) - mass for i in ids])
            self.by_length[length] = (hashes[order], ids[order], logs[order], seen)
        text = [spelled[i] for i in plain]
        # Chunks may be cut where no piece reaches over.
        self.cut_spaces = all(b" " not in s.lstrip(b" ") for s in text)
        self.cut_lines = all(b"\n" not in s or s == b"\n" for s in text)


@cache
def vocabulary(model: str, power: float) -> Vocabulary:
    return Vocabulary(model, power)


class Lattice:
    """Edges of distinct chunks. State ``s`` is a byte place; its edges are ``first[s]`` to ``first[s+1] - 1``."""

    def __init__(self, words: Vocabulary, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n = len(data)
        chunk_end = np.repeat(end, end - begin)
        place = np.arange(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64, out=prefix[1:])
        back = _powers(_INVERSE, n)
        lead = (data & 0xC0) != 0x80
        room = chunk_end - place
        found = []
        for length, (hashes, ids, logs, seen) in sorted(words.by_length.items(), reverse=True):
            if length > n:
                continue
            fits = lead[: n - length + 1] & (room[: n - length + 1] >= length)
            if 4 * np.count_nonzero(fits) > n:  # most places: whole arrays are faster than places
                keys = (prefix[length:] - prefix[: n - length + 1]) * back[: n - length + 1]
                fits &= seen[keys >> np.uint64(64 - _FILTER)]
                at = np.flatnonzero(fits)
                keys = keys[at]
            else:
                at = np.flatnonzero(fits)
                keys = (prefix[at + length] - prefix[at]) * back[at]
                maybe = seen[keys >> np.uint64(64 - _FILTER)]
                at, keys = at[maybe], keys[maybe]
            hit = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            equal = hashes[hit] == keys
            found.append((at[equal], length, ids[hit[equal]], logs[hit[equal]]))
        # A character without a piece of its own length is spelled in bytes.
        width = np.ones(n, np.int64)
        starts = np.flatnonzero(lead)
        if n and (not len(starts) or starts[0] != 0):
            starts = np.concatenate(([0], starts)).astype(np.int64)
        width[starts] = np.diff(np.append(starts, n))
        width = np.minimum(width, chunk_end - place)
        spelled = np.zeros(n, bool)
        for at, length, _, _ in found:
            spelled[at[width[at] == length]] = True
        at = starts[~spelled[starts]]
        found.append((at, width[at], np.full(len(at), -1), words.byte_log * width[at]))
        degree = np.zeros(n + 1, np.int64)
        for at, *_ in found:
            degree[at] += 1
        self.first = np.concatenate(([0], np.cumsum(degree[:-1])))
        total = int(self.first[-1])
        self.piece, self.target = np.empty(total, np.int32), np.empty(total, np.int32)
        self.log = np.empty(total)
        filled = self.first[:-1].copy()
        for at, length, ids, logs in found:
            slot = filled[at]
            self.piece[slot], self.target[slot], self.log[slot] = ids, at + length, logs
            filled[at] += 1
        del found, prefix, back, filled
        self.source = np.repeat(place.astype(np.int32), degree[:-1])
        self.data, self.end = data, end
        self._normalize(begin, end)

    def _normalize(self, begin: np.ndarray, end: np.ndarray) -> None:
        """Edge log probabilities given their source: weights times backward sums, from the ends of chunks."""
        order = np.argsort(begin - end, kind="stable")  # longest first
        ends, lengths = end[order], (end - begin)[order]
        self.closing = np.repeat(end, self._edges_per_chunk(begin, end)) == self.target
        alone, middle = (int(np.searchsorted(-lengths, -most, side="left")) for most in (_LONG, _SHORT))
        for stop, length in zip(ends[:alone].tolist(), lengths[:alone].tolist()):
            self._normalize_alone(stop - length, stop)
        self.share = np.exp(self.log)
        self._backward(ends[alone:middle], lengths[alone:middle])
        long = self._edges_of(ends[:middle], lengths[:middle])
        self.share[long] = np.exp(self.log[long])
        self._backward_plain(ends[middle:], lengths[middle:])
        short = self._edges_of(ends[middle:], lengths[middle:])
        self.log[short] = np.log(self.share[short])

    def _edges_of(self, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first = self.first[ends - lengths]
        return _ragged(first, self.first[ends] - first)

    def _layers(self, ends: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """States at growing distance from the ends of their chunks, with their degrees and edges."""
        steps = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
        for distance, n in enumerate(steps, 1):
            states = ends[:n] - distance
            degree = self.first[states + 1] - self.first[states]
            if not degree.all():
                states, degree = states[degree > 0], degree[degree > 0]
            if len(states):
                yield states, degree, _ragged(self.first[states], degree)

    def _backward_plain(self, ends: np.ndarray, lengths: np.ndarray) -> None:
        """Sums of short chunks stay far from the smallest double, so they need no logarithms on the way.

        The end of a chunk is the begin of the next, so the sum at an end is kept apart: it is one.
        """
        beta = np.ones(len(self.data) + 1)
        for states, degree, edges in self._layers(ends, lengths):
            after = beta[self.target[edges]]
            after[self.closing[edges]] = 1.0
            values = self.share[edges] * after
            total = np.add.reduceat(values, np.cumsum(degree) - degree)
            beta[states] = total
            self.share[edges] = values / np.repeat(total, degree)

    def _backward(self, ends: np.ndarray, lengths: np.ndarray) -> None:
        """The same in logarithms."""
        beta = np.zeros(len(self.data) + 1 if len(ends) else 0)
        for states, degree, edges in self._layers(ends, lengths):
            starts = np.cumsum(degree) - degree
            values = self.log[edges] + np.where(self.closing[edges], 0.0, beta[self.target[edges]])
            top = np.maximum.reduceat(values, starts)
            total = np.log(np.add.reduceat(np.exp(values - np.repeat(top, degree)), starts)) + top
            beta[states] = total
            self.log[edges] = values - np.repeat(total, degree)

    def _normalize_alone(self, begin: int, end: int) -> None:
        """The same for one long chunk, state by state."""
        low = int(self.first[begin])
        first = (self.first[begin : end + 1] - low).tolist()
        target = (self.target[low : low + first[-1]] - begin).tolist()
        log = self.log[low : low + first[-1]].tolist()
        beta = [0.0] * (end - begin + 1)
        for state in range(end - begin - 1, -1, -1):
            a, b = first[state], first[state + 1]
            if a < b:
                values = [log[k] + beta[target[k]] for k in range(a, b)]
                top = max(values)
                beta[state] = total = top + math.log(sum([math.exp(v - top) for v in values]))
                log[a:b] = [v - total for v in values]
        self.log[low : low + first[-1]] = log

    def _edges_per_chunk(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.first[end] - self.first[begin]

    def choose(self, states: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state, with the edges' own probabilities."""
        edge, left = self.first[states], u.copy()
        last = self.first[states + 1] - 1
        going = np.arange(len(states))
        while len(going):
            left[going] -= self.share[edge[going]]
            going = going[(left[going] >= 0) & (edge[going] < last[going])]
            edge[going] += 1
        return edge

    def walk(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each state to the end of its chunk, one state after another, and their numbers."""
        going, at, steps = np.arange(len(states)), states, []
        counts = np.zeros(len(states), np.int64)
        while len(going) > 4 or len(steps) < 64 and len(going):
            edge = self.choose(at, uniform(seeds[going], len(steps)))
            steps.append((going, edge))
            counts[going] += 1
            on = ~self.closing[edge]
            going, at = going[on], self.target[edge[on]]
        rest = [self._walk_alone(int(s), seeds[who], len(steps)) for who, s in zip(going, at)]
        counts[going] += np.array([len(r) for r in rest], np.int64)
        offset = np.concatenate(([0], np.cumsum(counts)))
        edges = np.empty(int(offset[-1]), np.int64)
        for k, (who, edge) in enumerate(steps):
            edges[offset[who] + k] = edge
        for who, own in zip(going, rest):
            edges[offset[who + 1] - len(own) : offset[who + 1]] = own
        return edges, counts

    def _walk_alone(self, state: int, seed: np.uint64, number: int) -> list[int]:
        """The rest of a long walk, edge by edge, with the same noise."""
        edges: list[int] = []
        first, share, closing, target = self.first, self.share, self.closing, self.target
        while True:
            for u in uniform(seed, np.arange(number, number + 1024)).tolist():
                edge, last = int(first[state]), int(first[state + 1]) - 1
                u -= share[edge]
                while u >= 0 and edge < last:
                    edge += 1
                    u -= share[edge]
                edges.append(edge)
                if closing[edge]:
                    return edges
                state = int(target[edge])
            number += 1024


def uniform(seeds, number) -> np.ndarray:
    """Uniform values inside (0, 1) of seeds and numbers, one of which may be an array."""
    bits = mix(np.atleast_1d(seeds + (np.asarray(number, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _below(noisy: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel values turned into ones that are known to stay below a bound."""
    return -np.logaddexp(-noisy, -bound)


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices ``first[i]`` to ``first[i] + counts[i] - 1``, one range after another."""
    stops = np.cumsum(counts)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(first - (stops - counts), counts)


class _Path:
    """One segmentation per active row: edges, their chunk occurrences, and the noise of siblings."""

    def __init__(self, rows, edges, occurrence, counts, lattice, bound, seeds, branch=None, spent=None):
        self.rows, self.edges, self.occurrence, self.counts = rows, edges, occurrence, counts
        self.offset = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(rows)), counts)
        logs = lattice.log[edges]
        self.spent = np.array(lattice.share[edges])
        if branch is not None:  # siblings before the branch belong to the parent; at it, several are spent
            self.spent[self.offset[:-1] + branch] = spent
        # Whole multiples of 2**-32 add up alike in any slice.
        whole = np.rint(logs * _FINE).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(whole)))
        along = (total[:-1] - np.repeat(total[self.offset[:-1]], counts)) / _FINE
        self.log = (total[self.offset[1:]] - total[self.offset[:-1]]) / _FINE
        with np.errstate(divide="ignore"):
            mass = along + np.log(np.maximum(1.0 - self.spent, 0.0) * (np.abs(1.0 - self.spent) > 1e-12))
        place = (np.arange(len(edges)) - np.repeat(self.offset[:-1], counts)).astype(np.uint64)
        noise = _gumbel(uniform(seeds[owner] ^ mix(place + np.uint64(1)), 0))
        self.noise = _below(mass + noise, bound[owner])
        if branch is not None:
            self.noise[place.astype(np.int64) < np.repeat(branch, counts)] = -np.inf
        self.bound = bound

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the largest sibling noise and its place."""
        top = np.where(self.counts > 0, np.maximum.reduceat(np.append(self.noise, -np.inf), self.offset[:-1]), -np.inf)
        hit = np.flatnonzero(self.noise == np.repeat(top, self.counts))
        rows = np.repeat(np.arange(len(self.rows)), self.counts)[hit]
        place = np.zeros(len(self.rows), np.int64)
        place[rows[::-1]] = hit[::-1] - self.offset[rows[::-1]]
        return top, place


class Chunks:
    """Texts cut into chunks: the lattice of the distinct ones, and where the chunks of each text begin in it."""

    def __init__(self, words: Vocabulary, texts: pa.Array):
        data, offsets = text_buffer(texts)
        mark = _MARK.encode()
        if bytes(data).find(mark) >= 0:  # the mark itself is read as a space
            texts = pa.array([(t.as_py() or "").replace(_MARK, " ") for t in texts], pa.string())
            data, offsets = text_buffer(texts)
        full = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if words.cut_spaces and len(data):
            cut[1:-1] |= (data[1:] == 32) & (data[:-1] != 32)
        if words.cut_lines and len(data):
            line = data == 10
            cut[:-1] |= line
            cut[1:] |= line
        begin = np.flatnonzero(cut[:-1])
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        # Distinct chunks, each written once.
        hashes = hash_ranges(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
        _, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = end[chosen] - begin[chosen]
        stop = np.cumsum(size)
        self.lattice = Lattice(words, data[_ragged(begin[chosen], size)], stop - size, stop)
        self.states = (stop - size)[which]
        self.first = np.searchsorted(begin, offsets)  # chunks of row r: first[r] to first[r + 1] - 1


def sample(words: Vocabulary, texts: pa.Array, keys: np.ndarray, draws: int = DRAWS):
    """Segmentations of texts: (row, draw, log probability, inclusion, piece ids as list array) in order of draws."""
    return draw_samples(words, Chunks(words, texts), 0, len(texts), keys, draws)


def draw_samples(words: Vocabulary, cut: Chunks, low: int, high: int, keys: np.ndarray, draws: int = DRAWS):
    """``sample`` for the texts ``low`` to ``high - 1`` of ``cut``; rows are counted from ``low``."""
    lattice, n = cut.lattice, high - low
    states = cut.states[cut.first[low] : cut.first[high]]
    chunks = cut.first[low : high + 1] - cut.first[low]  # chunks of row r: chunks[r] to chunks[r + 1] - 1
    seeds = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    number = np.arange(len(states)) - np.repeat(chunks[:-1], np.diff(chunks))

    def chunk_seeds(occurrences: np.ndarray, rows: np.ndarray, draw: int) -> np.ndarray:
        return mix(seeds[rows] + np.uint64(draw)) + mix(number[occurrences].astype(np.uint64) + np.uint64(7))

    rows = np.arange(n)
    row_of = np.repeat(rows, np.diff(chunks))
    edges, counts = lattice.walk(states, chunk_seeds(np.arange(len(states)), row_of, 0))
    occurrence = np.repeat(np.arange(len(states)), counts)
    per_row = np.bincount(row_of, counts, n).astype(np.int64)
    bound = _gumbel(uniform(seeds, 0x51ED))
    paths = [_Path(rows, edges, occurrence, per_row, lattice, bound, mix(seeds + np.uint64(0xA5)))]
    while True:
        # The best node that is left, over all paths of a row.
        top, source, place = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        for k, path in enumerate(paths):
            own, at = path.best()
            better = own > top[path.rows]
            hit = path.rows[better]
            top[hit], source[hit], place[hit] = own[better], k, at[better]
        if len(paths) == draws:
            break
        active = np.flatnonzero(top > -np.inf)
        if not len(active):
            break
        paths.append(_branch(lattice, paths, active, top, source, place, states, chunks, chunk_seeds, seeds))
    return _collect(words, lattice, paths, top, n)


def _branch(lattice, paths, rows, top, source, place, states, chunks, chunk_seeds, seeds) -> _Path:
    """The segmentations that start at the best nodes of ``rows``."""
    draw = len(paths)
    branch = place[rows]
    prefix = np.empty(len(rows), np.int64)  # where the parent's edges start in the joined storage
    node = np.empty(len(rows), np.int64)
    spent = np.empty(len(rows))
    store = np.concatenate([p.edges for p in paths])
    store_occurrence = np.concatenate([p.occurrence for p in paths])
    base = np.cumsum([0] + [len(p.edges) for p in paths])
    for k, path in enumerate(paths):
        own = np.flatnonzero(source[rows] == k)
        local = path.offset[np.searchsorted(path.rows, rows[own])]
        prefix[own], node[own] = base[k] + local, local + branch[own]
        spent[own] = path.spent[node[own]]
        path.noise[node[own]] = -np.inf
    state = lattice.source[store[prefix + branch]]
    # Edges at this place that earlier segmentations with the same start have taken.
    taken = np.zeros(len(lattice.log), bool)
    edge = np.empty(len(rows), np.int64)
    u = uniform(mix(seeds[rows] + np.uint64(draw)), 0xB5) * np.maximum(1.0 - spent, 0.0)
    for i, (r, k, t) in enumerate(zip(rows, source[rows], branch)):
        used = _used(paths, k, r, t)
        taken[used] = True
        options = np.arange(lattice.first[state[i]], lattice.first[state[i] + 1])
        options = options[~taken[options]]
        taken[used] = False
        edge[i] = options[min(int(np.searchsorted(np.cumsum(lattice.share[options]), u[i], side="right")), len(options) - 1)]
    spent = spent + lattice.share[edge]
    occurrence = store_occurrence[prefix + branch]
    partial = np.flatnonzero(~lattice.closing[edge])
    later = chunks[rows + 1] - occurrence - 1
    # Walk the rest of the branched chunks, then all later chunks of the rows.
    more = _ragged(occurrence + 1, later)
    more_rows = np.repeat(rows, later)
    starts = np.concatenate((lattice.target[edge[partial]], states[more]))
    where = np.concatenate((occurrence[partial], more))
    who = np.concatenate((rows[partial], more_rows))
    walked, counts = lattice.walk(starts, chunk_seeds(where, who, draw))
    order = np.argsort(where, kind="stable")  # occurrences grow with rows
    offset = np.concatenate(([0], np.cumsum(counts)))
    tail = walked[_ragged(offset[:-1][order], counts[order])]
    tail_occurrence = np.repeat(where[order], counts[order])
    tail_counts = np.bincount(np.searchsorted(rows, who), counts, len(rows)).astype(np.int64)
    total = branch + 1 + tail_counts
    begin = np.concatenate(([0], np.cumsum(total)))[:-1]
    edges, occurrences = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()), np.int64)
    into, back = _ragged(begin, branch), _ragged(prefix, branch)
    edges[into], occurrences[into] = store[back], store_occurrence[back]
    edges[begin + branch], occurrences[begin + branch] = edge, occurrence
    into = _ragged(begin + branch + 1, tail_counts)
    edges[into], occurrences[into] = tail, tail_occurrence
    path = _Path(
        rows, edges, occurrences, total, lattice, top[rows], mix(seeds[rows] + np.uint64(0xA5 + draw)), branch, spent
    )
    path.parent, path.branch = source[rows], branch
    return path


def _used(paths, k: int, row: int, place: int) -> list[int]:
    """Edges taken at one place by path ``k`` of a row and by the paths that it branched from there."""
    used = []
    while True:
        path = paths[k]
        local = int(np.searchsorted(path.rows, row))
        used.append(int(path.edges[path.offset[local] + place]))
        if k == 0 or int(path.branch[local]) != place:
            return used
        k = int(path.parent[local])


def _collect(words, lattice, paths, top, n: int):
    """Rows of all paths with their ids, by row and draw."""
    row = np.concatenate([p.rows for p in paths])
    draw = np.concatenate([np.full(len(p.rows), k) for k, p in enumerate(paths)])
    log = np.concatenate([p.log for p in paths])
    with np.errstate(over="ignore"):
        inclusion = np.where(top[row] > -np.inf, -np.expm1(-np.exp(log - top[row])), 1.0)
    counts = np.concatenate([p.counts for p in paths])
    edges = np.concatenate([p.edges for p in paths])
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    order = np.lexsort((draw, row))
    edges, counts = edges[_ragged(first[order], counts[order])], counts[order]
    piece = lattice.piece[edges]
    width = np.where(piece < 0, lattice.target[edges] - lattice.source[edges], 1)
    ids = np.repeat(piece, width)
    spelled = np.repeat(piece < 0, width)
    ids[spelled] = words.byte_ids[lattice.data[_ragged(lattice.source[edges], width)[spelled]]]
    total = np.concatenate(([0], np.cumsum(width)))
    bounds = total[np.concatenate(([0], np.cumsum(counts)))]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
    return row[order], draw[order], log[order], inclusion[order], lists


def decode(words: Vocabulary, ids: pa.Array) -> pa.Array:
    """The texts that lists of piece ids spell."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in ids]))) if ids.null_count else (
        ids.offsets.to_numpy() - ids.offsets[0].as_py()
    )
    length = words.lengths[flat]
    data = words.data[_ragged(words.places[flat], length)]
    stops = np.concatenate(([0], np.cumsum(length)))[bounds]
    # The space before the text is taken off again.
    led = np.zeros(len(stops) - 1, np.int64)
    some = stops[:-1] < stops[1:]
    led[some] = data[stops[:-1][some]] == 32
    keep = np.ones(len(data), bool)
    keep[stops[:-1][led > 0]] = False
    offsets = stops - np.concatenate(([0], np.cumsum(led)))
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())
    )


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, one row at least."""
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


SCHEMA = "doc_id bigint, draw int, n_pieces int, log_prob double, inclusion double, ids array<int>, round_trip boolean"


def _sampler(model: str, draws: int, power: float, slice_bytes: int, lattice_bytes: int = LATTICE):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, power)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").cast(pa.int64())
            keys = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            for start, stop in _runs(sizes, lattice_bytes):
                cut = Chunks(words, texts.slice(start, stop - start))
                for low, high in _runs(sizes[start:stop], slice_bytes):
                    own = slice(start + low, start + high)
                    row, draw, log, inclusion, lists = draw_samples(words, cut, low, high, keys[own], draws)
                    back, part = decode(words, lists), texts.slice(own.start, high - low)
                    # The mark of the file stands for a space, so a text with the mark itself does not come back.
                    same = pc.equal(back, pc.fill_null(part, "").cast(pa.large_string()).take(pa.array(row)))
                    yield pa.record_batch(
                        [ids.slice(own.start, high - low).take(pa.array(row)), pa.array(draw, pa.int32()),
                         pa.array(np.diff(lists.offsets.to_numpy()), pa.int32()), pa.array(log + 0.0), pa.array(inclusion), lists, same],
                        names=["doc_id", "draw", "n_pieces", "log_prob", "inclusion", "ids", "round_trip"],
                    )

    return sampled


def sampled(
    docs: DataFrame, draws: int = DRAWS, model: str = MODEL, power: float = POWER, slice_bytes: int = SLICE,
    lattice_bytes: int = LATTICE,
) -> DataFrame:
    """Per document its sampled segmentations: draw, pieces, log probability, inclusion score, ids.

    ``round_trip`` tells that the ids decode to the text itself. The rows do not depend on ``slice_bytes`` and
    ``lattice_bytes``, which bound the memory of a worker.
    """
    return docs.select("doc_id", "text").mapInArrow(_sampler(model, draws, power, slice_bytes, lattice_bytes), SCHEMA)


def decoded(encoded: DataFrame, model: str = MODEL, power: float = POWER) -> DataFrame:
    """``encoded`` with the text that its ids spell."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, power)
        for batch in batches:
            text = decode(words, batch.column("ids")).cast(pa.string())
            yield pa.record_batch([*batch.columns, text], names=[*batch.schema.names, "text"])

    kept = encoded.select([c for c in encoded.columns if c != "text"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(spelled, f"{schema}, text string")
