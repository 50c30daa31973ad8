"""Sampling SentencePiece segmentations without replacement, and decoding.

A text's lattice holds every way to cut it into pieces of a vocabulary, with the product of
the pieces' probabilities (``theta`` flattens them).  Perturbed A-star search returns the k segmentations with the
largest Gumbel-perturbed log-probability, which is a sample of k distinct ones without
replacement.  No piece crosses into a new word, so the lattice is a chain of small word
lattices: their forward sums are exact heuristics, a branch's best perturbed value is drawn
from the Gumbel truncated at its parent's value, and only branches that reach the top k
are ever opened.

All random numbers are hashes of (row key, seed, path, word, step): a row gets the same
sample wherever, whenever and beside whatever other rows it is drawn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # what stands for a space inside pieces
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
# Units: a run of Latin letters or of anything else, with the space marks before it, or one line
# break.  No piece crosses from one unit to the next (load_vocabulary checks that).
UNIT = re.compile(f"{SPACE}*(?:[{LATIN}]+|[^{LATIN}{SPACE}\n]+)|{SPACE}+|\n")
BLOCK_CHARS = 500_000  # texts handled at once inside a task; bounds memory, not what is read
SLOT_BITS = 19  # of the trie's hash table, about ten times its edges
SLOTS = 1 << SLOT_BITS
NOISE = 37.5  # above the Gumbel value of the largest number ``uniform`` gives
BRANCHING, MASK = 0x9E3779B97F4A7C15, 2**64 - 1


@dataclass
class Vocabulary:
    """Pieces, their log-probabilities and the trie over their code points."""

    pieces: list[bytes]  # what each id decodes to, spaces as SPACE
    byte_ids: np.ndarray  # id of each single byte
    edges: np.ndarray  # hash table of keys node * 2^21 + code point, -1 where empty
    targets: np.ndarray  # the node an edge leads to
    piece_of: np.ndarray  # id that ends at a node, -1 if none
    logp: np.ndarray  # by id


def slot_of(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(BRANCHING)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def follow(keys: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Which of the trie's ``keys`` exist (as indices) and the nodes they lead to."""
    slot = slot_of(keys)
    held = v.edges[slot]
    other = np.flatnonzero((held != keys) & (held != -1))
    while len(other):  # linear probing
        slot[other] = (slot[other] + 1) % SLOTS
        held[other] = v.edges[slot[other]]
        other = other[(held[other] != keys[other]) & (held[other] != -1)]
    hit = np.flatnonzero(held == keys)
    return hit, v.targets[slot[hit]]


def load_vocabulary(path: str | None = None, theta: float = 1.0) -> Vocabulary:
    """Read a SentencePiece model with byte fallback.

    Merge models carry ranks instead of probabilities, so pieces are weighed by Zipf's law
    over their rank, 1 / (rank + 2.7), to the power ``theta``; a byte weighs less than
    the rarest piece by a factor of 256.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(normal, key=lambda i: (-model.get_score(i), i))
    weights = 1 / (np.arange(1, len(ranked) + 1) + 2.7)
    logp = np.full(len(ids), -np.inf)
    logp[ranked] = theta * np.log(weights / weights.sum())
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    logp[byte_ids] = logp[ranked].min() - theta * np.log(256)
    nodes: dict[tuple[int, int], int] = {}
    ends = {}
    pieces = [b""] * len(ids)
    for b in range(256):
        pieces[byte_ids[b]] = bytes([b])
    for i in normal:
        text = model.id_to_piece(i)
        if UNIT.findall(text) != [text]:
            raise ValueError(f"piece {i} crosses units")
        pieces[i] = text.encode()
        at = 0
        for c in text:
            at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
        ends[at] = i
    keys = np.array([a << 21 | c for a, c in nodes], dtype=np.int64)
    edges, targets = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
    slots = slot_of(keys)
    for key, slot, node in zip(keys.tolist(), slots.tolist(), nodes.values()):
        while edges[slot] != -1:
            slot = (slot + 1) % SLOTS
        edges[slot], targets[slot] = key, node
    piece_of = np.full(len(nodes) + 1, -1)
    piece_of[list(ends)] = list(ends.values())
    return Vocabulary(pieces, byte_ids, edges, targets, piece_of, logp)


@dataclass
class Lattices:
    """The lattices of distinct units: states are the places between code points, arcs lead
    from an earlier state and are sorted by the state they end in."""

    first: np.ndarray  # first state of a unit
    last: np.ndarray
    arc_start: np.ndarray
    arc_piece: np.ndarray  # id, or -1 - (index into fallback) for a code point spelled in bytes
    arc_logp: np.ndarray
    head: np.ndarray  # first arc into a state
    width: np.ndarray  # and their number
    cumulative: np.ndarray  # probability of an arc and those before it into the same state
    fallback: list[bytes]


def build_lattices(units: list[str], v: Vocabulary) -> Lattices:
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    unit = np.repeat(np.arange(len(units)), sizes)
    first = np.r_[0, np.cumsum(sizes + 1)][:-1]
    last = first + sizes
    state = np.arange(len(points)) + unit  # state before each code point
    offset = state - first[unit]  # its place in the unit
    starts, ends, places, ids = [], [], [], []
    single = np.zeros(len(points), bool)
    at, node, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
    while len(at):
        inside = at + depth < len(points)
        at, node = at[inside], node[inside]
        inside = unit[at + depth] == unit[at]
        at, node = at[inside], node[inside]
        key = node << 21 | points[at + depth]
        hit, node = follow(key, v)
        at = at[hit]
        depth += 1
        piece = v.piece_of[node]
        whole = piece >= 0
        starts.append(state[at[whole]])
        ends.append(state[at[whole]] + depth)
        places.append(offset[at[whole]] + depth)
        ids.append(piece[whole])
        if depth == 1:
            single[at[whole]] = True
    lone = np.flatnonzero(~single)
    kinds, back = np.unique(points[lone], return_inverse=True)
    fallback = [chr(c).encode("utf-8", "surrogatepass") for c in kinds]
    spelled = np.array([v.logp[v.byte_ids[list(b)]].sum() for b in fallback])
    start = np.concatenate([*starts, state[lone]])
    end = np.concatenate([*ends, state[lone] + 1])
    place = np.concatenate([*places, offset[lone] + 1])
    piece = np.concatenate([*ids, -1 - back])
    logp = np.concatenate([v.logp[np.concatenate(ids)], spelled[back] if len(back) else np.empty(0)])
    # Forward sums, all units at once: arcs that end i code points into their unit, for i = 1, 2, ...
    order = np.argsort(end, kind="stable")  # runs that are sorted already, one a piece length
    start, end, piece, logp, place = start[order], end[order], piece[order], logp[order], place[order]
    alpha = np.zeros(len(points) + len(units))
    by_place = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
    cuts = np.flatnonzero(np.r_[True, place[by_place][1:] != place[by_place][:-1], True]) if len(by_place) else np.array([0])
    for a, b in zip(cuts[:-1], cuts[1:]):
        arcs = by_place[a:b]
        into = end[arcs]
        heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        value = alpha[start[arcs]] + logp[arcs]
        top = np.maximum.reduceat(value, heads)
        width = np.diff(np.r_[heads, len(arcs)])
        alpha[into[heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, width)), heads))
    conditional = alpha[start] + logp - alpha[end]
    p = np.exp(conditional)
    heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.empty(0, np.int64)
    width = np.diff(np.r_[heads, len(end)])
    total = np.cumsum(p)
    cumulative = total - np.repeat(total[heads] - p[heads], width)
    cumulative[heads + width - 1] = 1
    head, arcs_into = np.zeros(len(alpha), np.int64), np.zeros(len(alpha), np.int64)
    head[end[heads]], arcs_into[end[heads]] = heads, width
    return Lattices(first, last, start, piece, conditional, head, arcs_into, cumulative, fallback)


class Growing:
    """An array that is appended to in place, with room to spare."""

    def __init__(self) -> None:
        self.room, self.size = np.empty(0, np.int32), 0

    def append(self, new: np.ndarray) -> np.ndarray:
        """All values so far, the new ones last."""
        need = self.size + len(new)
        if need > len(self.room) or self.room.dtype != new.dtype:
            room = np.empty(max(need, len(self.room) * 3 // 2), new.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : need] = new
        self.size = need
        return self.room[:need]


class Numbering(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class LatticeStore:
    """The lattices of the units met so far in a task; begun anew when it has grown large.

    Frequent units are built again after that, so the bound is as high as memory allows (about 0.6 KB a unit).
    """

    MOST = 250_000

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.found, self.lat = v, Numbering(), None
        self.columns = [Growing() for _ in range(8)]

    def unit_ids(self, texts: list[str]) -> list[list[int]]:
        """The units of each text, as indices into ``lat``."""
        if len(self.found) > self.MOST:
            self.found, self.lat = Numbering(), None
            for c in self.columns:
                c.size = 0
        found, had = self.found, len(self.found)
        number = found.__getitem__
        split = [list(map(number, UNIT.findall(SPACE + t.replace(" ", SPACE)))) if t else [] for t in texts]
        if len(found) > had:
            self.append(build_lattices(list(islice(found, had, None)), self.v))
        return split

    def append(self, b: Lattices) -> None:
        """The units of ``b`` after those held."""
        a = self.lat
        states, arcs, odd = (int(a.last[-1]) + 1, len(a.arc_start), a.fallback) if a else (0, 0, [])
        piece = np.where(b.arc_piece < 0, b.arc_piece - len(odd), b.arc_piece)
        parts = b.first + states, b.last + states, b.arc_start + states, piece, b.arc_logp, b.head + arcs, b.width, b.cumulative
        self.lat = Lattices(*(c.append(x if x.dtype == np.float64 else x.astype(np.int32)) for c, x in zip(self.columns, parts)), odd + b.fallback)


def mix64(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from hashes."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw(units: np.ndarray, keys: np.ndarray, lat: Lattices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ancestral samples for many units at once: (arcs in text order, arcs per unit, log-probability)."""
    at, place = lat.last[units].astype(np.intp), np.arange(len(units))
    first = lat.first[units]
    counts, logp = np.zeros(len(units), np.int64), np.zeros(len(units))
    rows, arcs, step = [], [], 0
    while len(place):
        u = uniform(keys[place] + np.uint64(step * BRANCHING & MASK))
        arc = lat.head[at].astype(np.intp)
        more = np.flatnonzero(u >= lat.cumulative[arc])
        while len(more):
            arc[more] += 1
            more = more[u[more] >= lat.cumulative[arc[more]]]
        rows.append(place)
        arcs.append(arc)
        logp[place] += lat.arc_logp[arc]
        counts[place] += 1
        at = lat.arc_start[arc].astype(np.intp)
        on = at > first[place]
        at, place, step = at[on], place[on], step + 1
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for step, (place, arc) in enumerate(zip(rows, arcs)):
        out[ends[place] - 1 - step] = arc
    return out, counts, logp


def truncated(phi: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """The largest perturbed value among branches of log mass ``phi``, given that it is below ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - phi)


@dataclass
class Path:
    """One sampled segmentation: its arcs, and per unit their number and log-probability."""

    arcs: np.ndarray
    counts: np.ndarray
    logp: np.ndarray
    value: float  # perturbed log-probability
    key: int

    def choice(self, unit: int) -> tuple:
        start = int(self.counts[:unit].sum())
        return tuple(self.arcs[start : start + self.counts[unit]].tolist())


@dataclass
class Branch:
    """What leaves ``path`` at ``unit`` for a choice other than the path's own and ``taken``."""

    value: float
    path: int
    unit: int
    taken: frozenset = frozenset()
    taken_p: float = 0.0


def one_hash(*parts: int) -> int:
    """A hash of whole numbers, as a plain int below 2^64."""
    x = 0
    for part in parts:
        x ^= part & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        x = (x ^ x >> 31) + BRANCHING & MASK
    return x


class Search:
    """The perturbed A-star search of one text over its units."""

    def __init__(self, units: np.ndarray, key: int, k: int) -> None:
        self.units, self.key, self.k = units, int(key), k
        self.paths: list[Path] = []
        self.agenda: list[Branch] = []
        self.cut = -np.inf  # the best perturbed value that is not in the sample

    def unit_keys(self, key: int, start: int, most: int | None = None) -> np.ndarray:
        stop = len(self.units) if most is None else start + most
        return mix64(np.arange(start, stop, dtype=np.uint64) * np.uint64(2) ^ np.uint64(key))

    def branch_off(self, start: int, taken: frozenset, taken_p: float) -> None:
        """Put the best branches of the newest path, from unit ``start`` on, on the agenda.

        ``taken`` are choices at ``start`` that older paths hold, with their probability.
        At most the best k + 1 of a path can ever be opened.
        """
        path, p = self.paths[-1], len(self.paths) - 1
        # A branch's value exceeds its log mass by NOISE at most, so far along it cannot be among the best.
        near = start + 600
        before = np.concatenate([[0.0], np.cumsum(path.logp[:near])[:-1]])[start:]
        value, rest = self.branch_values(path, before, start, taken_p)
        if near < len(path.logp) and (before[-1] > -60.0 or np.partition(value, -self.k - 1)[-self.k - 1] <= NOISE - 60.0):
            before = np.concatenate([[0.0], np.cumsum(path.logp)[:-1]])[start:]
            value, rest = self.branch_values(path, before, start, taken_p)
        best = np.argpartition(-value, self.k)[: self.k + 1] if len(value) > self.k + 1 else np.arange(len(value))
        for m in best.tolist():
            if rest[m] > 0:
                self.agenda.append(Branch(float(value[m]), p, start + m, *((taken, taken_p) if m == 0 else ())))

    def branch_values(self, path: Path, before: np.ndarray, start: int, taken_p: float) -> tuple[np.ndarray, np.ndarray]:
        """Per unit from ``start`` on: the best perturbed value off the path, and the probability left there."""
        rest = -np.expm1(path.logp[start : start + len(before)])
        rest[0] -= taken_p
        rest[rest < 1e-12] = 0  # the only segmentation there is
        u = uniform(self.unit_keys(path.key, start, len(before)) ^ np.uint64(0x5BF03635))
        with np.errstate(divide="ignore"):
            return truncated(before + np.log(rest), path.value, u), rest

    def pop(self) -> Branch | None:
        if not self.agenda:
            return None
        best = max(range(len(self.agenda)), key=lambda a: (self.agenda[a].value, -a))
        return self.agenda.pop(best)


def other_choice(unit: int, taken: frozenset, key: int, lat: Lattices) -> tuple[np.ndarray, float]:
    """One of a unit's segmentations that is not ``taken``, by their probability: (arcs, log-probability).

    Drawn from the end like any other, but while the draw runs along taken ones their
    remaining probability is left out of each arc's.
    """
    at, first, along, got, logp = int(lat.last[unit]), int(lat.first[unit]), [t[::-1] for t in taken], [], 0.0
    while at > first:
        low = int(lat.head[at])
        p = np.exp(lat.arc_logp[low : low + int(lat.width[at])])
        for t in along:
            i = t[len(got)] - low
            p[i] = max(0.0, p[i] - np.exp(lat.arc_logp[list(t[len(got) :])].sum()))
            if p[i] < 1e-14:
                p[i] = 0.0
        sums = p.cumsum()
        u = (one_hash(key, len(got)) >> 11) * 2.0**-53 * sums[-1]
        arc = low + int(np.searchsorted(sums, u, side="right"))
        along = [t for t in along if t[len(got)] == arc]
        got.append(arc)
        logp += float(lat.arc_logp[arc])
        at = int(lat.arc_start[arc])
    return np.array(got[::-1], np.int64), logp


def extend(jobs: list[tuple[Search, Path, int]], lat: Lattices) -> None:
    """Draw what follows the given beginnings (search, beginning, first open unit), all at once."""
    tails = [s.units[start:] for s, _, start in jobs]
    keys = [s.unit_keys(path.key, start) for s, path, start in jobs]
    arcs, counts, logp = draw(np.concatenate(tails), np.concatenate(keys), lat)
    at = arc_at = 0
    for (s, path, _), tail in zip(jobs, tails):
        c = counts[at : at + len(tail)]
        n = int(c.sum())
        new = Path(np.concatenate([path.arcs, arcs[arc_at : arc_at + n]]), np.concatenate([path.counts, c]), np.concatenate([path.logp, logp[at : at + len(tail)]]), path.value, path.key)
        s.paths.append(new)
        at, arc_at = at + len(tail), arc_at + n


def sample_block(texts: list[str], keys: np.ndarray, k: int, store: LatticeStore) -> list[list[tuple]]:
    """Per text up to ``k`` tuples (ids, log-probability, perturbed value, log inclusion score), best first."""
    split = store.unit_ids(texts)
    if not any(split):
        return [[(np.empty(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    lat, v = store.lat, store.v
    searches = [Search(np.array(units, np.int64), key, k) for units, key in zip(split, keys.tolist())]
    live = [s for s in searches if len(s.units)]
    jobs = []
    for s in live:
        top = -np.log(-np.log(uniform(np.array([one_hash(s.key, 1)], np.uint64))))[0]
        jobs.append((s, Path(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), float(top), one_hash(s.key, 2)), 0))
    extend(jobs, lat)
    for s in live:
        s.branch_off(0, frozenset(), 0.0)
    for turn in range(1, k):
        jobs, opened = [], []
        for s in live:
            b = s.pop()
            if b is None:
                continue
            old, key = s.paths[b.path], one_hash(s.key, 3, turn)
            taken, taken_p = b.taken | {old.choice(b.unit)}, b.taken_p + float(np.exp(old.logp[b.unit]))
            arcs, logp = other_choice(int(s.units[b.unit]), taken, one_hash(key, b.unit), lat)
            opened.append((s, b.unit, taken, taken_p))
            beginning = [old.arcs[: old.counts[: b.unit].sum()], arcs], [old.counts[: b.unit], [len(arcs)]], [old.logp[: b.unit], [logp]]
            jobs.append((s, Path(*map(np.concatenate, beginning), b.value, key), b.unit + 1))
        if jobs:
            extend(jobs, lat)
        for s, unit, taken, taken_p in opened:
            s.branch_off(unit, taken, taken_p)
    paths = [path for s in searches for path in s.paths]
    ids, ends = piece_ids(np.concatenate([path.arcs for path in paths]), np.cumsum([len(path.arcs) for path in paths]), lat, v)
    pieces = iter(np.split(ids, ends[:-1]))
    result = []
    for s in searches:
        if not len(s.units):
            result.append([(np.empty(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        rest = s.pop()
        s.cut = rest.value if rest else -np.inf
        rows = []
        for path in s.paths:
            total = float(path.logp.sum())
            gap = total - s.cut  # log of the chance to be kept is log(1 - exp(-exp(gap))), near gap where that is tiny
            score = gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 700.0)))))
            rows.append((next(pieces), total, path.value, score))
        result.append(rows)
    return result


def piece_ids(arcs: np.ndarray, ends: np.ndarray, lat: Lattices, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary ids along paths that end at ``ends``, and where they end among the ids; a
    code point without a piece becomes its bytes."""
    ids = lat.arc_piece[arcs].astype(np.int64)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        spelled = [v.byte_ids[list(lat.fallback[-1 - i])] for i in ids[odd].tolist()]
        repeat = np.ones(len(ids), np.int64)
        repeat[odd] = [len(b) for b in spelled]
        stops = np.cumsum(repeat)
        at = stops[odd] - repeat[odd]
        ids = np.repeat(ids, repeat)
        within = np.arange(int(repeat[odd].sum())) - np.repeat(np.cumsum(repeat[odd]) - repeat[odd], repeat[odd])
        ids[np.repeat(at, repeat[odd]) + within] = np.concatenate(spelled)
        ends = stops[ends - 1]
    return ids.astype(np.int32), ends


def decode(ids: list[int], pieces: list[bytes]) -> str:
    """The text of a sequence of ids: pieces joined, marks as spaces, without the added first one."""
    raw = b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return raw[1:] if raw.startswith(" ") else raw


SAMPLES = "id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, path: str | None = None, theta: float = 1.0) -> DataFrame:
    """Up to ``k`` distinct segmentations per row of ``docs``, one row each, numbered from 0 by value.

    ``ids`` are the pieces; ``log_prob`` is the segmentation's log-probability in the lattice,
    ``perturbed`` the Gumbel-perturbed one it was chosen by, ``log_inclusion`` the logarithm of
    its inclusion score given the best value left out; ``round_trip`` tells that the ids decode
    to the text (a text that holds the space mark itself decodes with spaces there).  Null and
    empty texts have the one empty segmentation; a text with fewer than ``k`` has fewer rows.
    The draw depends on id, seed and text alone, so rows that repeat an id and text agree.
    An empty table gives an empty result; other columns are ignored.
    """
    v = load_vocabulary(path, theta)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = LatticeStore(shared.value)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key").to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(sizes, dtype=np.int64) // BLOCK_CHARS
            for b in np.unique(block):
                rows = np.flatnonzero(block == b)
                own = [t or "" for t in texts.slice(rows[0], len(rows)).to_pylist()]
                samples = sample_block(own, keys[rows], k, store)
                each = [len(s) for s in samples]
                flat = [x for s in samples for x in s]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32)), pa.array(np.concatenate([x[0] for x in flat]).astype(np.int32))
                )
                ok = [decode(x[0].tolist(), store.v.pieces) == t.replace(SPACE, " ") for t, s in zip(own, samples) for x in s]
                cols = [batch.column("id").take(pa.array(np.repeat(rows, each))), pa.array(np.concatenate([np.arange(n) for n in each]).astype(np.int32)), lists]
                cols += [pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)] + [pa.array(ok)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SAMPLES.split(", ")])

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("id"), F.xxhash64(F.lit(seed), doc_id).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SAMPLES).withColumnRenamed("id", "doc_id")
