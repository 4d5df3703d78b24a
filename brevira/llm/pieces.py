"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is cut before its runs of spaces; every part begins with space marks, and the pieces of a part form a lattice. Piece
scores fall with a piece's rank in the vocabulary as 1 / (rank + 2); characters that no piece covers
become byte pieces. Backward sums over the lattices of all distinct parts of a batch, in arrays, give the exact
probability of every next piece.

The k segmentations of a text with the highest Gumbel-perturbed log-probabilities are k draws without replacement.
They are found by best-first (A*) search: a region is a shared beginning with the next pieces that are ruled out
after it; its key is the perturbed maximum inside it, an exact bound. Taking the best region yields its maximum as
the next sample and splits the rest by the step at which it leaves that sample, with Gumbels truncated at the key. The
(k + 1)-th key is the threshold kappa of the inclusion score 1 - exp(-exp(log p - kappa)).

All random numbers are hashes of the row key, the sample, the part and the step, so a row's samples depend neither on
its batch nor on its partition.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free, mix, span_hashes

#: The public model; a parameter of the operators.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
SPACE = "▁"
#: Stands for a space mark that the text itself holds, which only byte pieces may spell.
LITERAL = 0x110001
#: Characters that are worked on at a time.
CHARS = 400_000
#: Lattice nodes that a task keeps (about 55 bytes each), and cells (8 bytes) of the lattices that are made at a time; one
#: part alone may have more.
HELD, CELLS = 1_000_000, 1_000_000
#: Parts up to which the last steps of a walk are taken one part after the other, and steps whose numbers are made at once.
FEW, RUN = 4, 64
#: Steps of a region whose keys are always made, and a bound of ``_uniform``'s Gumbels (37.5).
FIRST_STEPS, MOST_GUMBEL = 16, 38.0
_MULT = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20
SAMPLE_DDL = "samples array<struct<ids:binary,log_prob:double,perturbed:double,log_inclusion:double>>"


def _utf8_len(c: np.ndarray) -> np.ndarray:
    return np.where(c == LITERAL, 3, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))


class Pieces:
    """Piece table of a model, laid out for array look-ups."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.byte_id = {}
        words, ids, spell = [], [], [b""] * n
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                spell[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                spell[i] = p.replace(SPACE, " ").encode()
                if SPACE not in p.lstrip(SPACE):  # parts hold space marks at the start only
                    words.append(p)
                    ids.append(i)
        rank = np.argsort(np.argsort([-m.get_score(i) for i in ids], kind="stable"), kind="stable")
        score = -np.log(rank + 2.0)
        score -= np.log(np.exp(score).sum())
        self.byte_score = float(score.min()) / 2
        self.longest = max(map(len, words))
        key = np.array([self._hash(w) for w in words], np.uint64)
        order = np.argsort(key)
        self.key, self.weight, self.ids = key[order], np.exp(score[order]), np.array(ids)[order]
        if (np.diff(self.key) == 0).any():
            raise ValueError("two pieces have one hash")
        # one key per slot; the few that share a slot are looked up by search
        slot = self._slot(self.key)
        self.at = np.full(1 << SLOT_BITS, -1, np.int32)
        self.at[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[slot[self.at[slot] != np.arange(len(slot))]] = True
        # slots of the beginnings of longer pieces
        self.longer = np.zeros(1 << SLOT_BITS, bool)
        self.longer[self._slot(np.array([self._hash(w) for w in {w[:k] for w in words for k in range(1, len(w))}], np.uint64))] = True
        size = np.array([len(s) for s in spell])
        self.spell_at, self.spell_n = np.concatenate(([0], np.cumsum(size)[:-1])), size
        self.spell = np.frombuffer(b"".join(spell), np.uint8)

    @staticmethod
    def _hash(word: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in word:
            h = h * _MULT + np.uint64(ord(c) + 1)
        return int(h[0])

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of polynomial hashes: where pieces are, their weights and ids, and where longer pieces may start alike."""
        slot = self._slot(h)
        p = self.at[slot]
        at = np.flatnonzero(p >= 0)
        p, own = p[at], h[at]
        ok = self.key[p] == own
        again = np.flatnonzero(~ok & self.crowded[slot[at]])
        if len(again):
            q = np.minimum(np.searchsorted(self.key, own[again]), len(self.key) - 1)
            ok[again], p[again] = self.key[q] == own[again], q
        return at[ok], self.weight[p[ok]], self.ids[p[ok]], np.flatnonzero(self.longer[slot])

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids made by this module: without the space mark of the start."""
        return self.decode_all([ids])[0]

    def decode_all(self, each: list[np.ndarray]) -> list[str]:
        """The texts of several arrays of piece ids, in a few array operations."""
        ids = np.concatenate([np.empty(0, np.int32), *each])
        n = self.spell_n[ids]
        ends = np.cumsum(n)
        spelled = self.spell[np.repeat(self.spell_at[ids] - (ends - n), n) + np.arange(int(n.sum()))].tobytes()
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, each)])].tolist()
        return [spelled[a + 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """Lattices of distinct parts: for every node (part, position) the arcs to the next nodes by length, each with its
    probability and piece id (-1: a character in bytes).

    Lattices are kept from one call to the next, as frequent parts recur. Beyond ``HELD`` nodes only parts that were met
    again are kept, the most frequent first, up to half as many; others are made anew when met again. So memory is bounded.
    """

    NODES = {"first": np.int32, "options": np.int8, "best": np.int32, "best_p": np.float32, "share": np.float32, "total": np.float64, "char": np.int32}
    ARCS = {"arc_p": np.float32, "arc_id": np.int32, "arc_len": np.int8}

    def __init__(self, table: Pieces):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes of parts, in order, and their numbers
        self.n, self.base, self.uses = (np.empty(0, np.int64) for _ in range(3))
        self.nodes = self.arcs = 0
        for name, kind in (self.NODES | self.ARCS).items():
            setattr(self, name, np.empty(0, kind))

    def thin(self) -> None:
        """Drop what is held beyond the bound."""
        if self.nodes <= HELD:
            return
        by = np.argsort(-self.uses, kind="stable")
        by = by[(self.uses[by] > 1) & (np.cumsum(self.n[by]) <= HELD // 2)]
        keep = np.sort(by)
        if not len(keep):
            self.clear()
            return
        at, n = self.base[keep], self.n[keep]
        base = np.cumsum(n) - n
        node = np.arange(int(n.sum())) + np.repeat(at - base, n)
        arcs = np.add.reduceat(self.options[node].astype(np.int64), base)
        old, new = self.first[at].astype(np.int64), np.cumsum(arcs) - arcs
        arc = np.arange(int(arcs.sum())) + np.repeat(old - new, arcs)
        moved = np.repeat(new - old, n)
        columns = {name: getattr(self, name)[node] for name in self.NODES}
        columns["first"], columns["best"] = columns["first"] + moved, columns["best"] + moved
        columns |= {name: getattr(self, name)[arc] for name in self.ARCS}
        number = np.full(len(self.n), -1, np.int64)
        number[keep] = np.arange(len(keep))
        number = number[self.numbers]
        self.keys, self.numbers = self.keys[number >= 0], number[number >= 0]
        self.n, self.base, self.uses, self.nodes, self.arcs = n, base, self.uses[keep] // 2, len(node), len(arc)
        for name, kind in (self.NODES | self.ARCS).items():
            setattr(self, name, columns[name].astype(kind, copy=False))

    def _append(self, kinds: dict, used: int, columns: dict) -> None:
        more = used + len(next(iter(columns.values())))
        for name in kinds:
            held = getattr(self, name)
            if len(held) < more:
                room = np.empty(max(more, len(held) * 3 // 2), held.dtype)
                room[:used] = held[:used]
                setattr(self, name, room)
                held = room
            held[used:more] = columns[name]

    def number(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the parts that stand at these places of ``code`` (characters, with marks); lattices of new ones are made."""
        own, at, which, uses = np.unique(span_hashes(code, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.keys, own)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != own) if len(self.keys) else np.arange(len(own))
        numbers = np.empty(len(own), np.int64)
        old = np.ones(len(own), bool)
        old[new] = False
        numbers[old] = self.numbers[place[old]]
        numbers[new] = len(self.n) + np.arange(len(new))
        self.keys, self.numbers = np.insert(self.keys, place[new], own[new]), np.insert(self.numbers, place[new], numbers[new])
        starts, size = starts[at[new]], ends[at[new]] - starts[at[new]]
        first = len(self.n)
        self.n, self.base, self.uses = (np.concatenate((x, y)) for x, y in ((self.n, size), (self.base, np.zeros(len(new), np.int64)), (self.uses, np.zeros(len(new), np.int64))))
        self.uses[numbers] += uses
        order = np.argsort(size, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
            length = int(size[same[0]])
            many = max(1, CELLS // (length * min(self.table.longest, length)))
            for some in (same[i : i + many] for i in range(0, len(same), many)):
                self.base[first + some] = self.nodes + np.arange(len(some)) * length
                self._bucket(code[starts[some][:, None] + np.arange(length)])
        return numbers[which]

    def _bucket(self, c: np.ndarray) -> None:
        """Append the lattices of parts of one length, given by their characters. Cells are (position, length, part), so
        that every step works on all parts at once."""
        u, length = c.shape
        top, table = min(self.table.longest, length), self.table
        x = np.zeros((length, top, u))
        ids = np.full((length, top, u), -1, np.int32)
        c = np.ascontiguousarray(c.T).ravel()
        code = c.astype(np.uint64) + np.uint64(1)
        # places from which a longer piece may still start, their hashes so far, and their cells
        at, h = np.arange(length * u), np.zeros(length * u, np.uint64)
        cell = at + at // u * ((top - 1) * u)
        flat_x, flat_ids = x.ravel(), ids.ravel()
        for k in range(1, top + 1):
            m = np.searchsorted(at, (length - k + 1) * u)
            at, cell = at[:m], cell[:m]
            if not m:
                break
            h = h[:m] * _MULT + code[at + (k - 1) * u]
            hit, w, i, longer = table.find(h)
            to = cell[hit] + (k - 1) * u
            flat_x[to], flat_ids[to] = w, i
            at, cell, h = at[longer], cell[longer], h[longer]
        bare = x[:, 0] == 0
        x[:, 0][bare] = np.exp(table.byte_score * _utf8_len(c[bare.ravel()]))
        # sums over all ways to the end, scaled to 1 every few positions so that long parts stay within doubles
        back = np.zeros((length + top, u))
        back[length] = 1
        for s in range(length - 1, -1, -1):
            m = min(top, length - s)
            y = x[s, :m]
            y *= back[s + 1 : s + 1 + m]
            total = y.sum(axis=0)
            y /= total
            back[s] = total
            if s % 8 == 0:
                back[s : s + top] /= total
        p = x.transpose(2, 0, 1).astype(np.float32).ravel()
        flat = np.flatnonzero(p)
        p = p[flat]
        node, k = np.divmod(flat, top)
        options = np.bincount(node, minlength=u * length)
        first = np.cumsum(options) - options
        best_p = np.maximum.reduceat(p, first)
        likeliest = np.flatnonzero(p == best_p[node])
        best = np.empty(u * length, np.int64)
        best[node[likeliest[::-1]]] = likeliest[::-1]  # of ties the shortest
        total = np.add.reduceat(p, first, dtype=np.float64)
        # an arc to the end of its part has a negative length
        size = np.where(node % length + k + 1 == length, -1 - k, k + 1)
        self._append(self.NODES, self.nodes, {"first": first + self.arcs, "options": options, "best": best + self.arcs, "best_p": best_p, "share": best_p / total, "total": total, "char": c.reshape(length, u).T.ravel()})
        self._append(self.ARCS, self.arcs, {"arc_p": p, "arc_id": ids.transpose(2, 0, 1).ravel()[flat], "arc_len": size})
        self.nodes += u * length
        self.arcs += len(p)


def _state(*keys) -> np.ndarray:
    """Hashes of integer keys, for ``_uniform``."""
    h = np.array([0x2545F4914F6CDD1D], np.uint64)
    for k in keys:
        h = mix(np.asarray(k).astype(np.uint64) + h * _MULT)
    return h


def _uniform(state, last) -> np.ndarray:
    """Uniform numbers in (0, 1) from a state and one more integer key."""
    h = mix(np.asarray(last).astype(np.uint64) + state * _MULT)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _other(lat: Lattices, row, x):
    """The arcs, but for the likeliest, that numbers in [0, total) fall on, in order of length after the likeliest."""
    top, at = lat.best[row], lat.first[row]
    y, end, arc = x - lat.best_p[row], at + lat.options[row], lat.best[row]
    todo = np.arange(len(row))
    while len(todo):
        q = np.flatnonzero(at != top)
        arc[todo[q]] = at[q]  # the last one stands if rounding leaves a remainder
        y[q] -= lat.arc_p[at[q]]
        at += 1
        q = np.flatnonzero((y >= 0) & (at < end))
        todo, y, at, top, end = todo[q], y[q], at[q], top[q], end[q]
    return arc


def _walk(lat: Lattices, part, start, seed, place, sample):
    """Draw pieces from ``start`` to the end of every part: (counts, nodes, arcs), parts in order, end to end. The number of
    a step is a hash of the row key, the sample, the part's place and the step's."""
    count = np.zeros(len(part), np.int64)
    base = lat.base[part]
    active = np.flatnonzero(start < lat.n[part])
    row, state = (base + start)[active], _state(seed, place, sample)[active]
    steps, i = [], 0
    while len(active) > FEW:
        x = _uniform(state, i)
        arc = lat.best[row]
        # the likeliest arc takes the first part of the unit interval
        other = np.flatnonzero(x >= lat.share[row])
        if len(other):
            arc[other] = _other(lat, row[other], x[other] * lat.total[row[other]])
        steps.append((active, row, arc))
        count[active] += 1
        size = lat.arc_len[arc]
        left = np.flatnonzero(size > 0)
        active, state, row = active[left], state[left], row[left] + size[left]
        i += 1
    rest = []
    for q, (a, at) in enumerate(zip(active.tolist(), row.tolist(), strict=True)):  # few are left, of long parts: one by one
        nodes, arcs, j, own = [], [], i, state[q : q + 1]
        while at is not None:
            for x in _uniform(own, np.arange(j, j + RUN)).tolist():
                arc = lat.best[at]
                if x >= lat.share[at]:
                    arc = _other(lat, np.array([at]), np.array([x * lat.total[at]]))[0]
                nodes.append(at)
                arcs.append(arc)
                n = int(lat.arc_len[arc])
                if n < 0:
                    at = None
                    break
                at += n
            j += RUN
        rest.append((a, count[a], nodes, arcs))
        count[a] += len(nodes)
    first = np.cumsum(count) - count
    rows, arcs = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    for i, (a, row, arc) in enumerate(steps):
        at = first[a] + i
        rows[at], arcs[at] = row, arc
    for a, done, own, own_arcs in rest:
        at = first[a] + done
        rows[at : at + len(own)], arcs[at : at + len(own)] = own, own_arcs
    return count, rows, arcs


def _ids(lat: Lattices, rows, arcs, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of steps, and how many each step has (several where a character is spelled in bytes)."""
    ids = lat.arc_id[arcs]
    n = np.ones(len(ids), np.int64)
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, n
    chars, which = np.unique(lat.char[rows[bare]], return_inverse=True)
    spelled = [[table.byte_id[x] for x in (SPACE if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass")] for c in chars.tolist()]
    size = np.array([len(x) for x in spelled])
    grid = np.array([x + [0] * (4 - len(x)) for x in spelled], np.int32)
    n[bare] = size[which]
    out = np.repeat(ids, n)
    out[np.repeat(ids < 0, n)] = grid[which][np.arange(4) < size[which][:, None]]
    return out, n


def _truncated(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at ``loc``, each at most its ``bound``."""
    return loc - np.log(np.exp(loc - bound) - np.log(u))


def sample(texts: list[str | None], seeds: list[int], table: Pieces, k: int = SAMPLES, lat: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations in the order of their perturbed values: (ids, log probability, perturbed
    value, log inclusion score). Null and empty texts have one, without pieces. ``lat``: lattices of earlier calls."""
    out: list[list] = [[] for _ in texts]
    lat = lat or Lattices(table)
    lat.thin()
    # the space before a text is the mark of its start; a part starts there and at every run of spaces
    full = np.array([bool(t) for t in texts], bool)
    code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts if t)])
    mark = code == 32
    opens = mark.copy()
    opens[1:] &= ~mark[:-1]
    opens[begins[:-1]] = True
    code = np.where(mark, 0x2581, np.where(code == 0x2581, LITERAL, code))
    starts = np.flatnonzero(opens)
    part = lat.number(code, starts, np.append(starts[1:], len(code))) if len(code) else np.empty(0, np.int64)
    size = np.zeros(len(texts), np.int64)
    size[full] = np.diff(np.searchsorted(starts, begins))
    bounds = np.concatenate(([0], np.cumsum(size)))
    doc = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(part)) - bounds[doc]
    seed = np.array(seeds, np.int64).astype(np.uint64)
    top = -np.log(-np.log(_uniform(_state(seed, -1, 0), 0))) if len(texts) else []
    # a region: key (negated), tie-breaker, sample whose first steps are shared, number of those, their log-probability,
    # pieces ruled out next
    heaps = [[(-float(g), 0, -1, 0, 0.0, ())] if n else [] for g, n in zip(top, size, strict=True)]
    found: list[list[dict]] = [[] for _ in texts]
    for r in range(k):
        todo = [d for d, h in enumerate(heaps) if h]
        if not todo:
            break
        regions = [heapq.heappop(heaps[d]) for d in todo]
        docs = np.array(todo)
        first, begin, lead = bounds[docs].copy(), np.zeros(len(todo), np.int64), r > 0
        if lead:  # the step at which each leaves the sample that it shares
            row = np.array([found[d][x[2]]["rows"][x[3]] for d, x in zip(todo, regions, strict=True)])
            opening, choices = lat.first[row], lat.options[row]
            column = np.arange(int(choices.max()))
            inside = column < choices[:, None]
            left = np.where(inside, lat.arc_p[np.where(inside, opening[:, None] + column, 0)], 0).astype(np.float64)
            for i, x in enumerate(regions):
                left[i, [q - opening[i] for q in x[5]]] = 0
            left_over, ruled_out = left.sum(axis=1), np.array([len(x[5]) for x in regions])
            cum = np.cumsum(left, axis=1)
            shared = np.array([x[3] for x in regions])
            y = np.minimum(_uniform(_state(seed[docs], r, -7), shared) * cum[:, -1], cum[:, -1] * (1 - 1e-12))
            pick = opening + np.minimum((cum <= y[:, None]).sum(axis=1), choices - 1)
            at = np.array([found[d][x[2]]["unit"][x[3]] for d, x in zip(todo, regions, strict=True)])
            first += at
            begin = row - lat.base[part[first]] + np.abs(lat.arc_len[pick])
        n = bounds[docs + 1] - first
        opens = np.concatenate(([0], np.cumsum(n)[:-1]))
        occ = np.arange(int(n.sum())) - np.repeat(opens, n) + np.repeat(first, n)
        start = np.zeros(len(occ), np.int64)
        start[opens] = begin
        count, rows, ks = _walk(lat, part[occ], start, seed[doc[occ]], place[occ], r)
        unit = np.repeat(place[occ], count)
        steps = np.add.reduceat(count, opens)
        if lead:  # put the leaving step before the walk
            where = np.concatenate(([0], np.cumsum(steps)[:-1]))
            rows, ks, unit = np.insert(rows, where, row), np.insert(ks, where, pick), np.insert(unit, where, at)
            steps = steps + 1
        ends = np.cumsum(steps)
        begins = ends - steps
        owner = np.repeat(np.arange(len(todo)), steps)
        index = np.arange(len(rows)) - begins[owner] + (shared[owner] if lead else 0)
        p = lat.arc_p[ks].astype(np.float64)
        logs = np.cumsum(np.log(np.maximum(p, 1e-300)))
        base = np.concatenate(([0.0], logs))[begins]
        offset = np.array([x[4] for x in regions]) - base
        before = np.concatenate(([0.0], logs[:-1])) + offset[owner]
        bound, state, passed = np.array([-x[0] for x in regions]), _state(seed[docs], r, -9), np.arange(len(rows)) - begins[owner]

        def keyed(at):
            """Of steps: those that other arcs leave, and the keys of the regions that do."""
            own = owner[at]
            options, rest = lat.options[rows[at]].astype(np.int64) - 1, lat.total[rows[at]] - p[at]
            if lead:
                opening_step = np.flatnonzero(passed[at] == 0)
                of = own[opening_step]
                options[opening_step] -= ruled_out[of]
                rest[opening_step] = left_over[of] - p[at[opening_step]]
            ok = options > 0
            at, own, rest = at[ok], own[ok], rest[ok]
            return at, _truncated(before[at] + np.log(np.maximum(rest, 1e-12)), bound[own], _uniform(state[own], index[at]))

        def best(at, key):
            """Steps and keys by owner, best first, with each one's rank."""
            order = np.lexsort((-key, owner[at]))
            at, key = at[order], key[order]
            own = owner[at]
            return at, key, np.arange(len(at)) - np.searchsorted(own, np.arange(len(todo)))[own]

        # No more than the k + 1 best regions of a text can matter. A step's key is at most its log-probability plus the
        # greatest Gumbel, so later steps count only where that reaches the least of those among the first steps.
        need = k + 1 - r
        at, key, rank = best(*keyed(np.flatnonzero(passed < FIRST_STEPS)))
        floor = np.full(len(todo), -np.inf)
        last = rank == need - 1
        floor[owner[at[last]]] = key[last]
        later, more = keyed(np.flatnonzero((passed >= FIRST_STEPS) & (before + MOST_GUMBEL >= floor[owner])))
        reach = more >= floor[owner[later]]
        later, more = later[reach], more[reach]
        if len(later):
            at, key, rank = best(np.concatenate((at, later)), np.concatenate((key, more)))
        for i, (d, x) in enumerate(zip(todo, regions, strict=True)):
            a, b = int(begins[i]), int(ends[i])
            own = {"rows": rows[a:b], "ks": ks[a:b], "unit": unit[a:b]}
            if lead and x[3]:
                old = found[d][x[2]]
                own = {c: np.concatenate((old[c][: x[3]], v)) for c, v in own.items()}
            found[d].append(own | {"log_prob": float(logs[b - 1] + offset[i]), "g": -x[0]})
        chosen = np.flatnonzero(rank < need)
        for h, g, nth in zip(at[chosen].tolist(), key[chosen].tolist(), rank[chosen].tolist(), strict=True):
            i = int(owner[h])
            d, x = todo[i], regions[i]
            gone = (*(x[5] if passed[h] == 0 else ()), int(ks[h]))
            heapq.heappush(heaps[d], (-g, (r + 1) * 10 + nth, len(found[d]) - 1, int(index[h]), float(before[h]), gone))
    every = [(d, x) for d, xs in enumerate(found) for x in xs]
    if every:
        ids, n = _ids(lat, np.concatenate([x["rows"] for _, x in every]), np.concatenate([x["ks"] for _, x in every]), table)
        ids = ids.astype("<i4")
        cuts = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0] + [len(x["rows"]) for _, x in every])]
        for (d, x), a, b in zip(every, cuts[:-1], cuts[1:], strict=True):
            kappa = -heaps[d][0][0] if heaps[d] else -np.inf
            gap = x["log_prob"] - kappa
            inclusion = 0.0 if np.isneginf(kappa) else float(gap if gap < -30 else np.log(-np.expm1(-np.exp(min(gap, 700)))))
            out[d].append((ids[a:b], x["log_prob"], x["g"], inclusion))
    for d, n in enumerate(size):
        if not n:
            out[d].append((np.empty(0, "<i4"), 0.0, 0.0, 0.0))
    return out


def _in_groups(texts: list[str | None]):
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= CHARS:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _sampler(model: str, k: int, check: bool = False):
    """A function from texts and seeds to the samples of each text and, with ``check``, whether all decode to the text."""
    table = pieces(model)
    lat = Lattices(table)

    def run(texts, seeds):
        rows, same = [], []
        for a, b in _in_groups(texts):
            found = sample(texts[a:b], seeds[a:b], table, k, lat)
            rows += [[{"ids": ids.tobytes(), "log_prob": p, "perturbed": g, "log_inclusion": i} for ids, p, g, i in x] for x in found]
            if check:
                back = iter(table.decode_all([np.frombuffer(y["ids"], "<i4") for x in rows[a:b] for y in x]))
                same += [all([next(back) == (t or "") for _ in x]) for t, x in zip(texts[a:b], found, strict=True)]
        return (rows, same) if check else (rows,)

    return run


def _seeded(docs: DataFrame, key_col: str) -> tuple[DataFrame, str]:
    seed = free("_seed", docs)
    return docs.withColumn(seed, F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("")))), seed


def sampled(docs: DataFrame, k: int = SAMPLES, text_col: str = "text", key_col: str = "doc_id", model: str = MODEL) -> DataFrame:
    """``docs`` with ``samples``: for each row up to k distinct segmentations (ids as little-endian int32 bytes).

    Null and empty texts have one segmentation without pieces; rows with equal keys and texts get equal samples; null keys
    count as empty ones; an empty table gives no rows. A column called ``samples`` is replaced, others pass through. A text without
    spaces is one lattice, held whole by its task (about 60 bytes a character while it is worked on, and its arcs).
    """
    src, seed = _seeded(docs, key_col)
    return add_columns(src, [text_col, seed], SAMPLE_DDL, lambda: _sampler(model, k), drop=[seed])


def round_trip(docs: DataFrame, k: int = SAMPLES, text_col: str = "text", key_col: str = "doc_id", model: str = MODEL, drop: list[str] | None = None) -> DataFrame:
    """``docs`` with ``samples`` as by ``sampled`` and ``decoded``: whether every sample's ids decode to the whole text (null: the
    empty one). Both in one pass, so that texts and ids go to Python once. Columns in ``drop`` are left out."""
    src, seed = _seeded(docs, key_col)
    return add_columns(src, [text_col, seed], SAMPLE_DDL + ", decoded boolean", lambda: _sampler(model, k, check=True), drop=[seed, *(drop or ())])


def decoded(df: DataFrame, samples_col: str = "samples", model: str = MODEL) -> DataFrame:
    """``df`` with ``texts``: the text of every sample."""

    def make():
        table = pieces(model)
        return lambda rows: ([[table.decode(np.frombuffer(x["ids"], "<i4")) for x in row or ()] for row in rows],)

    return add_columns(df, [samples_col], "texts array<string>", make)


def report(docs: DataFrame, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """One row per document: piece counts, log-probabilities, log inclusion scores and id digests of its samples, whether
    they differ from each other and whether each decodes to the text."""
    s = round_trip(docs.select("doc_id", "text"), k, model=model, drop=["text"])
    return s.select(
        "doc_id",
        F.size("samples").alias("n_samples"),
        F.transform("samples", lambda x: (F.octet_length(x["ids"]) / 4).cast("long")).alias("n_pieces"),
        F.transform("samples", lambda x: F.round(x["log_prob"], 4)).alias("log_probs"),
        F.transform("samples", lambda x: F.round(x["perturbed"], 4)).alias("perturbed"),
        F.transform("samples", lambda x: F.round(x["log_inclusion"], 4)).alias("log_inclusions"),
        F.transform("samples", lambda x: F.sha2(x["ids"], 256)).alias("ids_sha256"),
        (F.size(F.array_distinct(F.transform("samples", lambda x: x["ids"]))) == F.size("samples")).alias("distinct"),
        "decoded",
    )
