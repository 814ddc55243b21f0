"""Operator 7: SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has every way to cut it into the vocabulary's pieces; a segmentation's log probability is
the sum of its pieces' over the lattice's total. As no piece holds a blank after another character, the
lattice is a chain of units (blanks with the word behind them, and line breaks), each a small lattice of
its own whose forward sums are kept for repeated units.

Sampling. The k segmentations with the largest Gumbel-perturbed log probabilities are a sample without
replacement. The search is best first: a node is a set of segmentations that share their first units and
avoid some segmentations of the next one; its perturbed maximum is drawn from a Gumbel at its log mass,
truncated at its parent's, and bounds all below it exactly. Popping the best node fixes one segmentation of
the whole text, drawn backwards through the forward sums, and pushes the nodes that differ from it first at
each later unit. The perturbed maximum left after k pops is the threshold that gives inclusion
probabilities 1 - exp(-exp(log_prob - threshold)).

One uniform number picks a unit's segmentation as an arithmetic decoder would: each choice rescales it to the
chosen piece's share. All numbers that lead along a unit's likeliest pieces so form one interval; a draw within
it, which most are, takes the ready pieces.

Every random number is a hash of seed, row key, sample, unit and step, so a row's samples never depend on
its batch or task. The vocabulary's own scores are merge ranks, not probabilities; a piece of merge rank r
gets log probability -alpha * log(r + 2), a byte of a character outside the vocabulary -alpha * log(size).
No tokenizer is trained.

Decoding joins the pieces' bytes and takes off the blank put before the text: every sampled encoding gives
the text back, character for character, also for blanks in a row, line breaks and characters outside the
vocabulary.

Defined cases: null and empty texts give one empty segmentation (log_prob 0, inclusion 1); a text with fewer
than k segmentations gives all of them (inclusion 1; what has less than 1e-12 of a unit's probability is not told
from rounding and not sampled); rows with equal keys share their random numbers; a
null id is a key of its own; long texts are one lattice, whatever their length. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, quiet, release, small_batches, table

#: The public vocabulary file that the query uses; a parameter everywhere else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = re.compile(r" *[^ \n]+| +|\n")
#: Units whose lattices are kept from slice to slice, and how many of them (the most used) outlive an overflow.
CACHED_UNITS, KEPT_UNITS = 320_000, 180_000
SLICE_CHARS = 1_000_000
NONE = 65535
#: Steps that one uniform number is good for; a longer usual segmentation has no shortcut.
USUAL = 8
BELOW_ONE = 1 - 2**-24


class Vocabulary:
    """Pieces with a plain blank for the model's blank sign, their ids and log probabilities. Small: it is shipped to the workers."""

    def __init__(self, model: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        if n >= NONE:
            raise ValueError("vocabularies of up to 65,534 pieces")
        self.size, self.ids, self.surface, self.byte = n, {}, [b""] * n, [NONE] * 256
        logp = np.full(NONE + 1, -alpha * math.log(n))
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte[b], self.surface[i] = i, bytes([b])
                continue
            plain = piece.replace("▁", " ")
            if " " in plain.lstrip(" ") or "\n" in plain:
                raise ValueError("pieces with a blank after another character are not supported")
            self.ids[plain], self.surface[i] = i, plain.encode()
            logp[i] = -alpha * math.log(-sp.get_score(i) + 2)
        if NONE in self.byte:
            raise ValueError("the vocabulary needs byte pieces")
        self.logp, self.longest = logp, max(map(len, self.ids))
        self._table()

    def _table(self) -> None:
        """Hash tables of all beginnings of pieces: slot -> (hash, piece or NONE). What finds its slot taken goes to the next table."""
        begins = sorted({p[:j] for p in self.ids for j in range(1, len(p) + 1)})
        value = np.array([self.ids.get(b, NONE) for b in begins], dtype=np.uint16)
        key = np.zeros(len(begins), dtype=np.uint64)
        for j in range(self.longest):
            has = [i for i, b in enumerate(begins) if len(b) > j]
            key[has] = next_hash(key[has], np.array([ord(begins[i][j]) for i in has], dtype=np.uint32))
        self.tables, left = [], np.arange(len(begins))
        while len(left):
            slot = (key[left] >> np.uint64(46)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            keys, values = np.zeros(1 << 18, np.uint64), np.full(1 << 18, NONE, np.uint16)
            keys[slot[first]], values[slot[first]] = key[left[first]], value[left[first]]
            self.tables.append((keys, values))
            left = np.delete(left, first)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are beginnings of pieces, and the pieces they are (NONE where they are none)."""
        slot = (key >> np.uint64(46)).astype(np.int64)
        found, value = np.zeros(len(key), dtype=bool), np.full(len(key), NONE, np.uint16)
        for i, (keys, values) in enumerate(self.tables):
            if i:
                open_ = np.flatnonzero(~found)
                hit = open_[keys[slot[open_]] == key[open_]]
            else:
                hit = np.flatnonzero(keys[slot] == key)
            found[hit], value[hit] = True, values[slot[hit]]
        return found, value

    def decode(self, ids) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "surrogatepass")
        return text[1:] if text else text


def next_hash(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    with quiet():
        x = (key ^ (code.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ x >> np.uint64(29)


class Lattices:
    """Forward sums of units. A state is the end of a prefix; its edges, one for each last piece, are in order of piece
    length and have the cumulated probability, the piece and its length. Single precision: draws tell odds down to
    6e-8 apart; log probabilities are sums of scores in full precision."""

    #: What is known of a unit, of a state (where its edges begin) and of an edge.
    UNIT = {"base": np.int64, "length": np.int64, "total": np.float64, "only": bool, "low": np.float64, "high": np.float64, "usual_logp": np.float64, "usual_size": np.int8}

    def __init__(self, v: Vocabulary, cached: int | None = None):
        self.v, self.cached = v, cached
        self.of: dict[str, int] = {}
        self.names: list[str] = []
        self.exactly: dict[str, tuple] = {}
        self.fresh: dict[str, list[np.ndarray]] = {}
        for name, kind in self.UNIT.items():  # only: the unit has a single segmentation; low, high: its usual one's interval
            setattr(self, name, np.zeros(0, dtype=kind))
        self.uses = np.zeros(0, dtype=np.int64)
        self.usual_pieces, self.usual_lengths = np.zeros((0, USUAL), dtype=np.int32), np.zeros((0, USUAL), dtype=np.int8)
        self.edges = np.zeros(1, dtype=np.int64)  # one more than states
        self.cum, self.pid, self.size = np.zeros(0, np.float32), np.zeros(0, np.uint16), np.zeros(0, np.uint8)
        self.states = 0

    def shrink(self) -> None:
        """Keeps the most used units; counts of use are halved."""
        kept = KEPT_UNITS if self.cached is None else self.cached // 2
        keep = np.sort(np.argpartition(-self.uses, kept)[:kept])
        size, base = self.length[keep], self.base[keep]
        states = spread(base, size)
        count = self.edges[states + 1] - self.edges[states]
        own = spread(self.edges[base], self.edges[base + size] - self.edges[base])
        self.cum, self.pid, self.size = self.cum[own], self.pid[own], self.size[own]
        self.edges = np.concatenate(([0], np.cumsum(count)))
        self.states = len(states)
        names = self.names
        self.names = [names[i] for i in keep.tolist()]
        for name in (*self.UNIT, "usual_pieces", "usual_lengths"):
            setattr(self, name, getattr(self, name)[keep])
        self.base, self.uses = np.cumsum(size) - size, self.uses[keep] // 2
        self.of = {u: i for i, u in enumerate(self.names)}

    def add(self, units: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for length, own in by_length.items():
            step = max(1, 400_000 // (length * self.v.longest))
            for i in range(0, len(own), step):
                self._add(own[i : i + step], length)
        # What is known of the new units joins the arrays at once.
        for name, parts in self.fresh.items():
            setattr(self, name, np.concatenate((getattr(self, name), *parts)))
        self.fresh = {}
        self.uses = np.concatenate((self.uses, np.zeros(len(self.names) - len(self.uses), dtype=np.int64)))
        self.states = len(self.edges) - 1

    def _add(self, own: list[str], length: int) -> None:
        v, n = self.v, len(own)
        k = min(v.longest, length)
        pid = np.full((n, length, k), NONE, dtype=np.uint16)
        score = np.full((n, length, k), -np.inf)
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, length)
        row, begin = np.divmod(np.arange(n * length), length)
        key = np.zeros(n * length, dtype=np.uint64)
        flat = codes.ravel()
        for size in range(1, k + 1):  # beginnings of pieces grow by a character; others drop out
            key = next_hash(key, flat[row * length + begin + size - 1])
            found, value = v.find(key)
            own_piece = np.flatnonzero(value != NONE)
            end = begin[own_piece] + size - 1
            pid[row[own_piece], end, size - 1] = value[own_piece]
            score[row[own_piece], end, size - 1] = v.logp[value[own_piece]]
            go = found & (begin + size < length)
            row, begin, key = row[go], begin[go], key[go]
            if not len(row):
                break
        for j, e in np.argwhere(pid[:, :, 0] == NONE):  # characters outside the vocabulary are written as bytes
            raw = own[j][e].encode("utf-8", "surrogatepass")
            score[j, e, 0] = len(raw) * v.logp[NONE]
            pid[j, e, 0] = v.byte[raw[0]] if len(raw) == 1 else NONE
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        cum, likeliest = np.zeros((n, length, k)), np.zeros((n, length), dtype=np.int64)
        with quiet():
            for e in range(1, length + 1):
                w = min(k, e)
                x = score[:, e - 1, :w] + alpha[:, e - w : e][:, ::-1]
                best = x.argmax(1)
                likeliest[:, e - 1] = best
                top = x[np.arange(n), best]
                p = np.exp(x - top[:, None])
                c = np.cumsum(p, axis=1)
                alpha[:, e] = top + np.log(c[:, -1])
                cum[:, e - 1, :w] = c / c[:, -1:]
                cum[:, e - 1, w:] = 1
        cum = cum.astype(np.float32)
        real = np.isfinite(score)
        only = (real.sum(2) <= 1).all(1)
        self._usual(cum, likeliest, pid, score, alpha[:, length])
        at = np.flatnonzero(real.ravel())
        known = self.fresh["edges"][-1][-1] if "edges" in self.fresh else self.edges[-1]
        self._note(edges=known + np.cumsum(real.sum(2).ravel()), cum=cum.ravel()[at], pid=pid.ravel()[at], size=(at % k + 1).astype(np.uint8))
        self.of.update(zip(own, range(len(self.names), len(self.names) + n), strict=True))
        self.names += own
        self._note(base=self.states + np.arange(n) * length, length=np.full(n, length), total=alpha[:, length], only=only)
        self.states += n * length

    def _usual(self, cum: np.ndarray, likeliest: np.ndarray, pid: np.ndarray, score: np.ndarray, total: np.ndarray) -> None:
        """Follows the likeliest last piece from state to state, and the interval of numbers that do so."""
        n, length, k = pid.shape
        low, high, logp = np.zeros(n), np.ones(n), -total
        size, pieces, lengths = np.zeros(n, np.int8), np.zeros((n, USUAL), np.int32), np.zeros((n, USUAL), np.int8)
        end, live = np.full(n, length), np.arange(n)
        for step in range(USUAL):
            at = end[live] - 1
            j = likeliest[live, at]
            top = cum[live, at, j].astype(np.float64)
            bottom = np.where(j > 0, cum[live, at, np.maximum(j - 1, 0)], np.float32(0)).astype(np.float64)
            width = high[live] - low[live]
            low[live], high[live] = low[live] + width * bottom, low[live] + width * top
            piece = pid[live, at, j].astype(np.int32)
            pieces[live, step] = np.where(piece == NONE, -end[live], piece)
            lengths[live, step] = j + 1
            logp[live] += score[live, at, j]
            size[live] += 1
            end[live] -= j + 1
            live = live[end[live] > 0]
            if not len(live):
                break
        # In order of the text, not as they were found.
        turn = np.clip(size[:, None].astype(np.int64) - 1 - np.arange(USUAL), 0, None)
        pieces, lengths = np.take_along_axis(pieces, turn, axis=1), np.take_along_axis(lengths, turn, axis=1)
        high[live] = low[live]  # longer than USUAL steps: no shortcut
        self._note(low=low, high=high, usual_logp=logp, usual_size=size, usual_pieces=pieces, usual_lengths=lengths)

    def _note(self, **columns: np.ndarray) -> None:
        for name, x in columns.items():
            self.fresh.setdefault(name, []).append(x)

    def exact(self, unit: int) -> tuple[list[list[tuple[int, float]]], list[float]]:
        """For each end of a prefix the (length, log probability) of its last pieces, and all forward sums, in full precision."""
        name = self.names[unit]
        if (known := self.exactly.get(name)) is not None:
            return known
        v, alpha, last = self.v, [0.0], []
        for e in range(1, len(name) + 1):
            some = []
            for n in range(1, min(e, v.longest) + 1):
                if (i := v.ids.get(name[e - n : e])) is not None:
                    some.append((n, float(v.logp[i])))
                elif n == 1:
                    some.append((1, len(name[e - 1].encode("utf-8", "surrogatepass")) * float(v.logp[NONE])))
            x = [alpha[e - n] + p for n, p in some]
            top = max(x)
            alpha.append(top + math.log(sum(math.exp(y - top) for y in x)))
            last.append(some)
        if len(self.exactly) > 4_000:
            self.exactly.clear()
        self.exactly[name] = last, alpha
        return last, alpha

    def another(self, unit: int, without: list[tuple], draw) -> tuple:
        """Piece lengths, last first, of a segmentation drawn from those not in `without`; draw(step) is uniform."""
        last, alpha = self.exact(unit)
        end, out, step = len(self.names[unit]), (), 0
        left = [(w, math.exp(self.log_prob(unit, w))) for w in without]
        log_mass = 0.0  # of the suffix chosen so far
        while end:
            odds = []
            for n, p in last[end - 1]:
                mass = math.exp(log_mass + alpha[end - n] + p - alpha[end]) - sum(m for w, m in left if w[step] == n)
                odds.append((n, p, mass if mass > 1e-15 or not any(w[step] == n for w, _ in left) else 0.0))
            at = draw(step) * sum(x for _, _, x in odds)
            for n, p, x in odds:
                if x > 0:
                    pick = n, p
                    if at < x:
                        break
                    at -= x
            n, p = pick
            log_mass += alpha[end - n] + p - alpha[end]
            left = [(w, m) for w, m in left if w[step] == n]
            out += (n,)
            end -= n
            step += 1
        return out

    def pieces(self, unit: int, lengths: tuple) -> list[int]:
        name, end, out = self.names[unit], len(self.names[unit]), []
        for n in lengths:
            i = self.v.ids.get(name[end - n : end])
            if i is None:  # a character outside the vocabulary: its byte, or its place if it has several
                raw = name[end - 1].encode("utf-8", "surrogatepass")
                i = self.v.byte[raw[0]] if len(raw) == 1 else -end
            out.append(i)
            end -= n
        return out[::-1]

    def log_prob(self, unit: int, lengths: tuple) -> float:
        if self.only[unit]:
            return 0.0
        name, end, out = self.names[unit], len(self.names[unit]), -float(self.total[unit])
        for n in lengths:
            i = self.v.ids.get(name[end - n : end])
            out += float(self.v.logp[i]) if i is not None else len(name[end - 1].encode("utf-8", "surrogatepass")) * float(self.v.logp[NONE])
            end -= n
        return min(out, 0.0)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then those of start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def uniform(keys: np.ndarray, sample: int, unit: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), a hash of all four."""
    with quiet():
        x = mix(keys + np.uint64(sample + 1) * np.uint64(0x9E3779B97F4A7C15) + unit.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((step + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def uniform_one(key: int, sample: int, unit: int, step: int) -> float:
    """uniform() for a single key."""
    m = (1 << 64) - 1
    x = (key + (sample + 1) * 0x9E3779B97F4A7C15 + unit * 0xD6E8FEB86659FD93 + (step + 1) * 0xA0761D6478BD642F) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return ((x ^ x >> 31) >> 12) / float(1 << 52) + 0.5 / float(1 << 52)


GUMBEL_STEP, ROOT_STEP = 1 << 20, 1 << 21


class Batch:
    """Texts of a slice as one long list of units, with the samples drawn so far."""

    def __init__(self, lattices: Lattices, texts: list[str], keys: np.ndarray):
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        if len(lattices.names) > (CACHED_UNITS if lattices.cached is None else lattices.cached):
            lattices.shrink()
        every = list(itertools.chain.from_iterable(units))
        unit = np.fromiter(map(lattices.of.get, every, itertools.repeat(-1)), dtype=np.int64, count=len(every))
        strange = np.flatnonzero(unit < 0).tolist()
        if strange:
            lattices.add(sorted({every[i] for i in strange}))
            of = lattices.of
            unit[strange] = [of[every[i]] for i in strange]
        lattices.uses += np.bincount(unit, minlength=len(lattices.names))
        self.lattices, self.keys = lattices, keys
        self.n = np.array([len(u) for u in units], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.unit = unit
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.place = np.arange(len(self.unit)) - self.first[self.doc] if len(self.unit) else np.empty(0, np.int64)
        self.base, self.length, self.total, self.only = lattices.base, lattices.length, lattices.total, lattices.only

    def draw(self, at: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segmentations of the units at `at`: (pieces in order, index into `at` of each, piece lengths, log probability of each unit)."""
        L = self.lattices
        cum, pid, edges, score = L.cum, L.pid, L.edges, L.v.logp
        unit = self.unit[at]
        number = uniform(self.keys[self.doc[at]], sample, self.place[at], 0)
        usual = (number >= L.low[unit]) & (number < L.high[unit])
        logp = np.where(usual, L.usual_logp[unit], -self.total[unit])
        count = np.where(usual, L.usual_size[unit], 0).astype(np.int64)
        live = np.flatnonzero(~usual)
        base, end, u = self.base[unit], self.length[unit], number[live]
        steps, step = [], 0
        while len(live):
            last = end[live]
            first = edges[base[live] + last - 1]
            edge, small = first.copy(), np.minimum(u, BELOW_ONE).astype(np.float32)
            ahead = np.flatnonzero(cum[edge] <= small)
            while len(ahead):
                edge[ahead] += 1
                ahead = ahead[cum[edge[ahead]] <= small[ahead]]
            piece, size = pid[edge].astype(np.int32), L.size[edge].astype(np.int64)
            gain = score[piece]
            strange = np.flatnonzero(piece == NONE)
            if len(strange):  # characters written as several bytes
                gain[strange] *= [len(L.names[n][e - 1].encode("utf-8", "surrogatepass")) for n, e in zip(unit[live[strange]], last[strange], strict=True)]
                piece[strange] = -last[strange]
            steps.append((live, piece, size.astype(np.int32)))
            left = last - size
            logp[live] += gain
            count[live] += 1
            end[live] = left
            on = left > 0
            live, step = live[on], step + 1
            if len(live):
                if step < USUAL:  # what is left of the number within the chosen piece's share
                    here = np.flatnonzero(on)
                    own = edge[here]
                    top = cum[own].astype(np.float64)
                    bottom = np.where(own > first[here], cum[np.maximum(own - 1, 0)], 0.0).astype(np.float64)
                    u = np.clip((u[here] - bottom) / np.maximum(top - bottom, 1e-30), 0.0, BELOW_ONE)
                else:
                    u = uniform(self.keys[self.doc[at[live]]], sample, self.place[at[live]], step)
        logp = np.where(self.only[unit], 0.0, np.minimum(logp, 0.0))
        last = np.cumsum(count)
        pieces, lengths = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int32)
        ready = np.flatnonzero(usual)
        which, own = unit[ready], count[ready]
        real = np.arange(USUAL) < own[:, None]
        to = spread(last[ready] - own, own)
        pieces[to], lengths[to] = L.usual_pieces[which][real], L.usual_lengths[which][real]
        for s, (own, piece, size) in enumerate(steps):
            pieces[last[own] - 1 - s] = piece
            lengths[last[own] - 1 - s] = size
        return pieces, count, lengths, logp


def _truncated(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel maxima at log_mass below bound."""
    with quiet():
        return np.where(np.isfinite(log_mass), -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass), -np.inf)


def _log_rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - exp(logp)); -inf where nothing but rounding is left."""
    with quiet():
        rest = -np.expm1(np.minimum(logp, 0.0))
        return np.where(rest > 1e-12, np.log(np.maximum(rest, 1e-300)), -np.inf)


def sample(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple]]:
    """For each text up to k tuples (ids, log_prob, gumbel, inclusion), best perturbed first."""
    out: list[list] = [[] for _ in texts]
    for live, flat, at, log_prob, gumbel, inclusion in sample_flat(lattices, texts, keys, k):
        for n, d in enumerate(live):
            out[d].append((flat[at[n] : at[n + 1]], float(log_prob[n]), float(gumbel[n]), float(inclusion[n])))
    return out


def sample_flat(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[tuple]:
    """For each rank: the texts that have it, their ids one after the other and where each begins, log_prob, gumbel, inclusion."""
    b = Batch(lattices, texts, keys)
    docs = len(texts)
    gumbel = -np.log(-np.log(uniform(keys, 0, np.zeros(docs), ROOT_STEP)))
    samples = []  # of each: pieces, counts, lengths, starts, log probabilities, prefix sums, and the nodes' maxima
    live = np.ones(docs, dtype=bool)
    branch = np.zeros(docs, dtype=np.int64)  # the unit at which a sample left its parent
    parent = np.zeros(docs, dtype=np.int64)
    avoided: list[dict[int, list]] = []
    at_branch: dict[int, tuple] = {}
    for r in range(k + 1):
        # What is drawn anew: all units behind the branch (from the first unit on for the first sample).
        if r == k:
            break
        fresh = live[b.doc] & ((b.place > branch[b.doc]) if r else np.ones(len(b.unit), dtype=bool)) if len(b.unit) else np.empty(0, dtype=bool)
        drawn = np.flatnonzero(fresh)
        pieces, count, lengths, logp = b.draw(drawn, r)
        last = np.cumsum(count)
        own_logp = np.zeros(len(b.unit))
        own_logp[drawn] = logp
        where = np.full(len(b.unit), r, dtype=np.int8)  # the sample whose arrays hold a unit
        start, size = np.zeros(len(b.unit), np.int64), np.zeros(len(b.unit), np.int64)
        start[drawn], size[drawn] = last - count, count
        special: dict[int, tuple] = {}
        if r:
            for j in range(r):
                took = live & (parent == j)
                before = took[b.doc] & (b.place < branch[b.doc])
                s = samples[j]
                where[before], start[before], size[before], own_logp[before] = s["where"][before], s["start"][before], s["size"][before], s["logp"][before]
            for d in np.flatnonzero(live):
                t = int(b.first[d] + branch[d])
                lengths_, without = at_branch[int(d)]
                special[t] = lengths_
                own_logp[t] = lattices.log_prob(int(b.unit[t]), lengths_)
                size[t], where[t] = len(lengths_), -1
                # A prefix taken over from a sample that itself branched there keeps that branch's segmentation.
            for j in range(r):
                special |= {t: x for t, x in samples[j]["special"].items() if where[t] == -1 and t not in special and live[b.doc[t]] and parent[b.doc[t]] == j}
        prefix = np.cumsum(own_logp) - own_logp
        prefix = prefix - (prefix[b.first[:-1][b.doc]] if len(b.unit) else 0)
        rest = _log_rest(own_logp)
        extra: dict[int, list] = {}
        if r:
            for d in np.flatnonzero(live):
                t = int(b.first[d] + branch[d])
                without = [*at_branch[int(d)][1], at_branch[int(d)][0]]
                extra[t] = without
                gone = sum(math.exp(lattices.log_prob(int(b.unit[t]), w)) for w in without)
                rest[t] = math.log(1 - gone) if 1 - gone > 1e-12 else -np.inf
        nodes = _truncated(prefix + rest, gumbel[b.doc], uniform(keys[b.doc], r, b.place, GUMBEL_STEP)) if len(b.unit) else np.empty(0)
        if r and len(b.unit):
            nodes[(b.place < branch[b.doc]) | ~live[b.doc]] = -np.inf
        total = np.zeros(docs)
        np.add.at(total, b.doc, own_logp)
        samples.append({"pieces": pieces, "lengths": lengths, "where": where, "start": start, "size": size, "logp": own_logp, "nodes": nodes, "special": special, "live": live.copy(), "gumbel": gumbel.copy(), "total": total})
        avoided.append(extra)
        # The best node of each text over all samples.
        best, branch, parent = np.full(docs, -np.inf), np.zeros(docs, dtype=np.int64), np.zeros(docs, dtype=np.int64)
        for j, s in enumerate(samples):
            if not len(b.unit):
                break
            top = np.full(docs, -np.inf)
            full = np.flatnonzero(b.n)
            top[full] = np.maximum.reduceat(s["nodes"], b.first[:-1][full])
            better = top > best
            hit = np.flatnonzero((s["nodes"] == top[b.doc]) & better[b.doc])[::-1]
            best[better], parent[better] = top[better], j
            branch[b.doc[hit]] = b.place[hit]
        live = np.isfinite(best)
        gumbel = best
        at_branch = {}
        if r < k - 1:
            for d in np.flatnonzero(live):
                j, t = int(parent[d]), int(b.first[d] + branch[d])
                s = samples[j]
                s["nodes"][t] = -np.inf
                without = avoided[j].get(t) or [_lengths(samples, s, t)]
                key, place = int(b.keys[d]), int(branch[d])
                at_branch[int(d)] = (lattices.another(int(b.unit[t]), without, lambda step, key=key, place=place, r=r: uniform_one(key, r + 1, place, step)), without)
    threshold, out = gumbel, []
    for s in samples:
        flat, ends = _flatten(b, samples, s)
        with quiet():
            inclusion = np.where(np.isfinite(threshold), -np.expm1(-np.exp(s["total"] - threshold)), 1.0)
        own = np.flatnonzero(s["live"])  # the units of other texts have no pieces here
        out.append((own, flat, np.append(ends[b.first[own]], len(flat)), s["total"][own], s["gumbel"][own], inclusion[own]))
    return out


def _lengths(samples: list[dict], s: dict, t: int) -> tuple:
    """Piece lengths, last first, of unit t in a sample."""
    w = int(s["where"][t])
    if w == -1:
        return s["special"][t]
    a, n = int(s["start"][t]), int(s["size"][t])
    return tuple(samples[w]["lengths"][a : a + n][::-1].tolist())


def _flatten(b: Batch, samples: list[dict], s: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sample's units in order, and where each unit begins in them."""
    if not len(b.unit):
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    size = s["size"]
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = np.zeros(int(ends[-1]), np.int32)
    for w in range(len(samples)):
        mine = np.flatnonzero((s["where"] == w) & (size > 0))
        if len(mine) == len(size) and len(samples[w]["pieces"]) == len(flat):
            flat[:] = samples[w]["pieces"]  # drawn as a whole
        elif len(mine):
            n = size[mine]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(ends[mine], n) + step] = samples[w]["pieces"][np.repeat(s["start"][mine], n) + step]
    for t, lengths in s["special"].items():
        if s["where"][t] == -1:
            flat[ends[t] : ends[t] + size[t]] = b.lattices.pieces(int(b.unit[t]), lengths)
    strange = np.flatnonzero(flat < 0)
    if len(strange):  # characters written as several bytes
        byte, names = b.lattices.v.byte, b.lattices.names
        owner = np.searchsorted(ends, strange, side="right") - 1
        more = [[byte[x] for x in names[b.unit[t]][-int(flat[i]) - 1].encode("utf-8", "surrogatepass")] for i, t in zip(strange, owner, strict=True)]
        grow = np.ones(len(flat), np.int64)
        grow[strange] = [len(m) for m in more]
        to = np.concatenate(([0], np.cumsum(grow)))
        longer = np.repeat(flat, grow)
        for i, m in zip(strange, more, strict=True):
            longer[to[i] : to[i] + len(m)] = m
        flat, ends = longer, to[ends]
    return flat, ends


def row_key(column: str):
    return F.xxhash64(F.lit("row"), F.coalesce(F.col(column).cast("string"), F.lit("\u0000null")))


def encode(docs: DataFrame, model: str = MODEL, k: int = 2, alpha: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", cached: int | None = None) -> DataFrame:
    """id, rank (from 1), ids, n_pieces, log_prob, gumbel, inclusion: up to k distinct segmentations of each row's text. cached: units whose
    lattices a worker keeps (CACHED_UNITS if none is given), which decides its memory and time but no result."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    shared = spark.sparkContext.broadcast(Vocabulary(model, alpha))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value, cached)
        salt = np.uint64((seed * 0x2545F4914F6CDD1D + 1) & (1 << 64) - 1)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            with quiet():
                keys = mix(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ salt)
            a = 0
            while a < len(texts):
                e, chars = a, 0
                while e < len(texts) and (e == a or chars + len(texts[e]) <= SLICE_CHARS):
                    chars += len(texts[e])
                    e += 1
                for rank, (live, flat, at, log_prob, gumbel, inclusion) in enumerate(sample_flat(lattices, texts[a:e], keys[a:e], k), 1):
                    ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                    columns = [batch.column("id").take(pa.array(live + a)), pa.array(np.full(len(live), rank), pa.int32()), ids, pa.array(np.diff(at), pa.int32()), pa.array(log_prob), pa.array(gumbel), pa.array(inclusion)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "rank", "ids", "n_pieces", "log_prob", "gumbel", "inclusion"])
                a = e
        del lattices
        release()

    own = docs.select(F.col(id_col).alias("id"), row_key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = own.mapInArrow(run, f"id {kind}, rank int, ids array<int>, n_pieces int, log_prob double, gumbel double, inclusion double")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """encoded with the text that its ids stand for."""
    from pyspark.sql.types import StringType

    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(ids: pd.Series) -> pd.Series:
        v = shared.value
        return pd.Series([None if x is None else v.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(run, StringType())(F.col(ids_col)))


def op7(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
