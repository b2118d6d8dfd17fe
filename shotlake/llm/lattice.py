"""SentencePiece encoding and decoding: distinct sampled segmentations by perturbed A-star search (Gumbel top-k).

The pieces that spell a text form a lattice; a segmentation has the product of its pieces' weights, normalised. The
k segmentations of largest log-probability plus Gumbel noise are a sample of k without replacement. They are found top
down: a set of segmentations that share a beginning carries the largest perturbed value in it, the set of largest value is
opened, and what does not get the value gets a smaller one by the truncated Gumbel law, so segmentations come out in order and
none twice.

No piece spans two neighbouring characters that are neighbours in no piece, so a text's lattice is a row of small ones
("atoms"), and opening a set means choosing a segmentation of the next atom. The likeliest segmentations of an atom are held
in tables, the rest of its mass is drawn from a longer list and beyond that from the lattice itself, so no segmentation is left out.

Decoding joins the pieces; bytes stand for characters without a piece, so it gives back every text exactly.
"""

from __future__ import annotations

import gc
import math
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, compress, islice, pairwise, repeat
from operator import itemgetter
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm.common import row_key, worker_cache
from shotlake.llm.tokens import tokenizer_file

UNIT = re.compile(r" +[^ ]*")
SHORT, LONG, MOST_LISTED, MOST_WORDS, MOST_LATTICES, PLAIN, AT_ONCE, BULK = 4, 64, 1 << 15, 120_000, 1_000, 60, 200, 8_000
FIRST = itemgetter(0)
POWER, OFFSET, SAMPLES = 1.5, 10.0, 2
SCALE = 5.0


STEP = np.uint64(0x9E3779B97F4A7C15)


def spelled_hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = (h + codes[:, k] + np.uint64(1)) * STEP
    return h


def in_a_row(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of `sizes` from `starts` on, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """The pieces of a SentencePiece model with log-weights -POWER * log(rank + OFFSET); pieces without a rank, and
    bytes, count as the rarest."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(file))
        n = model.get_piece_size()
        self.weight, self.spelled, self.ids, self.bytes = np.zeros(n), [b""] * n, {}, {}
        for i in range(n):
            piece, rank = model.id_to_piece(i), -model.get_score(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.spelled[i], rank = bytes([int(piece[3:-1], 16)]), n
            else:
                text = piece.replace("▁", " ")
                self.ids[text], self.spelled[i] = i, text.encode()
            self.weight[i] = -POWER * math.log(min(rank, n) + OFFSET)
        self.weights = self.weight.tolist()
        pairs = sorted({p[i:i + 2] for p in self.ids for i in range(len(p) - 1)})
        self.pairs = np.array([ord(a) << 21 | ord(b) for a, b in pairs], np.int64)
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.sizes = np.array(list(map(len, self.spelled)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        # every beginning of a piece; with the ids and the weight, scaled by its length, where it is one
        self.table: dict[str, tuple | None] = {p[:i]: None for p in self.ids for i in range(1, len(p))}
        self.table |= {p: ((i,), math.exp(self.weight[i] + SCALE * len(p))) for p, i in self.ids.items()}
        self.single = {p for p in self.ids if len(p) == 1}
        # for each length the hashes of beginnings, in order, and the piece that each is, -1 if none
        self.by_length = []
        for k in range(1, max(map(len, self.ids)) + 1):
            begins = [p for p in self.table if len(p) == k]
            h = spelled_hash(np.array([[ord(c) for c in p] for p in begins], np.uint64).reshape(len(begins), k))
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([self.ids.get(p, -1) for p in begins])[order]))

    def in_bytes(self, char: str) -> tuple[tuple[int, ...], float]:
        spelled = tuple(self.bytes[x] for x in char.encode())
        return spelled, math.exp(float(self.weight[list(spelled)].sum()) + SCALE)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.flat[in_a_row(self.starts[ids], self.sizes[ids])].tobytes().decode()[1:]


class Atom:
    """The lattice of one stretch that no piece leaves.

    edges[b] holds the pieces that end at b as (start, ids, weight of all ways to and over it); ways[b] sums them.
    Weights are scaled by e**(SCALE * length), and again wherever they would leave the range of doubles.
    """

    def __init__(self, pieces: Pieces, text: str):
        n, table = len(text), pieces.table
        edges: list[list] = [[] for _ in range(n + 1)]
        ways, shift = [1.0] + [0.0] * n, 0.0
        for a in range(n):
            way = ways[a]
            if not 1e-200 < way < 1e200:  # long stretches only
                shift += math.log(way)
                for b in range(a, n + 1):
                    ways[b] /= way
                    edges[b] = [(c, ids, w / way) for c, ids, w in edges[b]]
                way = 1.0
            b = a + 1
            while b <= n:
                piece = text[a:b]
                got = table.get(piece, 0)
                if got == 0:
                    break
                if got is not None:
                    w = way * got[1]
                    ways[b] += w
                    edges[b].append((a, got[0], w))
                b += 1
            if table.get(text[a]) is None:  # a character has its bytes only if it is no piece
                ids, w = pieces.in_bytes(text[a])
                ways[a + 1] += way * w
                edges[a + 1].append((a, ids, way * w))
        self.edges, self.ways, self.weight, self.lists, self.found = edges, ways, pieces.weights, {}, None
        self.log_total = math.log(ways[n]) + shift - SCALE * n

    def log_p(self, path: tuple[int, ...]) -> float:
        weight = self.weight
        return min(sum([weight[i] for i in path]) - self.log_total, 0.0)

    def best(self, k: int) -> tuple[list[tuple[float, tuple[int, ...]]], bool]:
        """The `k` likeliest segmentations (log-probability, ids), and whether these are all."""
        held, whole, weight = [[(0.0, 0, 0, ())]], True, self.weight  # log-weight, where from, which there, the piece
        for b in range(1, len(self.edges)):
            now = []
            for a, ids, _ in self.edges[b]:
                w = weight[ids[0]] if len(ids) == 1 else sum([weight[i] for i in ids])
                now += [(x[0] + w, a, r, ids) for r, x in enumerate(held[a])]
            if len(now) > 1:
                now.sort(key=FIRST, reverse=True)
            whole = whole and len(now) <= k
            held.append(now[:k])
        out = []
        for _, b, r, ids in held[-1]:
            parts = [ids]
            while b:
                _, b, r, ids = held[b][r]
                parts.append(ids)
            path = tuple(i for ids in reversed(parts) for i in ids)
            out.append((self.log_p(path), path))
        return out, whole

    def draw(self, random) -> tuple[float, tuple[int, ...]]:
        """One segmentation by its probability, from the end to the start."""
        b, out, edges, ways = len(self.ways) - 1, [], self.edges, self.ways
        while b:
            here = edges[b]
            if len(here) > 1:
                u = random() * ways[b]
                for a, ids, w in here:
                    u -= w
                    if u <= 0:
                        break
            else:
                a, ids, _ = here[0]
            out.append(ids)
            b = a
        path = tuple([i for ids in reversed(out) for i in ids])
        return self.log_p(path), path

    def _next(self, b: int) -> bool:
        """List one more of the likeliest ways to `b`, if there is one; only as many ways to earlier places as that takes."""
        held, heap, edges, weight = self.held, self.heaps[b], self.edges[b], self.weight
        if not b:
            return False
        if held[b]:  # the way after the last one over the same edge
            e, r = self.last[b]
            a, ids, _ = edges[e]
            if len(held[a]) > r + 1 or self._next(a):
                w = weight[ids[0]] if len(ids) == 1 else sum([weight[i] for i in ids])
                heappush(heap, (-(held[a][r + 1][0] + w), e, r + 1))
        if not heap:
            return False
        x, e, r = heappop(heap)
        a, ids, _ = edges[e]
        held[b].append((-x, a, r, ids))
        self.last[b] = e, r
        return True

    def in_order(self) -> Iterator[tuple[float, tuple[int, ...]]]:
        """The segmentations as `best` lists them, each found when it is asked for."""
        if self.found is None:
            edges, weight = self.edges, self.weight
            self.found, self.last = [], [(0, 0)] * len(edges)
            self.held = [[(0.0, 0, 0, ())]] + [[] for _ in edges[1:]]
            self.heaps: list[list] = [[]]
            for b in range(1, len(edges)):
                heap = [(-(self.held[a][0][0] + (weight[ids[0]] if len(ids) == 1 else sum([weight[i] for i in ids]))), e, 0)
                        for e, (a, ids, _) in enumerate(edges[b])]
                heapify(heap)
                self.heaps.append(heap)
                self._next(b)
        yield from self.found
        n, held = len(self.found), self.held
        while n < len(held[-1]) or self._next(len(held) - 1):
            _, b, r, ids = held[-1][n]
            parts = [ids]
            while b:
                _, b, r, ids = held[b][r]
                parts.append(ids)
            path = tuple([i for ids in reversed(parts) for i in ids])
            got = self.log_p(path), path
            n += 1
            if n > len(self.found):
                self.found.append(got)
            yield got

    def likeliest(self, k: int) -> tuple[list[tuple[float, tuple[int, ...]]], bool]:
        if k not in self.lists:
            if k > LONG or len(self.edges) > PLAIN:
                self.lists[k] = self.best(k)
            else:
                some = list(islice(self.in_order(), k + 1))
                self.lists[k] = some[:k], len(some) <= k
        return self.lists[k]

    def draw_other(self, random, without: set[tuple[int, ...]], mass: float) -> tuple[float, tuple[int, ...]]:
        """One segmentation that is not in `without`; all others have `mass`. Draws are repeated while that is likely to
        end soon; else it is looked up among the likeliest, of which more are listed until it is there."""
        k, u = LONG, random() * mass
        if mass <= 0.05 and len(self.edges) <= PLAIN:  # mostly it is one of the first
            rest = u
            for x, path in islice(self.in_order(), k):
                if path not in without:
                    rest -= math.exp(x)
                    if rest <= 0:
                        return x, path
        while mass <= 0.05 and k <= MOST_LISTED:
            paths, whole = self.likeliest(k)
            left = [p for p in paths if p[1] not in without]
            for x, path in left:
                u -= math.exp(x)
                if u <= 0:
                    return x, path
            if whole:
                return left[-1]
            k, u = 8 * k, u + sum(math.exp(x) for x, _ in left)
        while True:
            got = self.draw(random)
            if got[1] not in without:
                return got

    def left(self, without: set[tuple[int, ...]]) -> float:
        """The probability of all segmentations outside `without`."""
        mass = 1 - sum(math.exp(self.log_p(p)) for p in without)
        if mass > 1e-4:
            return mass
        paths, whole = self.likeliest(LONG)
        listed = sum(math.exp(x) for x, p in paths if p not in without)
        return listed if whole else max(mass, listed)


def bulk_best(pieces: Pieces, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `k` likeliest segmentations of many short texts at once, as of Atom.best; each character is a piece.

    (text, log-probability, ids of all in a row, how many ids each has, whether a text has no more), likeliest first.
    """
    sizes = np.array(list(map(len, texts)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    text_of, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    ends = (first + sizes)[text_of]
    # edges: pieces by start and end; node i + text is the place before character i, the one after a text comes last
    live, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    n_nodes = len(codes) + len(texts)
    ending = np.full((n_nodes, len(pieces.by_length) + 1), -1, np.int32)  # the piece of each size that ends at a node
    for size, (known, ids) in enumerate(pieces.by_length, 1):
        live_ok = live + size <= ends[live]
        live, h = live[live_ok], h[live_ok]
        if not len(live):
            break
        with np.errstate(over="ignore"):
            h = (h + codes[live + size - 1] + np.uint64(1)) * STEP
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        live, h, at = live[hit], h[hit], ids[at[hit]]
        piece = at >= 0
        ending[live[piece] + text_of[live[piece]] + size, size] = at[piece]
    to, size = np.nonzero(ending >= 0)
    place = np.arange(n_nodes) - np.repeat(first + np.arange(len(texts)), sizes + 1)  # of a node in its text
    depth = place[to].astype(np.uint16)
    order = np.argsort(depth, kind="stable")
    to, size, depth = to[order], size[order], depth[order]
    node, piece = to - size, ending[to, size]
    log_w = pieces.weight[piece]
    start_node = first + np.arange(len(texts))
    end_node = start_node + sizes
    total, count = np.full(n_nodes, -np.inf), np.zeros(n_nodes)
    score = np.full((n_nodes, k), -np.inf)
    from_edge, from_rank = np.zeros((n_nodes, k), np.int32), np.zeros((n_nodes, k), np.int8)
    total[start_node], count[start_node], score[start_node, 0] = 0.0, 1.0, 0.0
    edge_of_depth = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
    for a, b in zip(edge_of_depth, edge_of_depth[1:]):
        if a == b:
            continue
        source, target = node[a:b], to[a:b]
        group = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1])
        out = total[source] + log_w[a:b]
        top = np.maximum.reduceat(out, group)
        share = np.exp(out - np.repeat(top, np.diff(np.concatenate([group, [b - a]]))))
        total[target[group]] = top + np.log(np.add.reduceat(share, group))
        count[target[group]] = np.add.reduceat(count[source], group)
        # the best way left is picked k times for each target, the next best over its edge takes its place
        w, heads, group_of = log_w[a:b], target[group], np.repeat(np.arange(len(group)), np.diff(np.append(group, b - a)))
        now, used = score[source, 0] + w, np.zeros(b - a, np.int8)
        for r in range(k):
            best = np.maximum.reduceat(now, group)
            pick = np.flatnonzero(now == np.where(best > -np.inf, best, np.nan)[group_of])
            if not len(pick):
                break
            which = group_of[pick]
            one = np.append(True, which[1:] != which[:-1])
            pick, which = pick[one], heads[which[one]]
            score[which, r], from_edge[which, r], from_rank[which, r] = now[pick], a + pick, used[pick]
            used[pick] += 1
            more = used[pick] < k
            now[pick] = np.where(more, score[source[pick], used[pick] * more], -np.inf) + w[pick]
    text, rank = np.nonzero(np.isfinite(score[end_node]))
    log_p = np.minimum(score[end_node[text], rank] - total[end_node[text]], 0.0)
    # back from the ends, all paths together
    now, r, steps = end_node[text].copy(), rank.copy(), []
    while True:
        moving = now != start_node[text]
        if not moving.any():
            break
        e = from_edge[now, r]
        steps.append(np.where(moving, piece[e], -1))
        r = np.where(moving, from_rank[now, r], r)
        now = np.where(moving, node[e], now)
    paths = np.array(steps).reshape(len(steps), len(text)).T[:, ::-1]
    real = paths >= 0
    return text, log_p, paths[real], real.sum(axis=1), count[end_node] <= k


def split(text: str) -> list[str]:
    """A text in words, each with the space before it."""
    return UNIT.findall(" " + text)


# a first choice for each atom; for each choice its probability with those before it, logs of its own and of 1 less it, and its ids
TABLES = {"first": np.int64, "up_to": float, "log_p": float, "log_rest": float, "start": np.int32, "length": np.int32, "ids": np.int32}
# for each word its atoms, in a row, and whether it came again
WORDS = {"begin": np.int32, "width": np.int32, "again": bool, "row": np.int32}


class Sampler:
    """Tables of atoms, one after the other; `up_to` is the probability of an atom's choices up to and with each."""

    def __init__(self, file: str):
        self.pieces, self.most = Pieces(file), None
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.atoms: dict[int, Atom] = {}
        self.n, self.n_ids, self.n_row = 0, 0, 0
        for name, kind in (TABLES | WORDS).items():
            setattr(self, name, np.zeros(1 << 14, kind))

    def forget(self) -> None:
        """Leave only words that came again since the last time, and the tables of their atoms."""
        again = self.again[:len(self.units)]
        if 2 * int(again.sum()) > self.limit():
            again[:] = False
        kept, sizes = list(compress(self.units, again.tolist())), self.width[:len(again)][again]
        row = self.row[in_a_row(self.begin[:len(again)][again], sizes)]
        atoms, row = np.unique(row, return_inverse=True)
        texts, held = [self.texts[i] for i in atoms.tolist()], {name: getattr(self, name) for name in TABLES}
        ends = np.append(self.first[:len(self.texts)], self.n)
        width = np.diff(ends)[atoms]
        at = in_a_row(ends[atoms], width)
        listed = np.maximum(held["length"][at], 0)
        ids = held["ids"][in_a_row(held["start"][at], listed)]
        self.clear()
        self._room(len(atoms), len(at), len(ids))
        self._words(kept, row.astype(np.int32), sizes)
        self.texts, self.known, self.n, self.n_ids = texts, dict(zip(texts, range(len(texts)))), len(at), len(ids)
        self.first[:len(atoms)], self.ids[:len(ids)] = np.cumsum(width) - width, ids
        for name in ("up_to", "log_p", "log_rest", "length"):
            getattr(self, name)[:len(at)] = held[name][at]
        self.start[:len(at)] = np.cumsum(listed) - listed

    def limit(self) -> int:
        return self.most or MOST_WORDS

    def _words(self, words: list[str], row: np.ndarray, sizes: np.ndarray) -> None:
        """New words, with the atoms of all in a row and how many each has."""
        n, m = len(self.units), len(words)
        self._room(0, 0, 0, m, len(row))
        self.begin[n:n + m] = self.n_row + np.cumsum(sizes) - sizes
        self.width[n:n + m], self.again[n:n + m] = sizes, False
        self.row[self.n_row:self.n_row + len(row)] = row
        self.n_row += len(row)
        self.units.update(zip(words, range(n, n + m)))

    def _room(self, atoms: int, choices: int, ids: int, words: int = 0, parts: int = 0) -> None:
        for most, names in ((len(self.texts) + atoms, ("first",)), (self.n_ids + ids, ("ids",)), (self.n_row + parts, ("row",)),
                            (len(self.units) + words, ("begin", "width", "again")), (self.n + choices, ("up_to", "log_p", "log_rest", "start", "length"))):
            for name in names:
                held = getattr(self, name)
                if most > len(held):
                    wider = np.zeros(max(most, len(held) * 3 // 2), held.dtype)
                    wider[:len(held)] = held
                    setattr(self, name, wider)

    def _add(self, texts: list[str], text: np.ndarray, log_p: np.ndarray, ids: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> None:
        """Tables for new atoms: their listed segmentations, and a last choice for the rest where there is one."""
        base, m = len(self.texts), len(texts)
        listed = np.bincount(text, minlength=m)
        width = listed + ~whole
        self._room(m, int(width.sum()), len(ids))
        begin = self.n + np.cumsum(width) - width
        at = np.arange(len(text)) - np.repeat(np.cumsum(listed) - listed, listed) + begin[text]
        p = np.exp(log_p)
        sums = np.cumsum(p)
        up_to = sums - np.repeat((sums - p)[np.cumsum(listed) - listed], listed)
        self.up_to[at] = np.minimum(up_to, 1.0)
        self.log_p[at] = log_p
        only = whole[text] & (listed[text] == 1)
        with np.errstate(divide="ignore"):
            self.log_rest[at] = np.where(only, -np.inf, np.log1p(-np.minimum(p, 1 - 1e-16)))
        self.start[at] = self.n_ids + np.cumsum(sizes) - sizes
        self.length[at] = sizes
        last = begin + width - 1
        self.up_to[last] = 1.0
        rest = last[~whole]
        self.log_p[rest], self.log_rest[rest], self.start[rest], self.length[rest] = 0.0, 0.0, 0, -1
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + int(width.sum()), self.n_ids + len(ids)
        self.first[base:base + m] = begin
        self.known.update(zip(texts, range(base, base + m)))
        self.texts += texts

    def atoms_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The atoms of each of `texts`, split into words. Atoms without tables get them; when there are too many, those of words met once go."""
        if len(self.units) > self.limit() or len(self.texts) > self.limit():
            self.forget()
        words = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.units.get, words, repeat(-1)), np.int32, len(words))
        new = at < 0
        self.again[at[~new]] = True
        if new.any():
            found = list(compress(words, new.tolist()))
            self._learn(list(dict.fromkeys(found)))
            at[new] = np.fromiter(map(self.units.__getitem__, found), np.int32, len(found))
        sizes = self.width[at]
        row = self.row[in_a_row(self.begin[at], sizes)]
        ends = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, texts)])].tolist()
        return [row[a:b] for a, b in pairwise(ends)]

    def _learn(self, words: list[str]) -> None:
        known = self.known
        # cut words where two neighbours are neighbours in no piece
        sizes = np.array(list(map(len, words)))
        ends, joined = np.cumsum(sizes), "".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair, pairs = codes[:-1] << 21 | codes[1:], self.pieces.pairs
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] != pair
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        parts = [joined[a:b] for a, b in pairwise(cuts.tolist())]
        new = [x for x in dict.fromkeys(parts) if x not in known]
        plain = [x for x in new if len(x) <= PLAIN and self.pieces.single.issuperset(x)]
        for lo in range(0, len(plain), BULK):
            self._add(plain[lo:lo + BULK], *bulk_best(self.pieces, plain[lo:lo + BULK], SHORT))
        for x in new:
            if x not in known:  # long ones, and characters that are spelled in bytes
                best, whole = Atom(self.pieces, x).best(SHORT)
                self._add([x], np.zeros(len(best), np.int64), np.array([q for q, _ in best]), np.array([i for _, path in best for i in path]),
                          np.array([len(path) for _, path in best]), np.array([whole]))
        edges = np.searchsorted(cuts, ends)
        self._words(words, np.fromiter(map(known.__getitem__, parts), np.int32, len(parts)), np.diff(edges, prepend=0))

    def listed(self, at: int) -> set[tuple[int, ...]]:
        """The segmentations of an atom that are in the tables."""
        end = self.first[at + 1] if at + 1 < len(self.texts) else self.n
        return {self._path(c) for c in range(self.first[at], end) if self.length[c] >= 0}

    def atom(self, at: int) -> Atom:
        """The lattice of an atom whose rest is asked for; kept while there are not too many."""
        got = self.atoms.get(at)
        if got is None:
            if len(self.atoms) > MOST_LATTICES:
                self.atoms.clear()
            got = self.atoms[at] = Atom(self.pieces, self.texts[at])
        return got

    # ----------------------------------------------------------------------------------------------------------

    def _draw(self, atoms: np.ndarray, rng: np.random.Generator, random) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """A choice for each atom: its place in the tables, log p, log (1 - p), and the paths of those not in them."""
        x, at = rng.random(len(atoms)), self.first[atoms]
        for _ in range(SHORT):  # the last choice of an atom ends at 1, above every x
            at += self.up_to[at] <= x
        log_p, log_rest, odd = self.log_p[at], self.log_rest[at], {}
        for i in np.flatnonzero(self.length[at] < 0).tolist():
            a = int(atoms[i])
            atom, listed = self.atom(a), self.listed(a)
            log_p[i], odd[i] = atom.draw_other(random, listed, atom.left(listed))
            log_rest[i] = math.log1p(-math.exp(log_p[i])) if log_p[i] < -1e-12 else -math.inf
        return at, log_p, log_rest, odd

    def _path(self, at: int) -> tuple[int, ...]:
        return tuple(self.ids[self.start[at]:self.start[at] + self.length[at]].tolist())

    def _spell(self, at: np.ndarray, odd: dict) -> np.ndarray:
        sizes = self.length[at]
        for i, path in odd.items():
            sizes[i] = len(path)
        out = self.ids[np.minimum(in_a_row(self.start[at], sizes), len(self.ids) - 1)]
        if odd:
            ends = np.cumsum(sizes)
            for i, path in odd.items():
                out[ends[i] - len(path):ends[i]] = path
        return out

    def sample(self, text: str, seed: int, k: int, atoms: np.ndarray | None = None) -> list[tuple[np.ndarray, float, float, float]]:
        """Up to `k` distinct segmentations (ids, log-probability, perturbed value, log of the inclusion score),
        fewer only if the text has fewer. The score is the chance of a value above the first one left out.
        `atoms` are those of the text, if they are known."""
        if not text:
            return [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
        rng, random = np.random.default_rng(seed), Random(seed).random
        atoms = self.atoms_of([split(text)])[0] if atoms is None else atoms
        n, out, sets = len(atoms), [], []

        def noisy(log_mass: np.ndarray) -> np.ndarray:
            return log_mass - np.log(-np.log(rng.uniform(1e-300, 1, len(log_mass))))

        def cut_off(most: float, noisy: np.ndarray) -> float:
            """The largest perturbed value of these sets, known to stay below `most`; it grows with the noisy mass."""
            top = float(noisy.max())
            return top if top == -math.inf else -float(np.logaddexp(-most, -top))

        def add(begin: int, at, log_p, odd, values, without, most) -> None:
            sets.append((begin, at, log_p, odd, values, without, most))

        most = float(-math.log(-math.log(rng.uniform(1e-300, 1))))
        at, log_p, log_rest, odd = self._draw(atoms, rng, random)
        before = np.cumsum(log_p) - log_p
        add(0, at, log_p, odd, noisy(before + log_rest), None, most)
        out.append((at, odd, float(log_p.sum()), most))
        while len(out) < k:
            tops = [cut_off(s[6], s[4]) for s in sets]
            s = int(np.argmax(tops))
            if tops[s] == -math.inf:
                break
            begin, at0, log_p0, odd0, values, without, _ = sets[s]
            i, most = int(np.argmax(values)), tops[s]
            values[i] = -np.inf
            gone = set(without or ()) if i == begin and without else set()
            gone.add(odd0[i] if i in odd0 else self._path(at0[i]))
            atom = self.atom(int(atoms[i]))
            x, path = atom.draw_other(random, gone, atom.left(gone))
            at2, log_p2, log_rest2, odd2 = self._draw(atoms[i + 1:], rng, random)
            at = np.concatenate([at0[:i + 1], at2])
            log_p = np.concatenate([log_p0[:i], [x], log_p2])
            odd = {j: p for j, p in odd0.items() if j < i} | {i: path} | {j + i + 1: p for j, p in odd2.items()}
            gone.add(path)
            mass = atom.left(gone)
            before = np.cumsum(log_p) - log_p
            values = np.full(n, -np.inf)
            values[i:] = noisy(np.concatenate([[before[i] + (math.log(mass) if mass > 0 else -math.inf)], before[i + 1:] + log_rest2]))
            add(i, at, log_p, odd, values, gone, most)
            out.append((at, odd, float(log_p.sum()), most))
        bar = max(cut_off(s[6], s[4]) for s in sets)
        return [(self._spell(at, odd), x, g, self._included(x - bar)) for at, odd, x, g in out]

    @staticmethod
    def _included(x: float) -> float:
        """log(1 - exp(-exp(x)))."""
        if x > 40:
            return 0.0
        return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def sampler(file: str) -> Sampler:
    held = worker_cache("lattice")
    if file not in held:
        held[file] = Sampler(file)
    return held[file]


def places(sizes) -> pa.Array:
    """Where each list starts, and the end."""
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def encode_samples(docs: DataFrame, k: int = SAMPLES, file: str = "piece_bpe_32k.model", ids: bool = True,
                   held: int | None = None) -> DataFrame:
    """`docs` (doc_id, text, any others) with a row for each of up to `k` sampled segmentations of the whole text, and the
    column `pieces` (sample from 1, n, ids if asked for, ids_crc32, log_prob, gumbel, log_inclusion, decoded: whether the ids spell the text).

    The draw is seeded by doc_id, by the text where that is NULL, so repeated rows give equal samples, and it does not depend on the
    partitioning. NULL and empty texts have one segmentation, without pieces. An empty table gives an empty
    one. `pieces` replaces a column of that name. A worker holds tables of up to `held` words (MOST_WORDS), about 0.5 KB each;
    the samples do not depend on it.
    """
    kind = "array<struct<sample:int, n:int, " + "ids:array<int>, " * ids + "ids_crc32:long, log_prob:double, gumbel:double, log_inclusion:double, decoded:boolean>>"

    def encode(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        tool, rows, got_ids, n_rows = sampler(file), [], [], []
        tool.most = held
        gc.disable()  # tables of tuples only, no cycles; looking for some among them would take a third of the time
        texts, seeds = [t or "" for t in texts.to_pylist()], seeds.to_pylist()
        for lo in range(0, len(texts), AT_ONCE):
            some = texts[lo:lo + AT_ONCE]
            for text, seed, its in zip(some, seeds[lo:lo + AT_ONCE], tool.atoms_of([split(t) for t in some])):
                samples = tool.sample(text, seed & ((1 << 63) - 1), k, its)
                n_rows.append(len(samples))
                for i, (got, x, g, q) in enumerate(samples, 1):
                    got = got.astype("<i4", copy=False)
                    rows.append((i, len(got), zlib.crc32(got), x, g, q, tool.pieces.decode(got) == text))
                    got_ids.append(got if ids else None)
        gc.enable()
        sample, n, crc, log_p, gumbel, included, decoded = zip(*rows) if rows else [()] * 7
        columns = {"sample": pa.array(sample, pa.int32()), "n": pa.array(n, pa.int32())}
        if ids:
            columns["ids"] = pa.ListArray.from_arrays(places(n), pa.array(np.concatenate(got_ids) if rows else [], pa.int32()))
        columns |= {"ids_crc32": pa.array(crc, pa.int64()), "log_prob": pa.array(log_p, pa.float64()), "gumbel": pa.array(gumbel, pa.float64()),
                    "log_inclusion": pa.array(included, pa.float64()), "decoded": pa.array(decoded, pa.bool_())}
        return pa.ListArray.from_arrays(places(n_rows), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))

    # segmentations take several times the room of their texts, so a worker gets few texts at a time
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    text = F.col("text").cast("string")
    others = [F.col(c) for c in docs.columns if c != "pieces"]
    return docs.select(*others, F.explode(F.arrow_udf(encode, kind)(text, F.xxhash64(row_key(F.col("doc_id"), text)))).alias("pieces"))


def decode_pieces(rows: DataFrame, column: str = "ids", file: str = "piece_bpe_32k.model") -> DataFrame:
    """`rows` with a column `decoded`: the text that the ids spell; NULL for NULL."""
    def decode(ids: pd.Series) -> pd.Series:
        tool = sampler(file).pieces
        return pd.Series([None if x is None else tool.decode(np.asarray(x, np.int64)) for x in ids])

    return rows.withColumn("decoded", F.pandas_udf(decode, "string")(F.col(column)))
