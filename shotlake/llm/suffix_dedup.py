"""Removing repeated byte strings with suffix arrays built by external induced sorting.

A string of WINDOW bytes is named by its anchor, the GRAM in it of least hash, so equal strings have equal anchors wherever
they are. Neighbouring strings of one anchor make a stretch of text. Stretches that occur more than once are repeated as
a whole; those whose anchor leads other stretches too go to shards by anchor, where a suffix array with common-prefix values finds
the strings that several of them share. An anchor with very many stretches is dealt to several shards, which then exchange
hashes of the strings they hold once.

The suffix array of a shard is induced: suffixes that are local minima are sorted by names of what lies between them, recursively
over ever longer runs of names, and all others follow in two scans. The scans feed priority queues of (first byte, order
of arrival) that carry positions and common-prefix values and live on disk beyond a bound.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm.common import Run, drop, every_salt, grouped, row_key, with_salt, written

WINDOW, GRAM = 200, 32
SHARD_BYTES, HOT, IN_MEMORY = 4 << 20, 256, 4 << 20
INDEX = np.uint64((1 << 28) - 1)


# anchors ------------------------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position; `gram` is a power of two."""
    with np.errstate(over="ignore"):
        h, step = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
        while step < gram:
            h = h ^ (h >> np.uint64(29))
            h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:] * np.uint64(0x94D049BB133111EB)
            step *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row."""
    step, low = 1, keys
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(keys) - width + 1], low[width - step:]) if step < width else low


def stretches(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, strings) of each stretch of `data`: strings in a row with one anchor, the leftmost if tied."""
    if len(data) < window:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    h = gram_hashes(data, gram)
    keys = (h & ~INDEX) | np.arange(len(h), dtype=np.uint64)
    anchor = (least_of(keys, window - gram + 1) & INDEX).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return h[anchor[first]], first, np.diff(np.concatenate([first, [len(anchor)]]))


# external induced sorting -------------------------------------------------------------------------------------

class BucketQueue:
    """A priority queue of (bucket, order of arrival) for records of two integers, scanned bucket by bucket.
    Records beyond a bound in memory are kept in a temporary file of the task, which ends with it."""

    def __init__(self, buckets: int, in_memory: int):
        self.parts: list[list] = [[] for _ in range(buckets)]
        self.held, self.in_memory, self.file = 0, in_memory, None

    def push(self, bucket: int, at: np.ndarray, common: np.ndarray) -> None:
        self.parts[bucket].append((at, common))
        self.held += len(at)
        if self.held > self.in_memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for part in self.parts:
            if part and not isinstance(part[-1][0], int):
                kept = next(i for i, p in enumerate(part) if not isinstance(p[0], int))
                both = [np.concatenate([p[k] for p in part[kept:]]) for k in (0, 1)]
                self.file.seek(0, 2)
                part[kept:] = [(self.file.tell(), len(both[0]))]
                self.file.write(both[0].tobytes() + both[1].tobytes())
        self.held = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """The records of a bucket so far, in their order; they leave the queue."""
        out = []
        for a, b in self.parts[bucket]:
            if isinstance(a, int):
                self.file.seek(a)
                both = np.frombuffer(self.file.read(16 * b), np.int64)
                out.append((both[:b], both[b:]))
            else:
                self.held -= len(a)
                out.append((a, b))
        self.parts[bucket] = []
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Inducer:
    """One scan: records come in order, each with its common prefix with the one before, and send the suffix one position
    before them to the queue. `low` is the least common prefix since a bucket last got a record."""

    def __init__(self, text: np.ndarray, buckets: int, in_memory: int, track: bool):
        self.track = track  # whether common prefixes are wanted
        self.text, self.queue = text, BucketQueue(buckets, in_memory)
        self.low = np.zeros(buckets, np.int64)

    def feed(self, at: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        """Feed records in order; those `wanted` send on what precedes them."""
        sources, to = np.flatnonzero(wanted), self.text[at[wanted] - 1]
        order = np.argsort(to.astype(np.uint8), kind="stable")  # all values are under 256
        sources, to = sources[order], to[order]
        edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
        since = np.minimum(self.low, common.min()) if self.track else self.low
        for i, j in zip(edges, edges[1:]):
            c, k = int(to[i]), sources[i:j]
            if self.track:
                # the least common prefix over the records after the last source and up to this one
                low = np.minimum.reduceat(common[: k[-1] + 1], np.concatenate([[0], k[:-1] + 1]))
                low[0] = min(low[0], self.low[c])
                since[c] = common[k[-1] + 1:].min() if k[-1] + 1 < len(common) else np.iinfo(np.int64).max
                low += 1
            else:
                low = np.zeros(len(k), np.int64)
            self.queue.push(c, at[k] - 1, low)
        self.low = since


def scan_up(text: np.ndarray, run: np.ndarray, lms: np.ndarray, lms_common: np.ndarray, buckets: int, in_memory: int, track: bool = True) -> list:
    """The L-type suffixes of each bucket in order, (positions, common prefixes with the one before in the bucket), induced
    from the local minima `lms` in order."""
    scan = Inducer(text, buckets, in_memory, track)
    edges = np.searchsorted(text[lms], np.arange(buckets + 1))
    scan.queue.push(int(text[-1]), np.array([len(text) - 1]), np.array([0]))
    out = []
    for c in range(buckets):
        parts = []
        while True:
            at, common = scan.queue.pop(c)
            if not len(at):
                break
            if not parts:
                common[0] = 0  # nothing before it starts with c
            parts.append((at, common))
            scan.feed(at, common, (at > 0) & (text[at - 1] >= c))
        out.append(tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)))
        at, common = lms[edges[c]:edges[c + 1]], lms_common[edges[c]:edges[c + 1]].copy()
        if len(at):
            common[0] = min(run[out[-1][0][-1]], run[at[0]]) if parts else 0
            scan.feed(at, common, at > 0)
    scan.queue.close()
    return out


def scan_down(text: np.ndarray, is_s: np.ndarray, run: np.ndarray, large: list, buckets: int, in_memory: int, track: bool = True) -> list:
    """The S-type suffixes of each bucket from the last to the first, with the common prefix with the one after."""
    scan = Inducer(text, buckets, in_memory, track)
    out: list = [None] * buckets
    for c in range(buckets - 1, -1, -1):
        parts = []
        while True:
            at, common = scan.queue.pop(c)
            if not len(at):
                break
            if not parts:
                common[0] = 0
            parts.append((at, common))
            scan.feed(at, common, (at > 0) & is_s[at - 1] & (text[at - 1] <= c))
        out[c] = tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        at, common = large[c]
        if len(at):
            # from the last to the first, each with the common prefix with the one after it
            seam = min(run[at[-1]], run[out[c][0][-1]]) if parts else 0
            at, common = at[::-1], np.concatenate([[seam], common[:0:-1]])
            scan.feed(at, common, (at > 0) & is_s[at - 1] & (text[at - 1] <= c))
    scan.queue.close()
    return out


def words_of(text: np.ndarray, most: int) -> np.ndarray:
    """The eight values from each position on, all under 256, as one big-endian number; zeros follow the text."""
    out = np.zeros(len(text) + most + 16, np.uint64)
    for k in range(8):
        out[: max(len(text) - k, 0)] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def common_prefixes(words: np.ndarray, n: int, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix in `order` with the one before, up to about `most`; `n` values are text."""
    out = np.zeros(len(order), np.int64)
    live, shift = np.arange(1, len(order)), 0
    a, b = order[1:], order[:-1]
    while len(live) and shift < most:
        other = words[a + shift] ^ words[b + shift]
        same = other == 0
        odd = other[~same]
        out[live[~same]] = shift + sum((odd >> np.uint64(56 - 8 * k) == 0).astype(np.int64) for k in range(7))
        live, a, b, shift = live[same], a[same], b[same], shift + 8
    out[live] = shift
    return np.minimum(out, n - np.maximum(order, np.roll(order, 1)))


def suffix_array(text: np.ndarray, most: int, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(positions, common prefix with the one before) of the suffixes of `text` (values under 256), ordered by their first `most` values at
    least; common prefixes are exact up to there."""
    n, buckets, words = len(text), int(text.max()) + 1, words_of(text, most)
    # the next position of another value decides the type; the last run, before the end of the text, is L
    change = np.flatnonzero(np.diff(text)) + 1
    ends = np.concatenate([change, [n]])
    sizes = np.diff(np.concatenate([[0], ends]))
    run = np.repeat(ends, sizes) - np.arange(n)
    rising = np.concatenate([text[change] > text[change - 1], [False]])
    is_s = np.repeat(rising, sizes)
    lms = np.flatnonzero(is_s & np.concatenate([[False], ~is_s[:-1]]))
    if len(lms):
        # order of the pieces between local minima: induce once from the minima by first value alone
        first = lms[np.argsort(text[lms], kind="stable")]
        none = np.zeros(len(first), np.int64)
        large = scan_up(text, run, first, none, buckets, in_memory, False)
        small = scan_down(text, is_s, run, large, buckets, in_memory, False)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rank_of = np.concatenate([s[0][::-1] for s in small])
        pieces = rank_of[is_lms[rank_of]]
        where = np.searchsorted(lms, pieces)
        ends = np.concatenate([lms[1:], [n - 1]]) + 1
        size = ends[where] - pieces
        same = np.concatenate([[False], (size[1:] == size[:-1])])
        longest = int(size.max()) + 8
        reach = common_prefixes(words if longest <= most else words_of(text, longest), n, pieces, longest)
        names = np.zeros(len(lms), np.int64)
        names[where] = np.cumsum(~(same & (reach >= size)))
        # names of runs of 1, 2, 4, ... pieces; a piece has two values at least
        span = 1
        while span * 2 <= most + 2 and names.max() < len(names):
            after = np.concatenate([names[span:], np.zeros(min(span, len(names)), np.int64)])[: len(names)]
            names = np.unique(names * (int(names.max()) + 1) + after, return_inverse=True)[1] + 1
            span *= 2
        lms = lms[np.argsort(names, kind="stable")]
    common = common_prefixes(words, n, lms, most)
    large = scan_up(text, run, lms, common, buckets, in_memory)
    small = scan_down(text, is_s, run, large, buckets, in_memory)
    at, out = [], []
    for c in range(buckets):
        (l_at, l_common), (s_at, s_common) = large[c], small[c]
        at += [l_at, s_at[::-1]]
        out.append(l_common)
        if len(s_at):
            out.append(np.concatenate([[min(run[l_at[-1]], run[s_at[-1]]) if len(l_at) else 0], s_common[:0:-1]]))
    return np.concatenate(at), np.concatenate(out)


def shared_strings(parts: list[bytes], window: int, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of all parts in a row, each followed by a separator: whether a string of `window` bytes within a part
    starts there, whether an equal one starts elsewhere, and the first of the equal ones."""
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    inside = np.repeat(ends, sizes) - 1 - np.arange(len(text)) >= window
    at, common = suffix_array(text, window, in_memory)
    joined = (common >= window) & inside[at]
    twice = joined.copy()
    twice[:-1] |= joined[1:]
    again, first = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    again[at] = twice & inside[at]
    group = np.cumsum(~joined) - 1
    low = np.minimum.reduceat(at, np.flatnonzero(~joined))
    first[at] = low[group]
    return inside, again, first


# the job ------------------------------------------------------------------------------------------------------

def _runs(flags: np.ndarray) -> np.ndarray:
    """(start, length) of the runs of True, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return np.column_stack([edge[::2], edge[1::2] - edge[::2]]).ravel()


def _split(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of a sorted `key`, and the rows of each."""
    edge = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate([[0], edge])] if len(key) else key, np.split(rows, edge) if len(key) else []


def anchors_of(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, c, key, text_hash, start, size) of the stretches of each text; with the anchor, c names the stretch's bytes."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for lo in range(0, len(df), 200):
                out = []
                for key, th, text in zip(*(df[c].iloc[lo:lo + 200] for c in ("key", "text_hash", "text"))):
                    raw = (text or "").encode()
                    g, first, n = stretches(np.frombuffer(raw, np.uint8), window, gram)
                    if len(g):
                        names = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (first + n + window - 1).tolist())])
                        c = np.frombuffer(names, np.int64)
                        out.append((g.view(np.int64), c, np.full(len(g), key), np.full(len(g), th), first, n))
                if out:
                    yield pd.DataFrame(dict(zip(("anchor", "c", "key", "text_hash", "start", "size"), map(np.concatenate, zip(*out)))))

    return docs.mapInPandas(work, "anchor long, c long, key long, text_hash long, start long, size long")


def repeated_ranges(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(key, text_hash, ranges) of the texts of `docs` (key, text_hash, text) with repeated strings: (start, strings) in pairs."""
    stretch = ["anchor", "c"]
    anchors = written(anchors_of(docs, window, gram), "anchors")
    place = F.struct("key", "text_hash", "start", "size")
    found = written(anchors.groupBy(*stretch).agg(F.count("*").alias("n"), F.min(place).alias("at")), "stretches")
    others = found.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = found.where("n > 1").select(*stretch, F.array(F.lit(0).cast("long"), F.col("at.size")).alias("runs"))
    # stretches with one anchor: a shard for the anchor, several for one with many
    single = with_salt(found, "c").join(every_salt(others), ["anchor", "_salt"]).drop("_salt")
    parts = F.ceil(F.col("kinds") / hot)
    single = single.select(*stretch, "at.*", (F.col("n") > 1).alias("known"), F.when(F.col("kinds") > hot, parts).otherwise(0).alias("parts"), F.pmod("c", parts).alias("chunk"))

    wanted = single.groupBy("key", "text_hash").agg(F.collect_list(F.struct(*stretch, "start", "size", "known", "parts", "chunk")).alias("cuts"))

    names = [*stretch, "known", "parts", "chunk"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for text, cuts in zip(df["text"], df["cuts"]):
                raw = text.encode()
                out += [(*(c[k] for k in names), raw[c["start"]:c["start"] + c["size"] + window - 1]) for c in cuts]
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=[*names, "bytes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=[*names, "bytes"])

    # one of equal rows gives its bytes
    texts = docs.join(wanted, ["key", "text_hash"]).select("cuts", F.col("text").cast("string").alias("text"))
    spans = written(texts.mapInPandas(cut, "anchor long, c long, known boolean, parts long, chunk long, bytes binary").dropDuplicates(stretch), "spans")
    total = spans.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES + 1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        df = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if not len(df):
            return
        inside, again, first = shared_strings(df["bytes"].tolist(), window)
        begin, out, strings = 0, [], {}
        text = b"\0".join(df["bytes"]) + b"\0"
        for row, (anchor, c, known, parts, span) in enumerate(zip(df["anchor"], df["c"], df["known"], df["parts"], df["bytes"])):
            n = len(span) - window + 1
            runs = _runs(again[begin:begin + n])
            if len(runs) and not known:
                out.append((anchor, c, runs, None, None))
            if parts:
                # one of each string that this shard has, to be compared with those of the anchor's other shards
                own = np.flatnonzero(first[begin:begin + n] == np.arange(begin, begin + n))
                h = np.frombuffer(b"".join([hashlib.blake2b(text[i:i + window], digest_size=16).digest() for i in (begin + own).tolist()]), np.int64).reshape(-1, 2)
                twice = again[begin + own] | known
                strings.setdefault((anchor, parts), []).append(np.column_stack([h, np.full(len(own), c), np.where(twice, -1, own)]))
            begin += len(span) + 1
        for (anchor, parts), rows in strings.items():
            rows = np.concatenate(rows)
            at = rows[:, 0] % parts
            rows = rows[np.argsort(at, kind="stable")]
            for j, some in zip(*_split(np.sort(at), rows)):
                out.append((anchor, int(j), None, some.astype("<i8").tobytes(), int(len(some))))
        yield pd.DataFrame(out, columns=["anchor", "c", "runs", "strings", "m"]).astype({"m": "Int64"})

    got = written(spans.repartition(shards, "anchor", "chunk").mapInPandas(search, "anchor long, c long, runs array<long>, strings binary, m long"), "shared")

    def meet(run: Run) -> dict | None:
        """Strings of an anchor that several shards sent: the starts of those that their own shard has once."""
        rows = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 4) for x in run["strings"]])
        _, group, n = np.unique(rows[:, :2], axis=0, return_inverse=True, return_counts=True)
        hit = rows[(n[group.ravel()] > 1) & (rows[:, 3] >= 0)]
        if not len(hit):
            return None
        hit = hit[np.lexsort((hit[:, 3], hit[:, 2]))]
        names, starts = _split(hit[:, 2], hit[:, 3])
        runs = np.empty(len(names), object)
        runs[:] = [np.column_stack([x, np.ones(len(x), np.int64)]).ravel() for x in starts]
        return {"anchor": np.full(len(names), run["anchor"][0]), "c": names, "runs": runs}

    strings = got.where("strings IS NOT NULL").select("anchor", F.col("c").alias("part"), "strings")
    across = grouped(strings, ["anchor", "part"], meet, "anchor long, c long, runs array<long>")
    runs = whole.union(got.where("runs IS NOT NULL").select(*stretch, "runs")).union(across)
    runs = runs.groupBy(*stretch).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    hits = with_salt(anchors, "key", "text_hash").join(every_salt(runs), [*stretch, "_salt"])
    out = hits.groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "runs")).alias("ranges"))
    out = written(out, "ranges")
    drop(anchors, found, spans, got)
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """`docs` (doc_id, text, any others) with a column `repeats` (n_bytes, n_removed, n_spans, kept): each byte of a string of
    `window` bytes that starts anywhere else too is removed, judged on the input; n_spans counts the maximal removed runs, and kept
    holds the bytes that remain.

    NULL texts are empty ones; texts of under `window` bytes keep all; repeated rows remove each other's bytes; rows without
    doc_id take part; an empty table gives an empty one; `repeats` replaces a column of that name, other names don't matter.
    """
    text = F.col("text").cast("string")
    key, th = row_key(F.col("doc_id"), text), F.xxhash64(F.coalesce(text, F.lit("")))
    ranges = repeated_ranges(docs.select(key.alias("key"), th.alias("text_hash"), text.alias("text")), window, gram, hot)

    def work(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, ranges in zip(texts, found):
            raw = (t or "").encode()
            if ranges is None or not len(ranges):
                out.append((len(raw), 0, 0, raw))
                continue
            edge = np.zeros(len(raw) + 1, np.int64)
            for r in ranges:
                runs = np.asarray(r["runs"]).reshape(-1, 2)
                np.add.at(edge, r["start"] + runs[:, 0], 1)
                np.add.at(edge, r["start"] + runs.sum(axis=1) + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((len(raw), int(gone.sum()), len(_runs(gone)) // 2, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    names = [c for c in docs.columns if c != "repeats"]
    joined = docs.select(*names, key.alias("_llm_key"), th.alias("_llm_hash")).join(
        ranges.toDF("_llm_key", "_llm_hash", "_llm_ranges"), ["_llm_key", "_llm_hash"], "left")
    return joined.select(*names, F.pandas_udf(work, RESULT)(text, "_llm_ranges").alias("repeats"))
