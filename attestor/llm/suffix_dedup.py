"""Repeated passages by suffix arrays: every byte that a string of ``length`` bytes covers which starts elsewhere too is removed.

Windows of ``length`` bytes are dealt by their content: a window's anchor is the smallest hash of the ANCHOR-byte strings in it, so
equal windows have one anchor, wherever they stand. Neighbouring windows with one anchor make a context. Anchors that occur once are
done with; equal contexts become one with a count; the different contexts of an anchor are put into one block of text. Blocks follow the
place where an anchor stands first, so that neighbouring contexts meet in one block and lie there as one text. A block leaves out
windows that hold a short string which it has only once, sorts the suffixes of the rest, and windows that are neighbours in that order
and agree in all their bytes are repeated.

Suffixes are sorted by linear grouping: suffixes are grouped by their first byte, and groups are taken in descending order. Each suffix
of a group points at the nearest smaller suffix before it, and the suffixes pointed at move into new groups behind their old ones, by
the number of pointers. In the end, suffixes of one group have one Lyndon prefix. A pass from the smallest suffix up then puts the
suffixes before it, along the pointers, into their groups' next free places. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, scratch, small

#: Bytes of an anchor. Longer ones are repeated less often by chance, shorter ones are fewer.
ANCHOR = 64
#: Bytes of contexts in a block of text, about: suffixes of a small text are sorted in a processor's cache.
BLOCK_BYTES = 16 << 10
#: Anchors with more bytes of different contexts have their windows compared one by one.
GROUP_BYTES = 3 << 20
#: Bytes of a text whose anchors go to one block, and bytes of contexts from which on its anchors go to blocks each by itself.
REGION, REGION_BYTES = 4 << 10, 64 << 10
#: Windows of a context at most; text that repeats itself would make longer ones.
CONTEXT_WINDOWS = 1024
#: Rows of a batch that are worked at a time, and contexts whose windows are hashed at a time: what a worker holds besides the batch.
ROWS, HASHED = 256, 64


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a worker's lists and results do not grow with Spark's batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def suffix_order(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; its last value must be smaller than all others."""
    n = len(text)
    values = np.asarray(text, np.int64)
    order = np.argsort(values, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    sizes = np.diff(np.append(starts, n))
    group, size, place = np.empty(n, np.int64), [0] * n, np.empty(n, np.int64)
    group[order], place[order] = np.repeat(starts, sizes), np.arange(n)
    for start, members in zip(starts.tolist(), sizes.tolist(), strict=True):
        size[start] = members
    at, group, place, smaller = order.tolist(), group.tolist(), place.tolist(), [-1] * n

    end = n - 1
    while end >= 0:
        start = group[at[end]]
        if start == end:
            s = at[start]
            j = s - 1
            while j >= 0 and group[j] > start:
                j = smaller[j]
            smaller[s] = j
            if j >= 0:
                old = group[j]
                size[old] -= 1
                to = old + size[old]
                size[to], p, other = 1, place[j], at[to]
                at[to], at[p], place[j], place[other], group[j] = j, other, to, p, to
        else:
            members = at[start : end + 1]
            members.sort()
            targets = []
            for s in members:
                j = s - 1
                while j >= 0 and group[j] > start:
                    j = smaller[j]
                if j >= 0 and group[j] == start:
                    j = smaller[j]
                smaller[s] = j
                if j >= 0:
                    targets.append(j)
            if len(targets) == 2 and targets[0] != targets[1]:  # in text that stands twice, most groups are of two
                batches = [targets] if group[targets[0]] == group[targets[1]] else [targets[:1], targets[1:]]
            else:
                times: dict[int, int] = {}
                for j in targets:
                    times[j] = times.get(j, 0) + 1
                moves: dict[tuple[int, int], list[int]] = {}
                for j, n_pointers in times.items():
                    moves.setdefault((-n_pointers, group[j]), []).append(j)
                batches = [moves[key] for key in sorted(moves)] if len(moves) > 1 else moves.values()
            for targets in batches:  # those with the most pointers go behind all others of their group
                old = group[targets[0]]
                to = old + size[old]
                size[old] -= len(targets)
                new = old + size[old]
                size[new] = len(targets)
                for j in targets:
                    to -= 1
                    p, other = place[j], at[to]
                    at[to], at[p], place[j], place[other], group[j] = j, other, to, p, new
        end = start - 1

    free, placed, out = list(range(n)), bytearray(n), [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def viable_windows(data: np.ndarray, whole: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each place can be repeated: all short strings in it stand twice in ``data``, or it counts as several itself.

    ``whole``: whether a window starts there, ``counts``: how often it counts.
    """
    width = min(ANCHOR, 1 << (length.bit_length() - 1))
    grams = anchor_hashes(data.tobytes(), width)
    _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    single = np.concatenate([[0], np.cumsum(times[inverse] < 2)])
    starts = np.flatnonzero(whole)
    viable = np.zeros(len(data), bool)
    viable[starts] = (single[starts + length - width + 1] == single[starts]) | (counts[starts] > 1)
    return viable


def repeated_windows(texts: list[bytes], counts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each text, whether the window of ``length`` bytes at each start stands in all texts together at least twice.

    ``counts``: how often each window of a text counts. The suffixes of what can be repeated are sorted as one text with a mark
    behind each part.
    """
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole, weight = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    for begin, size, own in zip(begins.tolist(), sizes.tolist(), counts, strict=True):
        whole[begin : begin + max(0, size - length + 1)] = True
        weight[begin : begin + len(own)] = own
    repeated = np.zeros(len(data), bool)
    viable = viable_windows(data, whole, weight, length) if whole.any() else whole
    edges = np.flatnonzero(np.diff(np.concatenate([[0], viable, [0]])))
    first, last = edges[::2], edges[1::2] + length - 1  # parts of the text that viable windows cover, each text's by themselves
    found: dict[bytes, list[int]] = {}  # equal parts are sorted once; their windows count together
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        found.setdefault(data[a:b].tobytes(), []).append(a)
    if found:
        part_sizes = np.array([len(p) for p in found])
        part_begins = np.concatenate([[0], np.cumsum(part_sizes + 1)[:-1]])
        text = np.frombuffer(b"\0".join(found) + b"\0", np.uint8)
        values = text.astype(np.int64) + 2
        values[part_begins + part_sizes] = 1
        values[-1] = 0
        times = np.zeros(len(text), np.int64)
        for begin, size, places in zip(part_begins.tolist(), part_sizes.tolist(), found.values(), strict=True):
            for place in places:
                times[begin : begin + size - length + 1] += weight[place : place + size - length + 1]
        order = np.array(suffix_order(values.tolist()))
        order = order[times[order] > 0]  # the others are a window's tail, or a mark
        words = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8).copy().view("<u8").ravel()
        same = np.arange(len(order) - 1)  # neighbours that agree, 8 bytes at a time; the last 8 may overlap those before
        for shift in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            same = same[words[order[same] + shift] == words[order[same + 1] + shift]]
        alone = np.ones(len(order), bool)
        alone[same + 1] = False
        runs = np.flatnonzero(alone)
        several = np.zeros(len(text), bool)
        several[order] = np.repeat(np.add.reduceat(times[order], runs), np.diff(np.append(runs, len(order)))) > 1
        for begin, size, places in zip(part_begins.tolist(), part_sizes.tolist(), found.values(), strict=True):
            for place in places:
                repeated[place : place + size - length + 1] = several[begin : begin + size - length + 1]
    return [repeated[b : b + max(0, s - length + 1)] for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def anchor_hashes(data: bytes, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes (a power of two) from each place."""
    h = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n = 1
    while n < width:
        after = h[n:] * np.uint64(0x94D049BB133111EB)
        after += h[:-n] * np.uint64(0xBF58476D1CE4E5B9)
        h = after
        h ^= h >> np.uint64(31)
        n *= 2
    return h * np.uint64(0x9E3779B97F4A7C15)


def _sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` (minimum or maximum) of the ``width`` values from each place on."""
    n = 1
    while n * 2 <= width:
        values = best(values[:-n], values[n:])
        n *= 2
    return best(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def contexts_of(data: bytes, length: int, asked: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, start and number of windows of each context of a text of at least ``length`` bytes, and, where ``asked``, whether it holds its anchor twice."""
    hashes, span = anchor_hashes(data, ANCHOR), length - ANCHOR + 1
    least = _sliding(hashes, span, np.minimum)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    twice = np.zeros(len(starts), bool)
    if asked:
        # a place is an anchor if its hash is the least of a window that holds it; no other anchors are between two of one context
        edge = np.zeros(span - 1, np.uint64)
        places = np.flatnonzero(hashes == _sliding(np.concatenate([edge, least, edge]), span, np.maximum))
        pairs = np.flatnonzero((hashes[places[1:]] == hashes[places[:-1]]) & (np.diff(places) < span))
        twice[np.searchsorted(starts, np.maximum(0, places[pairs + 1] - span + 1), "right") - 1] = True
    ends = np.append(starts[1:], len(least))
    if (ends - starts).max() > CONTEXT_WINDOWS:
        pieces = [np.arange(a, b, CONTEXT_WINDOWS) for a, b in zip(starts, ends, strict=True)]
        twice, starts = np.repeat(twice, [len(p) for p in pieces]), np.concatenate(pieces)
        ends = np.append(starts[1:], len(least))
    return least[starts].view(np.int64), starts, ends - starts, twice


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """``anchor`` of all anchors that stand in two contexts, or twice in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, ROWS):
            found = [contexts_of(data, length) for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.list_(t)) for i, t in ((0, pa.int64()), (3, pa.bool_()))], ["anchor", "twice"])

    lists = rows.where(F.octet_length("text") >= length).select(F.col("text").cast("binary")).mapInArrow(cut, "anchor array<long>, twice array<boolean>")
    each = lists.select(F.explode(F.arrays_zip("anchor", "twice")).alias("c")).select("c.*")
    return each.groupBy("anchor").agg(F.count("*").alias("times"), F.bool_or("twice").alias("twice")).where("times > 1 or twice").select("anchor")


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """``row, anchor, context, start, n`` of all contexts; ``context`` is a hash of its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, ROWS):
            columns: list[list] = [[], [], [], [], []]
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                anchors, starts, n, _ = contexts_of(data, length, False)
                digest = [xxhash.xxh3_64_intdigest(data[s : s + k + length - 1]) for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
                for column, value in zip(columns, (row, anchors, np.array(digest, np.uint64).view(np.int64), starts, n), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2), strict=True)], ["row", "anchor", "context", "start", "n"])

    long = rows.where(F.octet_length("text") >= length).select("row", F.col("text").cast("binary"))
    lists = long.mapInArrow(cut, "row long, anchor array<long>, context array<long>, start array<int>, n array<int>")
    return lists.select("row", F.explode(F.arrays_zip("anchor", "context", "start", "n")).alias("c")).select("row", "c.*")


def _with(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that ``others`` (written, one for a row) have something for; only their texts are dealt out."""
    return rows.join(small(others.select("row"), 64), "row", "left_semi").join(others, "row")


def _texts_of(rows: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """``block, hot, anchor, context, times, n, bytes``: contexts as texts, cut out of the row that they name.

    Contexts of a block that follow each other in a row are one text, with lists of their anchors and so on.
    """
    names = ("block", "start", "n", "anchor", "context", "times", "hot")
    wanted = materialise(contexts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("wanted")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, ROWS):
            out: dict[str, list] = {c: [] for c in ("block", "hot", "anchor", "context", "times", "n", "bytes")}
            for data, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted"), strict=True):
                block, start, n, *rest = (wanted.values.field(i).to_numpy(zero_copy_only=False) for i in range(len(names)))
                hot = rest[-1]
                follows = (block[1:] == block[:-1]) & (start[1:] == start[:-1] + n[:-1]) & ~hot[1:] & ~hot[:-1]
                begins = np.flatnonzero(np.concatenate([[True], ~follows]))
                for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(n)], strict=True):
                    out["block"].append(block[a])
                    out["hot"].append(hot[a])
                    for c, values in zip(("anchor", "context", "times", "n"), (*rest[:3], n), strict=True):
                        out[c].append(values[a:b])
                    out["bytes"].append(data[start[a] : start[b - 1] + n[b - 1] + length - 1])
            types = (pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    found = _with(rows.select("row", F.col("text").cast("binary")), wanted)
    return found.select("text", "wanted").mapInArrow(cut, "block long, hot boolean, anchor array<long>, context array<long>, times array<long>, n array<int>, bytes binary")


def _runs(flags: np.ndarray) -> list[int]:
    """First and last place of each run of true values, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return (edges - np.tile([0, 1], len(edges) // 2)).tolist()


def _by_suffixes(texts: DataFrame, length: int) -> DataFrame:
    """``anchor, context, runs``: repeated windows of contexts, by the suffix order of blocks. All contexts of an anchor are in one block."""

    def find(table: pa.Table) -> pa.Table:
        lists = {c: table.column(c).to_pylist() for c in ("anchor", "context", "times", "n")}
        counts = [np.repeat(t, n) for t, n in zip(lists["times"], lists["n"], strict=True)]
        repeated = repeated_windows(table.column("bytes").to_pylist(), counts, length)
        out: tuple[list, list, list] = ([], [], [])
        for anchors, contexts, n, flags in zip(lists["anchor"], lists["context"], lists["n"], repeated, strict=True):
            if flags.any():
                for anchor, context, own in zip(anchors, contexts, np.split(flags, np.cumsum(n)[:-1]), strict=True):
                    if own.any():
                        for column, value in zip(out, (anchor, context, _runs(own)), strict=True):
                            column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["anchor", "context", "runs"])

    return texts.groupBy("block").applyInArrow(find, "anchor long, context long, runs array<int>")


def _by_windows(texts: DataFrame, length: int) -> DataFrame:
    """``anchor, context, runs`` as ``_by_suffixes``, for anchors with too many contexts for a block: windows meet by 128-bit hashes."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, HASHED):
            windows = [[xxhash.xxh3_128_digest(data[i : i + length]) for i in range(len(data) - length + 1)] for data in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "context", "times")), pa.array(windows, pa.list_(pa.binary()))], ["anchor", "context", "times", "windows"])

    own = texts.select(*[F.element_at(c, 1).alias(c) for c in ("anchor", "context", "times")], "bytes")
    hashed = materialise(own.mapInArrow(hashes, "anchor long, context long, times long, windows array<binary>"), "windows")
    each = hashed.select("anchor", "context", "times", F.posexplode("windows").alias("place", "window"))
    twice = materialise(each.groupBy("window").agg(F.sum("times").alias("times")).where("times > 1").select("window"), "twice")
    places = each.join(small(twice), "window").groupBy("anchor", "context").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return places.select("anchor", "context", F.flatten(F.transform("places", lambda p: F.array(p, p))).alias("runs"))


def _dealt(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts with ``hot`` (their anchor has too many for a block) and ``block``: by the region where their anchor stands first.

    A region with too many bytes has its anchors dealt each by itself, so a block is of bounded size, but for one context's text.
    """
    anchors = contexts.groupBy("anchor").agg(F.sum(F.col("n") + length).alias("size"), F.min(F.struct("row", "start")).alias("at"))
    region = F.struct(F.col("at.row").alias("row"), F.floor(F.col("at.start") / REGION).alias("part"))
    anchors = materialise(anchors.select("anchor", "size", region.alias("region"), (F.col("size") > GROUP_BYTES).alias("hot")), "homes")
    regions = anchors.where("not hot").groupBy("region").agg(F.sum("size").alias("bytes"))
    full = materialise(regions.where(F.col("bytes") > REGION_BYTES).select("region", F.lit(True).alias("full")), "regions")
    blocks = 1 + (anchors.where("not hot").agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES
    home = F.when(F.coalesce("full", F.lit(False)), F.xxhash64("anchor")).otherwise(F.xxhash64("region.row", "region.part"))
    told = anchors.join(small(full, 160), "region", "left").select("anchor", "hot", F.pmod(home, F.lit(blocks)).alias("block"))
    return contexts.join(told, "anchor")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with ``spans`` (start and end in bytes of the removed runs, in order) and ``kept`` (the other bytes).

    Removed is each byte of ``text`` in UTF-8 that a string of ``length`` bytes covers which also starts elsewhere, in the same
    text or another; overlaps count. All strings are judged on the input. Kept bytes may start or end inside a character.
    Repeated rows are texts each, so both lose all from ``length`` bytes on. Null and empty texts, and shorter ones, have no
    spans; an empty table gives no rows; other columns stay (``spans`` and ``kept`` are replaced).
    """
    spark = docs.sparkSession
    docs = docs.drop("spans", "kept")
    with scratch(spark):
        rows = materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"), F.monotonically_increasing_id().alias("row")), "texts", keep=True)
        met = materialise(_contexts(rows, length).join(materialise(_anchors(rows, length), "anchors"), "anchor"), "met")
        contexts = met.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "n")).alias("at")).select("anchor", "context", "times", "at.*")
        texts = materialise(_texts_of(rows, _dealt(materialise(contexts, "distinct"), length), length), "texts-of")
        runs = _by_suffixes(texts.where("not hot"), length)
        if not texts.where("hot").isEmpty():
            runs = runs.unionByName(_by_windows(texts.where("hot"), length))
        runs = materialise(runs, "runs")
        spans = met.join(runs, ["anchor", "context"]).groupBy("row").agg(F.collect_list(F.struct("start", "runs")).alias("found"))
        spans = materialise(spans, "spans", keep=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, ROWS):
            spans, kept = [], []
            for data, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data, merged = data or b"", []
                for a, b in sorted((f["start"] + a, f["start"] + b + length) for f in found or [] for a, b in zip(f["runs"][::2], f["runs"][1::2], strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc", "spans", "kept"])

    found = rows.join(small(spans.select("row"), 64), "row", "left_anti").select("doc", "text", F.lit(None).cast(spans.schema["found"].dataType).alias("found"))
    joined = _with(rows, spans).select("doc", "text", "found").unionByName(found).withColumn("text", F.col("text").cast("binary"))
    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL("spans array<struct<start:int,end:int>>, kept binary").fields])
    return joined.mapInArrow(cut, schema).select("doc.*", "spans", "kept")
