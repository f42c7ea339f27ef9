"""Best-fit packing of documents into token sequences through a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .tokens import blank_chunks, byte_bpe

#: Sub-groups that the pieces of one length are dealt to, so that no length is ranked in one task.
SALTS = 64
#: Rounds of the linear program, each on what the rounds before left over, and steps of multiplicative weights in a round.
ROUNDS, STEPS = 3, 150


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2, with_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids, then ``end_id``, cut to at most ``capacity``.

    A document that fits is one piece. A longer one is cut into pieces of ``capacity`` tokens, of which the first may be shorter,
    so that a document's end is never a fragment. Null text counts as empty: one piece that holds the end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_bpe(tokenizer_path, ranks_path)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                chunks = [blank_chunks(t or "") for t in part["text"]]
                table.learn(chunks)
                rows = []
                for doc, c in zip(part["doc_id"], chunks, strict=True):
                    ids = table.joined(c) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n else [0, 0]
                    for piece, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        held = ids[4 * low : 4 * high]
                        rows.append((doc, piece, low, high - low, zlib.crc32(held), held) if with_ids else (doc, piece, low, high - low, zlib.crc32(held)))
                table.forget()
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def best_pattern(value: np.ndarray, capacity: int) -> np.ndarray:
    """Pricing: the multiset of lengths, as counts by length, of the largest total value that ``capacity`` holds (a knapsack)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(value > 0)
    worth = value[lengths]
    for c in range(1, capacity + 1):
        m = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if m:
            gain = best[c - lengths[:m]] + worth[:m]
            i = int(np.argmax(gain))
            if gain[i] > best[c] + 1e-15:
                best[c], took[c] = gain[i], lengths[i]
    counts, c = np.zeros(capacity + 1, dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return counts


def configuration_lp(demand: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, int]]:
    """Patterns with counts that cover ``demand`` (counts by length) nearly, by multiplicative weights.

    A length's weight is its dual price. Each step adds the pattern that is worth most, for a share of the lower bound of the
    sequences at most; the share of a length that a step covers lowers its weight by a factor. Prices start as a convex
    function of the length, as long pieces have the fewest partners; volume alone would price all full patterns alike.
    """
    lengths = np.flatnonzero(demand)
    volume = int((demand * np.arange(capacity + 1)).sum())
    share = max(1.0, volume / capacity / steps)
    price = np.zeros(capacity + 1)
    price[lengths] = (lengths / capacity) ** 1.3
    least, left, patterns = price * 0.5, demand.copy(), {}
    for _ in range(steps):
        live = np.where(left > 0, price, 0)
        if not live.any():
            break
        pattern = np.minimum(best_pattern(live, capacity), left)
        used = np.flatnonzero(pattern)
        step = int(min(np.ceil(share), (left[used] // pattern[used]).min()))
        key = pattern.tobytes()
        patterns[key] = patterns.get(key, 0) + step
        left[used] -= pattern[used] * step
        price[used] *= np.exp(-0.5 * pattern[used] * step / demand[used])
        price = np.maximum(price, least)
    return [(np.frombuffer(k, dtype=np.int64), x) for k, x in patterns.items()]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """``([(length, copies), ...], times)`` patterns that hold every piece of the histogram exactly once.

    Lengths and counts alone come to the driver: ``capacity`` numbers at most, whatever the size of the corpus. Full pieces take a
    sequence each. Each round solves the linear program for what is left and takes its patterns whole times, as far as pieces
    are left to fill them; what the rounds leave over is put, longest first, into the fullest sequence that has room.
    """
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        demand[length] = count
    plan: list[tuple[list[tuple[int, int]], int]] = []
    if demand[capacity]:
        plan.append(([(capacity, 1)], int(demand[capacity])))
        demand[capacity] = 0
    sizes = np.arange(capacity + 1)
    for _ in range(ROUNDS):
        if demand.sum() <= 256:
            break
        taken = False
        for pattern, times in sorted(configuration_lp(demand, capacity), key=lambda x: (-int(np.flatnonzero(x[0]).max()), x[0].tobytes())):
            used = np.flatnonzero(pattern)
            if (pattern * sizes).sum() < capacity:
                continue  # not full: left to a later round or to best fit
            whole = int(min(times, (demand[used] // pattern[used]).min()))
            if whole > 0:
                demand[used] -= pattern[used] * whole
                plan.append(([(int(s), int(pattern[s])) for s in used[::-1]], whole))
                taken = True
        if not taken:
            break
    return plan + best_fit(demand, capacity)


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts by length: sequences that are filled alike are handled together."""
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}  # room left: {content: sequences}
    for length in range(capacity, 0, -1):
        count = int(demand[length])
        while count:
            room = next((r for r in range(length, capacity + 1) if open_.get(r)), None)
            if room is None:
                each = capacity // length  # equal sequences at once, the last one with what remains
                many, rest = divmod(count, each)
                for copies, times in ((each, many), (rest, 1)):
                    if copies and times:
                        held = open_.setdefault(capacity - copies * length, {})
                        held[((length, copies),)] = held.get(((length, copies),), 0) + times
                break
            content, times = open_[room].popitem()
            each = min(room // length, count)
            many = min(times, count // each)
            if many < times:
                open_[room][content] = times - many
            held = open_.setdefault(room - each * length, {})
            longer = (*content, (length, each))
            held[longer] = held.get(longer, 0) + many
            count -= each * many
    return [(list(content), times) for held in open_.values() for content, times in held.items()]


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length, columns (first rank, first sequence, copies, offset): where the pieces of that length go, in order of rank."""
    by, ranks, sequence = {}, {}, 0
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            by.setdefault(length, []).append((ranks.get(length, 0), sequence, copies, offset))
            ranks[length] = ranks.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in by.items()}


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (length and keys doc_id, piece; written already) with ``sequence_id`` and ``offset``.

    Pieces of one length are interchangeable: each gets a rank among them, and ranks map to slots. Ranks are counted in SALTS
    sub-groups of a length whose starts are summed first, so a length that a third of all pieces has is ranked by many tasks.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    held = counts.collect()  # capacity * SALTS rows at most
    histogram: dict[int, int] = {}
    starts = []
    for row in sorted(held, key=lambda r: (r["length"], r["_salt"])):
        starts.append((row["length"], row["_salt"], histogram.get(row["length"], 0)))
        histogram[row["length"]] = histogram.get(row["length"], 0) + row["_n"]
    where = slots(plan_patterns(histogram, capacity))
    start = pieces.sparkSession.createDataFrame(pd.DataFrame(starts, columns=["length", "_salt", "_start"]).astype("int64") if starts else [], "length long, _salt long, _start long")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(start), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_start"))

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, rows in batch.groupby("length").groups.items():
                at = where[length]
                ranks = batch["_rank"].to_numpy(np.int64)[rows]
                slot = at[np.searchsorted(at[:, 0], ranks, side="right") - 1]
                past = ranks - slot[:, 0]
                sequence[rows] = slot[:, 1] + past // slot[:, 2]
                offset[rows] = slot[:, 3] + past % slot[:, 2] * length
            yield batch[names].assign(sequence_id=sequence, offset=offset)

    return ranked.select(*names, "_rank").mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2, ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece: every piece once, sequences gapless from 0.

    Null text counts as empty; rows with the same doc_id are packed each on their own; an empty table gives no rows; extra columns
    are ignored. Equal lengths are ranked by doc_id, so the same input gives the same packing.
    """
    return place(materialise(token_pieces(docs, tokenizer_path, capacity, end_id, ranks_path=ranks_path), "pieces", keep=True), capacity)
