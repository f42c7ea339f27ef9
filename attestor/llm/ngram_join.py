"""Exact n-gram Jaccard join of whole texts: size bands, tiles, hashed bitmap signatures, sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, scratch, shuffle_partitions, small, without
from .components import connected_components

#: A size band reaches from a size to 7/5 of it.
BAND_NUM, BAND_DEN = 7, 5
#: Members of a tile that one task compares at once; larger tiles are cut into squares of so many by so many.
TILE = 2048
#: Members from which on a cell's maps are compared many at once.
LARGE = 256
#: Smallest keys by which two members of several tiles agree in which one they are compared.
SKETCH = 32
#: Sets that a task hands on at once.
ROWS = 256
#: Word hashes a task remembers at most.
MAX_WORDS = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def bands(largest: int) -> list[int]:
    """Upper sizes of the bands up to one that holds ``largest``."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * BAND_NUM // BAND_DEN))
    return tops


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; words keep their hash within a bounded table."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() lower-cases A-Z alone, and bytes.split() cuts at U+0020 and U+0009 to U+000D alone
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words) + 1)] if words else [], dtype=np.uint64)
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        h = np.array(hashes, dtype=np.uint64)
        out = h[: len(h) - self.n + 1].copy()
        for i in range(1, self.n):
            out = _mix(out * _A + h[i : len(h) - self.n + 1 + i])
        return np.unique(out)


class Rule:
    """Jaccard similarity of at least ``percent`` / 100, in whole numbers."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be 1 to 100")
        self.percent = percent

    def enough(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def most_apart(self, a: int, b: int) -> int:
        """Elements in one set alone, at most, of a linked pair of these sizes."""
        # both >= p (a + b) / (100 + p), so a + b - 2 both <= (a + b) (100 - p) / (100 + p)
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, a: int) -> int:
        return 100 * a // self.percent


def bucket_count(rule: Rule, top: int) -> tuple[int, int]:
    """Buckets for sets of up to ``top`` elements, and how many may be empty before empty ones count as well."""
    apart = rule.most_apart(top, top)
    spare = 0 if not apart else apart // 8 + 1
    return apart + 1 + spare, spare


def tile_keys(rule: Rule, hashes: np.ndarray) -> np.ndarray:
    """Keys of which any two linked sets share one at least.

    The hashes of a set fall into the buckets of its size band by their upper bits, and a bucket's key is a hash of its content.
    Linked sets differ in fewer elements than there are buckets, so one bucket has the same content in both. ``spare`` buckets
    are added for buckets that are empty in both; a set with more empty buckets than that gives keys for its empty buckets too.
    Sets whose partner may be in the next band give keys for that band as well.
    """
    size = len(hashes)
    tops = bands(rule.largest_partner(size))
    own = next(i for i, top in enumerate(tops) if top >= size)
    upper = hashes >> np.uint64(32)
    out = []
    for band in range(own, len(tops)):
        if band > own and rule.largest_partner(size) <= tops[band - 1]:
            break
        count, spare = bucket_count(rule, tops[band])
        bucket = (upper * np.uint64(count)) >> np.uint64(32)  # ascending, as the hashes are
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        content = np.add.reduceat(_mix(hashes), starts)
        label = np.uint64(band * 2 + 1)
        out.append(_mix(_mix(content) + _mix(bucket[starts] * _A + label)))
        if count - len(starts) > spare:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), bucket[starts])
            out.append(_mix(empty * _B + _mix(np.array([label + np.uint64(1)], dtype=np.uint64))))
    return np.unique(np.concatenate(out))


def bitmap(hashes: np.ndarray) -> bytes:
    """Hashed bitmap of the smallest power of two of bits that is 4 times the size or more, 64 at least."""
    width = 64
    while width < 4 * len(hashes):
        width *= 2
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (the last axis) of ``width`` words from wider ones: bit i of all pieces of a map together."""
    if bits.shape[-1] <= width:
        return bits
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, width), axis=-2)


def most_common(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets of these sizes and bitmaps: bits in one map alone are elements of one set alone."""
    width = min(a.shape[-1], b.shape[-1])
    a, b = _folded(a, width), _folded(b, width)
    return np.minimum(na - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))


def bits_in_common(na: int, nb: int, a: bytes, b: bytes) -> int:
    """``most_common`` of two sets alone: their maps are whole numbers, the wider one folded in halves."""
    x, y, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * min(len(a), len(b))
    for half in (4 * max(len(a), len(b)) >> i for i in range(64)):
        if half < width:
            break
        low = (1 << half) - 1
        x, y = (x >> half | x & low, y) if len(a) > len(b) else (x, y >> half | y & low)
    both = x & y
    return min(na - x.bit_count(), nb - y.bit_count()) + both.bit_count()


def may_link(rule: Rule, n: np.ndarray, maps: list[np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` member i may be linked with: bits in one map alone bound the overlap from above."""
    if not len(others):
        return np.zeros(0, dtype=bool)
    width = min(len(maps[i]), *(len(maps[j]) for j in others))
    mine, theirs = _folded(maps[i], width), np.stack([_folded(maps[j], width) for j in others])
    return rule.enough(most_common(n[i], n[others], mine, theirs), n[i], n[others])


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit digest of a whole set, so equal sets are one class; 0 for the empty one."""
    return int(np.int64(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)) - (1 << 63))) if len(hashes) else 0


def shingle_rows(docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """Two kinds of rows: of every document (kind 0: doc_id, class, size), and of every distinct set that a task meets (kind 1: key,
    class). A class is a 64-bit digest of the whole set, so equal sets are one node from here on, before any shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen = Shingler(n), set()
        for batch in batches:
            ids, classes, sizes, keys, owners = [], [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                hashes = shingles(text)
                digest = class_of(hashes)
                ids.append(doc)
                classes.append(digest)
                sizes.append(len(hashes))
                if len(hashes) and digest not in seen:
                    if len(seen) > MAX_WORDS:
                        seen.clear()
                    seen.add(digest)
                    k = tile_keys(rule, hashes)
                    keys.append(k.view(np.int64))
                    owners.append(np.full(len(k), digest, dtype=np.int64))
                if sum(map(len, keys)) > 200_000:
                    yield frame(ids, classes, sizes, keys, owners)
                    ids, classes, sizes, keys, owners = [], [], [], [], []
            yield frame(ids, classes, sizes, keys, owners)

    def frame(ids, classes, sizes, keys, owners) -> pd.DataFrame:
        k, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owners))
        spread = np.array([xxhash.xxh3_64_intdigest(str(i)) for i in ids], dtype=np.uint64).view(np.int64)
        docs_part = pd.DataFrame({"k": spread, "class": np.array(classes, dtype=np.int64), "doc_id": pd.array(ids, dtype="Int64"), "size": pd.array(sizes, dtype="Int64")})
        keys_part = pd.DataFrame({"k": k, "class": o, "doc_id": pd.array([pd.NA] * 0, dtype="Int64").take([-1] * len(k), allow_fill=True), "size": pd.array([pd.NA] * 0, dtype="Int64").take([-1] * len(k), allow_fill=True)})
        return pd.concat([docs_part, keys_part], ignore_index=True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "k long, class long, doc_id long, size long")


def shared_rows(rows: DataFrame, partitions: int) -> DataFrame:
    """Of rows dealt by key, the document rows and the distinct (key, class) rows of keys with two classes at least.

    Spark sorts what a task was dealt, by key and class, and the task reads it in order with one row kept back, so a key of any
    number of rows needs no more memory than another. Keys that one class alone has end here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, int, bool] | None = None  # key, class, and whether the key had another class before
        for batch in batches:
            is_doc = batch["size"].notna()
            if is_doc.any():
                yield batch[is_doc]
                batch = batch[~is_doc]
            k, c = batch["k"].to_numpy(np.int64), batch["class"].to_numpy(np.int64)
            if last:
                k, c = np.r_[last[0], k], np.r_[last[1], c]
            if not len(k):
                continue
            fresh = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            k, c = k[fresh], c[fresh]
            same = k[1:] == k[:-1]
            before = np.r_[bool(last and last[2]), same]
            shared = before[:-1] | same
            yield frame(k[:-1][shared], c[:-1][shared])
            last = int(k[-1]), int(c[-1]), bool(before[-1])
        if last and last[2]:
            yield frame(np.array([last[0]]), np.array([last[1]]))

    def frame(k: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        none = pd.array([None] * len(k), dtype="Int64")
        return pd.DataFrame({"k": k, "class": c, "doc_id": none, "size": none})

    dealt = rows.repartition(partitions, "k").sortWithinPartitions("k", "class")
    return dealt.mapInPandas(run, "k long, class long, doc_id long, size long")


def exact_links(pairs: DataFrame, sets: DataFrame, rule: Rule, name: str) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets are similar enough: bit counts first, then the sorted arrays themselves."""

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for (wa, wb), at in batch.groupby([batch["map_a"].str.len(), batch["map_b"].str.len()]).indices.items():
                part = batch.iloc[at]
                maps = (np.frombuffer(b"".join(part[m]), np.uint64).reshape(len(at), w // 8) for m, w in (("map_a", wa), ("map_b", wb)))
                na, nb = part["size_a"].to_numpy(np.int64), part["size_b"].to_numpy(np.int64)
                keep[at] = rule.enough(most_common(na, nb, *maps), na, nb)
            yield batch.loc[keep, ["a", "b"]]

    def intersected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
                both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))), kind="stable")  # merges two sorted runs
                keep.append(bool(rule.enough(int((both[1:] == both[:-1]).sum()), len(x) // 8, len(y) // 8)))
            yield batch.loc[keep, ["a", "b"]]

    def side(s: str, *columns: str) -> DataFrame:
        return sets.select(F.col("class").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])

    near = pairs.join(side("a", "size", "map"), "a").join(side("b", "size", "map"), "b").mapInPandas(bounded, "a long, b long")
    near = materialise(near, f"{name}-bounded")
    arrays = near.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").select("a", "b", "hashes_a", "hashes_b")
    return materialise(arrays.mapInPandas(intersected, "a long, b long"), name)


def tile_cells(tiles: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(told, cells)``: (k, class) of tiles that hold several groups, and (k, i, j, rest, class, grp) of their members,
    dealt to cells of TILE by TILE.

    Members of a tile's largest group need no look at each other: block i holds all members, block j those of other groups alone
    (``rest``). So a member of the largest group is copied once for each TILE members of other groups, however large its own is.
    """
    told = tiles.join(groups, F.col("node") == F.col("class"), "left").select("k", "class", F.coalesce("component", "class").alias("grp"))
    sizes = told.groupBy("k", "grp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("grp", F.struct("n", "grp")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    mixed = mixed.select("k", "largest", F.ceil(F.col("n") / TILE).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("most")) / TILE).cast("int").alias("rest_blocks"))
    told = materialise(told.join(mixed, "k"), "ngram-mixed")
    block = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = told.select("k", block("all_blocks").alias("i"), blocks("rest_blocks").alias("j"), F.lit(False).alias("rest"), "class", "grp")
    rest = told.where("grp <> largest").select("k", blocks("all_blocks").alias("i"), block("rest_blocks").alias("j"), F.lit(True).alias("rest"), "class", "grp")
    return told, whole.unionByName(rest)


def tile_pairs(members: DataFrame, rule: Rule, forest: bool = False) -> DataFrame:
    """Distinct ``(a, b)`` of members of one tile (a key) in different groups whose bit counts allow a link.

    ``members``: k, i, j, rest, class, grp, size, map, keys, sorted by (k, i, j), as ``tile_cells`` deals them. ``keys``:
    the SKETCH smallest keys of the member's tiles, in order. Copies share most of their tiles: a pair is given by the tile of its
    smallest common key alone. Pairs without a common key among these are given by each of their tiles. ``forest``: as if every
    pair that the bit counts allow were a link, only pairs that join groups which no pair of the cell has joined before.
    """

    def cell(c: dict) -> Iterator[pd.DataFrame]:
        n, classes, grp, keys, k = c["size"], c["class"], c["grp"], [x.tolist() for x in c["keys"]], c["k"]
        rest, whole = ([i for i, r in enumerate(c["rest"]) if r == side] for side in (True, False))
        in_rest, in_whole = ({classes[i] for i in side} for side in (rest, whole))
        large = len(whole) > LARGE
        sizes, places = np.array(n), np.array(whole)
        maps = [np.frombuffer(m, np.uint64) for m in c["map"]] if large else c["map"]
        joined: dict[int, int] = {}  # a group that another has taken in, and that one

        def root(g: int) -> int:
            while g in joined:
                g = joined[g]
            return g

        found_a, found_b = [], []
        for x in rest:
            mine, met = set(keys[x]), set()
            for y in places[may_link(rule, sizes, maps, x, places)].tolist() if large else whole:
                other = root(grp[y])
                if other == root(grp[x]) or forest and other in met:
                    continue
                # a pair that stands on both sides of this cell is taken in one order
                if classes[y] > classes[x] and classes[y] in in_rest and classes[x] in in_whole:
                    continue
                if next((key for key in keys[y] if key in mine), k) != k:
                    continue
                if large or rule.enough(bits_in_common(n[x], n[y], maps[x], maps[y]), n[x], n[y]):
                    found_a.append(classes[x])
                    found_b.append(classes[y])
                    met.add(other)
            if forest:
                for other in met:
                    joined[other] = root(grp[x])
        yield pd.DataFrame({"a": np.minimum(found_a, found_b).astype(np.int64), "b": np.maximum(found_a, found_b).astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                k, i, j, rest, cls, grp, size, bits, keys = row
                if (k, i, j) != at:
                    if now and len(now["size"]) > 1:
                        yield from cell(now)
                    at, now = (k, i, j), {"k": k, "size": [], "grp": [], "class": [], "map": [], "rest": [], "keys": []}
                for name, value in (("size", size), ("grp", grp), ("class", cls), ("map", bits), ("rest", rest), ("keys", keys)):
                    now[name].append(value)
        if now and len(now["size"]) > 1:
            yield from cell(now)

    return members.mapInPandas(run, "a long, b long").distinct()


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: every document's (doc_id, class, size), and (a, b) links between classes, whose groups are whole.

    1. Every document gives keys by size band; rows are dealt by key, and keys of one class end there.
    2. Stars: every class is compared with the smallest class of the tile that it shares most often, so copies fall into groups
       without all their pairs.
    3. Tiles: in each tile that still has several groups, members of different groups are compared through their bitmaps inside
       the task, and those that may be linked by their arrays. First a forest of such pairs alone, which joins most groups;
       then all pairs between groups that are still apart, so no link between groups is lost.
    """
    spark, rule = docs.sparkSession, Rule(percent)
    docs = docs.select("doc_id", "text")
    rows = materialise(shared_rows(shingle_rows(docs, n, rule), shuffle_partitions(spark)), "ngram-rows", keep=True)
    members = rows.where("size is not null").select("doc_id", "class", "size")
    tiles = rows.where("size is null").select("k", "class")
    hubs = tiles.groupBy("k").agg(F.min("class").alias("a"))
    votes = tiles.join(hubs, "k").where("class <> a").groupBy("class", "a").count()
    stars = materialise(votes.groupBy(F.col("class").alias("b")).agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"), "ngram-stars")

    wanted = tiles.select("class").distinct()
    firsts = members.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    picked = small(materialise(firsts, "ngram-firsts"))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(n)
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # a set takes more room than its text
                part = batch.iloc[at : at + ROWS]
                sets = [shingles(t) for t in part["text"]]
                digests = [class_of(s) for s in sets]
                fits = (part["class"] == digests).to_numpy()  # another row with this doc_id may have another text
                yield pd.DataFrame({"class": digests, "size": [len(s) for s in sets], "map": [bitmap(s) for s in sets], "hashes": [s.tobytes() for s in sets]})[fits]

    repeated = members.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    found = docs.join(picked, "doc_id").select("class", "text").mapInPandas(described, "class long, size long, map binary, hashes binary")
    sets = materialise(found.dropDuplicates(["class"]) if repeated else found, "ngram-sets")
    links = exact_links(stars, sets, rule, "ngram-star-links")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for forest in (True, False):
        groups = connected_components(links)
        told, cells = tile_cells(tiles, groups)
        smallest = told.select("class", "k", F.row_number().over(Window.partitionBy("class").orderBy("k")).alias("r"))
        sketches = smallest.where(F.col("r") <= SKETCH).groupBy("class").agg(F.array_sort(F.collect_list("k")).alias("keys"))
        sets_with_keys = sets.select("class", "size", "map").join(sketches, "class")
        cells = cells.join(sets_with_keys, "class").select("k", "i", "j", "rest", "class", "grp", "size", "map", "keys")
        cells = cells.repartition(shuffle_partitions(spark), "k", "i", "j").sortWithinPartitions("k", "i", "j")
        pairs = materialise(tile_pairs(cells, rule, forest).join(tried, ["a", "b"], "left_anti"), "ngram-tile-pairs")
        links, tried = links.unionByName(exact_links(pairs, sets, rule, "ngram-tile-links")), tried.unionByName(pairs)
    return members, links


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per document of ``docs`` (doc_id, text).

    ``n_shingles``: size of the set of distinct n-word shingles (A-Z lower-cased; fewer words: the whole sequence as one; null,
    empty or blank text: empty, linked with nothing). ``component_id``: the smallest doc_id that links reach, itself included; two
    documents are linked when 100 * intersection >= percent * union. Sets are compared by 64-bit shingle hashes. Rows with
    the same doc_id are kept one by one; extra columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        members, told = class_components(docs, n, percent)
    out = members.join(told, (F.col("class") == F.col("_class")) & (F.col("size") > 0), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(members, told)``: every document's class, and (_class, component_id) of the classes that are not empty."""
    members, links = similar_classes(docs, n, percent)
    groups = connected_components(links)
    low = members.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    low = low.join(groups, F.col("node") == F.col("class"), "left").select("class", "low", F.coalesce("component", "class").alias("grp"))
    least = low.groupBy("grp").agg(F.min("low").alias("component_id"))
    return members, materialise(low.join(least, "grp").select(F.col("class").alias("_class"), "component_id"), "ngram-told", keep=True)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component; columns stay. Rows without a doc_id stay."""
    return without(docs, ngram_components(docs, n, percent).where("doc_id <> component_id"))
