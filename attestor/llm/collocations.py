"""Phrase collocations by hierarchical pair naming.

Words that are frequent get ids; a phrase of k words is the pair of the ids of its first and its last k - 1 words, and frequent pairs
get ids of their own, in rounds. Texts are cut once into blocks of local codes. In each round a block's distinct pairs, not its
occurrences, meet those of all blocks: they are counted, and the frequent ones bring their new id back to the places in the blocks that
have them. A name has at most one row from a block, so no name gathers more rows than there are blocks. The pair of ids that names a
phrase also points at its two parents, from which the counts of both sides of each cut are read, and to which a longer phrase that
holds them is told.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Bytes of text after which a block of codes ends; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Parts in which a language's phrases are ranked before their best meet.
SALTS = 64
#: A-Z become a-z, the bytes .,;:!? and line breaks become \n, a tab a blank.
PHRASE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))


#: Distinct codes of a block in a row at most: rows stay small, whatever a block holds.
ENTRIES = 8192
#: Texts of a batch that are in Python's memory at once.
SLICE = 256


def _packed(codes: np.ndarray) -> bytes:
    """Codes from -1 on, compressed."""
    return zstandard.compress((codes + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # the four bytes apart


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64) - 1


def word_blocks(docs: DataFrame) -> DataFrame:
    """``block, lang, first, words, counts, codes``: texts in blocks of one language, as places in the block's list of distinct words.

    A row has ENTRIES of the words from place ``first`` on; the first row has the codes of the texts, where -1 ends a piece. Null
    texts count as empty, a null lang as ``und``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, list] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            vocabulary, codes, _ = open_blocks.pop(lang)
            codes, block = np.asarray(codes, np.int64), uuid.uuid4().int >> 65
            counts = np.bincount(codes[codes >= 0], minlength=len(vocabulary))
            words = [w.decode() for w in vocabulary]
            for first in range(0, max(1, len(words)), ENTRIES):
                lists = pa.array([words[first : first + ENTRIES]], pa.list_(pa.string())), pa.array([counts[first : first + ENTRIES]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([first], pa.int32()), *lists, pa.array([None if first else _packed(codes)], pa.binary())], ["block", "lang", "first", "words", "counts", "codes"])

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for lang, text in zip(*(c.slice(start, SLICE).to_pylist() for c in batch.columns), strict=True):
                    block = open_blocks.get(lang)
                    if block is None:
                        block = open_blocks[lang] = [defaultdict(count().__next__), array("i"), 0]
                    vocabulary, codes, _ = block
                    for piece in text.translate(PHRASE_BYTES).split(b"\n"):
                        codes.extend([vocabulary[w] for w in piece.split(b" ") if w])
                        codes.append(-1)
                    block[2] += len(text)
                    if block[2] >= BLOCK_BYTES:
                        yield from close(lang)
        for lang in list(open_blocks):
            yield from close(lang)

    rows = docs.where("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    return rows.mapInArrow(cut, "block long, lang string, first int, words array<string>, counts array<long>, codes binary")


def paired(codes: np.ndarray, named: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of adjacent (``k`` - 1)-grams of a block: ids left and right, counts, and the new codes (-1: no pair).

    ``named``: places and ids of the frequent grams of 1 to ``k`` - 1 words. The places of grams are those of the distinct pairs
    in order, so each round finds the rounds before again from the words' codes and the names.
    """
    for size in range(1, k):
        places, ids = named.get(size, (np.empty(0, np.int64),) * 2)
        local = np.full(max(codes.max(initial=-1), places.max(initial=-1)) + 2, -1, np.int64)  # the last place is that of code -1
        local[places] = np.arange(len(places))
        at = local[codes]
        valid = (at[:-1] >= 0) & (at[1:] >= 0)
        found, new, counts = np.unique(at[:-1][valid] * max(1, len(places)) + at[1:][valid], return_inverse=True, return_counts=True)
        codes = np.full(len(valid), -1, np.int64)
        codes[valid] = new
    return ids[found // max(1, len(places))], ids[found % max(1, len(places))], counts, codes


def pair_entries(codes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``block, at, left, right``: the distinct pairs of each block that name phrases of ``k`` words; ``at``: their place and count (_at).

    ``codes`` (block, codes), ``ids`` (block, size, place, id) of the frequent grams of 1 to ``k`` - 1 words. Pairs that have an
    infrequent side, or stand on both sides of a piece's end, are none.
    """

    def pairs(block: pa.Table, found: pa.Table) -> pa.Table:
        left = right = counts = np.empty(0, np.int64)
        if block.num_rows and found.num_rows:
            sizes, places, names = (found.column(c).to_numpy() for c in ("size", "place", "id"))
            named = {n: (places[sizes == n], names[sizes == n]) for n in range(1, k)}
            named = {n: tuple(x[np.argsort(p)] for x in (p, i)) for n, (p, i) in named.items()}
            left, right, counts, _ = paired(_unpacked(block.column("codes")[0].as_py()), named, k)
        whose = np.full(len(left), block.column("block")[0].as_py() if block.num_rows else 0, np.int64)
        return pa.table({"block": whose, "at": np.arange(len(left)) << 32 | counts, "left": left, "right": right})

    theirs = ids.select(F.col("block").alias("of"), "size", "place", "id")
    return codes.groupBy("block").cogroup(theirs.groupBy("of")).applyInArrow(pairs, "block long, at long, left long, right long")


def _at(place: Column, n: Column) -> Column:
    """A name's place and count in a block, which has fewer than 2 ** 31 words, as one number."""
    return F.shiftleft(place.cast("long"), 32).bitwiseOR(n.cast("long"))


def _count(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(2**32 - 1))


def _named(entries: DataFrame, keys: list[str], least_count: int) -> DataFrame:
    """``block, place, keys, f, id`` of the entries (block, at, keys) whose name, told by ``keys``, all blocks together have often enough."""
    name = Window.partitionBy(*keys)
    told = entries.repartition(*keys).withColumn("_row", F.monotonically_increasing_id())
    told = told.select("block", F.shiftright("at", 32).alias("place"), *keys, F.sum(_count("at")).over(name).alias("f"), F.min("_row").over(name).alias("id"))
    return told.where(F.col("f") >= least_count)


def frequent_phrases(docs: DataFrame, most: int = 3, least_count: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1 to ``most`` words, and ``lang, n`` with the count of all words.

    A row: ``id, lang, words`` (list), ``f``, ``left`` and ``right`` (ids of the first and the last k - 1 words), ``heads`` and
    ``tails`` (counts of its first and its last 1 to k words).
    """
    blocks = materialise(word_blocks(docs), "blocks")
    codes = blocks.where("codes is not null").select("block", "codes")
    totals = materialise(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals", keep=True)
    entries = blocks.select("block", "lang", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry")).select("block", _at(F.col("first") + F.col("at"), F.col("entry.counts")).alias("at"), "lang", F.col("entry.words").alias("word"))
    named = materialise(_named(entries, ["lang", "word"], least_count), "named")
    own = named.groupBy("id").agg(*[F.first(c).alias(c) for c in ("lang", "word", "f")])
    own = own.select("id", "lang", F.array("word").alias("words"), "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    tables, ids = [materialise(own, "words", keep=True)], named.select("block", F.lit(1).alias("size"), "place", "id")
    for k in range(2, most + 1):
        entries = pair_entries(codes, ids, k)
        # an id belongs to one language, so pairs of ids do
        if k < most:
            named = materialise(_named(entries, ["left", "right"], least_count), "named")
            ids = ids.unionByName(named.select("block", F.lit(k).alias("size"), "place", "id"))
            found = named.groupBy("id").agg(*[F.first(c).alias(c) for c in ("left", "right", "f")])
        else:
            found = entries.groupBy("left", "right").agg(F.sum(_count("at")).alias("f")).where(F.col("f") >= least_count).withColumn("id", F.monotonically_increasing_id())
        side = lambda name, *more: tables[-1].select(F.col("id").alias(name), *more, *[F.col(c).alias(f"{name}_{c}") for c in ("words", "heads", "tails")])  # noqa: B023, E731
        found = found.join(side("left", "lang"), "left").join(side("right"), "right")
        found = found.select(
            "id", "lang", F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"), "f", "left", "right",
            F.concat("left_heads", F.array("f")).alias("heads"), F.concat("right_tails", F.array("f")).alias("tails"),
        )
        tables.append(materialise(found, "phrases", keep=True))
    return tables, totals


def collocations(docs: DataFrame, least: int = 2, most: int = 3, least_count: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of ``least`` to ``most`` words.

    ``docs``: lang, text. A phrase stands ``a`` >= ``least_count`` times inside pieces of text; of its cuts into two parts, which
    stand l and r times, the one with the lowest score floor(10^6 a^2 / (l r)) counts, ties to the shortest first part. A phrase
    goes if a longer one holds it and has at least ``share`` hundredths of its count. ``n``: all words of the language. Equal
    scores rank by count, then by the phrase's bytes.

    Null texts count as empty, a null lang as ``und``; repeated rows count as often as they stand there; long texts are whole;
    an empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession):
        tables, totals = frequent_phrases(docs, most, least_count)
        ranked = None
        for k in range(max(2, least), most + 1):
            cuts = [
                F.struct(F.expr(f"(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(heads[{j - 1}] as decimal(18,0)) * cast(tails[{k - j - 1}] as decimal(18,0)))").alias("score"), F.lit(j).alias("cut"), F.expr(f"heads[{j - 1}]").alias("l"), F.expr(f"tails[{k - j - 1}]").alias("r"))
                for j in range(1, k)
            ]
            own = tables[k - 1]
            if k < most:  # whatever longer phrase holds it, the one a word longer stands at least as often
                longer = tables[k].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), F.col("f").alias("held")).groupBy("id").agg(F.max("held").alias("held"))
                own = own.join(longer, "id", "left").where(f"held is null or 100 * held < {share} * f")
            own = own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.least(*cuts).alias("cut") if len(cuts) > 1 else cuts[0].alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
            ranked = own if ranked is None else ranked.unionByName(own)
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        best = materialise(best.drop("salt"), "ranked", keep=True)
        return best.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 2, most: int = 3, least_count: int = 10, share: int = 50, top: int = 2000) -> str:
    """DuckDB's SQL for the same rows over ``documents``."""
    grams = "\nunion all ".join(
        f"select lang, {k} as k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: {' || '.join(chr(39) + ' ' + chr(39) + f' || w[i + {j}]' if j else 'w[i]' for j in range(k))})) as g from pieces" for k in range(1, most + 1)
    )
    return f"""
with texts as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
pieces as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as p from texts)),
grams as ({grams}),
f as (select lang, k, g, count(*) as f from grams group by all),
frequent as materialized (select * from f where f >= {least_count}),
cuts as (select lang, k, g, f, unnest(range(1, k)) as c, string_split(g, ' ') as w from frequent where k between {least} and {most}),
scored as (select c.lang, c.k, c.g, c.f, c.c, l.f as l, r.f as r, ((1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f)) as score
  from cuts c join frequent l on l.lang = c.lang and l.g = array_to_string(c.w[:c.c], ' ') join frequent r on r.lang = c.lang and r.g = array_to_string(c.w[c.c + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, c) = 1),
parts as (select lang, f, string_split(g, ' ') as w, k, unnest(range({least}, k)) as size from frequent where k between {least + 1} and {most}),
starts as (select lang, f, w, size, unnest(range(1, k - size + 2)) as i from parts),
held as (select lang, array_to_string(w[i:i + size - 1], ' ') as g, max(f) as held from starts group by all),
kept as (select b.* from best b left join held h on h.lang = b.lang and h.g = b.g where h.held is null or 100 * h.held < {share} * b.f),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang)
select lang, rank, g as phrase, f as a, l, r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, f desc, g) as rank from kept) join n using (lang) where rank <= {top}"""
