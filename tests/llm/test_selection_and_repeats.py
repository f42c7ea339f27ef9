"""Phrases, repeated passages and the importance draw against plain Python, over odd tables and whole queries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import collocations, queries, resampling, suffix_dedup

PASSAGE = "".join(random.Random(5).choice("abcdefgh ") for _ in range(320))
OTHER = "".join(random.Random(6).choice("abcdefghé ") for _ in range(260))


def texts():
    r = random.Random(7)
    filler = lambda n: "".join(r.choice("ijklmnopqrst ,.") for _ in range(n))
    out = [None, "", " ", "short", "A b, C d. a b; c d\n" * 40, filler(300) + PASSAGE + filler(50), PASSAGE[:250] + filler(400), filler(10) + PASSAGE[20:219] + filler(10)]
    out += [filler(100) + OTHER + filler(100), OTHER, OTHER, filler(30) + PASSAGE[60:] + OTHER[:230] + filler(5), "x" * 450, "ab" * 130, filler(5000), filler(700) + "x" * 199, "x" * 205 + filler(20)]
    out += [" ".join(r.choice(["new york", "san francisco bay", "the", "of", "état libre", "#1 u2"]) for _ in range(90)) for _ in range(12)]
    return out


def documents():
    found = [(i, t, ["en", None, "und", "de"][i % 4]) for i, t in enumerate(texts())] + [(7, "an id that repeats, with words of its own", "en"), (None, "no id " * 30, "de"), (None, None, None)]
    found += [found[21], found[21]]
    return [(*row, "x", "x", "x", "x") for row in found]


SCHEMA = "doc_id long, text string, lang string, row string, word string, rank string, score string"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "San Francisco bay, 7 words"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_collocations", "op12_suffix_dedup", "op13_importance_resampling"])
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_collocations(rows, least=2, most=3, least_count=10, share=50, top=2000):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f = Counter()
        for text in (lower(r[1] or "") for r in rows if (r[2] or "und") == lang):
            for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                words = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = [p for p, a in f.items() if least <= len(p) <= most and a >= least_count]
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p in candidates:
            a = f[p]
            if any(len(q) > len(p) and inside(p, q) and 100 * f[q] >= share * a for q in candidates):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations(spark, path):
    got = sorted(map(tuple, queries.QUERIES["op11_collocations"](spark, path).select(COLUMNS).collect()))
    assert got == plain_collocations(documents()) and any(len(r[2].split()) == 3 for r in got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(f"select {', '.join(COLUMNS)} from ({queries.ORACLE_SQL['op11_collocations']})").fetchall()) == got


@pytest.mark.parametrize("most, top", [(5, 7), (2, 3)])
def test_longer_collocations_in_small_blocks(spark, path, monkeypatch, most, top):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = collocations.collocations(docs, 2, most, 4, 70, top)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == plain_collocations(documents(), 2, most, 4, 70, top)


def test_products_past_64_bits(spark):
    score = spark.range(1).selectExpr("(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(f as decimal(18,0)) * cast(f + 1 as decimal(18,0))) as s".replace("f", "900000000000000"))
    assert score.first().s == 10**6 * 900000000000000**2 // (900000000000000 * 900000000000001)


def test_suffix_order():
    r = random.Random(3)
    for _ in range(400):
        text = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 60))] + [0]
        assert suffix_order_of(text) == sorted(range(len(text)), key=lambda i: text[i:])  # noqa: B023
    long = [1 + (i * i) % 3 for i in range(3000)] + [1] * 500 + [0]
    assert suffix_order_of(long) == sorted(range(len(long)), key=lambda i: long[i:])


suffix_order_of = suffix_dedup.suffix_order


@pytest.mark.parametrize("length", [8, 12, 13])
def test_repeated_windows(length):
    r = random.Random(length)
    contexts = ["".join(r.choice("ab\0") for _ in range(r.randint(0, 90))).encode() for _ in range(30)]
    counts = np.array([r.choice([1, 1, 1, 2]) for _ in contexts])
    seen = Counter()
    for c, n in zip(contexts, counts, strict=True):
        seen.update({w: n * k for w, k in Counter(c[i : i + length] for i in range(len(c) - length + 1)).items()})
    got = suffix_dedup.repeated_windows(contexts, [np.full(max(0, len(c) - length + 1), n) for c, n in zip(contexts, counts, strict=True)], length)
    assert [g.tolist() for g in got] == [[seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)] for c in contexts]


def plain_repeats(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for row, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        yield row[0], len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group, windows, region", [(64 << 10, 1024, 256 << 10), (0, 1024, 256 << 10), (900, 50, 256 << 10), (64 << 10, 1024, 300)])
def test_repeats(spark, path, monkeypatch, group, windows, region):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)  # 0: all anchors are compared window by window
    monkeypatch.setattr(suffix_dedup, "CONTEXT_WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup, "REGION_BYTES", region)  # anchors each in a block of their own
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", min(region, 96 << 10))
    got = queries.QUERIES["op12_suffix_dedup"](spark, path).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = list(plain_repeats(documents(), 200))
    assert Counter(map(tuple, got.collect())) == Counter(want) and 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_repeats_keep_columns(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("spans", F.lit(1))
    out = suffix_dedup.remove_repeats(docs, 120)
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "spans", "kept"]
    want = Counter((w[0], w[2]) for w in plain_repeats(documents(), 120))
    assert Counter((r.doc_id, sum(s.end - s.start for s in r.spans)) for r in out.collect()) == want


def plain_draw(rows, target, percent=10, buckets=10_000, least_words=20, seed=2024, least=1, most=1):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = pattern.findall(lower(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(least, most + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(b for r in rows for b in features(r[1])[1]), Counter(b for x in target for b in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        n, found = features(r[1])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((n, r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[0] >= least_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    ranks = {}
    for rank, r in enumerate(order[: len(order) * percent // 100], 1):
        ranks.setdefault(r, []).append(rank)
    return Counter((*r[1:], ranks[r].pop(0) if ranks.get(r) else None) for r in out)


@pytest.mark.parametrize("options", [{}, {"percent": 90, "buckets": 50, "least": 1, "most": 3, "seed": 3}, {"percent": 55, "least": 2, "most": 2}, {"percent": 100}, {"percent": 0}])
def test_draw(spark, path, options):
    docs, target = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    got = resampling.resample(docs, target, **options) if options else queries.QUERIES["op13_importance_resampling"](spark, path)
    got = got.select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == plain_draw(documents(), ["San Francisco bay, 7 words", None, ""], **options)


def test_first_k_by_digits(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DIGIT", 3)
    r = random.Random(1)
    values = [(r.choice([-(2**63), 2**63 - 1, 0, -1, 5, 6, 7, 1000]), r.randint(-3, 3), i) for i in range(300)]
    rows = spark.createDataFrame(values, "a long, b long, c long").cache()
    for k in (0, 1, 7, 150, 299, 300):
        taken = resampling.first_k(rows, [F.col("a"), F.bitwise_not("b"), F.col("c")], k)
        assert sorted(map(tuple, rows.where(taken).collect())) == sorted(sorted(values, key=lambda v: (v[0], -v[1], v[2]))[:k])


def test_batches_are_worked_in_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], ["n"])
    pieces = list(suffix_dedup._slices(iter([batch, batch.slice(0, 0), batch]), 4))
    assert [p.num_rows for p in pieces] == [4, 4, 2, 4, 4, 2] and [x for p in pieces[:3] for x in p.column(0).to_pylist()] == list(range(10))


def test_contexts_are_the_same_without_asking_for_double_anchors():
    text = np.random.default_rng(3).integers(97, 101, 3000).astype(np.uint8).tobytes() * 2
    for whole, bare in zip(suffix_dedup.contexts_of(text, 200)[:3], suffix_dedup.contexts_of(text, 200, False)[:3], strict=True):
        assert whole.tolist() == bare.tolist()
    assert suffix_dedup.contexts_of(b"ab" * 500, 200)[3].any() and not suffix_dedup.contexts_of(b"ab" * 500, 200, False)[3].any()
