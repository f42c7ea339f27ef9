"""Operators for training data: brute force, round trips, held-out accuracy and edge cases on small tables."""

import hashlib
import json
import re
import textwrap
import zlib
from collections import Counter
from html import escape as html_escape

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm import chat_format, components, langid, license_scan, line_dedup, media, ngram_join, packing, quality, sentencepiece_codec, token_counts, tokens
from attestor.llm.license_registry import KNOWN

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "  ", "a  b", " a", "a ", "▁y", "x▁y ▁ ▁▁z", "\n", "\n\na", "a \n b", "\n b", "a\n ", "</s> <0x0A>", "a\x00b 😀", " 　 a", "<|endoftext|> x", "x<|endoftext|> y",
    " <|endoftext|>", "tab\t x", "\x1c y\x1c z", "don't  stop  ", "ﬁ Ǻ", "word " * 3000, "y" * 5000, "a\r\nb\r\n  c", "trailing \n",
]


def odd_docs(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, line long")  # repeated rows and a clashing name


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def empty(spark):
    return docs_of(spark, [])


# 1 and 4, 6: tokens


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sentencepiece_codec.pieces_stay_in_words(sp)
    found = sentencepiece_codec.encode_documents(odd_docs(spark), path).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        ids = sp.encode(ODD[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids), repr(ODD[r.doc_id])
        assert r.decoded == sp.decode(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(empty(spark), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab<>x0é\t"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_marked_words_are_the_whole_text(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table, words = sentencepiece_codec.marked_table(sp), sentencepiece_codec.marked_words(text)
    table.learn([words])
    assert np.frombuffer(table.joined(words), "<u4").tolist() == sp.encode(text)


@pytest.fixture(scope="module")
def byte_tables():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'st12.\x1c\x85　é<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_are_the_whole_text(byte_tables, text):
    whole, table = byte_tables
    chunks = tokens.blank_chunks(text)
    table.learn([chunks])
    assert np.frombuffer(table.joined(chunks), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_special_strings_and_a_full_table(byte_tables, monkeypatch):
    whole, table = byte_tables
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 3)
    for text in [t or "" for t in ODD] * 2:
        chunks = tokens.blank_chunks(text)
        table.learn([chunks])
        assert np.frombuffer(table.joined(chunks), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        table.forget()


def test_ledger_adds_each_batch_once(spark, tmp_path):
    counts = token_counts.count_tokens(docs_of(spark, ["a b", "c", None]), P.path("byte_bpe_50k.json"), "v")
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", token_counts.insertions(counts)) and not ledger.commit("b1", token_counts.insertions(counts))
    assert [(r.documents, r.tokens, r.chars) for r in ledger.totals().collect()] == [(3, 3, 4)]
    revised = counts.where("doc_id = 0").withColumn("tokens", F.lit(10).cast("long"))
    ledger.commit("b2", token_counts.revisions(counts.where("doc_id = 0"), revised))
    assert ledger.totals().first().tokens == 11
    (tmp_path / "ledger" / "batch=died").mkdir()  # no marker: not read
    ledger.compact()
    assert ledger.totals().first().tokens == 11 and not ledger.commit("b1", token_counts.insertions(counts))
    ledger.commit("b3", token_counts.deletions(counts.where("doc_id > 0")).unionByName(token_counts.deletions(revised)))
    assert ledger.totals().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", token_counts.insertions(counts))


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plans_hold_every_piece_once(histogram):
    plan = packing.plan_patterns(histogram, 64)
    held = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(length * copies for length, copies in pattern) <= 64
        for length, copies in pattern:
            held[length] += copies * times
    assert held == histogram
    used, least = sum(t for _, t in plan), -(-sum(k * v for k, v in histogram.items()) // 64)
    assert used <= 2 * least


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 0.9, 20_000).astype(int), 1, 1023), return_counts=True)
    used = sum(t for _, t in packing.plan_patterns(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 1024))
    assert used <= 1.002 * (lengths * counts).sum() / 1024 + 1


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = packing.pack_documents(odd_docs(spark), P.path("byte_bpe_50k.json"), 64).toPandas()
    for i, text in enumerate(ODD):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        rows = found[found.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert rows["start"].tolist() == [0, *np.cumsum(rows["length"])[:-1]] and rows["length"].sum() == len(ids)
        assert (rows["length"].iloc[1:] == 64).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(rows["start"], rows["length"], strict=True)] == rows["ids_crc32"].tolist()
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *np.cumsum(rows["length"])[:-1]] and rows["length"].sum() <= 64
    assert packing.pack_documents(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


# 2: licences


def test_licences_match_across_spellings(spark):
    mit = next(t for i, t in KNOWN if t.startswith("MIT License"))
    changed = mit.upper().replace("LICENSE", "licence").replace("\n\n", "\n\nCopyright (c) 2020 Someone, Inc.\nAll rights reserved.\n\n").replace(",", " --")
    docs = docs_of(spark, [mit, changed, "x\nReleased under the MIT License\nLICENSED under the apache licence, version 2.0!!\n", mit + " more", None, ""])
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [found[i].text_license for i in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert found[2].n_license_lines == 2 and found[2].line_licenses == "Apache-2.0,MIT" and found[4].line_licenses == ""
    assert found[0].text_digest == found[1].text_digest
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_licence_sql(spark):
    docs = odd_docs(spark).union(docs_of(spark, [t for _, t in KNOWN]).selectExpr("doc_id + 100", "text", "lang", "source", "0L"))
    ours = {r.doc_id: tuple(r) for r in license_scan.scan_licenses(docs).collect()}
    documents = docs.toPandas()  # noqa: F841  read by duckdb
    theirs = {r[0]: r for r in duckdb.sql(license_scan.oracle_sql()).limit(10_000).fetchall()}
    assert ours == theirs and sum(r[2] is not None for r in ours.values()) == len(KNOWN)


@pytest.mark.parametrize("mark", ["", " * "])
def test_wrapped_licences_are_known(spark, mark):
    whole = [(i, t) for i, t in KNOWN if len(t) > 300]
    holders = "Copyright (c) 2020 Someone\n\u00a9 2021 Other\nCopyright OpenJS Foundation and others\nCopyright by A. Holder\nAll rights reserved.\n\n"
    cases = []
    for name, text in whole:
        for width in (20, 40, 60, 65, 70, 72, 76, 78, 80, 100):
            lines = [w for line in text.split("\n") for w in textwrap.wrap(line, width, break_long_words=False, break_on_hyphens=False) or [""]]
            cases.append((name, holders + "\n".join(mark + x for x in lines)))
        cases.append((name, holders + re.sub(r" (?=copyright)", "\n", text, flags=re.I)))
        cases.append((name, re.sub(r"(?<=copyright) ", "\n", re.sub(r" (?=copyright)", "\n", text, flags=re.I), flags=re.I)))
    found = {r.doc_id: r.text_license for r in license_scan.scan_licenses(docs_of(spark, [t for _, t in cases])).collect()}
    assert found == {i: name for i, (name, _) in enumerate(cases)}


# 3: lines


def test_line_dedup_keeps_one_of_each_group(spark):
    a = "the quick brown fox jumps over the lazy dog near the old river bank today"
    near, other = a.replace("lazy", "sleepy"), "entirely different words stand in this line and nothing else does at all"
    docs = docs_of(spark, [f"{a}\nshort line\n\n{other}", f"{near}\nshort line", a.upper() + "!", None, "", other + "\n" + other])
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("x"))).collect()}
    assert found[0].text == f"{a}\nshort line\n\n{other}" and found[0].n_removed == 0
    assert found[1].text == "short line" and found[2].text == "" and found[3].text is None and found[5].text == ""
    assert [found[i].n_lines for i in range(6)] == [4, 2, 1, 0, 1, 2] and found[5].n_removed == 2
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_edit_similarity_in_words(spark):
    def similar(a, b):
        row = spark.createDataFrame([(a, b)], "a string, b string").select(line_dedup.edit_similar(line_dedup.coded(F.col("a")), line_dedup.coded(F.col("b")))).first()
        return row[0]

    ten = "one two three four five six seven eight nine ten"
    assert similar(ten, ten.replace("two", "x").replace("six", "y")) and not similar(ten, ten.replace("two", "x").replace("six", "y").replace("ten", "z"))
    long = " ".join(f"w{i}" for i in range(2500))
    assert similar(long, long.replace("w1200 ", "")) and not similar(long, long[: len(long) // 2])


def test_line_dedup_of_many_near_copies(spark):
    base = [f"word{i}" for i in range(30)]
    texts = [" ".join(base[:k] + [f"new{k}x{j}"] + base[k + 1 :]) for k in range(30) for j in range(4)] + [" ".join(base)]
    found = line_dedup.dedup_lines(docs_of(spark, texts)).where("text <> ''").count()
    assert found <= 12  # pigeonhole blocks find nearly all; every group keeps one


def test_similar_lines_share_a_key(spark):
    rng, pairs = np.random.default_rng(4), []
    for n in (5, 6, 7, 8, 9, 10, 11, 13, 15, 20, 30, 40):
        for edits in {1, n // 5}:
            for k in range(200):
                a = [f"w{i}" for i in rng.integers(0, 10**9, n)]
                b = list(a)
                for at in rng.choice(n, edits, replace=False):
                    b[at] = f"w{rng.integers(0, 10**9)}"
                if k % 4 == 0 and edits == 1 and n > line_dedup.MIN_WORDS:  # a word less is one edit too
                    at = int(rng.integers(0, n))
                    b = a[:at] + a[at + 1 :]
                pairs.append((n, edits, " ".join(a), " ".join(b)))
    frame = spark.createDataFrame(pairs, "n int, edits int, a string, b string")
    for side in "ab":
        frame = line_dedup.with_keys(frame.withColumn("norm", F.col(side))).withColumnRenamed("keys", f"keys_{side}")
    shares = {(r.n, r.edits): r.share for r in frame.groupBy("n", "edits").agg(F.avg(F.arrays_overlap("keys_a", "keys_b").cast("int")).alias("share")).collect()}
    print(sorted(shares.items()))
    assert min(shares.values()) >= 0.9 and all(v == 1 for (n, _), v in shares.items() if n <= line_dedup.ONE_EDIT)


def test_long_lines_are_compared_exactly(spark):
    long = [f"w{i}" for i in range(2000)]
    new = [f"n{i}" for i in range(450)]
    pairs = [
        (new[:150] + long, True),  # 150 of 430 allowed
        (long[:700] + new[:400] + long[700:], True),
        (new[:250] + long[:1000] + new[250:] + long[1000:], True),  # 450 of 490
        (new[:300] + long[300:1800] + new[300:], False),  # 500 replaced or cut, 400 allowed
        (long[:-400], True),
        (long[:-401], False),
        (long, True),
    ]
    rows = [(i, " ".join(long), " ".join(other)) for i, (other, _) in enumerate(pairs)]
    frame = spark.createDataFrame([(i + 100 * k, *ab[:: 1 - 2 * k]) for i, *ab in rows for k in (0, 1)], "i int, a string, b string")
    found = {r.i: r.ok for r in frame.select("i", line_dedup.edit_similar(line_dedup.coded(F.col("a")), line_dedup.coded(F.col("b"))).alias("ok")).collect()}
    assert found == {i + 100 * k: ok for i, (_, ok) in enumerate(pairs) for k in (0, 1)}


def test_short_lines_and_lines_without_blanks(spark, tmp_path):
    from attestor.llm import queries

    han, thai = "我们昨天在城里的老书店买了三本关于历史的书", "ฉนรกประเทศไทยมากเพราะอาหารอรอย"
    docs = docs_of(spark, [f"Read more\n{han}\n --- \n{thai}", f"read MORE!\n{han.replace('三', '四')}\n --- \nRead less", f"x\n{thai}\n\n今天很好", "今天很坏\nx", None])
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs, 1).collect()}
    assert [found[i].text for i in range(5)] == [f"Read more\n{han}\n --- \n{thai}", " --- \nRead less", "x\n\n今天很好", "今天很坏", None]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 2, 2: 1, 3: 1, 4: 0}


# 5: n-gram join


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_components_are_brute_force(spark, n, percent):
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    texts = list(ODD) + [" ".join(base)] * 5
    for changes in (1, 1, 1, 2, 2, 3, 4, 6):
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), changes):
                w[at] = f"c{rng.integers(0, 10**6)}"
            texts.append(" ".join(w[: int(rng.integers(100, 121))]))
    found = sorted(tuple(r) for r in ngram_join.ngram_components(docs_of(spark, texts), n, percent).collect())
    assert found == brute_components(texts, n, percent)
    assert ngram_join.ngram_components(empty(spark), n, percent).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.data(), st.sampled_from([50, 80, 90, 95]))
def test_linked_sets_share_a_key(size, data, percent):
    rule, rng = ngram_join.Rule(percent), np.random.default_rng(data.draw(st.integers(0, 10**6)))
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    gone, new = data.draw(st.integers(0, len(a) // 4)), data.draw(st.integers(0, len(a) // 4))
    b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
    both = len(np.intersect1d(a, b))
    if rule.enough(both, len(a), len(b)):
        assert len(np.intersect1d(ngram_join.tile_keys(rule, a), ngram_join.tile_keys(rule, b)))
        maps = [np.frombuffer(ngram_join.bitmap(x), np.uint64) for x in (a, b)]
        assert ngram_join.may_link(rule, np.array([len(a), len(b)]), maps, 0, np.array([1]))[0]


def test_squares_of_a_large_tile(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(0, 60, 3)]
    for percent in (85, 90, 92):
        found = sorted(tuple(r) for r in ngram_join.ngram_components(docs_of(spark, texts), 3, percent).collect())
        assert found == brute_components(texts, 3, percent)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.connected_components(links.where("false")).count() == 0


# 7: chat


def formatted(spark, rows):
    records = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    turns = chat_format.canonical_turns(records)
    return turns, {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}


def test_layouts_become_the_same_turns(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    layouts = [
        {"messages": [{"role": r, "content": t} for r, t in want]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"turns": [{"role": r, "text": t} for r, t in want]},
        {"prompt": "hi", "response": "yo"},
        {"question": "hi", "answer": "yo"},
        {"instruction": "hi", "input": "", "output": "yo"},
    ]
    rows = [(i, 0, json.dumps(x)) for i, x in enumerate(layouts)]
    turns, found = formatted(spark, rows + [(50, 0, "no json"), (51, 0, json.dumps({"strange": 1})), (52, 0, None)])
    for i in range(len(layouts)):
        assert [(t.role, t.text) for t in found[i].turns] == want and found[i].loss_text == "yo"
    assert sorted(r.conv_id for r in turns.where("layout is null").collect()) == [50, 51, 52]


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>\\", "\\<|text|>", "<s", "", "a\nb", "[[INST]] <<s>> \\\\", "<|end|>" * 300, "é😀"]
    rows = [(1, 2 * i + r, json.dumps({"role": ("user", "assistant")[r], "text": t})) for i, t in enumerate(texts) for r in (0, 1)]
    _, found = formatted(spark, rows + [(2, 0, json.dumps({"role": "a<|text|>b", "text": "<|turn|>"}))])
    assert [t.text for t in found[1].turns] == [t for t in texts for _ in (0, 1)]
    assert found[1].loss_text == "".join(texts)
    assert [(t.role, t.text) for t in found[2].turns] == [("a<|text|>b", "<|turn|>")] and found[2].loss_text == ""


# 8: media


def test_interleaved_pages(spark):
    html = '<h1>T</h1><script>no</script><p>one<img src="a.png" alt="A">two<figure><img src="media:sha256-ff"><figcaption>cap &amp; x</figcaption></figure><b>three'
    pages = spark.createDataFrame([(1, html, 0), (2, None, 0), (3, "<p><img>", 0)], "page_id long, html string, key long")
    parsed = media.parse_pages(pages)
    found = {r.page_id: r.sequence for r in parsed.collect()}
    assert [(s.pos, s.kind, s.text, s.caption) for s in found[1]] == [(0, "text", "T", None), (1, "text", "one", None), (2, "image", None, "A"), (3, "text", "two", None), (4, "image", None, "cap & x"), (5, "text", "three", None)]
    assert found[2] == [] and found[3] == []
    stored = spark.createDataFrame([("ff", 5)], "media_digest string, size long")
    assert [(r.pos, r.resolved, r["size"]) for r in media.resolve(parsed, stored).orderBy("pos").collect()] == [(2, False, None), (4, True, 5)]
    assert html_escape("&") == "&amp;"


def test_images_hold_the_text(spark):
    pages, images = media.text_media(odd_docs(spark))
    parsed = media.parse_pages(pages, "doc_id")
    found = {r.doc_id: r for r in media.resolve(parsed, media.media_features(images), "doc_id").collect()}
    assert len(found) == len(ODD)
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        raw += b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert found[i].payload_sha256 == hashlib.sha256(raw).hexdigest() and found[i].tail_crc32 == zlib.crc32(raw[-64:]) and found[i].payload_bytes == len(raw)
        assert found[i].resolved and found[i].media_bytes > len(raw)
    assert media.samples_of(media.image_of(b"\n" * 128)) == b"\n" * 128
    with pytest.raises(ValueError):
        media.samples_of(b"P5\n64 2\n255\n" + b"x" * 64)


# 9: quality


def test_counts_are_brute_force():
    for text in [*ODD, "a b c d e " * 3, "a\na\n \na", "# x ### | <b>", "A b C É é", "one two three four five six " + "one two three four five", " a b c"]:
        w = WORD.findall(text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen, marked = Counter(windows), set()
        for i, x in enumerate(windows):
            if seen[x] > 1:
                marked.update(range(i, i + 5))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        found = dict(zip(quality.COUNTS, quality.text_counts(text), strict=True))
        assert found["n_words"] == len(w) and found["word_chars"] == sum(map(len, w)) and found["n_repeat_words"] == len(marked), repr(text)
        assert found["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or "")) and found["n_dup_lines"] == len(lines) - len(set(lines))
        assert found["n_upper"] == sum(c.isupper() for c in text or "") and found["n_letters"] == sum(c.isupper() or c.islower() for c in text or "")


def test_exact_bounds():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    from math import comb

    p = quality.upper_bound(3, 50, 0.01)
    assert sum(comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_limit_false_rejection():
    rng, wrong = np.random.default_rng(5), 0
    for _ in range(60):
        shares = rng.exponential(60, 3000)
        above = {("x", r): [int((shares > c).sum()) for c in quality.GRID] for r in quality.RULES}
        found = quality.select_cutoffs(above, {"x": 3000}, 0.05, 0.05)
        wrong += any(np.exp(-c / 60) > 0.05 / len(quality.RULES) for c in found.values())
    assert wrong <= 6  # delta is 0.05
    assert quality.select_cutoffs({("x", "marks"): [0] * len(quality.GRID)}, {"x": 20}) == {}  # too few to be sure


def test_rated_documents(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 10**6, 40)) for _ in range(1800)] + [" ".join(f"w{i}%%%" for i in rng.integers(0, 10**6, 40)) for _ in range(20)] + ["too short", None, "a b c d e f g h i j " * 5]
    docs = docs_of(spark, texts).withColumn("kept", F.lit("x"))
    labels = spark.range(1800).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    found = {r.doc_id: r for r in quality.rate_documents(docs, labels).collect()}
    assert all(found[i].kept for i in range(1800)) and not any(found[i].kept for i in range(1800, len(texts)))
    assert found[1820].base_failed and found[1821].base_failed and found[1822].base_failed and not found[1800].base_failed
    assert all(r.kept == (not r.base_failed) for r in quality.rate_documents(docs, labels.where("false")).collect())
    assert quality.rate_documents(empty(spark), labels).count() == 0


# 10: language


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab"]
    prob = np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.2], [0.01]])

    def brute(s):
        return 1.0 if not s else sum((prob[pieces.index(s[:k])][0] if s[:k] in pieces else prob[-1][0] if k == 1 else 0.0) * brute(s[k:]) for k in range(1, len(s) + 1))

    parts = ["▁ab", "▁ba", "▁", "▁abab", "▁axb"]
    assert np.exp(langid.part_scores(langid.Pieces(pieces), prob, parts)[:, 0]) == pytest.approx([brute(p) for p in parts])


def test_languages_are_told(spark):
    rng = np.random.default_rng(2)
    words = {"xx": ["the", "thing", "with", "that", "there"], "yy": ["der", "und", "nicht", "auch", "über"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    rows += [(900 + i, t, None) for i, t in enumerate([None, "", "123 !?", "²", "the " * 4000, "x" * 300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in langid.identify(docs, P.path("piece_bpe_32k.model")).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [found[900 + i].lang_pred for i in range(5)] == ["und"] * 4 + ["xx"] and found[900].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.values())
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), P.path("piece_bpe_32k.model")).collect()} == {"und"}
    assert langid.identify(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    rng = np.random.default_rng(7)
    clean = [" ".join(rng.choice([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)], 60)) for _ in range(30)]
    texts = clean + [clean[0], " ".join(clean[1].split()[:55]) + " and more words to close it", "short", "12345", None]
    docs_of(spark, texts).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(33)) and kept[1] == set(range(32)) and kept[2] <= kept[1] and set(range(30)) <= kept[3]
    assert 30 not in kept[2] and 31 not in kept[3] and kept[4] == kept[3]
