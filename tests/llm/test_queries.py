"""Every registered query of the operators over small odd tables, against plain Python; empty tables, null and repeated ids, clashing columns."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import chat_format, common, components, langid, line_dedup, ngram_join, quality, queries, token_counts

P = pytest.importorskip("public_tokenizers")
ODD = [
    None, "", " ", "a  b", "▁y", "\n\na", "a \n b", "</s> <0x0A>", "<b>x</b> & y", "😀 don't  stop", "word " * 700, "y" * 900, "a\r\nb\r\n  c", "zwölf Boxkämpfer jagen Viktor",
    "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten twelve", "one two three four five six seven eight nine ten eleven",
    "#tag ### $ a b c d e f g h i j", "a\na\na\nb", "l1 x y z\n\nl2 <p> </p>\nl3 &amp;\nl4",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, key string, class string, piece string, length string, _doc string, size string"
QUERIES = [q for q in queries.QUERIES if q != "op2_license_scan"]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", 1) for i, t in enumerate(ODD)]
    out += out[2:4] + [(3, "another text with the id of three, of some ten words or so", "en", "s0", 1), (None, "no id here", "en", "s1", 1), (None, None, None, None, None)]
    return [(*r, *["x"] * 7) for r in out]


def write(spark, path, documents, conversations):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(1, 0, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string, record string, v string").write.parquet(f"{path}/conversations.parquet")
    return path


TURNS = [(c, t, r, x, "x", "x") for c, t, r, x in [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST]"), (1, 2, "assistant", ""), (2, 0, "system", None), (2, 1, None, "text"), (3, 5, "human", "<|turn|>\\"),
    (3, 2, "assistant", "first é😀"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (None, 0, "user", "who"), (5, 0, "gpt", "role named so"), (6, 1, "user", "x\ny"),
]]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = write(spark, str(tmp_path_factory.mktemp("odd")), rows(), TURNS)
    return {name: [r.asDict() for r in queries.QUERIES[name](spark, path).collect()] for name in QUERIES}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def counted(values):
    return Counter(json.dumps(v, sort_keys=True) for v in values)


def test_op1(found):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = []
    for r in rows():
        ids = sp.encode(r[1] or "")
        want.append({"doc_id": r[0], "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(sp.decode(ids))})
    assert counted({k: r[k] for k in want[0]} for r in found["op1_sentencepiece"]) == counted(want)


def test_op3_rows(found):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in found["op3_line_dedup"])
    assert len(got) == len(rows()) and [g[:2] for g in got] == sorted((r[0] is None, r[0] or 0) for r in rows())
    by = defaultdict(list)
    for r in found["op3_line_dedup"]:
        by[r["doc_id"]].append(r)
    assert by[16][0]["n_removed"] == 1 and by[15][0]["n_removed"] == 1 and by[14][0]["n_removed"] == 0  # one equal, one similar line
    assert sorted(r["n_removed"] for r in by[3]) == [0, 0, 1]  # rows with one id: the equal one loses its line, the other text keeps its own
    assert by[18][0]["n_removed"] == 4  # "a" three times and "b", all known from earlier documents


def test_op4(found):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(lambda: [0, 0, 0])
    for r in rows():
        total = want[r[3], r[2]]
        for i, n in enumerate((1, len(t.encode(r[1] or "", add_special_tokens=False).ids), len(r[1] or ""))):
            total[i] += n
    assert {(r["source"], r["lang"]): [r["documents"], r["tokens"], r["chars"]] for r in found["op4_token_counts"]} == dict(want)


def test_op5(found):
    want = []
    sets = []
    for r in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    for r, s in zip(rows(), sets, strict=True):
        near = [q[0] for q, t in zip(rows(), sets, strict=True) if s and t and 100 * len(s & t) >= 90 * len(s | t) and q[0] is not None]
        want.append({"doc_id": r[0], "n_shingles": len(s), "component_id": r[0] if r[0] is None and not near else min([*near, *[r[0]] * (r[0] is not None)])})
    assert counted({k: r[k] for k in want[0]} for r in found["op5_ngram_join"]) == counted(want)


def test_op6(found):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for r in rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [{"doc_id": r[0], "piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert counted({k: r[k] for k in want[0]} for r in found["op6_best_fit_packing"]) == counted(want)
    places = defaultdict(list)
    for r in found["op6_best_fit_packing"]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 1024


def test_op7(found):
    turns = defaultdict(list)
    for c, t, r, x, *_ in [*TURNS, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        turns[c].append((t, r or "", x or ""))
    want = []
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        want.append({"conv_id": c, "n_turns": len(ts), "turns_sha256": sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), "loss_chars": len(loss), "loss_sha256": sha(loss)})
    assert counted({k: r[k] for k in want[0]} for r in found["op7_chat_format"]) == counted(want)
    assert all(r["formatted_chars"] > 0 for r in found["op7_chat_format"])


def test_op7_layouts_and_unknown_records(spark):
    frame = spark.createDataFrame(TURNS * 8, "conv_id long, turn long, role string, text string, record string, v string").withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string")))
    turns = chat_format.canonical_turns(chat_format.mixed_records(frame))
    assert {r[0] for r in turns.select("layout").distinct().collect()} == {"turn", "messages", "turns", "conversations"}
    told = turns.groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in told} == Counter(r or "" for _ in range(8) for _, _, r, *_ in TURNS)
    odd = spark.createDataFrame([(1, 0, "{}"), (1, 1, '{"prompt": "a", "response": "b"}'), (2, 0, "no json"), (2, 1, None)], "conv_id long, turn long, record string")
    got = {r.conv_id: r for r in chat_format.format_conversations(chat_format.canonical_turns(odd)).collect()}
    assert got[1].n_unknown == 1 and "b" in got[1].formatted and (got[2].n_unknown, got[2].formatted, got[2].loss) == (2, "", [])


def test_op8(found):
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        want.append({"doc_id": r[0], "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": sha(payload), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(image), "media_sha256": sha(image)})
    assert counted({k: r[k] for k in want[0]} for r in found["op8_media_columns"]) == counted(want)
    assert all(r["caption"] == f"document {r['doc_id']}" for r in found["op8_media_columns"])
    by = {r["doc_id"]: r for r in found["op8_media_columns"]}
    assert (by[19]["pos"], by[19]["n_items"]) == (2, 5) and (by[0]["pos"], by[0]["n_items"]) == (0, 1)  # two lines before the image, two after
    features = defaultdict(set)
    for r in found["op8_media_columns"]:
        features[r["payload_sha256"]].add(r["feature"])
    assert all(len(f) == 1 for f in features.values())


def test_op9(found):
    want = []
    for r in rows():
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen, marked = Counter(windows), set()
        for i, x in enumerate(windows):
            if seen[x] > 1:
                marked.update(range(i, i + 5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append({"doc_id": r[0], "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "base_failed": len(w) < 10 or 100 * len(marked) > 20 * len(w)})
    assert counted({k: r[k] for k in want[0]} for r in found["op9_quality_rules"]) == counted(want)
    assert not any(r["kept"] and r["base_failed"] for r in found["op9_quality_rules"])


def test_op10(found):
    assert Counter(r["doc_id"] for r in found["op10_language_id"]) == Counter(r[0] for r in rows())
    letters = {r[0]: bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows() if r[0] is not None}
    for r in found["op10_language_id"]:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]])


def test_empty_tables(spark, tmp_path):
    path = write(spark, str(tmp_path), [], [])
    for name in QUERIES:
        assert queries.QUERIES[name](spark, path).count() == (1 if name == "op7_chat_format" else 0), name


def test_pipeline_of_an_empty_table_and_of_odd_ids(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, write(spark, str(tmp_path / "none"), [], [])).count() == 0
    path = write(spark, str(tmp_path / "odd"), rows(), [])
    assert corpus_pipeline.run(spark, path).where("doc_id is not null").count() >= 0


# 3: lines against brute force


def words_distance(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, np.empty_like(row)
        row[0] = i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return int(row[-1])


def test_line_groups_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "ta", "li")]
    lines = []
    for n in (5, 7, 9, 10, 12, 15, 20, 30, 45, 70, 120):
        for _ in range(5):
            base = rng.choice(vocabulary, n).tolist()
            lines.append(base)
            for share in (0.2, 0.2, 0.1, 0.4):
                w = list(base)
                for at in rng.choice(n, max(1, int(n * share)), replace=False):
                    kind = rng.integers(3)
                    w[at] = "" if kind == 0 else rng.choice(vocabulary) if kind == 1 else f"{w[at]} {rng.choice(vocabulary)}"
                lines.append(" ".join(w).split())
    texts = [" ".join(w) for w in lines]
    linked = set()
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            longer = max(len(a), len(b))
            if min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= longer * 0.2 and words_distance(a, b) <= longer * 0.2 + 1e-9:
                linked.add((j, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_copy", F.lit(0).cast("long"))
    with common.scratch(spark):
        occurrences = common.materialise(line_dedup.line_occurrences(docs, 1), "o")
        distinct = common.materialise(line_dedup.distinct_lines(occurrences), "l")
        groups = components.connected_components(line_dedup.line_links(docs, occurrences, distinct))
        told = {r.doc_id: r.c for r in distinct.join(groups, F.col("node") == F.col("line"), "left").select("doc_id", F.coalesce("component", "line").alias("c")).collect()}
    first = {t: texts.index(t) for t in texts}
    group = [told[first[t]] for t in texts]
    whole = sum(group[i] == group[j] for i, j in linked)
    assert len(linked) > 150 and whole >= 0.95 * len(linked)
    parent = list(range(len(texts)))
    for i, j in sorted(linked):
        old, new = parent[j], parent[i]
        parent = [new if p == old else p for p in parent]
    brute = {}
    for i, p in enumerate(parent):
        assert brute.setdefault(group[i], p) == p or texts[i] in texts[:i]  # no group joins what brute force keeps apart


def test_hot_keys_are_parted(spark, monkeypatch):
    """Many lines with one common run of words, and pairs of similar ones among them."""
    monkeypatch.setattr(line_dedup, "GROUPS", 4)
    rng = np.random.default_rng(2)
    lines = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 9)]
        lines.append("in the name of " + " ".join(w))
        if i % 3 == 0:
            lines.append("in the name of " + " ".join([*w[:4], "other", *w[5:]]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    removed = line_dedup.dedup_lines(docs, 1).where("n_removed = 1").count()
    assert removed == 20


def template_lines(rng, n, common, groups, vocabulary):
    """Lines of n words, of which ``common`` are all lines' at the same places, in groups of three that are similar to one another."""
    places = set(rng.choice(n, common, replace=False).tolist())
    template = [f"t{i}" for i in range(n)]
    lines = []
    for _ in range(groups):
        base = [template[i] if i in places else f"v{rng.integers(vocabulary)}" for i in range(n)]
        lines.append(base)
        edits = rng.choice(n, int(n * 0.2), replace=False)
        for part in np.array_split(edits, 2):  # edits of the second and third add up to what is allowed between them
            w = list(base)
            for at in part:
                w[at] = f"v{rng.integers(vocabulary)}"
            lines.append(w)
    return [" ".join(w) for w in lines]


@pytest.mark.parametrize(("n", "common", "vocabulary"), [(12, 8, 10**6), (20, 14, 10**6), (40, 28, 10**6), (40, 28, 300)])
def test_lines_of_a_template_are_found(spark, n, common, vocabulary):
    """Every key of 1,200 lines is full of their template, and with 300 words beside it no word is rare."""
    lines = template_lines(np.random.default_rng(n), n, common, 400, vocabulary)
    left = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), 1).where("text <> ''").select("doc_id").collect()
    assert 400 >= len({r.doc_id // 3 for r in left}) >= 0.97 * 400 and len(lines) - len(left) >= 0.95 * 800


def test_simhash_sums_bits_by_weight(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(h), int(w)) for i in range(20) for h, w in zip(rng.integers(-(2**63), 2**63, 9), rng.integers(0, 257, 9), strict=True)]
    got = {r.line: r.bits for r in line_dedup.simhash(spark.createDataFrame(rows, "line long, hash long, weight long")).collect()}
    for i in range(20):
        own = [(h % 2**64, w) for line, h, w in rows if line == i]
        brute = sum(1 << b for b in range(64) if 2 * sum(w for h, w in own if h >> b & 1) > sum(w for _, w in own))
        assert got[i] % 2**64 == brute


def test_rows_with_one_id_keep_their_own_lines(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"{a}\n{b}", 1), (1, f"{b}\n{a}\nlast line of this row", 2), (1, f"{a}\n{b}", 3), (None, a, 4), (None, "only here and nowhere else at all", 5)], "doc_id long, text string, n int")
    got = [x for r in line_dedup.dedup_lines(docs, 1).collect() for x in r.text.split("\n") if x]
    assert sorted(got) == sorted([a, b, "last line of this row", "only here and nowhere else at all"])


# 5: cells


def test_members_of_the_largest_group_are_not_copied(spark):
    tiles = spark.range(3000).selectExpr("7L as k", "id as class")
    groups = spark.range(1, 2999).selectExpr("id as node", "1L as component")
    _, cells = ngram_join.tile_cells(tiles, groups)
    assert cells.count() <= 3000 + 2 * 2  # two members of other groups meet two blocks


# 9: cutoffs


def test_cutoffs_of_several_strata(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 10**6, 40)) for _ in range(900)]
    langs = ["en"] * 300 + ["de"] * 300 + ["fr"] * 260 + ["es"] * 40
    bad = [" ".join(f"w{i}!!" for i in rng.integers(0, 10**6, 40)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts + bad, langs + ["en", "de", "fr", "es"], strict=True))], "doc_id long, text string, lang string")
    labels = spark.range(900).selectExpr("id as doc_id", "1 as quality")
    counts = quality.count_documents(docs)
    cutoffs = quality.learn_cutoffs(counts, labels.unionByName(labels))  # a label twice is one trial
    assert {s for s, _ in cutoffs} == {"en", "de", "fr"}  # es has too few to be sure
    kept = {r.doc_id: r.kept for r in quality.rate_documents(docs, labels).collect()}
    assert [kept[900 + i] for i in range(4)] == [False, False, False, True] and all(kept[i] for i in range(900))
    twice = quality.learn_cutoffs(counts.where("lang = 'es'").unionByName(counts.where("lang = 'es'")).unionByName(counts.where("lang = 'es'")), labels)
    assert twice == {}  # repeated rows are no more trials


# 10: long words


def test_long_words_are_scored_whole():
    pieces = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab"]
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.15, 0.1], [0.25, 0.3], [0.05, 0.1], [0.1, 0.1], [0.05, 0.05], [0.1, 0.05], [0.01, 0.02]])
    finder = langid.Pieces(pieces)
    short = ["▁" + "abba"[: 1 + i % 4] * (1 + i % 5) for i in range(20)]
    short = [w for w in short if len(w) <= langid.TOGETHER]
    together = langid.part_scores(finder, prob, short)
    alone = np.array([langid.log_forward(finder.grid(w), prob)[-1] for w in short])
    assert together == pytest.approx(alone)
    long = "▁" + "ab" * 4000
    assert np.isfinite(langid.part_scores(finder, prob, [long])).all()
    seen = langid.long_counts(finder.grid("▁abab"), prob[:, :1])
    assert (seen * np.array([len(p) for p in pieces] + [1])).sum() == pytest.approx(5)  # pieces of every segmentation cover the word


def test_ledger_folds_and_renames(spark, tmp_path):
    counts = spark.createDataFrame([(1, "s", "en", "v", 3, 9), (2, "s", None, "v", 4, 8)], "doc_id long, source string, lang string, tokenizer_version string, tokens long, chars long")
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    for b in ("b1", "b2", "b3"):
        assert ledger.commit(b, token_counts.insertions(counts))
    ledger.compact()
    assert [p.name.split("=")[0] for p in (tmp_path / "ledger").iterdir()] == ["snapshot"]  # what was folded is gone
    assert not ledger.commit("b2", token_counts.insertions(counts)) and ledger.commit("b4", token_counts.deletions(counts))
    ledger.compact()
    assert {(r.lang, r.documents, r.tokens) for r in ledger.totals().collect()} == {("en", 2, 6), (None, 2, 8)}
    assert not ledger._renamed("snapshot=00000001", "snapshot=00000001")
