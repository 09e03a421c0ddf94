"""Lexical search, conversation tries and language identification against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_helpers import WORDS, frame, prose, same
from pyspark.sql import functions as F

from rowdelta.llm import language, lexical, trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FEW_LETTERS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(FEW_LETTERS))


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for row, (i, c) in enumerate(counted):
            score = 0
            for t, q in Counter(terms(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += q * w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * c.total() * n // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, row))
        out += [(item, r + 1, docs[row][0], -s) for r, (s, _, _, row) in enumerate(sorted(scored)[:k])]
    return out


def searched(spark, docs, items, **kw):
    d = frame(spark, [(i, t, "a") for i, t in docs]).repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    found = lexical.rank(lexical.build_index(d, only=lexical.term_filter(q)), q, **kw)
    assert [n for n, _ in found.dtypes] == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in found.collect()]


def test_search_ranks_as_scoring_everything_does(spark, tricky):
    docs = [(r["doc_id"], r["text"]) for r in tricky.select("doc_id", "text").collect()]
    rng = random.Random(5)
    docs += [(100 + k, " ".join(rng.choice(WORDS[: 8 + k % 40]) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    docs += [(900, "Kaİn KAİN É é ٣ _x_ 12a3"), (901, "the " * 400_000)]
    items = [(1, prose(3, 40)), (2, "kan"), (3, None), (4, ""), (5, "unseen"), (6, "Kan KAN losts the THE é"), (None, prose(2, 30)), (2, "kan"), (7, " ".join(WORDS))]
    same(searched(spark, docs, items), ranked(docs, items))
    same(searched(spark, docs, items, k=2), ranked(docs, items, 2))


def test_search_leaves_common_terms_without_losing_a_document(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(k, " ".join(["common", "plain"] * rng.randint(0, 3) + [rng.choice(WORDS) for _ in range(12)] + [f"rare{k % 97}"])) for k in range(600)]
    items = [(k, f"common plain common rare{k} {prose(k, 6)}") for k in range(12)]
    for tenths in (0, 6, 10):
        monkeypatch.setattr(lexical, "COMMON_TENTHS", tenths)
        monkeypatch.setattr(lexical, "SENT_ROWS", 10 if tenths == 10 else 500_000)
        monkeypatch.setattr(lexical, "SEED_POSTINGS", 15)
        same(searched(spark, docs, items, k=3), ranked(docs, items, 3))


def test_search_of_empty_tables_and_whole_indexes(spark, nothing, tricky):
    items = spark.createDataFrame([(1, "kan lo")], "item_id long, text string")
    assert lexical.rank(lexical.build_index(nothing), items).collect() == []
    assert lexical.rank(lexical.build_index(tricky), items.limit(0)).collect() == []
    whole, part = (lexical.rank(lexical.build_index(tricky, only=only), items).collect() for only in (None, lexical.term_filter(items)))
    same(whole, part)
    assert lexical.build_index(tricky).postings.where("term = 'passage'").count() == 0


def test_search_takes_other_ids_and_long_sizes(spark):
    docs = spark.createDataFrame([("a", "kan lo"), ("b", "kan"), (None, "kan")], "doc_id string, text string")
    found = lexical.rank(lexical.build_index(docs), spark.createDataFrame([(1, "lo kan")], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in found] == ["a", "b", None]
    sizes = [1, 10**6, 2**62]
    got = spark.createDataFrame([(x,) for x in sizes], "n long").select(lexical.impact(F.lit(3), F.col("n"), 10**11, 10**14)).collect()
    assert [r[0] for r in got] == [3 * 10**9 // (3000 + 8 * (25 + 75 * x * 10**11 // 10**14)) for x in sizes]


def trie_rows(turns, width=100, most=6):
    convs: dict = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(rows)] for c, rows in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = int(math.copysign(abs(c) - abs(c) % width, c))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes: dict = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        parent = min(nodes[path[:-1]]) if path else None
        kids = sum(1 for q in nodes if len(q) == len(path) + 1 and q[: len(path)] == path)
        out.append((min(members), len(path), parent, len(members), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(3)
    turns = []
    for c in [*range(0, 130), 250, 399, -7, -100, 10**12]:
        for k in range(rng.randint(1, 9)):
            turns.append((c, None if c % 17 == 3 and k == 0 else k, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é🙂", "", None, prose(c % 5, 4)])))
    turns += [(c, k, "user", f"same {k}") for c in range(1000, 1040) for k in range(8)]  # copies of a whole conversation
    turns += [(c, k, "user", "same" if k < 7 else f"last {c}") for c in range(2000, 2030) for k in range(9)]  # a hot beginning
    turns += [(5, 1, "user", "twice"), (5, 1, "user", "twice"), (None, 0, "user", "lost"), (301, 0, "user", "x")]
    return turns


@pytest.mark.parametrize("limit", [2, 40, 100_000])
def test_trie_is_the_brute_force_one_however_it_is_parted(spark, limit):
    turns = conversations()
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, path string, depth string").repartition(3)
    found = trie.prefix_trie(df, limit=limit)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    same([tuple(r) for r in found.collect()], trie_rows(turns))


def test_trie_of_an_empty_table_and_of_conversations_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    only = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    turns = [(only, 0, "user", "goes")]  # its turn gives way to one of a conversation that isn't there
    same([tuple(r) for r in trie.prefix_trie(spark.createDataFrame(turns, schema)).collect()], trie_rows(turns))


def test_digests_over_ids_go_on_over_ranges_and_batches(spark):
    ids = [7, 65535, 65536, 200_000, -5, 10**15]
    convs = spark.createDataFrame([("e", i) for i in ids] + [("f", 1)], "end string, conv_id long")
    got = dict(trie._id_digests(convs).collect())
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in (("e", ids), ("f", [1]))}


def spoken(lang: str, seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = {"aa": ["ka", "ko", "mi", "ra"], "bb": ["str", "schu", "ein", "ung"], "cc": ["é", "oix", "eau", "ment"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize()


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, spoken(lang, 1000 * n + k, 1 + k % 60), lang) for n, lang in enumerate(("aa", "bb", "cc")) for k in range(n, 360, 3)]
    rows += [(None, spoken("aa", 1, 9), "bb"), (1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 $%", "cc"), (1003, spoken("bb", 4, 5), None), (1004, spoken("cc", 5, 150_000), "cc"), (1004, spoken("cc", 5, 150_000), "cc")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, id string, score string").repartition(3).persist()


def test_languages_of_the_held_out_fold(spark, labelled):
    found = language.predict(labelled, language.fit(labelled))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == labelled.count()
    truth = {r["doc_id"]: r["lang"] for r in labelled.where("doc_id < 1000").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in truth)
    assert len(held) > 90 and np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert rows[1003]["lang_pred"] == "bb" and rows[1004]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in rows.values())


def test_nothing_of_the_held_out_fold_is_learned(spark, labelled):
    flipped = labelled.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    a, b = language.fit(labelled), language.fit(flipped)
    assert a.languages == b.languages == ("aa", "bb", "cc") and (a.logs == b.logs).all()


def test_mixtures_are_those_of_a_plain_loop(spark, labelled):
    model = language.fit(labelled, fit_rows=50)
    texts = [spoken("aa", 7, 30) + ". " + spoken("cc", 8, 30), spoken("bb", 9, 40), "", spoken("aa", 10, 1), spoken("aa", 11, 20) + spoken("bb", 12, 60), "1 2"]
    shares, rows = language.shares_of(texts, model)
    assert rows.tolist() == [0, 1, 3, 4]

    def climb(p, shares, rounds):
        for _ in range(rounds):
            r = p * shares[:, None]
            r = r / (r.sum(axis=0) + language.NOISE)
            shares = r.sum(axis=1) / r.sum()
        return shares, np.log(p.T @ shares + language.NOISE).sum()

    for row, got in zip(rows, shares.T, strict=True):
        p = language.word_likelihoods([texts[row]], model.logs)[0].astype(float)
        now, fit = climb(p, np.full(3, 1 / 3), language.ROUNDS)
        while (now > 0).sum() > 1:
            tried = now.copy()
            tried[np.where(tried > 0, tried, np.inf).argmin()] = 0
            new, other = climb(p, tried / tried.sum(), language.MORE_ROUNDS)
            if other + 0.5 * math.log(p.shape[1]) + 0.5 < fit:
                break
            now, fit = new, other
        assert np.allclose(got, now, atol=1e-3)
    both = dict(zip(model.languages, shares[:, 0], strict=True))
    assert both["bb"] == 0 and 0.3 < both["aa"] < 0.7 and abs(both["aa"] + both["cc"] - 1) < 1e-6


def test_grams_stay_within_words_and_pieces(spark):
    buckets, places = language._grams(language._words(["ab c"])[0])
    assert len(buckets) == len(places) == 3 + 5 + 3 + 1  # a b c; _a ab b_ _c c_; _ab ab_ _c_; _ab_
    long = spoken("aa", 3, 60_000)
    pieces = list(language._pieces(long, 1000))
    assert "".join(pieces) == long and not any(p[0].isalpha() for p in pieces[1:])


def test_very_long_texts_take_the_room_of_their_words(spark, labelled, monkeypatch):
    model = language.fit(labelled)
    texts = [spoken("aa", 1, 4000) + " " + spoken("bb", 2, 3000), spoken("cc", 3, 20)]
    whole = language.shares_of(texts, model)[0]
    monkeypatch.setattr(language, "_TOGETHER", 500)
    monkeypatch.setattr(language, "_PIECE", 2000)
    assert np.allclose(whole, language.shares_of(texts, model)[0], atol=1e-3)


def test_no_labels_and_no_rows(spark, labelled):
    bare = labelled.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(bare, language.fit(bare)).collect()} == {("und", 0.0)}
    assert language.predict(labelled.limit(0), language.fit(labelled)).collect() == []
