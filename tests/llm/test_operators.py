import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import flac, op1_license_scan, op2_mixing, op3_media, op4_packing, op5_url_filter, op7_sharding, op8_toxicity, op9_exact_dedup, op10_jaccard_join
from tarn.llm.lexicon import EXACT, FUZZY, STEM, Matcher

LONG = "word " * 30_000
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Licensed under the Apache License, Version 2.0.", "a"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa. Licensed under the Apache License, Version 2.0.", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, LONG, "b"),
    (5, LONG, "b"),
    (None, "one two three", "c"),
    (7, "one two three", "c"),
    (8, "MIT license, mit License; CC-BY and GNU General Public License", "c"),
    (9, "  \t\n ", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in TEXTS], "doc_id long, text string, source string, size string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=4))
@settings(max_examples=25, deadline=None)
def test_flac_round_trip(payloads):
    assert flac.decode(flac.encode(payloads)) == payloads


def test_flac_notices_damage():
    s = bytearray(flac.encode([b"some payload" * 100])[0])
    s[-30] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(s)])


def test_media(docs, empty):
    rows = op3_media.features(docs).collect()
    assert len(rows) == len(TEXTS)
    want = sorted(hashlib.sha256(op3_media.payload((t or "").encode())).hexdigest() for _, t, _ in TEXTS)
    assert sorted(r["payload_sha256"] for r in rows) == want
    blocks = op3_media.pcm_blocks(op3_media.store(docs.filter("doc_id = 5").limit(1))).orderBy("block").collect()
    assert bytes(b ^ 0x80 for b in b"".join(bytes(b["pcm"]) for b in blocks)) == op3_media.payload(LONG.encode())
    assert op3_media.features(empty).count() == 0


def test_exact_dedup(docs, empty):
    marks = op9_exact_dedup.assign(op9_exact_dedup.fingerprints(docs)).collect()
    groups = Counter((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for _, t, _ in TEXTS)
    assert sorted(r["group_size"] for r in marks) == sorted(n for n in groups.values() for _ in range(n))
    assert {r["id"]: r["keep_id"] for r in marks}[1] == 2
    kept = op9_exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [2, 4, 5, 7, 8, 9]
    assert op9_exact_dedup.exact_dedup(empty).count() == 0


def test_sharding(docs, empty):
    rows = docs.select("doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    out = op7_sharding.shard_rows(rows, "source", ["doc_id", "tie"], shards=3).collect()
    n = Counter(r["shard"] for r in out)
    assert sum(n.values()) == len(TEXTS) and max(n.values()) - min(n.values()) <= 1
    for k in n:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(n[k]))
    assert op7_sharding.shard_rows(rows.filter("false"), "source", ["doc_id", "tie"]).count() == 0


def test_mixing(docs, empty):
    sized = docs.select("doc_id", "source", op2_mixing.count_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    out = op2_mixing.mix(sized).collect()
    assert len(out) == len(TEXTS)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert op2_mixing.mix_rows(docs).columns == docs.columns
    assert op2_mixing.mix_rows(empty).count() == 0


def test_license_scan(docs):
    r = {x["doc_id"]: x for x in op1_license_scan.scan(docs).collect()}
    assert r[3]["n_words"] == 0 and r[8]["n_words"] == 11
    assert sorted(d["label"] for d in r[8]["found"] if d["base"]) == ["cc-by", "gpl", "mit", "mit"]
    assert "apache-2.0" in {d["label"] for d in r[1]["spans"]}


def test_license_names_without_a_space(spark):
    texts = {"distributed as GPLv3": "gpl-3.0", "LGPLv2.1 code": "lgpl-2.1", "LGPLv2": "lgpl-2.0", "an LGPLv3 part": "lgpl-3.0", "AGPLv3": "agpl-3.0", "AGPL3": "agpl-3.0", "MPLv2": "mpl-2.0", "GPLv1": "gpl-1.0", "GPLv2": "gpl-2.0", "gpl v2": "gpl-2.0"}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: [x["label"] for x in r["spans"]] for r in op1_license_scan.scan(d).collect()}
    assert got == {t: [label] for t, label in texts.items()}


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_best_fit_fills_every_slot_once(counts):
    used = {}
    placed = Counter()
    for n, rank, each, first, offset in sorted(op4_packing.best_fit(counts, 64)):
        todo = min((r for m, r, *_ in op4_packing.best_fit(counts, 64) if m == n and r > rank), default=counts[n]) - rank
        for k in range(todo):
            used.setdefault(first + k // each, []).append((offset + k % each * n, n))
            placed[n] += 1
    assert placed == Counter(counts)
    for cells in used.values():
        at = 0
        for o, n in sorted(cells):
            assert o == at
            at += n
        assert at <= 64


def test_packing(docs, empty):
    out = op4_packing.pack(docs).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([*t.encode(TEXTS[0][1], add_special_tokens=False).ids, 0], "<u4")
    assert [r["ids_crc32"] for r in out if r["doc_id"] == 1] == [zlib.crc32(ids.tobytes())]
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for cells in by.values():
        ends = 0
        for o, n in sorted(cells):
            assert o == ends
            ends += n
        assert ends <= 2048
    assert op4_packing.pack(empty).count() == 0


def test_packing_reads_the_end_token_as_the_tokenizers_file_does(monkeypatch):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endoftext|", "<|endoftext|>\n\n é <|endoftext|>z", "plain"]
    want = [slow.encode(t, add_special_tokens=False).ids for t in texts]
    encode = op4_packing.encoder()
    assert 50256 in want[0] and [encode(t).tolist() for t in texts] == want

    def refuse(*_, **__):
        raise ValueError

    monkeypatch.setattr(tiktoken.Encoding, "encode", refuse)
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", refuse)
    assert [encode(t).tolist() for t in texts] == want


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://Sub.Example.ORG/es/1", "http://x.com/de/1", "https://a.net", "http://example.org/en/12?q", "http://y.com/fr/2#z"] * 3
    p = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    r = {x["page_id"]: x for x in op5_url_filter.judge(p).collect()}
    assert [r[i]["rule"] for i in range(7)] == [None, None, "example.org/es/", "com/de/", None, "example.org/en/1", "com/fr/"]
    assert [r[i]["verdict"] for i in (0, 2, 3, 5, 6)] == ["allow", "block", "block", "block", "allow"]
    assert r[2]["host"] == "sub.example.org" and r[4]["path"] == ""
    assert op5_url_filter.judge(p.filter("false")).count() == 0


def test_lexicon_against_edit_distance():
    m = Matcher(["stupid", "moron"], ["lowei"])
    assert m.match("stupid") == EXACT and m.match("stpid") == FUZZY and m.match("stuupid") == FUZZY and m.match("stxpid") == FUZZY
    assert m.match("sttupidd") == 0 and m.match("loweixyz") == STEM and m.match("lowexyz") == 0 and m.match("") == 0


def test_toxicity(spark, docs):
    words = ["idiotic", "clownish"]
    rows = [(i, f"plain text number {i} " + (" ".join(words) if i % 3 == 0 else "calm"), "s", "x") for i in range(90)]
    d = spark.createDataFrame(rows, docs.schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = op8_toxicity.fit(d, labels)
    assert set(model["words"]) == set(words)
    got = {r["doc_id"]: r["score"] for r in op8_toxicity.score_texts(d, model).collect()}
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got.items())
    assert op8_toxicity.score_texts(docs, model).count() == len(TEXTS)
    assert op8_toxicity.fit(d.filter("false"), labels)["weights"] is None


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp, [len(s) for s in sets]


def test_jaccard_join_against_brute_force(spark):
    rng = np.random.default_rng(10)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "a b", "a  B", "x"]
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(5, 120)))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = "edit%d" % rng.integers(1000)
            texts.append(" ".join(t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, percent in ((4, 85), (5, 80)):
        comp, sizes = brute_components(texts, n, percent)
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in op10_jaccard_join.link_components(d, shingle=n, percent=percent).collect()}
        assert got == {i: (comp[i], sizes[i]) for i in range(len(texts))}


def test_signatures_lose_no_link_among_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(op10_jaccard_join, "FREQUENT", 3)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rng.integers(1, 5)):
            t[rng.integers(len(t))] = "e%d" % rng.integers(9999)
        texts.append(" ".join(t))
    comp, _ = brute_components(texts, 4, 85)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op10_jaccard_join.link_components(d).collect()}
    assert got == dict(enumerate(comp))


def test_near_dedup_handles_odd_rows(docs, empty):
    kept = op10_jaccard_join.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 3, 4, 5, 7, 8, 9]
    assert op10_jaccard_join.near_dedup(empty).count() == 0
