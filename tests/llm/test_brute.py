"""Operators without SQL against plain versions of what they must return."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import flac, op2_mixing, op3_media, op4_packing, op7_sharding, op8_toxicity
from tarn.llm.lexicon import EXACT, FUZZY, STEM, Matcher

ODD = [None, "", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x   y\t\n  z ", "   wide  spaces", "a" * 5000, " " * 3000 + "x", "1234567890" * 300, "é" * 700 + "\U0001f600" * 50, "don't we'll I'VE", "word " * 3000, "日本語のテキスト" * 100]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")


def test_packing_equals_the_contract_on_every_text(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(ODD)}
    got = op4_packing.pack(odd).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        by[r["doc_id"]].append(r)
    for i, all_ids in ids.items():
        at = 0
        for k, r in enumerate(by[i]):
            assert r["piece"] == k and r["start"] == at and (r["length"] == 2048 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(all_ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(all_ids) and len(by[i]) == -(-len(all_ids) // 2048)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for cells in bins.values():
        end = 0
        for o, n in sorted(cells):
            assert o == end
            end += n
        assert end <= 2048
    # best fit one document at a time needs as many sequences
    room = []
    for n in sorted((r["length"] for r in got), reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(2048 - n)
        else:
            room[room.index(fit)] = fit - n
    assert len(bins) == len(room)


def test_media_against_a_plain_reading(odd):
    got = {r["doc_id"]: r for r in op3_media.features(odd).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = flac.encode([pay])[0]
        assert flac.decode([stored]) == [pay]
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(pay, np.uint8).astype(int) - 128
        assert r["feature"] == f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};peak={abs(x).max()};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"


def test_media_blocks_can_be_sought(odd):
    stored = op3_media.store(odd.filter("doc_id IN (6, 11)"))
    rows = op3_media.pcm_blocks(stored).collect()
    streams = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in rows:
        text = ODD[r["doc_id"]].encode()
        pay = op3_media.payload(text)
        a, n = r["sample_offset"], r["n_samples"]
        assert bytes(b ^ 0x80 for b in bytes(r["pcm"])) == pay[a : a + n]
        assert streams[r["doc_id"]][r["byte_offset"] : r["byte_offset"] + 2] in (b"\xff\xf8", b"\xff\xf9")  # a frame starts there


def test_sharding_interleaves_sources_in_proportion(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "abc"[int(rng.integers(0, 10) > 5) + int(rng.integers(0, 10) > 8)], f"t{i}") for i in range(900)] + [(900 + i, None, "n") for i in range(30)] + [(5000, "a", "same")] * 3
    d = spark.createDataFrame(rows, "doc_id long, source string, tie string")
    out = op7_sharding.shard_rows(d, "source", ["doc_id", "tie"], shards=8).collect()
    # the whole order by hand: seeded ranks within a source, then fractional rank, source, rank
    key = lambda r: hashlib.md5("\x1f".join(["shard-1", str(r[0]), r[2]]).encode()).hexdigest()
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = []
    for s, members in by.items():
        for k, r in enumerate(sorted(members, key=lambda r: (key(r), r[0], r[2]))):
            order.append(((k + 0.5) / len(members), (s is None, s or ""), k, r))
    place = [r for *_, r in sorted(order, key=lambda x: x[:3])]
    n = len(rows)
    want = Counter((min(7, i * 8 // n), r) for i, r in enumerate(place))
    assert Counter((r["shard"], (r["doc_id"], r["source"], r["tie"])) for r in out) == want
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    share = Counter(r[1] for r in rows)
    for shard, m in sizes.items():
        mine = Counter(r["source"] for r in out if r["shard"] == shard)
        for s, total in share.items():
            assert abs(mine[s] - total * m / n) <= 2
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(m))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_matcher_against_edit_distances():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcd"), rng.integers(2, 9)))
    words, stems = sorted({word() for _ in range(60)}), ["dddd", "acac"]
    m = Matcher(words, stems, most_states=50)  # small, so that states are thrown away on the way
    for w in [word() for _ in range(1500)] + words:
        # the stem is found as soon as it has been read; before that nothing else is reported
        want = STEM if any(w.startswith(s) for s in stems) else EXACT if w in words else FUZZY if any(len(x) >= 5 and edits(w, x) == 1 for x in words) else 0
        assert m.match(w) == want


def slow_features(text, words, stems):
    low = (text or "").lower()
    spans = [(x.start(), x.end(), x.group()) for x in op8_toxicity.WORD.finditer(low)]
    kinds = []
    for _, _, w in spans:
        kinds.append(3 if any(w.startswith(s) for s in stems) else 1 if w in words else 2 if any(len(x) >= 5 and edits(w, x) == 1 for x in words) else 0)
    score, plain = [0.0, 0.0, 0.0], 0.0
    for i, k in enumerate(kinds):
        if k:
            a, b = max(0, i - op8_toxicity.WINDOW), min(len(spans), i + op8_toxicity.WINDOW + 1)
            before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1]]
            quoted = (any(q in before for q in op8_toxicity.QUOTES) and any(q in after for q in op8_toxicity.QUOTES)) or any(w in op8_toxicity.REPORTING for _, _, w in spans[a:b])
            score[k - 1] += op8_toxicity.QUOTED if quoted else 1.0
            plain = plain if quoted else 1.0
    return [*np.log1p(score), plain, np.log1p(100 * sum(score) / max(1, len(spans)))]


def test_toxicity_scores_against_a_plain_version(spark):
    words, stems = ["idiot", "moron", "stupid"], ["scum"]
    texts = [None, "", "you idiot", "you idiiot and morn", 'he said "you idiot" twice', "scumbag scummy plain", "an idio is no ediot", "the report quoted a stupid remark and more words follow here", "calm words only " * 50 + "stupid"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = [-1.5, 2.0, 1.0, 1.5, 0.7, 0.3]
    got = {r["doc_id"]: r["score"] for r in op8_toxicity.score_texts(d, {"words": words, "stems": stems, "weights": weights}).collect()}
    for i, t in enumerate(texts):
        z = weights[0] + np.dot(weights[1:], slow_features(t, words, stems))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_keeps_every_term_that_passes(spark):
    rows = [(i, " ".join(f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(450)) if i % 2 else "good plain words", int(i % 2)) for i in range(20)]
    words, stems = op8_toxicity.learn_lexicon(spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int"))
    covered = {w for _, t, y in rows if y for w in t.split() if w in words or any(w.startswith(s) for s in stems)}
    assert len(covered) == 450


def test_mixing_schedule_is_the_golden_one(spark):
    rows = [(i, "ab"[i % 3 == 0], f"{'w ' * (i % 40 + 1)}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = d.select("doc_id", "source", op2_mixing.count_words(F.col("text")).alias("size"), F.md5("text").alias("tie"))
    out = op2_mixing.mix(sized).collect()
    assert all((r["slot"] is None) == (r["taken"] == 0) for r in out)
    # any stretch of the mixture holds both sources near their weights
    first = sorted((r["slot"], r["source_size"]) for r in out if r["slot"] is not None)
    half = [s for _, s in first[: len(first) // 2]]
    whole = [s for _, s in first]
    for s in set(whole):
        assert abs(half.count(s) / len(half) - whole.count(s) / len(whole)) < 0.12
    taken = defaultdict(int)
    for r in out:
        taken[r["source_size"]] += r["taken"]
    for r in out:
        assert abs(taken[r["source_size"]] - r["target"]) <= 1
