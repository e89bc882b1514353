import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import mixing_model as m
from tarn.llm import op6_lm_score

from odd_rows import TEXTS


SPACES = {9, 10, 11, 12, 13, 32}


@pytest.fixture(scope="module")
def learned():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 110, rng.integers(1, 9)).astype(np.uint8)) for _ in range(60)]
    texts = [b" ".join(words[i] for i in rng.zipf(1.4, 40) % 60) for _ in range(150)]
    counts = m.pair_counts(texts)
    learner = m.Learner(m.Coder(counts))
    for i in range(0, 120, 10):
        learner.learn([p for t in texts[i : i + 10] for p in m.pieces(t)])
    return texts, counts, m.Model(learner.coder, dict(learner.blocks()))


def slow_log10(model, text):
    """One decision after the other, from the definitions."""
    coder, total = model.coder, 0.0
    mask, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    before, word = [0] * m.PAD, [0]
    for s in [*text, m.END]:
        p = before[::-1]
        w = 0
        for k, v in enumerate(word[1:]):
            w = (w + v * pow(odd, k + 2, 1 << 64)) & mask
        w = (w + word[0]) & mask
        two = p[0] << 9 | p[1]
        three = two << 9 | p[2]
        five = ((three << 18 | p[3] << 9 | p[4]) * odd) & mask
        contexts = [two, three, five ^ five >> 31, w ^ w >> 29]
        pair = p[0] * m.SYMBOLS + s
        for node, bit in ((int(coder.node[coder.first[pair] + j]), int(coder.bit[coder.first[pair] + j])) for j in range(coder.steps[pair])):
            cells = []
            spread = (((node >> 4) * 0x9E3779B1) << 4 & 0xFFFFFFFF) | node & 15
            for k, c in enumerate(contexts):
                h = ((c * odd & mask) >> 28) & 0xFFFFFFF0
                cells.append(int(m.OFFSET[k]) + ((h ^ spread) & ((1 << m.CELLS[k]) - 1)))
            x = [float(model.inputs[c]) for c in cells]
            gate = int(model.levels[cells[2] - m.OFFSET[2]]) * (len(m.LEVELS) + 1) + int(model.levels[cells[3] - m.OFFSET[2]])
            z = sum(float(model.weights[k, gate]) * x[k] for k in range(m.K))
            cell = p[0] * m.BUCKETS + round(min(8, max(-8, z)) * 2 + 16)
            q = (1 / (1 + math.exp(-min(20, max(-20, z)))) + 3 * float(model.map[cell])) / 4
            q = min(1 - 1e-6, max(1e-6, q))
            total += math.log10(q if bit else 1 - q)
        before = [*before[1:], s + 1]
        word = [s + 1] if s in SPACES else [*word, s + 1]
    return total


def test_scores_equal_the_definition_bit_by_bit(learned):
    texts, _, model = learned
    some = [b"", b"a", texts[3], texts[130], b"x\x00 \xc3\xa9  y\n" + texts[7]]
    got = model.log10(some)
    for t, s in zip(some, got):
        want = slow_log10(model, t)
        assert abs(s - want) < 1e-3 * max(1, abs(want))


def test_a_symbol_has_probability_one_in_all(learned):
    _, _, model = learned
    ends = model.log10([b"ab"])[0]
    whole = 0.0
    for s in range(256):
        # P(first byte s and then the end) over P(end after s), found by the slow coder's parts
        t = bytes([s])
        whole += 10 ** (slow_log10(model, t) - slow_end(model, t))
    whole += 10 ** model.log10([b""])[0]
    assert ends < 0 and abs(whole - 1) < 1e-3


def slow_end(model, text):
    """log10 of the end symbol alone, after ``text``."""
    cells, before, bit, _ = model.coder.decisions([(b"", text, True)])
    n = int(model.coder.steps[(text[-1] + 1) * m.SYMBOLS + m.END])
    _, _, z = model.mixed(cells[:, -n:])
    p = (1 / (1 + np.exp(-np.clip(z, -20, 20))) + 3 * model.map.take(m.bucket(before[-n:], z))) / 4
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(np.log10(np.where(bit[-n:], p, 1 - p)).sum())


def test_held_out_texts_cost_less_than_by_byte_counts_alone(learned):
    texts, counts, model = learned
    counts = counts.reshape(m.BEFORE, m.SYMBOLS).sum(0)
    share = (counts + 1) / (counts + 1).sum()
    plain = sum(math.log10(share[b]) for t in texts[120:] for b in [*t, m.END])
    scored = model.log10(texts[120:]).sum()
    assert scored > 0.8 * plain
    shuffled = [bytes(np.random.default_rng(1).permutation(np.frombuffer(t, np.uint8))) for t in texts[120:]]
    assert model.log10(shuffled).sum() < 1.2 * scored


def test_order_of_words_counts(learned):
    texts, counts, _ = learned
    learner = m.Learner(m.Coder(counts))
    for _ in range(30):
        learner.learn([(b"", b"alpha beta", True), (b"", b"gamma delta", True)])
    model = m.Model(learner.coder, dict(learner.blocks()))
    a, b = model.log10([b"alpha beta", b"alpha delta"])
    assert a > b  # the same words, but contexts reach over the space


def test_long_texts_are_read_in_pieces(learned):
    _, _, model = learned
    text = b"some words and others " * 30_000
    assert len(list(m.pieces(text))) == 3 and b"".join(p[1] for p in m.pieces(text)) == text
    whole = model.log10([text])[0]
    half = model.log10([text[: len(text) // 2]])[0]
    assert abs(whole - 2 * half) < 0.01 * abs(whole)


def test_blocks_add_up(learned):
    texts, counts, _ = learned
    a, b, both = (m.Learner(m.Coder(counts)) for _ in range(3))
    a.learn([(b"", texts[0], True)])
    b.learn([(b"", texts[1], True)])
    x, y = dict(a.blocks()), dict(b.blocks())
    total = {k: m.added(k, [d[k] for d in (x, y) if k in d]) for k in {*x, *y}}
    got = np.zeros((m.TOTAL, 2))
    for k, data in total.items():
        if k < m.BLOCKS:
            got[k * m.BLOCK : (k + 1) * m.BLOCK] = m.unpacked(data).reshape(-1, 2)
    assert (got == a.counts + b.counts).all()


def brute_base(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter()
    for w, h in zip(words, held):
        if not h:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    return [(i, h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None])) for (i, _), w, h in zip(rows, words, held)]


def test_base_columns_against_brute_force(spark, clashing):
    rows = [(i, t) for i, t, _ in TEXTS] + [(i, f"Word{i} common é\x00 " * (i % 4)) for i in range(20, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (op6_lm_score.HEAD, 3):  # with a tail too
        got = op6_lm_score.score(d, head=head).collect()
        key = lambda r: (str(r[0]), r[2], r[3])
        a = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
        b = sorted(brute_base(rows), key=key)
        assert [x[:5] for x in a] == [x[:5] for x in b]
        assert all(abs(x[5] - y[5]) < 1e-6 for x, y in zip(a, b))
        assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_lm_odd_tables(clashing):
    out = op6_lm_score.score(clashing)
    assert out.count() == len(TEXTS)
    assert op6_lm_score.score(clashing.filter("false")).count() == 0
    only = op6_lm_score.score(clashing.filter("doc_id = 8")).collect()
    assert len(only) == 1


def plain_learn(learner, parts):
    """One run, every decision looked up by itself."""
    cells, before, bit, _ = learner.coder.decisions(parts)
    mixer = m.Mixer(m.stretched(learner.counts), m.evidence(learner.counts[m.OFFSET[m.K - 2] :]), learner.weights)
    for a in range(0, len(bit), m.STEP):
        cut = slice(a, a + m.STEP)
        x, gate, z = mixer.mixed(cells[:, cut])
        error = bit[cut] - 1 / (1 + np.exp(-np.clip(z, -20, 20)))
        for k in range(m.K):
            slope = np.bincount(gate, error * x[k], m.GATES)
            learner.past[k] += slope**2
            learner.weights[k] += (m.RATE * slope / np.sqrt(learner.past[k])).astype(np.float32)
        learner.behind += np.bincount(gate, minlength=m.GATES)
        np.add.at(learner.map, (m.bucket(before[cut], z), bit[cut]), 1)
    for k in range(m.K):
        np.add.at(learner.counts, (cells[k], bit), 1)


@pytest.mark.parametrize("slots", [m.SLOTS, 17])  # 17: few slots, which cases take from each other
def test_learning_by_cases_equals_learning_by_decisions(learned, monkeypatch, slots):
    monkeypatch.setattr(m, "SLOTS", slots)
    texts, counts, _ = learned
    a, b = (m.Learner(m.Coder(counts)) for _ in range(2))
    odd = [b"", b" ", b"a\x00 \xc3\xa9", b"x " * 30_000]
    for some in (texts[:60], odd, texts[60:] * 3, odd[:1]):
        run = [p for t in some for p in m.pieces(t)]
        a.learn(run)
        plain_learn(b, run)
    assert (a.counts == b.counts).all() and (a.map == b.map).all() and (a.behind == b.behind).all()
    assert np.allclose(a.weights, b.weights, rtol=1e-5)


def looked_up(monkeypatch):
    sizes, paths = [], m.Coder.paths
    monkeypatch.setattr(m.Coder, "paths", lambda self, pair, hashes: sizes.append(len(pair)) or paths(self, pair, hashes))
    return sizes


def test_each_case_is_looked_up_once(learned, monkeypatch):
    texts, counts, model = learned
    sizes = looked_up(monkeypatch)
    text = b" ".join(texts[:20])
    m.Learner(m.Coder(counts)).learn([(b"", text, True)] * 30)
    assert 0 < sum(sizes) < 1.1 * len(text)
    model.log10(texts)
    sizes.clear()
    again = model.log10(texts)
    assert sum(sizes) < 0.1 * sum(map(len, texts))
    fresh = m.Model.__new__(m.Model)
    fresh.__dict__.update(model.__dict__, keys=None, known=None)
    monkeypatch.setattr(m, "SLOTS", 17)
    assert np.allclose(again, fresh.log10(texts), rtol=1e-12)
    assert np.allclose(again, [fresh.log10([t])[0] for t in texts], rtol=1e-12)


def test_symbols_of_one_case_have_the_same_decisions(learned, monkeypatch):
    texts, counts, _ = learned
    monkeypatch.setattr(m, "SLOTS", 17)
    coder = m.Coder(counts)
    symbols, before, hashes, _ = coder.contexts([p for t in texts for p in m.pieces(t)])
    pair = before * m.SYMBOLS + symbols
    key, slot = m.cases(pair, hashes)
    assert key.min() > 0 and 0 <= slot.min() and slot.max() < 1 << 17
    cells, _, bit, upto = coder.paths(pair, hashes)
    first = upto - coder.steps[pair]
    seen = {}
    for i in range(len(pair)):
        own = (cells[:, first[i] : upto[i]].tobytes(), bit[first[i] : upto[i]].tobytes(), pair[i])
        assert seen.setdefault((key[i], slot[i]), own) == own


def test_words_of_texts():
    texts = [b"", b" \t", b" a\x0bb\x0c\x00 a", "é\x85　 x".encode(), b"a", b"\xff\xfe a"]
    words, at, n = op6_lm_score.words_of(texts)
    words = words.to_pylist()
    assert [words[i] for i in at] == [w for t in texts for w in t.split()] and len(set(words)) == len(words)
    assert n.tolist() == [len(t.split()) for t in texts]
    assert op6_lm_score.words_of([b"", b" "])[2].tolist() == [0, 0] and len(op6_lm_score.words_of([])[2]) == 0


def test_slices_and_merged_counts():
    texts = [None, b"x" * 3_000_000, b"", b"y" * 3_000_000, b"z" * 9_000_000, *[b"a"] * 2000, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["t"])
    got = list(op6_lm_score._sliced([batch, batch.slice(0, 0)]))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert [b.num_rows for b in got][:3] == [3, 1, 1] and max(b.num_rows for b in got) == op6_lm_score.SLICE
    parts = [op6_lm_score._counted(pa.array(w, pa.large_binary()), np.array(c), np.array(c) + 1) for w, c in (([b"a", b"b"], [1, 0]), ([b"b", b"c"], [5, 2**40]))]
    assert op6_lm_score._merged(parts).to_pylist() == [{"word": b"a", "c": 1, "total": 2}, {"word": b"b", "c": 5, "total": 7}, {"word": b"c", "c": 2**40, "total": 2**40 + 1}]
