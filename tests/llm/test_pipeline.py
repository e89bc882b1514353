"""Every stage of the pipeline, on the columns of documents, against a plain version."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import brute_components

import corpus_pipeline
from tarn.llm import op8_toxicity
from tarn.llm.common import SPACE_TOKEN, materialize

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, exact and near copies, in three sources, and their labels."""
    rng = np.random.default_rng(11)
    vocabulary = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, rng.integers(20, 80))) for _ in range(40)]
    texts = list(base)
    texts += [t.upper() for t in base[:8]]  # equal after lower-casing
    for t in base[8:16]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{t} idiotic clownish trash" for t in base[16:40]]
    texts += [None, "", "short"]
    docs = [(i, t, "en", "abc"[i % 3] if i % 10 else None, len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int("idiotic" in (t or ""))) for i, t in enumerate(texts)] * 3
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(name, rows in, rows out) of each stage as run() chains them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, folder), "tested")
        out.append((name, [tuple(r) for r in docs.collect()], [tuple(r) for r in done.collect()]))
        docs = done
    return dict((n, (a, b)) for n, a, b in out)


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, stages):
    before, after = stages["toxicity"]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = op8_toxicity.fit(docs, labels)
    from test_brute import slow_features

    w = model["weights"]
    want = [r for r in before if 1 / (1 + math.exp(-(w[0] + np.dot(w[1:], slow_features(r[1], model["words"], model["stems"]))))) < 0.5]
    assert Counter(after) == Counter(want)
    assert {r[0] for r in before if r not in after} == {r[0] for r in before if "idiotic" in (r[1] or "")}


def test_exact_copies_leave_the_largest_id(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before:
        k = (r[1] or "").translate(UP)
        best[k] = max(best.get(k, r), r, key=lambda x: x[0])
    assert Counter(after) == Counter(best.values())


def test_near_copies_leave_the_smallest_id(stages):
    before, after = stages["near_dedup"]
    before = sorted(before)
    comp, sizes = brute_components([r[1] for r in before], 5, 80)
    assert sorted(after) == [r for i, r in enumerate(before) if comp[i] == i or not sizes[i]]
    assert len(after) < len(before)


def test_mixed_sources_stand_as_often_as_the_mixture_takes_them(stages):
    import hashlib
    import re

    before, after = stages["mix_sources"]
    size = lambda t: len(re.findall(SPACE_TOKEN, t or ""))
    total = defaultdict(int)
    for r in before:
        total[r[3]] += size(r[1])
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    everything, target, free = sum(total.values()), {}, set(sources)
    while True:  # the excess over three times the size goes to the others by weight, until none is above
        left = everything - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > 3 * total[s]]
        if not over:
            target |= shares
            break
        for s in over:
            target[s] = 3 * total[s]
            free.remove(s)
    want = Counter()
    for s in sources:
        take, at = min(round(target[s]), 3 * total[s]), 0
        key = lambda r: hashlib.md5("\x1f".join(["mix-1", str(r[0]), str(size(r[1])), hashlib.md5((r[1] or "").encode()).hexdigest()]).encode()).hexdigest()
        for r in sorted((r for r in before if r[3] == s), key=key):
            n = size(r[1])
            taken = n * (take // total[s]) + max(0, min(at + n, take % total[s]) - at) if total[s] else 0
            at += n
            want[r] = int(math.floor(taken / n + 0.5)) if n else 1
    assert Counter(after) == +want


def test_packed_pieces_hold_every_document(stages):
    before, after = stages["best_fit_packing"]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in before)
    assert Counter((r[0], r[3]) for r in after) == want


def test_run_is_its_stages(spark, folder, stages):
    rows = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    drop = lambda rs: Counter(r[:5] for r in rs)  # the numbers of sequences are free
    assert drop(rows) == drop(stages["best_fit_packing"][1])
