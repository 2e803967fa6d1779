"""The queries over the smallest tables against plain versions over whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from punchdeck.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer(name))


def test_op2(spark, docs):
    data = {d: t.encode() for d, t in docs.items()}
    count = Counter(hash(t[i : i + 400]) for t in data.values() for i in range(len(t) - 399))
    for r in q.op2_suffix_dedup(spark, SF).collect():
        t = data[r.doc_id]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest())


def test_op3(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = {(int(i), int(near[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
    assert {tuple(r) for r in q.op3_embedding_dedup(spark, SF).collect()} == want


def test_op4(spark, docs):
    lib, found, bins = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in q.op4_packing(spark, SF).collect():
        found[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d, t in docs.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(found[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 2048 and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or k == 0)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * total / 2048 + 2


def test_op5(spark, docs):
    lib = library("word_bpe_49k.json")
    want = {(d, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 2048) for d, t in docs.items()}
    assert {tuple(r) for r in q.op5_token_counts(spark, SF).collect()} == want


def test_op10(spark, docs):
    lib, at, want = library("word_bpe_49k.json"), 0, set()
    for d in sorted(docs):
        ids = lib.encode(docs[d], add_special_tokens=False).ids + [1]
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in q.op10_token_store(spark, SF).collect()} == want


def test_op1(spark, docs):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, text in docs.items():
        t = np.array(words(text))
        for i, item in items.items():
            item, w = np.array(item), min(16, len(item))
            for shift in range(-len(item) + w, len(t) - w + 1):
                a, b = max(0, shift), min(len(t), shift + len(item))
                equal = t[a:b] == item[a - shift : b - shift]
                if len(equal) >= w and equal.sum() >= 0.8 * w and (np.convolve(equal, np.ones(w), "valid") >= 0.8 * w).any():
                    want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in q.op1_decontaminate(spark, SF).collect()} == want


def test_op6(spark, docs):
    from tests.llm.test_cases import plain_components, plain_shingles

    # texts without a shingle in common can't be similar: each is compared with those that share one
    holds = defaultdict(set)
    for d, t in docs.items():
        for x in set(plain_shingles(t)):
            holds[x].add(d)
    near = {d: set() for d in docs}
    for ds in holds.values():
        for d in ds:
            near[d] |= ds
    label, todo = {}, set(docs)
    while todo:
        group, front = set(), {min(todo)}
        while front:
            group |= front
            front = set().union(*(near[d] for d in front)) - group
        todo -= group
        label |= plain_components({d: docs[d] for d in sorted(group)}) if len(group) > 1 else {d: d for d in group}
    assert {(r.doc_id, r.component_id) for r in q.op6_order_minhash(spark, SF).collect()} == set(label.items())


def test_op8(spark):
    rows = {r.doc_id: r for r in q.op8_quality(spark, "/root/testdata/sf0.1").select("doc_id", "kept").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    right = Counter((r.quality == 1 and not r.toxic, rows[r.doc_id].kept) for r in labels)
    assert right[True, False] <= 0.01 * (right[True, True] + right[True, False])
    assert right[False, True] <= 0.05 * (right[False, True] + right[False, False])


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) > 50


def test_op11(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = {r.vec_id: [math.floor(64 * float(x)) for x in r.embedding] for r in rows}
    order = sorted(v, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    centroids, n = [v[i] for i in order], len(rows[0].embedding)

    def assigned():
        return {i: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids)) for i, x in v.items()}

    for _ in range(3):
        groups = defaultdict(list)
        for i, (_, k) in assigned().items():
            groups[k].append(v[i])
        centroids = [[sum(x[d] for x in groups[k]) // len(groups[k]) for d in range(n)] if k in groups else c for k, c in enumerate(centroids)]
    last = assigned()
    inertia = Counter()
    for d, k in last.values():
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = {(i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, (d, k) in last.items()}
    assert {tuple(r) for r in q.op11_centroids(spark, SF).collect()} == want


def plain_runs(words, least=24, times=3):
    """(start, period, length) of each run, by comparing all words ``q`` apart for each ``q``."""
    found = {}
    for q in range(1, len(words) // times + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i + q == len(words) or words[i] != words[i + q]:
                if i > start and i - start + q >= max(least, times * q):
                    found.setdefault((start, i - start + q), q)
                start = i + 1
    return sorted((s, q, m) for (s, m), q in found.items())


def test_op13(spark, docs):
    want = set()
    for d, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(w)
        dropped = {i for s, q, m in found for i in range(s + q, s + m)}
        best = max(((Fraction(m, q), -s, -q) for s, q, m in found), default=None)
        top = (-best[1], int(best[0] * -best[2]), -best[2], int(1000 * best[0])) if best else (None,) * 4
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, q, m in found), " ".join(x for i, x in enumerate(w) if i not in dropped))]
        want.add((d, len(found), *top, *sha))
    assert {tuple(r) for r in q.op13_periodic_runs(spark, SF).collect()} == want and any(x[1] for x in want)


def test_op12(spark, docs):
    patterns = ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "(AKIA[A-Z0-9]+)", 16), ("hex", "([0-9a-f]+)", 32)
    rows = {r.doc_id: r for r in q.op12_secret_scan(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, text in docs.items():
        found = sorted((m.start(), k, m.end()) for k, (_, p, least) in enumerate(patterns) for m in re.finditer(p, text) if len(m[m.lastindex]) >= least)
        base = [f"{patterns[k][0]}:{a}:{b}" for a, k, b in found]
        assert (rows[d].n_assign, rows[d].n_access, rows[d].n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert rows[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[d].spans.split(","))
