"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from itertools import combinations

import numpy as np
import pytest

from punchdeck.llm import decontaminate, embedding_dedup, order_minhash, packing, quality, suffix_dedup, token_counts, token_store, url_rules, warc
from punchdeck.llm import queries as q

LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
SAME = " ".join(f"tok{i}" for i in range(120))
EXTRA = "key string, n long, id long, host string, path string, row string, h string, owner long, evidence string, seed long"
ROWS = [(1, None), (2, ""), (3, SAME), (4, SAME), (4, SAME), (5, LONG), (6, "  \n"), (None, "no id at all"), (7, "Ünï çødé 日本語 😀")]


def frame(spark, rows):
    full = [(i, t, "en", "s", len(t or "")) + ("x", 1, 2, None, "p", "r", "h", 3, "e", 4) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, SAME), (2, None), (3, "two words"), (3, "two words")], "item_id long, text string")
    found = decontaminate.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in found} == {(3, 1, 1.0), (4, 1, 1.0)}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "7", "None"]
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_decontaminate_substitutions(spark):
    words = [f"tok{i}" for i in range(60)]
    text = " ".join("other" if i % 5 == 2 else w for i, w in enumerate(words))
    worse = " ".join("other" if i % 3 == 2 else w for i, w in enumerate(words))
    found = decontaminate.overlaps(frame(spark, [(1, text), (2, worse)]), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {1}


def test_decontaminate_masks():
    """Some mask fits between the tokens that differ, wherever they lie in a window or in a shorter item."""
    for n in range(decontaminate.LONG, decontaminate.WINDOW + 1):
        differ = max(k for k in range(n) if (n - k) / n >= decontaminate.LEAST)
        at = [{s + j for j, x in enumerate(m) if x == "1"} for m in decontaminate.MASKS for s in range(n - len(m) + 1)]
        assert all(any(places.isdisjoint(c) for places in at) for c in combinations(range(n), differ))


def test_decontaminate_short_items(spark):
    """Items of each length with as many substitutions as their definition allows, and with one more."""
    cases = [(7, (3,)), (7, (0,)), (9, (4,)), (15, (3, 7, 11)), (15, (2, 6, 10)), (16, (3, 7, 12)), (17, (2, 8, 13)), (5, (2,)), (6, (5,)), (6, (0,)), (6, ()), (4, ()), (2, ()), (1, ())]
    far = [(5, (1, 3)), (6, (2, 4)), (4, (1,)), (2, (0,))]
    texts = {(n, c): [f"i{n}c{''.join(map(str, c))}t{k}" for k in range(n)] for n, c in cases + far}
    items = [(i, " ".join(w)) for i, w in enumerate(texts.values())] + [(99, " .. ")]
    rows = [(i, " ".join(["before"] * 20 + ["other" if k in c else x for k, x in enumerate(w)] + ["after"] * 20)) for i, ((_, c), w) in enumerate(texts.items())]
    found = decontaminate.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(len(cases))}


def test_suffix(spark, docs, none):
    rows = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digest(docs).collect()}
    n = len(SAME)
    assert {(1, 0, 0), (2, 0, 0), (3, n, n), (4, n, n), (6, 3, 0)} <= rows and len(suffix_dedup.digest(docs).collect()) == len(ROWS)
    assert suffix_dedup.digest(none).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert {r.text for r in kept.filter("doc_id in (3, 4)").collect()} == {""}
    assert suffix_dedup.digest(frame(spark, [(1, "ab" * 300)])).first().n_removed == 600


def test_suffix_array(monkeypatch):
    """Induced sorting with its recursion against a plain sort: random and periodic strings, few and many symbols."""
    rng = np.random.default_rng(2)
    for few in (suffix_dedup.FEW, 1):
        monkeypatch.setattr(suffix_dedup, "FEW", few)
        for trial in range(400):
            n, k = int(rng.integers(1, 90)), int(rng.integers(1, 7))
            s = rng.integers(1, k + 1, n)
            s = np.append(np.tile(s[: max(1, n // 7)], 9) if trial % 3 == 0 else s, 0).astype(np.uint16)
            t = s.tolist()
            sa = suffix_dedup.suffix_array(s)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            shared, before = suffix_dedup.common_prefixes(s, sa)
            for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
                same = next(x for x in range(len(t)) if i + x >= len(t) or j + x >= len(t) or t[i + x] != t[j + x])
                assert (shared[i], before[i]) == (same, j)


def test_suffix_hot_owner(spark, monkeypatch):
    """An owner with many segments is cut a second time; nothing that repeats is lost."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rng = np.random.default_rng(4)
    own = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    edge, tails = own(80), [own(90) for _ in range(4)]
    texts = [own(60) + edge + tails[i % 4] + own(50) for i in range(30)] + [own(200) + tails[0]]
    met = {}
    for t in texts:
        for k in range(len(t) - 99):
            met[t[k : k + 100]] = met.get(t[k : k + 100], 0) + 1
    want = {(i, len({j for k in range(len(t) - 99) if met[t[k : k + 100]] > 1 for j in range(k, k + 100)})) for i, t in enumerate(texts)}
    found = suffix_dedup.digest(frame(spark, list(enumerate(texts))), length=100, gram=16).collect()
    assert {(r.doc_id, r.n_removed) for r in found} == want and all(n >= 170 for i, n in want if i < 30)


def test_suffix_words(spark, none):
    """Passages of 51 short words go, of any layout, once and twice in a text; those of 50 stay. Against a plain version."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    own = lambda n: [f"{x:x}" for x in rng.integers(1 << 12, 1 << 20, n)]
    one, two, fifty = own(51), own(70), own(50)
    words = [own(90) + one + own(40), one + own(33), own(10) + fifty + own(9), own(12) + fifty, own(5) + two + own(30) + two, own(200), ["é"] * 60, own(20) + one, own(70)]
    words.append(words[-1])
    rows = [(i, ("\n " if i % 2 else " ").join(w)) for i, w in enumerate(words)]
    rows += [(20, None), (21, ""), (22, " \n")]
    met = {}
    for w in words:
        for k in range(len(w) - 50):
            met[tuple(w[k : k + 51])] = met.get(tuple(w[k : k + 51]), 0) + 1
    want = {}
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 50) if met[tuple(w[k : k + 51])] > 1 for j in range(k, k + 51)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    assert len(want[0]) == 130 and len(want[2]) == 69 and want[6] == want[8] == []
    found = {r.doc_id: r.text for r in corpus_pipeline.suffix_stage(spark, frame(spark, rows), "").collect()}
    assert {i: t.split() for i, t in found.items() if i < 20} == {i: w for i, w in want.items() if i in found}
    assert {i for i in want if i not in found} == {6, 8, 9} and {20, 21, 22} <= set(found)
    assert corpus_pipeline.suffix_stage(spark, none, "").count() == 0


def test_minhash(spark, docs, none):
    rows = {r.doc_id: r for r in order_minhash.near_duplicates(docs).collect()}
    assert (rows[3].component_id, rows[4].component_id, rows[4].kept, rows[3].kept) == (3, 3, False, True)
    assert rows[1].kept and rows[2].kept and rows[6].kept and set(rows) == {1, 2, 3, 4, 5, 6, 7}
    assert order_minhash.near_duplicates(none).count() == 0


def test_minhash_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    near = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(60)]
    apart = [(100 + k, " ".join(base[:60] + [f"x{k}y{i}" for i in range(140)])) for k in range(40)]
    rows = order_minhash.near_duplicates(frame(spark, near + apart)).collect()
    assert {r.component_id for r in rows if r.doc_id < 100} == {0} and all(r.kept for r in rows if r.doc_id >= 100)


def test_embeddings(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(1, one), (2, one), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, float("nan"), 0.0]), (6, [-1.0, 0.2, 0.0]), (7, [1.0, 0.01, 0.5]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, 0, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, class string, n int")
    found = {tuple(r) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == {(1, 2, 1, True), (2, 2, 1, False), (7, 2, 1, False)} | {(i, 0, i, True) for i in (3, 4, 5, 6, 8, 9)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_lengths_and_scale(spark):
    """Vectors of each length among themselves, and components whose squares leave the range of doubles."""
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [1e-200, 1e-200]), (4, [1.0, 0.1]), (5, [1e200, 1e200]), (6, [2e200, 2e200]), (7, [1.0]), (8, [3.0]), (9, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (0, 4), 5: (2, 3), 6: (2, 3), 7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_embedding_recall_in_a_dense_direction(spark):
    """Pairs at cosine 0.955 among 20,000 vectors of which any two have about 0.85."""
    rng = np.random.default_rng(14)
    dim, n, pairs = 64, 20_000, 400
    one = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = one(rng.standard_normal(dim))
    side = lambda k: one((g := rng.standard_normal((k, dim))) - np.outer(g @ axis, axis))
    a, b = np.sqrt(0.85), np.sqrt(0.15)
    first, more = side(n), side(pairs)
    share = 0.7  # cosine of the parts off the axis of a pair: 0.85 + 0.15 * 0.7 = 0.955
    off = one(more - (more * first[:pairs]).sum(1, keepdims=True) * first[:pairs])
    twin = share * first[:pairs] + np.sqrt(1 - share**2) * off
    x = np.concatenate([a * axis + b * first, a * axis + b * twin])
    near = x[:pairs] @ x.T >= 0.95
    near[np.arange(pairs), np.arange(pairs)] = False
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, distinct = embedding_dedup.classes(df, "vec_id", "embedding")
    found = {(r.a, r.b) for r in embedding_dedup.passes(distinct, 0.95, embedding_dedup.PASSES, embedding_dedup.BITS, None, 1).collect()}
    want = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero(near))}
    assert len(want & found) >= 0.95 * len(want), len(want & found) / len(want)


def test_embedding_forest():
    """The pairs of a window join what all its near pairs join, with fewer of them."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((6, 16)), 40, axis=0) + 0.05 * rng.standard_normal((240, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    pairs = embedding_dedup.neighbours(np.arange(240), x, 64, 0.95, step=50)
    label = list(range(240))
    for a, b in sorted(pairs):
        low, high = sorted((label[a], label[b]))
        label = [low if v == high else v for v in label]
    assert label == [k // 40 * 40 for k in range(240)] and len(pairs) < 300


def test_packing_shards(spark):
    """Pieces that fill no sequence well: no task gets much over ``shard_rows``, and each has a sequence of its own."""
    rows = spark.range(9_000).selectExpr("id doc_id", "0 piece", "0L start", "1100L length", "7L ids_crc32")
    out = packing.pack(rows, 2048, shard_rows=1_000)
    found = out.selectExpr("shiftright(sequence_id, 32) shard").groupBy("shard").count().collect()
    assert max(r["count"] for r in found) < 1_500 and out.select("sequence_id").distinct().count() == 9_000 == out.count()


def test_packing(spark, docs, none):
    path = q.tokenizer("byte_bpe_50k.json")
    rows = packing.pack(packing.pieces(docs, path, 2048, 0), 2048).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack(packing.pieces(none, path, 2048, 0), 2048).count() == 0


def test_tokens(spark, docs, none):
    path = q.tokenizer("word_bpe_49k.json")
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    assert (counts[1].n_tokens, counts[2].n_tokens, counts[6].n_tokens, counts[5].over_limit) == (0, 0, 0, True)
    assert token_counts.token_counts(none, path).count() == 0
    for df, n in ((docs, len(ROWS)), (none, 0)):
        folder = token_store.store_folder(spark)
        rows = token_store.read_digest(spark, folder, token_store.write(df, folder, path, end_id=1)).collect()
        assert len(rows) == n and [r.start for r in sorted(rows, key=lambda r: r.start)][:1] == [0][:n]


def test_urls(spark, monkeypatch):
    rows = [(1, None), (2, "no scheme/en/"), (3, "http://A.Example.COM/en/7x?q"), (4, "http://example.com/en/"), (5, "x://b.net/de"), (6, "http://example.net/de/8#f"), (7, "http://anet/de/"), (7, "http://anet/de/")]
    df = spark.createDataFrame([(i, u, "h", "p", "t") for i, u in rows], "page_id long, url string, html string, host string, token string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, q.url_table(spark)).collect()}
    assert found == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 4: ("example.com", "/en/", "com/en/", "block"),
        5: ("b.net", "/de", None, "allow"), 6: ("example.net", "/de/8", "example.net/de/8", "block"), 7: ("anet", "/de/", None, "allow"),
    }
    assert url_rules.judge(df.limit(0), q.url_table(spark)).count() == 0
    assert url_rules.judge(df, q.url_table(spark)).count() == 8 and {r.verdict for r in url_rules.judge(df, q.url_table(spark).limit(0)).collect()} == {"allow"}
    monkeypatch.setattr(url_rules, "LITERAL_RULES", 0)
    joined = url_rules.judge(df, q.url_table(spark)).collect()
    assert len(joined) == 8 and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined} == found


def test_warc(spark):
    schema = "record_id long, url string, at long, kind string, headers map<string,string>, slice int, found string"
    rows = [(1, "http://a.org/x/", 1, "response", {"ETag": '"1"', "Server": "s"}), (2, "https://www.a.org/x#f", 2, "revisit", {"etag": 'W/"1"', "Server": "no", "Date": "d"}), (3, "http://a.org/x", 0, "revisit", None),
            (4, None, 3, "revisit", {}), (5, "http://a.org/x", 4, "response", {"ETag": '"2"'}), (6, "http://a.org/x", 9, "revisit", {"ETag": '"1"'}), (7, "http://a.org/x", 9, "request", None)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], schema)
    found = {r.record_id: (r.refers_to, r.status, r.headers) for r in warc.resolve(df).collect()}
    assert found == {2: (1, "resolved", {"Server": "s", "etag": 'W/"1"', "Date": "d"}), 3: (None, "no-response", None), 4: (None, "no-url", None), 6: (None, "etag-differs", None)}
    assert warc.resolve(df.limit(0)).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (99, 1, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r.kept for r in rows)
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == len(ROWS)


def test_quality_posterior(spark):
    """Shares and posteriors against the formulas written out in plain Python."""
    rng = np.random.default_rng(8)
    rows = [(i, f"h{i % 5}", f"p{i % 3}" if i % 7 else None, float(e)) for i, e in enumerate(rng.normal(0, 2, 300) + np.arange(300) % 5 - 2)]
    df = spark.createDataFrame(rows, "id long, host string, path string, evidence double")
    prior = 0.6
    vote = {r[0]: 1 / (1 + np.exp(-(r[3] + np.log(prior / (1 - prior))))) for r in rows}
    hosts, paths = {}, {}
    for i, h, p, _ in rows:
        for group, key in ((hosts, h), (paths, (h, p))):
            k, n = group.get(key, (0, 0))
            group[key] = k + vote[i], n + 1
    mean = sum(k for k, _ in hosts.values()) / len(rows)

    def weight(groups, centre):
        between = np.mean([(k / n - centre(g)) ** 2 for g, (k, n) in groups.items()]) - np.mean([centre(g) * (1 - centre(g)) / n for g, (k, n) in groups.items()])
        return min(1000.0, max(1.0, np.mean([centre(g) * (1 - centre(g)) for g in groups]) / between - 1)) if between > 0 else 1000.0

    wh = weight(hosts, lambda g: mean)
    share = {h: (k + wh * mean) / (n + wh) for h, (k, n) in hosts.items()}
    wp = weight(paths, lambda g: share[g[0]])
    for r in quality.posterior(df.select("host", "path", "evidence"), df, prior).collect():
        (hk, hn), (k, n) = hosts[r.host], paths[r.host, r.path]
        h = (hk - vote[r.id] + wh * mean) / (hn - 1 + wh)
        p = (k - vote[r.id] + wp * h) / (n - 1 + wp)
        want = 1 / (1 + np.exp(-(r.evidence + np.log(p / (1 - p)))))
        assert abs(r.host_share - h) < 1e-9 and abs(r.path_share - p) < 1e-9 and abs(r.posterior - want) < 1e-9 and r.kept == (want >= 0.5)


def test_quality_carries_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", "mine", "own")], "doc_id long, text string, source string, lang string, kept string, evidence string")
    row = quality.judged(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    assert (row.row.kept, row.row.evidence, row.kept, row.evidence) == ("mine", "own", True, 0.0)


def test_encoding_random_unicode():
    """Ids of units one after the other are those of the whole text, for both tokenizers."""
    from tokenizers import Tokenizer

    from punchdeck.llm import encoding

    rng = np.random.default_rng(9)
    pools = [range(32, 127), range(0xA0, 0x250), [*range(9, 14), 32, 0x1C, 0x85, 0xA0, 0x2009, 0x3000], range(0x370, 0x530), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), range(0x300, 0x340), [ord(c) for c in "<|endoftext|> 's 12"]]
    texts = []
    for _ in range(2_000):
        some = [pools[k] for k in rng.integers(0, len(pools), 3)]
        texts.append("".join(chr(some[k % 3][int(rng.integers(len(some[k % 3])))]) for k in rng.integers(0, 3, int(rng.integers(0, 40)))))
    for name, split in (("byte_bpe_50k.json", encoding.spaced_words), ("word_bpe_49k.json", encoding.words)):
        lib = Tokenizer.from_file(q.tokenizer(name))
        made = encoding.UnitEncoder(q.tokenizer(name), split, list)(texts)
        assert [[i for unit in parts for i in unit] for parts in made] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_shingles(text):
    import re

    words = re.findall(r"\w+", text.lower())
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain_components(texts):
    """Smallest id reachable by pairs of texts whose shingles are within a fifth of the longer length in edits."""
    parts, label = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            n = max(len(parts[a]), len(parts[b]))
            if a < b and label[a] != label[b] and parts[a] and parts[b] and abs(len(parts[a]) - len(parts[b])) <= n / 5 and len(set(parts[a]) & set(parts[b])) and plain_distance(parts[a], parts[b]) <= int(0.2 * n + 1e-9):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return label


def test_edit_distance():
    """Banded alignment against the whole table of an ordinary dynamic program."""
    rng = np.random.default_rng(10)
    for _ in range(1_500):
        a = rng.integers(0, int(rng.integers(2, 9)), int(rng.integers(1, 40))).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 2)) if rng.random() < 0.5 else rng.permutation(a)
        b = np.insert(b, rng.integers(0, len(b) + 1, 2), 3) if rng.random() < 0.7 else b
        most = int(rng.integers(0, 12))
        assert order_minhash.edit_distance(a, b, most) == min(most + 1, plain_distance(a.tolist(), b.tolist()))


def test_minhash_one_template(spark):
    """Thirty texts with one template, in pairs of near copies that mostly miss the first text: no pair is lost."""
    rng = np.random.default_rng(11)
    template, rows = [f"t{k}" for k in range(60)], []
    for k in range(30):
        own = [f"x{rng.integers(1 << 40)}" for _ in range(30)]
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + own[:-3] + ["other", "end"]))]
    rows = [(int(j), t) for j, (_, t) in zip(rng.permutation(60), rows)]
    found = {r.doc_id: r.component_id for r in order_minhash.near_duplicates(frame(spark, rows), small=4).collect()}
    assert found == plain_components(dict(rows)) and len(set(found.values())) == 30


def test_minhash_sketches_of_long_texts(monkeypatch):
    """A text with more places than the bits kept for them changes nothing for the others of its batch."""
    rng = np.random.default_rng(12)
    short, long_ = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (40, 3_000))
    alone = order_minhash.sketches([short])
    monkeypatch.setattr(order_minhash, "PLACE_BITS", 8)
    assert (order_minhash.sketches([short, long_])[0] == alone[0]).all()


def test_components(spark):
    from punchdeck.llm.common import components

    rng = np.random.default_rng(13)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + k, 501 + k) for k in range(40)] + [(7, 7)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            low, high = sorted((label[a], label[b]))
            label = {x: low if v == high else v for x, v in label.items()}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in rows} == set(label.items()) and len(rows) == len(label)


def test_order_minhash_large_buckets(spark):
    """Texts that drift from one to the next: most links miss the first text of their bucket."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[int(rng.integers(40, 120))] = f"x{rng.integers(1 << 40)}"
    one = [order_minhash.shingles(order_minhash.word_hashes(t, order_minhash.Hashes())) for _, t in rows]
    smallest = list(range(60))
    for a in range(60):
        for b in range(a):
            if smallest[a] != smallest[b] and order_minhash.similar(one[a], one[b]):
                low, high = sorted((smallest[a], smallest[b]))
                smallest = [low if x == high else x for x in smallest]
    docs = frame(spark, rows)
    assert {(r.doc_id, r.component_id) for r in order_minhash.near_duplicates(docs, small=2).collect()} == set(enumerate(smallest))
    classes = spark.createDataFrame([(i, i // 20 % 2) for i in range(60)], "id long, k long")
    held = order_minhash.contested(classes.selectExpr("k key", "id class"), classes.selectExpr("id class", "id - id % 20 component"))
    assert (held.count(), held.filter("outside").count()) == (40, 20)


def test_order_minhash_lines_of_two_templates(spark, monkeypatch):
    """Two templates whose texts end in the same few lines: what only one of them has shows that no pair needs a look."""
    rng = np.random.default_rng(14)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(6)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join([f"t{i % 2}w{k}" for k in range(164)] + [lines[k] for k in rng.permutation(6)[:3]])))
    assert plain_components(dict(rows)) == {i: i % 2 for i in range(80)}
    tried, linked = [], order_minhash.linked
    monkeypatch.setattr(order_minhash, "linked", lambda pairs, *a: tried.append(pairs.count()) or linked(pairs, *a))
    found = spark.createDataFrame([(i, i % 2) for i in range(80)], "class long, component long")
    bucket = found.selectExpr("0L key", "class", "0L first")
    none = spark.createDataFrame([], "a long, b long")
    assert order_minhash.rest(bucket, none, found, frame(spark, rows), "doc_id", "text", order_minhash.LEAST).isEmpty()
    assert len(tried) == 2 and sum(tried) <= len(rows)


def joined_rows(spark, df):
    """Rows that the joins of a plan gave when it ran, and the rows of ``df``."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, rows = store.executionsCount(), df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, rows


def test_order_minhash_prefixes_of_large_groups(spark):
    """Most shingles of a large group are common ones: they need no rows in the join, and each text has the same prefix."""
    rng = np.random.default_rng(15)
    texts = {}
    for i in range(120):
        shared = rng.permutation(200)[: 1 + i % 3]
        words = [f"w{k}" if k not in shared else f"x{k}y{int(rng.integers(6))}" for k in range(200)]
        texts[i] = " ".join(words + ([f"only{i}n{k}" for k in range(60)] if i % 4 == 0 else []))
    texts[120] = " ".join(f"other{k}" for k in range(30))
    rows = [(i, i % 5, True, t) for i, t in texts.items()]
    held = order_minhash.held_shingles(spark.createDataFrame(rows, "id long, component long, outside boolean, text string")).cache()
    hs = {r.id: r.hs for r in held.collect()}
    of = {}
    for i, x in hs.items():
        for h in x:
            of.setdefault(h, []).append(i)
    joint = {h: len(ids) for h, ids in of.items() if len({i % 5 for i in ids}) > 1}
    want = set()
    for i, x in hs.items():
        order = sorted((h for h in x if h in joint), key=lambda h: (joint[h], h))
        for j, h in enumerate(order):
            at = len(x) - len(order) + j
            if at <= int((1 - order_minhash.LEAST) * len(x) + 1e-9):
                want.add((h, i, i % 5, True, len(x), at))
    made, found = joined_rows(spark, order_minhash.prefixes(held, order_minhash.LEAST).select("h", "id", "component", "outside", "n", "at"))
    assert want and {tuple(r) for r in found} == want and len(found) == len(want)
    assert 0 < made < sum(joint.values()) // 5
    none = order_minhash.prefixes(held.limit(0), order_minhash.LEAST)
    assert none.isEmpty()


def test_encoding_spellings():
    """Spellings of a word are one unit for a tokenizer that lower-cases, and plain words pass by its patterns."""
    from tokenizers import Tokenizer

    from punchdeck.llm import encoding

    letters = [chr(c) for c in range(0xC0, 0x250)]
    texts = ["Straße STRASSE straße Ünder ünder ÜNDER it's IT'S 'Street O'DREW x1Y2", "<|EndOfText|> Abc", "<|endoftext|>ABC <|ENDOFTEXT|>", "\u212aelvin \u212bng \u1e9e \u0130stan \u0181a \u023a \u0243", "".join(letters), " ".join(a + "b" + a.upper() for a in letters)]
    texts += [a + "X" for a in letters] + [f"{a}'S {a}" for a in letters]
    path = q.tokenizer("word_bpe_49k.json")
    encode, lib = encoding.UnitEncoder(path, encoding.words, list), Tokenizer.from_file(path)
    assert [[i for unit in parts for i in unit] for parts in encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    encode = encoding.UnitEncoder(path, encoding.words, list)
    encode(["Word word WORD wOrd", "WORD Ünder ÜNDER ünder"])
    assert set(encode.table) == {"word", "ünder"}
    many = sorted({"".join(map(chr, r)) for r in np.random.default_rng(16).integers(97, 123, (900, 7)).tolist()})
    calls, whole = [], encode.plain
    encode.plain = type("Counted", (), {"encode_batch_fast": lambda _, texts, **k: calls.append(1) or whole.encode_batch_fast(texts, **k)})()
    assert encode(many) == [[lib.encode(t, add_special_tokens=False).ids] for t in many] and len(calls) == -(-len(many) // encoding.JOINED)
    ends, encode.ends, encode.table = encode.ends, set(), {}
    assert encode(many) == [[lib.encode(t, add_special_tokens=False).ids] for t in many] and ends
    assert encoding.lowers(path) and not encoding.lowers(q.tokenizer("byte_bpe_50k.json"))
