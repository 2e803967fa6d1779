"""Cases of clustering, secret scans and periodic runs: nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re

import numpy as np

from punchdeck.llm import centroids, periodic_runs, secrets
from tests.llm.test_contracts import plain_runs

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, cluster string, distance long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "v", "c", 3) for i, e in rows], VECTORS)


def plain_clusters(rows, k, rounds):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [np.array(r[1], object) for r in order[:k]]
    for at in range(rounds + 1):
        near = [min((int(((np.array(x, object) - m) ** 2).sum()), j) for j, m in enumerate(c)) for _, x in rows]
        if at < rounds:
            for j in range(len(c)):
                own = [np.array(x, object) for (_, x), n in zip(rows, near, strict=True) if n[1] == j]
                if own:
                    c[j] = sum(own) // len(own)
    return sorted((str(i), n[1], n[0]) for (i, _), n in zip(rows, near, strict=True))


def test_centroids(spark):
    rng = np.random.default_rng(3)
    whole = [(i, [float(x) for x in rng.integers(-3, 3, 4)]) for i in range(60)]
    whole += [(5, whole[5][1]), (5, whole[6][1]), (None, [0.0, 0.0, 1.0, -1.0]), (77, [1e6, -1e6, 0.5, 0.25]), (78, [-0.25, -0.75, 0.0, -0.0])]
    left_out = [(90, None), (91, []), (92, [1.0, 2.0, 3.0]), (93, [1.0, None, 0.0, 0.0]), (94, [float("nan"), 0.0, 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0, 0.0]), (96, [1e30, 0.0, 0.0, 0.0])]
    want = plain_clusters([(i, [int(np.floor(4 * x)) for x in e]) for i, e in whole], 5, 2)
    found = centroids.cluster(vectors(spark, whole + left_out).repartition(7), k=5, rounds=2, dim=4, scale=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found) == want
    assert {r.inertia for r in found} == {sum(d for *_, d in want)}
    few = centroids.cluster(vectors(spark, whole[:3]), k=16, dim=4)
    assert sorted((r.vec_id, r.distance) for r in few.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert centroids.cluster(vectors(spark, [])).count() == 0 and centroids.cluster(vectors(spark, left_out), dim=4).columns == few.columns


TEXTS = "doc_id long, text string, id long, start long, runs string, collapsed string, n_runs int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "r", "c", 3) for i, t in rows], TEXTS)


def test_periodic_runs(spark):
    rng = random.Random(5)
    made = ["", "  \n\t", "a " * 23, "a " * 24, "x " + "a b " * 12 + "a", "a b c d e f g h " * 3, "é\x85 \x1f " * 30, "\x0b".join("ab" * 40)]
    for _ in range(150):
        words: list[str] = []
        while len(words) < rng.randint(0, 300):
            root = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
            words += (root * 9)[: rng.randint(1, 90)] if rng.random() < 0.6 else [rng.choice("ab") for _ in range(20)]
        made.append("".join(w + rng.choice([" ", "  ", "\n", "\r\n"]) for w in words))
    long = " ".join(f"w{i % 997}" for i in range(100_000)) + " end"
    rows = list(enumerate(made)) + [(500, long), (500, long), (None, "a " * 30), (501, None)]
    want = sorted((str(i), s, m, p) for i, t in rows if t != long for s, p, m in plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    want = sorted(want + [("500", 0, 100_000, 997)] * 2)
    docs = texts(spark, rows).repartition(3)
    assert sorted((str(r.doc_id), r.start, r.length, r.period) for r in periodic_runs.runs(docs).collect()) == want
    kept = {(r.doc_id, r.n_words, r.n_dropped, r.text) for r in periodic_runs.collapsed(docs).collect()}
    assert {(501, 0, 0, ""), (None, 30, 29, "a"), (500, 100_001, 99_003, " ".join(f"w{i}" for i in range(997)) + " end"), (4, 26, 23, "x a b")} <= kept
    none = texts(spark, [])
    assert periodic_runs.runs(none).count() == periodic_runs.collapsed(none).count() == periodic_runs.digest(none).count() == 0
    assert len(periodic_runs.digest(docs).collect()) == len(rows)


def test_guess_cost():
    """The cheapest of all ways to cut a value into dictionary words and single characters; parts of other kinds by hand."""
    rank = {"the": 2, "moon": 300, "hem": 40, "emo": 7, "oon": 9}
    one, part = math.log10(26), math.log10(2)

    def plain(value):
        least = math.inf
        for cuts in itertools.product([0, 1], repeat=len(value) - 1):
            ends = [i for i, c in enumerate(cuts, 1) if c] + [len(value)]
            pieces = [value[a:b] for a, b in zip([0, *ends], ends)]
            if all(len(x) == 1 or x in rank for x in pieces):
                least = min(least, sum(one if len(x) == 1 else math.log10(rank[x]) + part for x in pieces))
        return least

    rng = random.Random(2)
    for _ in range(150):
        value = "".join(rng.choice(["the", "moon", "hem", "oon", "v", "x", "em"]) for _ in range(rng.randint(1, 4)))[:11]
        if not re.search(r"(.{1,8})\1", value) and not any(b - a > 3 for a, b, _ in secrets.walk_parts(value)):
            assert math.isclose(secrets.guess_cost(value, rank), plain(value)), value
    assert math.isclose(secrets.guess_cost("The", rank), math.log10(2) + math.log10(2) + part)
    assert math.isclose(secrets.guess_cost("2014-02-28", {}), math.log10(365 * 20) + math.log10(4) + part)
    assert math.isclose(secrets.guess_cost("28021990", {}), math.log10(365 * 20) + part) and secrets.guess_cost("99999999", {}) < 3
    assert math.isclose(secrets.guess_cost("xk" * 30, {}), 2 * one + math.log10(30) + part)
    assert math.isclose(secrets.guess_cost("asdfgh", {}), math.log10(47 * 6) + math.log10(4) + part)
    assert secrets.guess_cost("x9$Kq!27vLz", rank) > 13 and secrets.guess_cost("", rank) == 0


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    kelvin = "to\u212aen = abcdefghijkl"
    made = [
        f'x token = "{key}" y', "API_KEY: abcdefgh, apikey=short", "secret=token=abcdefgh1", "secret: token: abcdefgh", "AKIA" + "A" * 11, "zAKIA" + "B" * 12 + " " + "f" * 32, "pwd => 'x9$Kq!27vLz'.",
        "passphrase is changeme. password is changeme", kelvin, "", " \n", "😀 PassWord : Zx81Qp0055", "pwd: " + "qwerty" * 3000 + "!", "changeme " * 500,
    ]
    rows = list(enumerate(made)) + [(0, made[0]), (None, made[6]), (90, None)]
    found = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.digest(texts(spark, rows).repartition(3)).collect()}
    want = {
        (0, 1, 0, 1, "assign:2:51,hex:11:51"), (1, 1, 0, 0, "assign:0:17"), (2, 1, 0, 0, "assign:0:22"), (3, 0, 0, 0, ""), (4, 0, 0, 0, ""), (5, 0, 1, 1, "access:1:17,hex:18:50"),
        (6, 0, 0, 0, "guess:8:19"), (None, 0, 0, 0, "guess:8:19"), (7, 0, 0, 0, ""), (8, 0, 0, 0, ""), (9, 0, 0, 0, ""), (10, 0, 0, 0, ""), (11, 1, 0, 0, "assign:2:23"), (12, 0, 0, 0, ""), (13, 0, 0, 0, ""), (90, 0, 0, 0, ""),
    }
    assert found == want
    assert secrets.digest(texts(spark, rows)).count() == len(rows) and secrets.digest(texts(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redacted(texts(spark, rows)).collect()}
    assert clean[0] == 'x [assign]" y' and clean[6] == "pwd => '[guess]'." and clean[90] == ""
    assert {(r.doc_id, r.secret) for r in secrets.spans(texts(spark, rows)).filter("kind = 'guess'").collect()} == {(6, "x9$Kq!27vLz"), (None, "x9$Kq!27vLz")}
    # words of one count are ordered by themselves
    assert secrets.frequent_words(texts(spark, [(1, "Bee ant bee ant cow an"), (2, None)]), 2) == {"ant": 1, "bee": 2}
    many = texts(spark, [(i, " ".join(f"{a}{b}{c}" for a in "abcdef" for b in "xyz" for c in "uvw") + " top" * i) for i in range(4)])
    some = secrets.frequent_words(many, 30)
    assert len(some) == 30 and list(some.values()) == list(range(1, 31)) and "top" in some
