"""The store of facts: what changed is taken apart, the rest stays; damage is found."""

import glob
import os

from pyspark.sql import functions as F

from punchdeck.sources import store


def facts(counter):
    def run(sources):
        counter.append(sorted(r.source for r in sources.select("source").collect()))
        lines = sources.select("source", F.posexplode(F.split("text", "\n")).alias("seq", "line")).filter("line <> ''")
        return {"lines": lines, "sizes": sources.select("source", F.lit(0).alias("seq"), F.length("text").alias("size"))}

    return run


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "source string, text string").withColumn("key", store.content_key(F.col("text"), "utf-8"))


def files(root, table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{table}/part=*/*.parquet")}


def test_store(spark, tmp_path):
    root, runs = f"file://{tmp_path}/store", []
    path = f"{tmp_path}/store"
    texts = {f"s{i}": f"a{i}\nb\n" for i in range(30)} | {"empty": ""}

    def check(now):
        got = {(r.source, r.seq, r.line): r.id for r in store.read(spark, root, "lines").collect()}
        assert set(got) == {(s, k, x) for s, t in now.items() for k, x in enumerate(t.split("\n")) if x}
        assert len(set(got.values())) == len(got)
        assert {(r.source, r["size"]) for r in store.read(spark, root, "sizes").collect()} == {(s, len(t)) for s, t in now.items()}
        return got

    def update(now):
        return {r.source: r.change for r in store.update(root, sources(spark, now), facts(runs), parts=8).collect()}

    assert update(texts) == {s: "added" for s in texts}
    first = check(texts)
    assert update(texts) == {} and len(runs) == 1
    before = files(path, "lines")
    texts["s3"] = "new\nb\nc\n"
    assert update(texts) == {"s3": "changed"} and runs[-1] == ["s3"]
    second = check(texts)
    # the others keep their ids, and their partitions their files
    assert all(second[k] == v for k, v in first.items() if k[0] != "s3") and {v // store.STRIDE for k, v in second.items() if k[0] == "s3"} == {first["s3", 1, "b"] // store.STRIDE}
    after = files(path, "lines")
    assert {os.path.dirname(f) for f in set(before) - set(after)} == {os.path.dirname(f) for f in set(after) - set(before)} and len({os.path.dirname(f) for f in set(after) - set(before)}) == 1
    del texts["s4"]
    texts["t"] = "x"
    assert update(texts) == {"s4": "removed", "t": "added"}
    check(texts)
    # a damaged file: its sources are taken apart again
    victim = sorted(files(path, "lines"))[0]
    os.chmod(victim, 0o644)
    with open(victim, "wb") as f:
        f.write(b"no parquet")
    for crc in glob.glob(os.path.join(os.path.dirname(victim), ".*.crc")):
        os.remove(crc)
    found = update(texts)
    assert found and set(found.values()) == {"damaged"} and set(runs[-1]) == set(found) and len(found) < len(texts)
    check(texts)
    assert update(texts) == {}
    assert set(update({}).values()) == {"removed"} and store.keys(spark, root).count() == 0
