import random

import numpy as np
import xxhash

from claimspark.llm import common, simhash
from claimspark.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "Zz"
        near.append(" ".join(w))
    return [*base, *near, *base[:10], None, "", "  \n", "ÄB c d", "äb c d", "one", "ONE", "two words", "x " * 70_000]


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_components_like_brute_force(docs_of):
    t = texts()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(t)).collect()}
    fps = [brute_fingerprint(x) for x in t]
    assert len(got) == len(t)
    for i, root in enumerate(brute_components(fps)):
        assert got[i]["fp"] % (1 << 64) == fps[i]
        assert got[i]["component_id"] == root


def test_links_among_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = [int(c) for c in centre]
    for c in centre:
        v = int(c)
        for _ in range(4):
            for b in rng.choice(64, 2, replace=False):
                v ^= 1 << int(b)
            fps.append(v)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for tile in (2048, 3):
        links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        index = {f: i for i, f in enumerate(fps)}
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            x, y = root(index[a]), root(index[b])
            parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(fps))] == brute_components(fps)


def test_empty_ties_and_nulls(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    got = simhash.near_duplicates(docs_of(["a b c d"] * 3, [None, 4, 4])).collect()
    assert len(got) == 3 and all(r["component_id"] == 4 for r in got)


def test_stage_keeps_one_of_each_group(spark, docs_of):
    docs = docs_of(["a b c d e", "a b c d e", "quite another text here now", None, ""], [3, 1, 2, 9, 8])
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 8]


def test_stage_links_sets_of_similarity_over_four_fifths(spark, docs_of):
    rng = random.Random(11)
    base = [[f"v{rng.randrange(2000)}" for _ in range(n)] for n in (30, 60, 100, 200, 400) for _ in range(12)]
    texts = [" ".join(t) for t in base]
    for t in base:
        for edits in (1, 2, 4, 8):
            near = list(t)
            for at in rng.sample(range(len(t)), edits):
                near[at] = "changed"
            texts.append(" ".join(near))
    sets = [simhash.shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    kept = simhash.stage(spark, docs_of(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})
    assert len({root(i) for i in range(len(texts))}) < len(texts) - 60


def test_intermediate_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in files.mkString("\n").split("\n") if "shuffle_" in x}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(setting), shuffles()
    links = spark.range(400).selectExpr("id AS a", "id DIV 7 AS b").repartition(5, "a")
    table = common.written(links.groupBy("b").count(), "counted")
    roots = components(links)
    assert not shuffles() - held
    assert table.count() == 58 and {r["root"] for r in roots.collect()} == {0}
    assert spark.conf.get(setting) == before
