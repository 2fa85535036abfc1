import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from claimspark.llm import sais, suffix


def brute(texts, length, keep_first=False):
    raws = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]].append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at[1:] if keep_first else at:
                gone[d][i : i + length] = True
    out = []
    for raw, g in zip(raws, gone):
        spans = int((g[1:] & ~g[:-1]).sum() + g[:1].sum()) if len(g) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~g]) if len(raw) else b""
        out.append((len(raw), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(150) for _ in range(4)]
    texts = []
    for i in range(40):
        parts = [prose(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 100)
            parts += [s[a : a + rng.randint(380, 600)], prose(rng.randint(0, 40))]
        texts.append("".join(parts))
    twice = prose(90)
    return [*texts, texts[3], texts[3], twice + "|" + twice, "z" * 2000, "z" * 1999, "ab" * 700, None, "", "short", prose(30_000)]


@pytest.mark.parametrize("seed,keep_first,hot", [(1, False, 256), (2, False, 0), (3, True, 256), (4, True, 0)])
def test_like_brute_force(docs_of, seed, keep_first, hot, monkeypatch):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (suffix.LENGTH, suffix.GRID, suffix.SHARD, False, hot))
    texts = random_texts(seed)
    docs = suffix.with_spans(docs_of(texts).select("doc_id", "text"), keep_first=keep_first)
    got = {r["doc_id"]: (r["d"]["n_bytes"], r["d"]["n_removed"], r["d"]["n_spans"], r["d"]["kept_sha256"]) for r in docs.withColumn("d", suffix.digests("text", "__spans")).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, suffix.LENGTH, keep_first)):
        assert got[i] == want, i


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (2, 2), (50, 2), (400, 3), (400, 200), (900, 5)):
        t = np.append(rng.integers(1, k + 1, n), 0)
        sa = sais.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common = sais.common_prefixes(t, sa)
        for a, b in zip(sa[:-1], sa[1:]):
            n_same = 0
            while max(a, b) + n_same < len(t) and t[a + n_same] == t[b + n_same]:
                n_same += 1
            assert common[b] == n_same


def test_query_like_brute_force(spark, docs_of, write_tables):
    texts = random_texts(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op7_query(spark, write_tables(documents=docs_of(texts))).collect()}
    assert got == dict(enumerate(brute(texts, 400)))


def test_empty_and_repeated_rows(spark, docs_of):
    assert suffix.with_spans(docs_of([])).count() == 0
    assert suffix.stage(spark, docs_of([]), "").count() == 0
    long = " ".join(f"w{i}" for i in range(200))
    docs = docs_of([long, long, "other", None, f"before it {long}", long], [5, 5, None, 7, 8, None])
    kept = suffix.stage(spark, docs, "")
    assert kept.columns == docs.columns
    # rows of one id and text are one document, which keeps what comes first; a text that is nothing but repeated goes
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "other"), (5, long), (5, long), (7, None), (8, "before it ")]


def test_stage_keeps_one_of_passages_over_fifty_words(spark, docs_of):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"v{rng.randrange(9999)}y" for _ in range(n))
    passage, line = prose(60), prose(20)
    texts = [f"{prose(100)} {passage} {prose(50)}" for _ in range(300)] + [f"{prose(80)} {line} {prose(9)}" for _ in range(50)]
    kept = {r["doc_id"]: r["text"] for r in suffix.stage(spark, docs_of(texts), "").collect()}
    assert kept[0] == texts[0] and all(passage[20:-20] not in kept[i] and len(kept[i]) < len(texts[i]) - 0.9 * len(passage) for i in range(1, 300))
    assert all(kept[i] == texts[i] for i in range(300, 350))
