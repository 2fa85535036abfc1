"""Chat formatting, toxicity, quality, media columns, mixing, URL filters, chained passages and decontamination."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from claimspark.llm import chains, chat, decontaminate, grams, hosts, media, mixing, quality, toxicity


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(9)}" for _ in range(n))


# chat formatting
def test_chat_round_trip():
    texts = ["", "<|im_end|>", "<\\|im_start|>x", "a\nb", "<\\\\|", "é<|im_end|><|im_start|>assistant ok"]
    messages = [("us\ner", t) for t in texts] + [("assistant", t) for t in texts]
    output, spans, rewritten = chat.turn_spans(messages, chat.chatml)
    assert rewritten is None and spans[0][0] == 0 and spans[-1][1] == len(output)
    assert [m for m, _, _ in chat.parse_chatml(output)] == messages


def test_chat_finds_templates_that_rewrite_history():
    shout = lambda messages: "".join(t.upper() if i + 1 == len(messages) else t for i, (_, t) in enumerate(messages))
    _, spans, rewritten = chat.turn_spans([("user", "a"), ("user", "b")], shout)
    assert spans == [] and rewritten == 1


def test_chat_rows_ties_and_nulls(spark):
    rows = [(1, 1, "user", None, 0), (1, 1, "user", None, 0), (None, 0, None, "x", 0), (2, None, "assistant", "y" * 100_000, 0)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 1, 2: 1}
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# toxicity
def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_like_edit_distance():
    terms = {"gremlin": 2.0, "blorgh": 3.0, "snarfle": 1.0}
    automaton = toxicity.Automaton(toxicity.Lexicon(terms, {}))
    rng = random.Random(1)
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "r", "l"])
        word = "".join(w)
        near = min(brute_edits(word, t) for t in terms)
        hit = automaton.match(word) if word else None
        assert (hit is not None and hit[1] == near) == (near <= 1), word


def test_quotation_weighs_less():
    abuse, quoted = "you are a blorgh you know", 'they said the word "blorgh" in print'
    long = 'they said the "' + "z" * 200 + ' blorgh" in print'
    at = lambda t: (t, [m.span() for m in toxicity.WORD.finditer(t)], toxicity.WORD.findall(t).index("blorgh"))
    assert toxicity.quotation(*at(quoted)) > 0.5 > toxicity.quotation(*at(abuse))
    assert toxicity.quotation(*at(long)) > 0.5  # a window is of words, however long they are


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_cover_every_row(spark, docs_of, operator, label):
    rng = random.Random(2)
    good = [prose(rng, 40) for _ in range(60)]
    bad = [("%%% " if label == "quality" else "") + " ".join(f"{w} blorghan!!" for w in prose(rng, 20).split()) for _ in range(60)]
    texts = [*good, *bad, None, "", "z " * 50_000, good[0]]
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(120)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts)
    scored = {r["doc_id"]: r["s"] for r in operator.with_score(docs, operator.fit(docs, labels), "s").collect()}
    assert len(scored) == len(texts) and all(0 <= s <= 1 for s in scored.values()) and scored[0] == scored[123]
    high, low = (range(60), range(60, 120)) if label == "quality" else (range(60, 120), range(60))
    assert np.mean([scored[i] for i in high]) > np.mean([scored[i] for i in low]) + 0.3
    empty = operator.with_score(docs_of([]), operator.fit(docs_of([]), labels.limit(0)), "s")
    assert empty.count() == 0


def test_commonest_word_counts_in_mostly_distinct_texts():
    text = " ".join(["spam"] * 45 + [f"w{i}" for i in range(55)])
    assert quality.text_features(text)[8] == pytest.approx(0.45)


# media columns
def test_media_round_trip_and_retry(spark, tmp_path):
    payloads = [bytes([i % 256]) * 192 * (i % 5 + 1) for i in range(40)]
    rows = spark.createDataFrame([(str(i) if i else None, bytearray(p)) for i, p in enumerate(payloads)], "name string, payload binary")
    path = f"file://{tmp_path}/media"
    media.store_payloads(rows.repartition(3), path)
    got = {r["name"]: bytes(r["media"]) for r in media.read_media(spark, path, range_bytes=500).collect()}
    assert {k: media.decode_png(v).tobytes() for k, v in got.items()} == {(str(i) if i else None): p for i, p in enumerate(payloads)}
    reader, failed = media.ArchiveReader(path, 1 << 20), []

    class Flaky:
        def __init__(self, source):
            self.source = source

        def size(self):
            return self.source.size()

        def read_at(self, n, at):
            if at not in failed and len(failed) < 3:
                failed.append(at)
                raise OSError("lost")
            return self.source.read_at(n, at)

    plain = reader._open
    part = reader.partitions()[0]
    whole = sum(b.num_rows for b in media.ArchiveReader(path, 1 << 20).read(part))
    reader._open = lambda f: Flaky(plain(f)) if failed else plain(f)
    failed.append(-1)
    offset = 0
    assert reader.member(part.file, offset)[1] and whole > 0
    with pytest.raises(OSError):
        media.ArchiveReader(path, 1 << 20).member(part.file, 5)


# mixing
def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet((0.3, 0.2, 0.1), 500)
    n = rng.integers(0, 500, 500)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    target = np.array([0.3, 0.3, 0.4])
    steps = mixing.solve(table, target)
    rate, _ = mixing.rates_after(p, steps)
    assert (rate >= 0).all()
    assert np.abs((n * rate) @ p / n.sum() - target).max() < 2e-3
    assert mixing.solve(table.where("n_tokens < 0"), target) == []


def test_mixing_like_a_plain_loop(spark):
    p = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    n = np.array([100.0, 100, 10])
    target, r = np.array([0.2, 0.8]), np.ones(3)
    for _ in range(20_000):  # projected gradient in the same metric, without momentum
        r = np.maximum(0, r - p @ ((n * r) @ p / n.sum() - target))
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    rate, _ = mixing.rates_after(p, mixing.solve(table, target, most=300, close=1e-7))
    assert np.abs((n * rate) @ p - (n * r) @ p).max() / n.sum() < 1e-3


def test_mixing_rows(spark, docs_of):
    rng = random.Random(3)
    texts = [prose(rng, 30) for _ in range(20)] + ["ää öö üü " * 20] * 10 + [None, ""]
    docs = docs_of(texts)
    labelled = spark.createDataFrame([(t, "de" if t and t.startswith("ä") else "en") for t in texts[:30]], "text string, domain string")
    got = mixing.with_rates(docs, mixing.fit(labelled, ["en", "de"]), {"en": 1.0, "de": 1.0}).collect()
    assert len(got) == len(texts) and all(r["rate"] >= 0 for r in got)
    assert {r["domain"] for r in got if (r["text"] or "").startswith("ä")} == {"de"}
    assert mixing.with_rates(docs_of([]), mixing.fit(labelled.limit(0), ["en", "de"]), {"en": 1.0, "de": 1.0}).count() == 0


# URL filters
def test_urls(spark):
    urls = [None, "nothing", "HTTP://A.Example.NET/en/x?y", "http://example.net", "http://x.org/fr/", "https://xorg/fr/", "http://Exämple.com/de/1#f", "http://example.com/de", "http://b.co.uk/p/1", "://h?q://z"]
    pages = spark.createDataFrame([(i, u, "old", 7) for i, u in enumerate(urls)], "page_id long, url string, verdict string, __rule int").drop("__rule")
    labels = spark.createDataFrame([(8, 1), (8, 0), (None, 1), (1, None), (0, 0)], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judged(pages, labels).collect()}
    assert got[0] == got[1] and got[0][:3] == ("", "", None)
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3][:3] == ("example.net", "", None)
    assert got[4] == ("x.org", "/fr/", "org/fr/", "allow") and got[5][2] is None
    assert got[6][0] == "exämple.com" and got[7][2] is None
    assert got[9][:2] == ("h", "")
    assert hosts.judged(pages.limit(0), labels).count() == 0


def test_reputation_shrinks(spark):
    rows = [("a.x.com", 1)] * 90 + [("a.x.com", 0)] * 10 + [("b.x.com", 1)] + [("c.y.com", 0)] * 200 + [("d.y.com", 0)] * 3
    got = {r["host"]: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["c.y.com"]["mean"] < got["d.y.com"]["mean"] < got["b.x.com"]["mean"] < 1
    assert got["b.x.com"]["bound"] < got["a.x.com"]["bound"]


def test_hosts_without_labels_are_judged_by_domain(spark):
    hosts_of = ["a.bad.com"] * 60 + ["b.bad.com"] * 60 + ["a.good.com"] * 60 + ["new.bad.com", "new.good.com", "new.nolabel.com", "new.nosuffix"]
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts_of)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "page_id long, bad int")
    got = {r["host"]: r for r in hosts.judged(pages, labels).collect()}
    assert got["new.bad.com"]["verdict"] == "block" and got["new.good.com"]["verdict"] == "allow"
    assert got["new.good.com"]["bad_share"] < got["new.nolabel.com"]["bad_share"] < got["new.bad.com"]["bad_share"]
    assert got["new.nosuffix"]["bad_share"] is not None


# words
def test_word_hashes_follow_words():
    a, b = grams.word_hashes("The cat, the CAT; é!"), grams.word_hashes("the  cat the cat É")
    assert a.tolist() == b.tolist() and len(a) == 5
    assert len(grams.word_hashes(None)) == len(grams.word_hashes(" ,. ")) == 0


# chained passages
def brute_chain(x, y, weight, cost):
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    best = {}
    for i in order:
        best[i] = weight + max([0.0, *(best[j] - cost * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i])])
    return max(best.values(), default=0)


def test_best_chain_like_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(2, 30)
        x, y = (np.array([rng.randrange(40) for _ in range(n)]) for _ in range(2))
        found = chains.chain(x, y, widest=1000)
        score = lambda c: 5 * len(c) - 0.05 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:]))
        best = brute_chain(x.tolist(), y.tolist(), 5, 0.05)
        assert max([5.0, *map(score, found)]) == pytest.approx(max(best, 5.0))
        used = [i for c in found for i in c.tolist()]
        assert len(used) == len(set(used))


def test_common_length_like_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert chains.common_length(a, b) == t[-1][-1]


def test_passages_are_found_and_others_are_not(docs_of):
    rng = random.Random(6)
    passage = prose(rng, 70).split()
    edited = list(passage)
    edited[20] = "changed"
    del edited[45]
    texts = [prose(rng, 60) + " " + " ".join(passage) + " " + prose(rng, 30), prose(rng, 10) + " " + " ".join(edited) + " " + prose(rng, 80), prose(rng, 300), prose(rng, 25), None, "", prose(rng, 20_000)]
    texts += [texts[2], texts[3], " ".join(passage)]
    rows = chains.repeated_passages(docs_of(texts)).collect()
    linked = {(r["doc_id"], r["with_id"]) for r in rows}
    members = {i for p in linked for i in p}
    assert {0, 1, 9} <= members and (7, 2) in linked and not members & {3, 4, 5, 6, 8}
    for r in rows:
        assert r["agreeing"] >= 0.8 * max(r["end_word"] - r["start_word"], r["with_end"] - r["with_start"])
        a, b = (grams.word_hashes(texts[r[k]]) for k in ("doc_id", "with_id"))
        assert chains.common_length(a[r["start_word"] : r["end_word"]].tolist(), b[r["with_start"] : r["with_end"]].tolist()) >= r["agreeing"]
    assert chains.repeated_passages(docs_of([])).count() == 0


# decontamination
def brute_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_like_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        score, s, e = decontaminate.align(a, b)
        assert score == brute_alignment(a, b)
        assert brute_alignment(a, b[s:e]) == score


def test_leaks(spark, docs_of, write_tables):
    rng = random.Random(8)
    items = [prose(rng, 30) for _ in range(5)]
    edited = items[1].split()
    edited[3:5] = ["other", "new", "words"]
    edited[15] = "swapped"
    texts = [prose(rng, 100) + " " + items[0].upper() + " " + prose(rng, 10), prose(rng, 50) + " " + " ".join(edited), prose(rng, 200), " ".join(items[2].split()[:6]), None, "", items[0], "Two words!", "two words more"]
    docs = docs_of(texts)
    benchmark = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (9, "two words"), (None, items[3])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(0, 0), (1, 1), (6, 0), (7, 9)}
    sf = write_tables(benchmark=benchmark)
    kept = decontaminate.stage(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 8]
    assert decontaminate.contaminated(docs_of([]), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_seeds_of_items_that_leak_everywhere(docs_of, spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = docs_of([f"doc {i} " + item for i in range(50)])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(docs, benchmark).count() == 50


def test_edited_copies_in_a_third_of_the_documents(docs_of, spark):
    rng = random.Random(9)
    items = [prose(rng, 30).split(), prose(rng, 16).split()]
    begun, swapped = items[0][:18], list(items[1])
    swapped[5], swapped[10] = "other", "words"
    docs = docs_of([prose(rng, 20) + " " + " ".join([begun, swapped, []][i % 3]) for i in range(300)])
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(i, i % 3) for i in range(300) if i % 3 < 2}
