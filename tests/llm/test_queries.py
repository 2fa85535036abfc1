"""Whole queries and stages: against plain versions or held-out rows, and on nulls, ties, repeats, clashing names and empty tables."""

import hashlib
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from claimspark.llm import chains, chat, decontaminate, grams, media, mixing, quality, queries, simhash, suffix, toxicity

LANGS = ("en", "de", "fr", "es")


def prose(rng, n, tag="w"):
    return " ".join(f"{tag}{rng.randrange(400)}x{rng.randrange(9)}" for _ in range(n))


# chat formatting
def test_op1_like_a_plain_version(spark, write_tables):
    rng = random.Random(1)
    texts = [None, "", "a\nb", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<", "|im_end|>", "é" * 50_000]
    rows = [(c, t, rng.choice(("user", "assistant", "system", None)), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [rows[0], (None, 1, "assistant", "of none"), (7, None, "assistant", "first")]
    sf = write_tables(conversations=spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op1_query(spark, sf).collect()}
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{role}\n{text}\n" for _, role, text in turns), loss)]
        want[conv] = (len(turns), sha[0], len(loss), sha[1])
    assert got == want


def test_loss_mask_of_other_templates(spark):
    rows = [(1, 1, "user", "hi", 0), (1, 2, "assistant", "there", 0), (1, 3, "assistant", "there", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    masked = lambda template: [r["formatted"][s["start"] : s["end"]] for r in chat.format_conversations(turns, template).collect() for s in r["loss_spans"]]
    assert masked(lambda m: "".join(f"[{r}]{t}[/{r}] " for r, t in m)) == ["there", "there"]
    assert masked(lambda m: "".join(f"[{r}]{t.upper()};" for r, t in m)) == ["THERE", "THERE"]
    # a text that can't be told from what surrounds it: the whole turn
    assert masked(lambda m: "".join(f"{t}{t};" for _, t in m)) == ["therethere;", "therethere;"]


# toxicity and quality
@pytest.mark.parametrize("query, label, folds, held_out, least", [(toxicity.op2_query, "toxic", 3, 1, 0.7), (quality.op3_query, "quality", 5, 0, 0.3)])
def test_classifiers_on_held_out_rows(spark, docs_of, write_tables, query, label, folds, held_out, least):
    rng = random.Random(3)
    slurs = [f"blorg{x}" for x in ("an", "ish", "ers", "ed", "y", "est")]
    marked = [rng.random() < 0.4 for _ in range(300)]
    texts = []
    for bad in marked:
        words = prose(rng, 40).split()
        if bad and label == "toxic":
            for at in rng.sample(range(40), 4):
                words[at] = f"you {rng.choice(slurs)}"
        texts.append(" ".join(w + ("!! %%" if bad and label == "quality" else "") for w in words) + ".")
    texts += [None, "", texts[0], "z" * 300_000]
    ids = [*range(303), None]
    labels = [(i, int(not bad), int(bad)) for i, bad in enumerate(marked)] + [(None, 1, 1), (5, None, None), (900, 1, 0)]
    sf = write_tables(documents=docs_of(texts, ids), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = query(spark, sf).collect()
    assert len(rows) == len(texts)
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == held_out
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    truth = {i: int(bad) if label == "toxic" else int(not bad) for i, bad in enumerate(marked)}
    held = [i for i in range(300) if fold(i)]
    assert sum(by[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert by[0]["score"] == by[302]["score"]


def test_quality_is_learned_from_all_pairs_of_all_labelled_rows(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.6).astype(int)
    x = np.clip(rng.random((400, quality.N_FEATURES)) + 0.1 * y[:, None] * (np.arange(quality.N_FEATURES) < 3), 0, 1)
    model = quality.learn(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "f array<double>, y int").repartition(3))
    wide = quality.expand(x)
    pairs = (wide[y == 1][:, None] - wide[y == 0][None]).reshape(-1, wide.shape[1])
    w, ridge = np.zeros(wide.shape[1]), quality.RIDGE / 20
    for _ in range(30):
        lost = 1 / (1 + np.exp(pairs @ w))
        hess = (pairs * (lost * (1 - lost))[:, None]).T @ pairs / len(pairs) + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, pairs.T @ lost / len(pairs) - ridge * w)
    assert np.abs(wide @ (model.weights - w) - np.mean(wide @ (model.weights - w))).max() < 1e-3
    assert model.cut == pytest.approx(np.quantile(model.worths(x), np.mean(y == 0)), abs=1e-12)


def test_quality_threshold_counts_every_labelled_row(spark):
    rng = np.random.default_rng(6)
    n = 13_000
    y = (rng.random(n) < 0.7).astype(int)
    x = np.round(np.clip(rng.random((n, quality.N_FEATURES)) * 0.5 + 0.3 * y[:, None], 0, 1), 2)
    x[: n // 2] = x[0]  # many of one worth
    own = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, f array<double>")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(y)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_features(own, labels)
    used = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n)])
    assert used.sum() > 10_000 and model.cut == pytest.approx(np.quantile(model.worths(x[used]), np.mean(y[used] == 0)), abs=1e-12)


def test_toxicity_scores_like_a_plain_version(spark, docs_of):
    """The features of texts, by edit distance with every term instead of the automaton."""
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({"gremlin": 2.0, "blorgh": 3.0, "oaf": 1.5}, {"snarf": 4.0}, frozenset({"gremlins"}))
    words = ["gremlin", "gremlins", "gremlim", "blorg", "blorghh", "oaf", "oat", "snarfle", "snar", "you", "said", "plain", '"blorgh"', "«oaf»", "z" * 90]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    def plain(text):
        spans = [m.span() for m in toxicity.WORD.finditer(text)]
        out = []
        for k, (a, b) in enumerate(spans):
            w, hit = text[a:b], None
            if any(w.startswith(s) for s in lexicon.stems):
                hit = ("stem", lexicon.stems["snarf"])
            elif w in lexicon.words:
                hit = ("word", lexicon.words[w])
            elif w not in lexicon.ordinary:
                near = [t for t in lexicon.words if len(t) >= 5 and distance(w, t) == 1]
                hit = ("fuzzy", lexicon.words[min(near)]) if near else None
            if hit:
                low, high = max(0, k - 6), min(len(spans) - 1, k + 6)
                left, right = text[spans[low][0] : a], text[b : spans[high][1]]
                beside = {text[x:y] for n, (x, y) in enumerate(spans) if low <= n <= high and n != k}
                q = 0.6 * (len(toxicity.QUOTES.findall(left)) % 2 == 1 and bool(toxicity.QUOTES.search(right))) + 0.3 * bool(beside & toxicity.REPORTING) - 0.3 * bool(beside & toxicity.SECOND_PERSON)
                out.append((a, b, *hit, min(1.0, max(0.0, q))))
        return out

    scorer = toxicity.Scorer(lexicon)
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(30)))
        assert scorer.find(text) == plain(text), text


# media columns
def test_op4_like_a_plain_version(spark, docs_of, write_tables):
    texts = ["", None, "a", "é" * 95 + "ab", "x" * 192, "y" * 193, "a", "long " * 200_000]
    sf = write_tables(documents=docs_of(texts, [*range(7), None]))
    rows = {r["doc_id"]: r for r in media.op4_query(spark, sf).collect()}
    assert len(rows) == 8
    for i, t in zip([*range(7), None], texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        png = media.encode_png(payload)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest()) and media.decode_png(png).tobytes() == payload
    assert rows[2]["feature"] == rows[6]["feature"]
    assert media.op4_query(spark, write_tables(documents=docs_of([]))).count() == 0


# chained passages
def test_passages_whose_parts_have_many_holders(docs_of):
    """Pairs that share 60 words, each 20 of which stand in twenty other texts."""
    rng = random.Random(5)
    texts, pairs = [], []
    for _ in range(12):
        passage = prose(rng, 60).split()
        pairs.append((len(texts), len(texts) + 1))
        texts += [f"{prose(rng, 50)} {' '.join(passage)} {prose(rng, 50)}" for _ in range(2)]
        for part in range(3):
            texts += [f"{prose(rng, 40)} {' '.join(passage[20 * part : 20 * part + 20])} {prose(rng, 40)}" for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)  # of ids, not that they matter
    linked = {frozenset((r["doc_id"], r["with_id"])) for r in chains.repeated_passages(docs_of(texts, order)).collect()}
    assert linked == {frozenset((order[a], order[b])) for a, b in pairs}


def test_passages_with_edits(docs_of):
    rng = random.Random(6)
    texts, wanted = [], []
    for share in (0.0, 0.05, 0.1):
        for _ in range(40):
            passage = prose(rng, 60).split()
            edited = [w if rng.random() >= share else f"e{rng.randrange(9999)}" for w in passage]
            wanted.append((share, len(texts)))
            texts += [f"{prose(rng, 30)} {' '.join(passage)} {prose(rng, 30)}", f"{prose(rng, 30)} {' '.join(edited)} {prose(rng, 30)}"]
    linked = {frozenset((r["doc_id"], r["with_id"])) for r in chains.repeated_passages(docs_of(texts)).collect()}
    found = {s: np.mean([frozenset((i, i + 1)) in linked for x, i in wanted if x == s]) for s in (0.0, 0.05, 0.1)}
    assert found[0.0] == 1 and min(found.values()) >= 0.9
    assert all(abs(a - b) == 1 for a, b in map(sorted, linked))


@pytest.mark.parametrize("held, least", [(64, 20), (12, 18)])
def test_passages_whose_anchors_share_less(docs_of, monkeypatch, held, least):
    """Pairs that share 54 words with an edit in every nine, each part of which twenty other texts hold."""
    monkeypatch.setattr(chains, "HELD", held)
    rng = random.Random(15)
    texts, wanted = [], set()
    for _ in range(20):
        passage = prose(rng, 54).split()
        edited = [f"e{rng.randrange(9999)}" if i % 9 == 8 else w for i, w in enumerate(passage)]
        wanted.add(frozenset((len(texts), len(texts) + 1)))
        texts += [f"{prose(rng, 50)} {' '.join(p)} {prose(rng, 50)}" for p in (passage, edited)]
        for part in range(6):
            texts += [f"{prose(rng, 40)} {' '.join(passage[9 * part : 9 * part + 8])} {prose(rng, 40)}" for _ in range(20)]
    rows = chains.repeated_passages(docs_of(texts)).collect()
    linked = {frozenset((r["doc_id"], r["with_id"])) for r in rows}
    assert linked <= wanted and len(linked) >= least
    assert all(r["class_id"] == min(r["doc_id"], r["with_id"]) for r in rows)


def test_repeated_words_share_one_long_passage(spark, docs_of):
    rng = random.Random(43)
    line = [f"r{i}" for i in range(8)]
    own = lambda: prose(rng, 60).split()
    for period in (["is", "onhe"], ["a"], line):
        while not chains.seeds(grams.word_hashes(" ".join(period * 40)))[0].size:
            period = [w + "x" for w in period]
        times = 320 // len(period)
        texts = [" ".join(own() + period * n + own()) for n in [times] * 4 + [times // 2]]
        rows = chains.repeated_passages(docs_of(texts, [1 + i for i in range(5)])).collect()
        between = [r for r in rows if r["doc_id"] != r["with_id"]]
        assert len(between) <= 40, (period, len(between))
        assert len({r["class_id"] for r in rows}) == 1
        linked = {r["doc_id"] for r in between}
        assert len(linked) >= 4
        for d in linked:  # the repeated words are covered, all but a few at their ends
            covered = {w for r in between if r["doc_id"] == d for w in range(r["start_word"], r["end_word"])}
            n = len(period) * (times // 2 if d == 5 else times)
            assert len(covered & set(range(60, 60 + n))) >= n - 40, (period, d)


def test_texts_are_read_three_times_and_seeds_not_stored(spark, docs_of, monkeypatch):
    """For seeds, for ids, and for the words of one round, as anchors connect all; copies are counted without reading them again."""
    names, own = [], chains.written
    monkeypatch.setattr(chains, "written", lambda df, name: names.append(name) or own(df, name))
    rng = random.Random(44)
    passage = prose(rng, 60)
    texts = [f"{passage} {prose(rng, 20)}", f"{prose(rng, 20)} {passage}", passage, passage, passage]
    docs = docs_of(texts, [0, 1, 2, 3, 3]).select("doc_id", "text")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = chains.repeated_passages(docs.mapInArrow(counted, docs.schema)).collect()
    assert {(r["doc_id"], r["with_id"]) for r in rows} >= {(3, 2)} and {r["class_id"] for r in rows} == {0}
    assert [r["end_word"] for r in rows if r["doc_id"] == 3] == [60]
    assert read.value <= 3 * len(texts) and "places" not in names


def test_anchors_of_sorted_places_like_plain_version():
    rng = random.Random(45)
    for _ in range(200):
        rows = []
        for seed in range(rng.randrange(1, 6)):
            for t in rng.sample(range(5), rng.randrange(1, 4)):
                size, step, at = rng.randrange(1, 5), rng.randrange(1, 40), rng.randrange(99)
                places = [(seed, t, at + i * step, 64 * size + step * (size > 1) if not i else -64 * i - step) for i in range(size)]
                rows += places * rng.choice([1, 1, 3])  # copies
        rows.sort(key=lambda r: r[:3])
        wanted = []
        for seed in sorted({r[0] for r in rows}):
            group = sorted({r for r in rows if r[0] == seed})
            _, a, first, a_run = group[0]
            for _, t, at, run in group if len(group) > 1 else []:
                i, step = divmod(-run, 64)
                same = t != a and run < 0 and a_run >= 128 and a_run % 64 == step
                wanted.append((seed, t, at, a, first + i % (a_run // 64) * step if same else first))
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randrange(4))))
        batches = []
        for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[s:e]], k) for i, k in enumerate(kinds)], ["seed", "t", "at", "run"]))
        got = [tuple(r.values()) for b in chains._matched(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(wanted)


def test_seeds_and_words_of_many_texts_like_those_of_one():
    rng = random.Random(46)
    texts = [rng.choice([None, "", " ,. ", "é", "go " * 60, f"{'a b ' * 30}{prose(rng, 50)}", prose(rng, rng.randrange(36, 90)), prose(rng, 300)]) for _ in range(300)]
    for most in (1, 500, 1 << 17):
        got = [words[s : e - 1].tolist() for _, words, begin in grams.words_of_texts(texts, most) for s, e in itertools.pairwise(begin)]
        assert got == [grams.word_hashes(t).tolist() for t in texts]
    found = chains._seeds_of(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["t", "text"])]))
    got = sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    wanted = []
    for i, words in enumerate(map(grams.word_hashes, texts)):
        hashes, at = chains.seeds(words) if len(words) >= chains.LEAST else ([], [])
        nth = chains.runs(hashes, at, chains.LEAST - 1, words=words) if len(at) else []
        wanted += [(int(h.view(np.int64)), i, int(x), int(n)) for h, x, n in zip(hashes, at, nth, strict=True)]
    assert got == sorted(wanted) and len({i for _, i, _, _ in wanted}) > 100


def test_gaps_of_a_passage_like_plain_version():
    """Agreeing words between seeds on one diagonal and on several, gap by gap."""
    rng = random.Random(47)
    for case in range(200):
        a = [rng.randrange(1 << 40) for _ in range(200)]
        b = list(a)
        for _ in range(rng.randrange(4) * 5):
            b[rng.randrange(200)] = rng.randrange(1 << 40)
        xs = sorted(rng.sample(range(20, 190), rng.randrange(2, 9)))
        shift = 0
        if case % 2:  # a word more in b, between two seeds
            b.insert(xs[0] + 1, 7)
            shift = 1
        ys = [xs[0], *(x + shift for x in xs[1:])]
        agree = 0
        split = False
        for x, y, u, v in zip(xs[:-1], ys[:-1], xs[1:], ys[1:], strict=True):
            n = chains.common_length(a[x:u], b[y:v])
            split |= n < 0.5 * max(u - x, v - y)
            agree += n
        if split:
            continue
        u, v = (np.array(z, np.uint64) for z in (a, b))
        right = chains._extended(u[xs[-1] :][: chains.KMER + chains.MARGIN], v[ys[-1] :][: chains.KMER + chains.MARGIN])
        left = chains._extended(u[: xs[0]][::-1][: chains.MARGIN], v[: ys[0]][::-1][: chains.MARGIN])
        found = chains.passages(u, v, np.array(xs, "<i4"), np.array(ys, "<i4"), least=0, identity=0)
        assert found == [(xs[0] - left[0], xs[-1] + right[0], ys[0] - left[0], ys[-1] + right[0], agree + left[1] + right[1])]


def test_passages_of_odd_rows(docs_of):
    rng = random.Random(7)
    passage, twice = prose(rng, 60), prose(rng, 50)
    texts = [f"{passage} one", f"two {passage}", f"three {passage} end", f"{twice} | {prose(rng, 20)} | {twice}", passage, passage, "x " * 30_000]
    rows = chains.repeated_passages(docs_of(texts, [4, 4, None, 9, 7, 7, 3])).collect()
    ids = {(r["doc_id"], r["with_id"]) for r in rows}
    # different texts of one id, a null id and a passage within one text are found; repeated rows are one document
    assert (9, 9) in ids and len(ids) > 3 and {None, 4, 7} <= {i for p in ids for i in p}
    assert all(r["end_word"] - r["start_word"] >= chains.LEAST for r in rows)


# mixing
def test_mixing_of_clashing_names_and_rare_domains(spark, docs_of):
    rng = random.Random(8)
    docs = docs_of([prose(rng, 30) for _ in range(40)]).withColumnsRenamed({"lang": "domain", "score": "rate", "n_chars": "n_tokens"})
    model = mixing.Classifier(["a", "b"], np.zeros((mixing.BUCKETS + 1, 2)))
    got = mixing.with_rates(docs, model, {"a": 0.5, "b": 0.5})
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "n_tokens", "domain", "rate"]) and got.count() == 40
    n, p = np.array([50.0] * 999 + [50.0]), np.array([[0.999, 0.001]] * 999 + [[0.001, 0.999]])
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    rate, _ = mixing.rates_after(p, mixing.solve(table, np.array([0.85, 0.15])))
    assert np.abs((n * rate) @ p / n.sum() - [0.85, 0.15]).max() < 1e-3
    with pytest.warns(UserWarning, match="differ from their targets"):
        mixing.solve(spark.createDataFrame([(10, [1.0, 0.0])], "n_tokens long, p array<double>"), np.array([0.5, 0.5]))


def test_shares_are_held_a_block_at_a_time(monkeypatch):
    rng = random.Random(16)
    model = mixing.Classifier(["a", "b"], np.random.default_rng(1).normal(size=(mixing.BUCKETS + 1, 2)))
    texts = [None, "", *(prose(rng, 5) for _ in range(600))]
    x, n = zip(*map(mixing.pair_shares, texts))
    want, sizes, plain = model.posteriors(np.array(x, np.float64)), [], mixing.Classifier.posteriors
    monkeypatch.setattr(mixing.Classifier, "posteriors", lambda self, x: sizes.append(len(x)) or plain(self, x))
    words, p = mixing.described(texts, model)
    assert words == list(n) and np.abs(p - want).max() < 1e-12 and max(sizes) <= mixing.BLOCK and mixing.described([], model)[1].shape == (0, 2)


def test_counting_shingles_takes_little_memory():
    texts = [" ".join(f"w{k}x{i}" for i in range(50_000)) for k in range(40)] + [" ".join(f"w1x{i}" for i in range(40_000))]
    tracemalloc.start()
    (got,) = simhash._often(iter([pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 39_996 and set(got.column(1).to_pylist()) == {2}
    assert peak < 110e6


# stages
def tables(spark, docs_of, write_tables, texts, ids=None, items=("none such",)):
    rng = random.Random(9)
    labels = [(i, 1, 0) for i in range(len(texts))]
    docs = docs_of(texts, ids)
    return docs, write_tables(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string")), rng


CLASHES = {"lang": "k1", "source": "component", "score": "__kept"}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs_of, write_tables, stage):
    rng = random.Random(10)
    texts = [None, "", prose(rng, 80), prose(rng, 80), prose(rng, 20_000), "  \n", "one"]
    texts.append(texts[2])
    docs, sf, _ = tables(spark, docs_of, write_tables, texts, [None, 1, 2, 2, None, 5, 6, 2])
    odd = docs.withColumnsRenamed(CLASHES) if stage is not mixing.stage else docs
    rows = stage(spark, odd, sf).collect()
    assert {r["text"] for r in rows} >= {texts[2], texts[3], texts[4], "one"}
    if stage is not mixing.stage:
        assert rows[0].asDict().keys() == set(odd.columns)
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_simhash_stage_tells_rows_apart(spark, docs_of):
    rng = random.Random(11)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = a.split()
    near[30] = "changed"
    docs = docs_of([a, b, c, a, " ".join(near), b], [None, None, 4, 9, 2, None])
    kept = simhash.stage(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, b), (4, c), (2, " ".join(near))])


def test_simhash_candidates_of_common_passages(spark, docs_of, monkeypatch):
    """Texts that share a passage, but are not near copies, all stay; near copies among them are found in tiles and blocks."""
    rng = random.Random(12)
    passage = prose(rng, 40)
    texts = [f"{prose(rng, 30)} {passage}" for _ in range(150)]
    base = prose(rng, 100).split()
    for _ in range(150):
        t = list(base)
        t[rng.randrange(100)] = f"e{rng.randrange(99)}"
        t[rng.randrange(100)] = f"f{rng.randrange(99)}"
        texts.append(" ".join(t))
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
    for tile, frequent in ((2048, 1 << 16), (7, 1 << 16), (2048, 0)):
        monkeypatch.setattr(simhash.similar_roots, "__defaults__", (tile,))
        monkeypatch.setattr(simhash.frequent_shingles, "__defaults__", (frequent,))
        kept = simhash.stage(spark, docs_of(texts), "")
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})


def test_pipeline(spark, docs_of, write_tables):
    rng = random.Random(13)
    item, passage = prose(rng, 30, "b"), prose(rng, 70, "p")
    texts = [f"{prose(rng, 120)}." for _ in range(60)]
    near = texts[3].split()
    near[50] = "changed"
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(3)]
    texts += [f"{prose(rng, 40)} {item}", " ".join(near), texts[4], *[f"you blorgan {prose(rng, 10)} you blorgish blorgers {prose(rng, 10)} blorged" for _ in range(20)]]
    labels = [(i, 1, int(i >= 66)) for i in range(len(texts))]
    docs = docs_of(texts).drop("score")
    sf = write_tables(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == list(range(63))
    assert [got[i]["text"] for i in range(61)] == texts[:61] and passage[9:-9] not in got[61]["text"] + got[62]["text"]
    assert got[0].asDict().keys() == {*docs.columns, "n_tokens", "domain", "rate"} and all(r["rate"] >= 0 for r in got.values())
    assert {n for n in queries.QUERIES} == set(queries.QUERIES) and len(queries.QUERIES) == 10


def test_decontamination_of_odd_texts(spark, docs_of):
    rng = random.Random(14)
    item = prose(rng, 25)
    docs = docs_of([f"{prose(rng, 60_000)} {item} {prose(rng, 60_000)}", item, item, None], [None, 3, 3, 4])
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 3, 3] and all(r["score"] == 1 for r in rows)
    words = grams.word_hashes(item)
    assert all(r["end_word"] - r["start_word"] == len(words) for r in rows)
    assert suffix.with_spans(docs).count() == 4
