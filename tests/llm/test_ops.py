"""Each operator against brute force on small rows, with nulls, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from commerce_lake.llm import components, gru, op1_decontamination, op2_html_extraction, op3_lm_scoring, op4_language_id, op5_jaccard_join, op6_mixing, op7_exact_topk, op8_substring_dedup, op9_token_output, op10_warc
from commerce_lake.llm import words as W
from commerce_lake.llm.labelled_pages import labelled_pages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: extra columns whose names clash with those that operators add
EXTRA = "score double, chunk int, n long, lang_pred string, size int, copies int, rank int, bucket int"


def texts(n=120, seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(rng.choice([" ", "\n", "\t ", "  "]).join(w))
    return out + [None, "", "   \n", "a", "A b", "a B", "one two three four", "x y 　z", "w " * 3000, "q " + "long" * 5000]


def docs_of(spark, values=None, empty=False):
    rows = [] if empty else [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s3", None][i % 4], len(t or ""), *[None] * 8) for i, t in enumerate(values or texts())]
    rows += rows[3:5]  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    return spark.createDataFrame(rows, schema).repartition(3)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_words_match_the_pattern():
    values = texts() + ["é\x0bü\x1fz", " a b"]
    got = [[s.word(i).decode() for i in range(s.word_of[k], s.word_of[k + 1])] for s in W.slices(pa.array(values)) for k in range(s.n_texts)]
    assert got == [WORD.findall(t or "") for t in values]
    h = np.concatenate([s.hashes() for s in W.slices(pa.array(values))])
    flat = [w for t in values for w in WORD.findall(t or "")]
    assert len(set(h.tolist())) == len(set(flat))


def test_windows():
    s = next(W.slices(pa.array(["a b c a b c", "b c a b"])))
    h, at, text = W.windows(s.hashes(), s.word_of, 3)
    assert text.tolist() == [0, 0, 0, 0, 1, 1] and h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(30, 50)] + [(5, 40), (100, 7), (7, 9), (None, 3), (8, 8)]
    got = dict(rows_of(components.connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 5 for i in [5, *range(30, 51)]} | {7: 7, 9: 7, 100: 7}


# ---- 1


def brute_edits(item, text):
    best = list(range(len(item) + 1))
    low = best[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(best[i - 1] + (x != c), best[i] + 1, new[i - 1] + 1))
        best = new
        low = min(low, best[-1])
    return low


def plain(t):
    return "".join(map(chr, op1_decontamination.normalise([t])[0][1:].tolist()))


def test_decontamination_against_all_alignments():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([20, 12, 6, 30, 2, 1])] + [(9, None), (10, "")]
    held = op1_decontamination.index_items(items)
    values = []
    for _ in range(40):
        k = rng.randrange(5)
        t = list(items[k][1])
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice(["", "z", "zz", "Q", "."])
        values.append(" ".join(word() for _ in range(rng.randint(0, 30))) + " " + "".join(t) + " " + word())
    values += [None, "", "!!!"]
    got = {(t, held.ids[i]): n for t, i, n in op1_decontamination.scan(values, held)}
    want = {}
    for k, c, e in zip(held.ids, held.codes, held.edits.tolist()):
        for t, v in enumerate(values):
            n = brute_edits("".join(map(chr, c.tolist())), plain(v))
            if n <= e:
                want[t, k] = n
    assert got == want and want


def test_decontamination_query(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, None)], "item_id long, text string")
    values = ["clean text " * 40, "before THE QUICK -- brown fox jumps over the lazy dog again, after", None, "the quick brown cat"]
    d = docs_of(spark, values + ["x", "y"])
    assert {(r[0], r[1], r[2]) for r in rows_of(op1_decontamination.contaminated(d, bench))} == {(1, 1, 0)}
    kept = op1_decontamination.decontaminate(d, bench)
    assert kept.columns == d.columns and 1 not in {r.doc_id for r in kept.collect()} and kept.count() == 7
    assert op1_decontamination.contaminated(docs_of(spark, empty=True), bench).count() == 0
    assert op1_decontamination.contaminated(d, bench.limit(0)).count() == 0
    twice = bench.unionByName(bench)
    try:
        op1_decontamination.BLOCK_BYTES, kept_size = 1, op1_decontamination.BLOCK_BYTES
        op1_decontamination.blocks.__defaults__ = (1,)
        assert [tuple(r)[:3] for r in op1_decontamination.contaminated(d, twice).collect()] == [(1, 1, 0)] * 2
        assert op1_decontamination.decontaminate(d, twice).count() == 7
    finally:
        op1_decontamination.BLOCK_BYTES = kept_size
        op1_decontamination.blocks.__defaults__ = (kept_size,)
    piece = op1_decontamination.PIECE
    try:
        op1_decontamination.PIECE = 64
        assert op1_decontamination.scan(["y " * 70 + values[1] + " z" * 90], op1_decontamination.index_items([(1, bench.first().text)])) == [(0, 0, 0)]
    finally:
        op1_decontamination.PIECE = piece


# ---- 2


def test_html_pages(spark):
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p>First  one.<br>still<p><b>Second.'
        '<script>var x = "</p>";</script><ul><li>item one</li><li>item &lt;two&gt;</ul><form><p>mail me</p><input></form></article><section id="comments"><p>I liked this. Really a lot, thanks.</p></section><aside class="sidebar"><p>Other things.</p></aside><footer>(c) us</footer></body></html>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "</div></p><<<>&bogus; <p"), (1, "u", page), (5, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows + [(6, "u", "<article>" + "<p>So it goes on. And on.</p>" * 20_000 + "</article>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op2_html_extraction.extract(pages.withColumns({c: F.lit(1) for c in ("text", "n_chars", "label", "names")})).collect()}
    assert got[6] == "\n".join(["So it goes on. And on."] * 20_000)
    assert got[1] == "Title & more\nFirst one. still\nSecond.\nitem one\nitem <two>" and got[2] == got[3] == ""
    assert op2_html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_held_out_pages():
    model, hit, miss, extra = op2_html_extraction.default_model(), 0, 0, 0
    for source in labelled_pages(150, seed=4242):
        page = op2_html_extraction.parse(source, labelled=True)
        odds = op2_html_extraction.marginals(page, model)
        for node, _ in page.runs:
            y, g = bool(page.label[node]), odds[node] > 0
            hit, miss, extra = hit + (y and g), miss + (y and not g), extra + (g and not y)
    assert hit / (hit + miss) > 0.98 and hit / (hit + extra) > 0.98


def test_messages_give_exact_marginals():
    page = op2_html_extraction.parse("<div class=nav><p>a.</p><ul><li>b</li></ul></div><article><p>c.</p></article>")
    model = op2_html_extraction.default_model()
    odds, names = op2_html_extraction.marginals(page, model), op2_html_extraction.features(page)
    u = [sum(model.unary.get(f, 0.0) for f in x) for x in names]
    n, mass = len(u), [[0.0, 0.0] for _ in u]
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        w = math.exp(sum(u[i] for i in range(n) if y[i]))
        for i in range(1, n):
            w *= model.turn[op2_html_extraction.edge_kind(page, i)][y[page.parent[i]]][y[i]]
        for i in range(n):
            mass[i][y[i]] += w
    assert np.allclose(odds, [math.log(b / a) for a, b in mass])


# ---- 3


def test_gru_gradients_and_sums():
    rng = np.random.default_rng(0)
    p = gru.init(12, 4, 3, np.arange(12, 0, -1.0), np.ones(3), hidden=5)
    p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) if v.dtype.kind == "f" else v for k, v in p.items()}
    h = rng.standard_normal((1, 5))
    each = [gru.log_probs(p, h.copy(), np.array([i]))[0][0] for i in range(15)]
    assert abs(np.exp(each).sum() - 1) < 1e-9
    hs, target = rng.standard_normal((9, 5)), rng.integers(0, 15, 9)
    grads = {k: np.zeros_like(p[k]) for k in ("wc", "bc", "wo", "bo")}
    _, dh = gru.log_probs(p, hs, target, grads)
    for k, at in (("wc", (2, 1)), ("wo", (1, 3, 2)), ("bo", (0, 1))):
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-5
        slope = (gru.log_probs(q, hs, target)[0].sum() - gru.log_probs(p, hs, target)[0].sum()) / 1e-5
        assert abs(slope - grads[k][at]) < 1e-3
    moved = hs.copy()
    moved[3, 2] += 1e-5
    assert abs((gru.log_probs(p, moved, target)[0].sum() - gru.log_probs(p, hs, target)[0].sum()) / 1e-5 - dh[3, 2]) < 1e-3


def test_gru_gradients_through_time():
    """Every trained parameter against differences, over a window in which a text starts."""
    rng = np.random.default_rng(4)
    p = gru.init(12, 4, 3, np.arange(12, 0, -1.0), np.ones(3), hidden=5)
    p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) if v.dtype.kind == "f" else v for k, v in p.items()}
    x, target, fresh = rng.integers(0, 15, (6, 3)), rng.integers(0, 15, (6, 3)), np.zeros((6, 3), bool)
    fresh[0, 0] = fresh[3, 1] = True
    h = rng.standard_normal((3, 5))
    zero = lambda: {k: np.zeros_like(p[k]) for k in gru._TRAINED}
    grads = zero()
    _, _, rows, demb = gru.backpropagate(p, x, fresh, target, h, grads)
    grads["emb"] = np.zeros_like(p["emb"])
    np.add.at(grads["emb"], rows, demb)
    for k, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(12)]:
            total = []
            for side in (1e-6, -1e-6):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += side
                total.append(gru.backpropagate(q, x, fresh, target, h, zero())[0].sum())
            assert abs((total[0] - total[1]) / 2e-6 - g[at]) < 1e-5 * max(1, abs(g[at])), (k, at)


def test_gru_trains_on_every_id(monkeypatch):
    seen = []
    real = gru.backpropagate
    monkeypatch.setattr(gru, "backpropagate", lambda p, x, fresh, target, h, g: (seen.append(target.size), real(p, x, fresh, target, h, g))[1])
    monkeypatch.setattr(gru, "LEAST_WINDOWS", 2)
    p = gru.init(12, 4, 3, np.arange(12, 0, -1.0), np.ones(3))
    for n in (0, 1, 31, 1000, 8211):
        seen.clear()
        gru.train(p, np.random.default_rng(n).integers(0, 15, n), np.zeros(n, bool))
        assert sum(seen) == n


def test_scores_carry_state_over_windows():
    p = gru.init(12, 4, 3, np.arange(12, 0, -1.0), np.ones(3))
    p["wc"] = np.random.default_rng(1).standard_normal(p["wc"].shape).astype(np.float32)
    ids, bounds = np.random.default_rng(2).integers(0, 15, 700), np.array([0, 1, 350, 380, 700])
    got = gru.score(p, ids, bounds, most=16)
    for i in range(4):
        h, prev, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([11]), 0.0
        for x in ids[bounds[i] : bounds[i + 1]]:
            h, _ = gru.step(p, p["emb"][prev] + p["bias"], h)
            prev = np.array([x])
            total += gru.log_probs(p, h, prev)[0][0]
        assert abs(total - got[i]) < 1e-2


def test_lm_counts(spark):
    values = texts()
    rows = op3_lm_scoring.score_documents(docs_of(spark, values)).collect()
    d = list(enumerate(values)) + [(i, values[i]) for i in (3, 4)]
    split = {i: WORD.findall((t or "").translate(FOLD)) + [None] for i, t in d}
    c = collections.Counter(w for i, _ in d if zlib.crc32(str(i).encode()) % 7 != 2 for w in split[i])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(d)
    for r in rows:
        w = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r.score < 0
    assert op3_lm_scoring.score_documents(docs_of(spark, empty=True)).count() == 0


def test_lm_learns(spark):
    rows = [r for r in op3_lm_scoring.op3_lm_scoring(spark, SF.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.95


def test_lm_fits_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(op3_lm_scoring, "SHARD_BYTES", 1 << 12)
    rows = [(i, f"w{i % 50} v{i % 7}") for i in range(9000)] + [(None, f"n{i}") for i in range(40)] + [(5, "again")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sum(i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    h = np.sort(np.arange(1, 10, dtype=np.uint64) << np.uint64(40))
    vocab = op3_lm_scoring.Vocabulary(h, np.arange(9), 9, np.ones(op3_lm_scoring.RARE_CLASSES), 9, 9)
    start = gru.init(9, 4, op3_lm_scoring.RARE_CLASSES, np.ones(9), np.ones(op3_lm_scoring.RARE_CLASSES))
    params, documents = op3_lm_scoring.fit(docs, vocab, start, total=sum(len(t) for _, t in rows))
    assert documents == want > 7000
    again, _ = op3_lm_scoring.fit(docs, vocab, start, total=sum(len(t) for _, t in rows))
    assert set(params) == set(start)
    assert all(np.isfinite(params[k]).all() and np.allclose(params[k], again[k], atol=1e-5) for k in params) and not np.allclose(params["rec"], start["rec"])


def test_lm_averages_groups_of_shards():
    import pickle

    one = [{"a": np.full(3, float(i), np.float32), "size": np.array([7])} for i in range(5)]
    groups = [pickle.dumps(op3_lm_scoring._merged([pickle.dumps((1, p)) for p in part])) for part in (one[:3], one[3:])]
    n, mean = op3_lm_scoring._merged(groups)
    assert n == 5 and np.allclose(mean["a"], 2.0) and mean["size"].tolist() == [7]


# ---- 4


def test_language_id(spark):
    rows = op4_language_id.op4_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert held and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    values = ["le la les un une des", "the and of is it", None, "", "12 34 !!", "ü", "漢字 かな", "THE AND"] * 3
    d = docs_of(spark, values)
    model = op4_language_id.fit(d)
    out = op4_language_id.predict(d, model)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.columns.count("score") == 1
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[6].lang_pred != "und" and got[5].lang_pred != "und"
    empty = docs_of(spark, empty=True)
    assert {r.lang_pred for r in op4_language_id.predict(d, op4_language_id.fit(empty)).collect()} == {"und"}
    assert op4_language_id.predict(empty, model).count() == 0


def test_language_id_against_a_plain_predictor(spark):
    """Counts, tables and scores in dictionaries, for known, unseen, very long and tied words."""
    rng = random.Random(8)
    pools = {"aa": "abcd", "bb": "bcde", "cc": "cdeé"}
    word = lambda c: "".join(rng.choice(c) for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word(pools[lang]) for _ in range(rng.randint(1, 30))).title(), lang) for i in range(150) for lang in [rng.choice(sorted(pools))]]
    rows += [(900, "d" * 90 + " z", "bb"), (901, "D" * 90, "cc"), (902, "zz zz yy", None), (903, "x1y-d" + "d" * 90, None), (904, "q w q", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    letters = re.compile(op4_language_id.WORD)
    words, grams, langs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), sorted(pools)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in letters.findall(t.lower()):
                words[w][lang] += 1
                padded = op4_language_id.PAD + w + op4_language_id.PAD
                for k in range(1, 6):
                    for j in range(len(padded) - k + 1):
                        grams[padded[j : j + k]][lang] += 1
    score = lambda table, x, lang: math.log((table[x][lang] + 0.1) / (sum(c[lang] for c in table.values()) + 0.1 * (len(table) + 1)))
    by_k = {k: {g: c for g, c in grams.items() if len(g) == k} for k in range(1, 6)}

    def plain_scores(w):
        if w in words:
            return [score(words, w, lang) for lang in langs]
        padded = op4_language_id.PAD + w + op4_language_id.PAD
        for k in range(5, 0, -1):
            known = [padded[j : j + k] for j in range(len(padded) - k + 1) if padded[j : j + k] in by_k[k]]
            if known:
                return [sum(score(by_k[k], g, lang) for g in known) / len(known) for lang in langs]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in op4_language_id.predict(d, op4_language_id.fit(d)).collect()}
    for i, t, _ in rows:
        total = [sum(x) for x in zip(*(plain_scores(w) for w in letters.findall(t.lower())))]
        best = max(range(3), key=lambda j: (total[j], -j))
        p = 1 / sum(math.exp(x - total[best]) for x in total)
        assert got[i].lang_pred == langs[best] and abs(got[i].score - p) < 1e-3, (i, t)


def test_backoff_takes_the_longest_known_gram():
    m = op4_language_id.Model(["a", "b"], np.zeros(0, np.uint64), np.zeros((0, 2), np.float32), {}, {})
    for k, (gram, s) in {2: ("xy", (-1.0, -9.0)), 1: ("x", (-9.0, -1.0))}.items():
        m.gram_keys[k], m.gram_scores[k] = op4_language_id._gram_keys([gram], k), np.array([s], np.float32)
    assert op4_language_id.backoff(m, ["qxyq", "qxq", "zz"]).tolist() == [[-1.0, -9.0], [-9.0, -1.0], [0.0, 0.0]]


# ---- 5


def brute_components(values, shingle=4, percent=85):
    sets = {}
    for i, t in values:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("shingle", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, shingle, percent, monkeypatch):
    values = texts(200, seed=shingle)
    monkeypatch.setattr(op5_jaccard_join, "frequent_from", lambda sketch: 3)  # most tokens count as frequent: pairs of tokens are indexed
    rows = op5_jaccard_join.jaccard_components(docs_of(spark, values), shingle, percent).collect()
    want = brute_components(list(enumerate(values)), shingle, percent)
    assert len(rows) == len(values) + 2 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_edges(spark):
    d = docs_of(spark, texts(30)).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    rows = op5_jaccard_join.jaccard_components(d).collect()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert op5_jaccard_join.jaccard_components(docs_of(spark, empty=True)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_jaccard_hot_keys(spark, monkeypatch, hot):
    """Hot digests and signatures, and ids with unlike texts, give what brute force gives."""
    rng = random.Random(3)
    line = [f"w{i}" for i in range(60)]
    near = [" ".join(line[:k] + [f"x{rng.random()}"] + line[k + 1 :]) for k in (3, 20, 40, 59) for _ in range(15)]
    values = texts(60) + [" ".join(line)] * 60 + near
    rows = list(enumerate(values))
    two = [(1000, values[70]), (1000, "quite another text of more than four words"), (1001, "quite another text of more than four words"), (1001, "a third one with no link to others at all")]
    if hot:
        monkeypatch.setattr(op5_jaccard_join, "MOST_KEYS", 5)
        monkeypatch.setattr(op5_jaccard_join, "HOT_SHARE", 20)
    d = spark.createDataFrame(rows + two, "doc_id long, text string").repartition(4)
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    got = {(r.doc_id, r.n_shingles): r.component_id for r in op5_jaccard_join.jaccard_components(d).collect()}
    assert all(got[i, n] == want[i] for i, n in got if i < 1000)
    assert {c for (i, _), c in got.items() if i >= 1000} == {want[70]}


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    sketch = rng.integers(1, 60, 1 << op5_jaccard_join.SKETCH_BITS)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((rng.choice(x, max(1, len(x) - int(rng.integers(0, 1 + n // 8))), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64))))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both) and len(x) > 1 and len(y) > 1 and not np.array_equal(x, y):
            (a, la, _), (b, lb, _) = (op5_jaccard_join.signatures(s, sketch, 30, percent) for s in (x, y))
            left = {k: v for k, v in zip(b.tolist(), lb.tolist())}
            assert any(k in left and (100 + percent) * min(v, left[k]) >= percent * (len(x) + len(y)) for k, v in zip(a.tolist(), la.tolist()))


# ---- 6


def test_mixing(spark, duck):
    values = texts()
    d = docs_of(spark, values)
    out = op6_mixing.mixed(d).collect()
    size = {}
    rows = list(enumerate(values)) + [(i, values[i]) for i in (3, 4)]
    for i, t in rows:
        size.setdefault(["s1", "s2", "s3", None][i % 4], []).append(len(WORD.findall(t or "")))
    total, weight, open_, target = sum(map(sum, size.values())), {"s1": 1, "s2": 2, "s3": 3, None: 1}, set(size), {}
    while True:
        left = total - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sum(size[s])}
        if not over:
            break
        target |= {s: 3.0 * sum(size[s]) for s in over}
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert {r.source: round(r.target, 6) for r in out} == {s: round(t, 6) for s, t in target.items()}
    assert len(out) == len(rows) and all(math.floor(r.target / r.source_size) <= r.copies <= math.floor(r.target / r.source_size) + 1 for r in out if r.source_size)
    mix = op6_mixing.emit(d)
    assert mix.columns == d.columns and mix.count() == sum(r.copies for r in out) and sorted(op6_mixing.mixed(d).collect(), key=repr) == sorted(out, key=repr)
    own = {"size": -7, "source_size": -8, "target": -9, "copies": -10, "copy": -11, "mix_source": "mine", "mix_size": -12, "mix_target": -13}
    clash = d.select("doc_id", "text", "source").withColumns({k: F.lit(v) for k, v in own.items()})
    kept = op6_mixing.emit(clash)
    assert kept.columns == clash.columns and {tuple(r)[3:] for r in kept.collect()} == {tuple(own.values())} and kept.count() == mix.count()
    assert sorted((r.doc_id, r.copies) for r in op6_mixing.mixed(clash).collect()) == sorted((r.doc_id, r.copies) for r in out)
    assert op6_mixing.mixed(docs_of(spark, empty=True)).count() == 0
    assert {r.copies for r in op6_mixing.mixed(docs_of(spark, [None, "", " "] * 3)).collect()} == {0}


# ---- 7


def test_lookup():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.concatenate((rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 1, 2**63] if n > 1 else [], np.uint64))))
        h = np.concatenate((keys, keys + np.uint64(1), rng.integers(0, 1 << 63, 50).astype(np.uint64)))
        where = {int(k): i for i, k in enumerate(keys)}
        assert W.Lookup(keys)(h).tolist() == [where.get(int(x), -1) for x in h]


def test_topk_index_is_exact():
    """The possible members hold the best rows, with exact scores, at any range of values."""
    rng = np.random.default_rng(3)
    for scale, n, d in ((100, 700, 16), (5, 300, 4), (40000, 400, 8), (0, 200, 3), (1, 3, 2)):
        rows = np.floor(scale * rng.standard_normal((n, d))).astype(np.int64)
        index = op7_exact_topk.ImpactIndex(rows)
        for i in range(0, n, max(1, n // 25)):
            (maybe, got), s = index.search(rows[i], 5, np.array([i])), rows @ rows[i]
            best = sorted((j for j in range(n) if j != i), key=lambda j: (-s[j], j))[:5]
            assert set(best) <= set(maybe.tolist()) and i not in maybe and got.tolist() == s[maybe].tolist()


def test_topk_stops_before_all_postings():
    rng = np.random.default_rng(5)
    rows = np.floor(100 * rng.standard_normal((4000, 24)) * np.geomspace(1, 0.01, 24)).astype(np.int64)
    index = op7_exact_topk.ImpactIndex(rows)
    for i in range(40):
        maybe, _ = index.search(rows[i], 5, np.array([i]))
        assert len(maybe) < len(rows) // 8
    assert index.visited < 0.6 * 40 * rows.size


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, [-1.0, 2.0]), (8, [1.0])]
    rows = spark.createDataFrame([(*x, 0, 0) for x in v], "vec_id long, embedding array<float>, rank int, score long")
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "rank")
    got = sorted(rows_of(op7_exact_topk.exact_topk(rows, q, k=3)))
    assert got == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 6, 81920), (0, 3, 6, 81920), (50, 1, 0, 49152), (50, 2, 1, 49152), (50, 3, 6, 49152)]
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    asked = huge.where("vec_id in (0, 3)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    most = (1 << 63) - 1
    assert sorted(rows_of(op7_exact_topk.exact_topk(huge, asked, k=2))) == [(0, 1, 1, most), (0, 2, 3, 256 * 5 * 256), (3, 1, 2, 512 * 1280), (3, 2, 0, 256 * 1280)]
    assert op7_exact_topk.exact_topk(rows.limit(0), q).count() == 0 and op7_exact_topk.exact_topk(rows, q.limit(0)).count() == 0


# ---- 8


@pytest.mark.parametrize("window", [35, 3])
def test_substrings(spark, window):
    values = texts()
    d = list(enumerate(values)) + [(i, values[i]) for i in (3, 4)]
    split = [WORD.findall(t or "") for _, t in d]
    c = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    want = []
    for (i, _), w in zip(d, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if c[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    out = op8_substring_dedup.dedup_substrings(docs_of(spark, values), window).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed for r in out)
    assert op8_substring_dedup.dedup_substrings(docs_of(spark, empty=True)).count() == 0


# ---- 9


def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    values = texts() + ["it's <|endoftext|> Ünïcode é", "don't stop 12ab", "İstanbul ΣΑΣ"]
    d = docs_of(spark, values)
    op9_token_output.write_tokens(d, f"file://{tmp_path}/t")
    tok = Tokenizer.from_file(op9_token_output.default_tokenizer())
    want, start = [], 0
    for i in sorted([*range(len(values)), 3, 4]):
        ids = [*tok.encode(values[i] or "", add_special_tokens=False).ids, op9_token_output.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = f"file://{tmp_path}/t"
    assert sorted(rows_of(op9_token_output.read_documents(spark, path))) == want
    assert sorted((r.doc_id, r.start) for r in op9_token_output.read_index(spark, path).collect()) == [(a, b) for a, b, _, _ in want]
    op9_token_output.write_tokens(docs_of(spark, empty=True), f"{path}0")
    assert op9_token_output.read_documents(spark, f"{path}0").count() == 0


def test_token_files(spark, tmp_path):
    """Encodings, row groups and page indexes of the files, and reads of single documents."""
    import pyarrow.parquet as pq

    values = texts() * 3
    d = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    op9_token_output.write_tokens(d, f"file://{tmp_path}/t")
    files = sorted((tmp_path / "t").glob("*.parquet"))
    seen = set()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                seen |= {(column.path_in_schema, e) for e in column.encodings}
                assert column.has_offset_index and (column.has_column_index or not column.is_stats_set)
    assert any(p.startswith("ids") and e == "RLE_DICTIONARY" for p, e in seen)
    assert {p for p, e in seen if e == "DELTA_BINARY_PACKED"} >= {"doc_id", "local_start"}
    some = op9_token_output.read_ids(spark, f"file://{tmp_path}/t", 17, 19)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,17)" in plan and "LessThanOrEqual(doc_id,19)" in plan
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op9_token_output.default_tokenizer())
    got = {r.doc_id: list(r.ids) for r in some.collect()}
    assert got == {i: [*tok.encode(values[i] or "", add_special_tokens=False).ids, op9_token_output.END_ID] for i in (17, 18, 19)}


# ---- 10


def test_warc_dictionary(spark, tmp_path):
    """A trained dictionary in the leading frame, several archives a part, and archives that do not match."""
    import io

    import zstandard

    body = [f"<html><head><title>page {i}</title></head><body><p>{'the same words again and again ' * 20} {i}</p></body></html>" for i in range(400)] + ["<p>tiny</p>"] * 2
    pages = spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in enumerate(body)], "page_id long, url string, html string").repartition(2)
    dictionary = op10_warc.train_dictionary(pages)
    assert dictionary
    folder = f"file://{tmp_path}/w"
    manifest = op10_warc.write_warc(pages, folder, least_bytes=100, most_bytes=50_000)
    assert manifest.count() > 4 and manifest.agg(F.sum("records")).first()[0] == len(body) and manifest.agg(F.max("bytes")).first()[0] < 52_000
    got = op10_warc.read_warc(manifest, folder).collect()
    assert sorted(r.page_id for r in got) == list(range(len(body))) and {r.record_type for r in got} == {"response"}
    raw = (tmp_path / "w" / manifest.first().path).read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert int.from_bytes(raw[:4], "little") == op10_warc.DICTIONARY_MAGIC and size == len(dictionary)
    assert len(list(op10_warc.read_archive(io.BytesIO(raw)))) > 1
    other = zstandard.train_dictionary(4096, [bytes([65 + i % 26]) * 50 + str(i * 7919).encode() * 30 for i in range(300)]).as_bytes()
    for broken in (raw[:4] + (0).to_bytes(4, "little") + raw[8 + size :], raw[:4] + len(other).to_bytes(4, "little") + other + raw[8 + size :]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(op10_warc.read_archive(io.BytesIO(broken)))
    packed = zstandard.ZstdCompressor().compress(dictionary)  # the dictionary frame may itself be compressed
    again = raw[:4] + len(packed).to_bytes(4, "little") + packed + raw[8 + size :]
    assert list(op10_warc.read_archive(io.BytesIO(again))) == list(op10_warc.read_archive(io.BytesIO(raw)))
    revisit = op10_warc.parse(op10_warc.record(9, "u", b"abc", op10_warc.digest32(b"abc"), 1))[0]
    assert revisit["warc-refers-to"] == op10_warc.parse(op10_warc.record(1, "u", b"abc", op10_warc.digest32(b"abc"), None))[0]["warc-record-id"]


def test_warc(spark, tmp_path):
    body = ["<p>é</p>", None, "", "<p>é</p>", "x" * 100_000, "\r\n\r\nWARC/1.1\r\n", "", "unique"] * 5
    rows = [(i, f"http://h/{i}\r\nx", b, 1) for i, b in enumerate(body)] + [(None, None, "<p>é</p>", 1), (4, "u", body[4], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = f"file://{tmp_path}/w"
    got = sorted(rows_of(op10_warc.read_warc(op10_warc.write_warc(pages, folder), folder).drop("url")), key=repr)
    first = {}
    for i, _, b, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(b or "", i)
    want = []
    for i, _, b, _ in rows:
        raw = (b or "").encode()
        o = first[b or ""]
        want.append((i, len(raw), op10_warc.digest32(raw), "response" if o == i else "revisit", None if o == i else o))
    assert got == sorted(want, key=repr)
    none = op10_warc.write_warc(pages.limit(0), f"{folder}0")
    assert op10_warc.read_warc(none, f"{folder}0").count() == 0


def test_warc_rejects_damage():
    import io

    good = op10_warc.record(1, "u", b"abc", op10_warc.digest32(b"abc"), None)
    assert op10_warc.parse(good)[1] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 3", b"Content-Length: 2"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"WARC-Type:", b"WARC-Type ")):
        with pytest.raises(ValueError):
            op10_warc.parse(bad)
    out = io.BytesIO()
    op10_warc.write_archive(out, b"", iter([good, good]))
    assert list(op10_warc.read_archive(io.BytesIO(out.getvalue()), block=7)) == [good, good]
    with pytest.raises(ValueError):
        list(op10_warc.read_archive(io.BytesIO(out.getvalue()[:-3])))
    with pytest.raises(ValueError):
        list(op10_warc.read_archive(io.BytesIO(b"plain text, no frame")))
