import math
import zlib
from collections import Counter

import numpy as np

from colloquy.llm import lm
from colloquy.llm.lm import BLOCK, Attention, blocks, lm_scores


def test_gradients():
    rng = np.random.default_rng(0)
    model = Attention(np.arange(12, dtype=np.int32) % 5)
    model.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    x, joined, y, counts, _ = blocks([rng.integers(0, 11, n) for n in (3, 40, 16, 0)], 11)
    loss, g, ids = model.gradients(x, joined, y, counts)
    g["ei"] = np.array([g["ei"][ids == i].sum(0) for i in range(12)])
    assert math.isclose(loss, -(model.log_class(x, joined, y) * counts).sum() / counts.sum(), rel_tol=1e-5)
    for name, w in model.p.items():
        for k in rng.choice(w.size, min(6, w.size), replace=False):
            at, old, out = np.unravel_index(k, w.shape), None, []
            for step in (1e-4, -1e-4):
                old = w[at]
                w[at] = old + step
                out.append(model.gradients(x, joined, y, counts)[0])
                w[at] = old
            assert math.isclose((out[0] - out[1]) / 2e-4, g[name][at], rel_tol=2e-2, abs_tol=2e-5), name


def test_windows_score_each_token_once_and_never_look_ahead():
    rng = np.random.default_rng(1)
    model = Attention(np.arange(12, dtype=np.int32) % 5)
    ids = rng.integers(0, 11, 70)
    x, joined, y, counts, _ = blocks([ids[:5], ids], 11)
    full = (model.log_class(x, joined, y) * counts)[1:]
    assert counts.sum() == 6 + 71
    for t in (1, BLOCK, 2 * BLOCK + 3, 69):
        x2, j2, y2, c2, _ = blocks([ids[:t]], 11)
        assert np.allclose(model.log_class(x2, j2, y2).ravel()[:t], full.ravel()[:t], atol=1e-5)


def plain(rows):
    toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(w := toks(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, t in rows]


def check(got, want):
    key = lambda r: (str(r[:5]), r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-6)


def test_base_and_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in lm_scores(docs, head=2000).collect()]
    check(got, plain([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r[1]]
    print(sum(r[6] for r in held) / sum(r[2] for r in held), sum(r[5] for r in held) / sum(r[2] for r in held))
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # context helps on held-out texts


def plain_score(rows, model, path):
    """The score by loops over single tokens."""
    p, end = {k: v.astype(np.float64) for k, v in model.p.items()}, len(model.classes) - 1
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in t.lower().split())
    size, kinds = Counter(), Counter()
    of = {w: int(i) for w in {w for _, t in rows for w in t.lower().split()} for i in lm.lead([w.encode()], path)}
    for w, n in c.items():
        size[model.classes[of[w]]] += n
        kinds[model.classes[of[w]]] += 1
    out = []
    for d, t in rows:
        words = t.lower().split()
        seen, total = [end, *[of[w] for w in words]], 0.0
        for at, (now, word) in enumerate(zip(seen, [*words, None])):
            first = max(0, (at // BLOCK - 1) * BLOCK)
            e = np.array([p["ec"][model.classes[i]] + p["ei"][i] for i in seen[first : at + 1]])
            s = (e @ p["k"]) @ (e[-1] @ p["q"]) / math.sqrt(lm.WIDTH) + p["b"][at - np.arange(first, at + 1)]
            a = np.exp(s - s.max())
            h = e[-1] + (a / a.sum()) @ (e @ p["v"]) @ p["o"]
            z = h @ p["u"] + p["c"]
            g = model.classes[end if word is None else of[word]]
            total += z[g] - z.max() - math.log(np.exp(z - z.max()).sum())
            if word is not None:
                total += math.log((c[word] + 0.5) / (size[g] + 0.5 * (kinds[g] + 1)))
        out.append((d, total / math.log(10)))
    return out


def test_score_matches_single_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 6000").limit(150).selectExpr("doc_id", "lower(regexp_replace(text, '[^a-zA-Z0-9 ]', '')) as text")
    rows, model = lm.scored(docs, head=300)
    want = dict(plain_score([tuple(r) for r in docs.collect()], model, lm.vocabulary_path()))
    got = rows.collect()
    assert len(got) == len(want) > 100
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-4, abs_tol=1e-3)


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, "É é A a \x0b b"), (4, "word " * 100), (5, "x\x1fy z"), (6, "a")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, word string")
    check([tuple(r) for r in lm_scores(df).collect()], plain(rows))
    assert lm_scores(df.limit(0)).count() == 0


def test_long_texts_train_the_model(spark):
    rows = [(i, "alpha beta gamma delta " * 1500) for i in range(60)]  # each over 20000 bytes
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sum(r.score - r.base_score for r in got) > 0.2 * sum(r.n_tokens for r in got)


def test_words_are_counted_where_the_text_lies(spark):
    rows = [(i, "Alpha beta alpha \x1f\x0bÉ é " * 50) for i in range(40)] + [(None, None)]
    counts = lm.word_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row a word before the shuffle
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    want = Counter(w.decode() for d, t in rows if not held(d) for w in [*(t or "").encode().lower().split(), b""])
    assert {r.word: r.c for r in counts.collect() if r.c} == want


def test_leading_ids_are_those_of_single_words():
    path, rng = lm.vocabulary_path(), np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(0x21, 0x7F, n))).encode() for n in rng.integers(1, 14, 5000)] + [b"'s", b"\x1c", b"a\x1fb", b"\x00", "é".encode(), "a\xa0".encode(), "日本".encode(), b"1", b"(x)"]
    single = [lm._encoding(path).encode_ordinary(" " + w.decode())[0] for w in words]
    assert lm.lead(words, path).tolist() == single and lm.lead([], path).tolist() == []


def test_words_of_a_batch_are_those_of_each_text():
    import pyarrow as pa

    texts = ["É é A a \x0b b", None, "", "  two  blanks\t\n", "x\x1fy z\x1c \x00 ", "A\xa0b　c", " ", "b B b"]
    words, codes, text = lm.words_of(pa.array(["skipped", *texts]).slice(1))
    assert len(set(words)) == len(words) and b"" not in words
    got = [[words[c] for c in codes[text == k]] for k in range(len(texts))]
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert [len(x) for x in lm.words_of(pa.array([], pa.string()))] == [0, 0, 0]


def test_a_batch_is_encoded_without_a_loop_over_its_words(spark):
    import cProfile
    import pstats
    from types import SimpleNamespace

    import pyarrow as pa

    class Texts:
        """Hands out the function that ``encoded`` gives to the workers."""

        schema = spark.range(1).schema
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))
        mapInArrow = lambda self, work, _: work

    texts = ["the cat sat on the mat Ärger über café ", None, "the the"] * 400
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array([True] * 1200), pa.array(texts)], ["id", "held_out", "text"])
    work = lm.encoded(Texts(), [SimpleNamespace(word="the", c=4), SimpleNamespace(word="cat", c=1)], lm.vocabulary_path())
    with cProfile.Profile() as p:
        (out,) = work(iter([batch]))
    rows = out.to_pylist()
    assert [(r["n_words"], r["n_head"]) for r in rows[:3]] == [(9, 3), (0, 0), (2, 2)]
    assert math.isclose(rows[0]["head"], 2 * math.log10(4.5) + math.log10(1.5)) and rows[1]["tail"] == []
    assert {d["word"]: d["tf"] for d in rows[0]["tail"]} == dict.fromkeys(["sat", "on", "mat", "Ärger".encode().lower().decode(), "über", "café"], 1)
    ids = lm.lead([w for w in texts[0].encode().lower().split()], lm.vocabulary_path())
    assert np.frombuffer(rows[0]["ids"], np.int32).tolist() == ids.tolist()
    calls = sum(n for (_, _, name), (_, n, *_) in pstats.Stats(p).stats.items() if name in ("<method 'encode_ordinary' of 'builtins.CoreBPE' objects>", "encode_ordinary", "<method 'split' of 'bytes' objects>"))
    assert calls < 50, calls  # one split and at least one encoding a text before


def test_sums_out_of_range_are_shifted():
    s = np.array([[1.0, 2.0], [200.0, 199.0], [-200.0, -201.0]], np.float32)
    out, total, shift = lm.exps(s)
    assert np.allclose((np.log(total) + shift)[:, 0], np.logaddexp(s[:, 0], s[:, 1])) and np.allclose((out / total).sum(1), 1)
    assert lm.exps(s[:1])[2] == 0.0


def score_by_subwords(rows, model, path):
    """The score by loops over the subword ids of each text, all of them."""
    p, end, enc = {k: v.astype(np.float64) for k, v in model.p.items()}, len(model.classes) - 1, lm._encoding(path)
    ids = {w: enc.encode_ordinary(" " + w) for _, t in rows for w in t.lower().split()}
    c = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in t.lower().split())
    size, kinds = Counter(), Counter(model.classes[ids[w][0]] for w in c)
    for w, n in c.items():
        size[model.classes[ids[w][0]]] += n
    out = {}
    for d, t in rows:
        seen, total = [end], 0.0
        for word in [*t.lower().split(), None]:
            at, g = len(seen) - 1, model.classes[end if word is None else ids[word][0]]
            first = max(0, (at // BLOCK - 1) * BLOCK)
            e = np.array([p["ec"][model.classes[i]] + p["ei"][i] for i in seen[first:]])
            a = np.exp((e @ p["k"]) @ (e[-1] @ p["q"]) / math.sqrt(lm.WIDTH) + p["b"][at - np.arange(first, at + 1)])
            z = (e[-1] + (a / a.sum()) @ (e @ p["v"]) @ p["o"]) @ p["u"] + p["c"]
            total += z[g] - z.max() - math.log(np.exp(z - z.max()).sum())
            if word is not None:
                total += math.log((c[word] + 0.5) / (size[g] + 0.5 * (kinds[g] + 1)))
                seen += ids[word]
        out[d] = total / math.log(10)
    return out


def test_all_subwords_of_a_word_enter_the_model(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").limit(120).selectExpr("doc_id", "lower(regexp_replace(text, '[^a-zA-Z0-9 ]', '')) as text")
    models, scored = [], lm.scored
    monkeypatch.setattr(lm, "scored", lambda *a, **k: models.append(scored(*a, **k)) or models[-1])
    got = lm_scores(docs, head=300).collect()
    texts = [tuple(r) for r in docs.collect()]
    want = score_by_subwords(texts, models[0][1], lm.vocabulary_path())
    assert len(got) == len(want) > 80
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-4, abs_tol=1e-3)
    inner = {i for _, t in texts for w in t.split() for i in lm._encoding(lm.vocabulary_path()).encode_ordinary(" " + w)[1:]}
    assert len(inner) > 100 and np.any(models[0][1].p["ei"][sorted(inner)], axis=1).mean() > 0.9  # and is learned from


def test_pieces_are_those_of_single_words():
    path, rng = lm.vocabulary_path(), np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(0x21, 0x7F, n))).encode() for n in rng.integers(1, 30, 5000)] + [b"'s", b"\x1c", b"a\x1fb", "é".encode(), "a\xa0".encode(), "日本".encode(), b"antidisestablishmentarianism"]
    single = [lm._encoding(path).encode_ordinary(" " + w.decode()) for w in words]
    ids, sizes = lm.pieces(words, path)
    assert sizes.tolist() == list(map(len, single)) and ids.tolist() == [i for x in single for i in x]
    opens = lm.opening(path)
    assert all(opens[x[0]] and not opens[x[1:]].any() for x in single) and opens[-1]
    assert [len(x) for x in lm.pieces([], path)] == [0, 0]


def test_equal_texts_score_alike_wherever_they_stand():
    rng = np.random.default_rng(0)
    model = Attention((np.arange(2001) % 58).astype(np.int32))
    model.p = {k: (w + 0.3 * rng.standard_normal(w.shape)).astype(np.float32) for k, w in model.p.items()}
    texts = [rng.integers(0, 2000, n) for n in rng.integers(0, 400, 80)]

    def each(texts):
        x, joined, y, counts, of = blocks(texts, 2000)
        return np.bincount(of, (model.log_class(x, joined, y).astype(np.float64) * counts).sum(1), len(texts))

    for far in (1, 100):  # and where one text leaves the range of plain floats
        model.p["u"][:, 3] *= far
        alone = np.array([each([t])[0] for t in texts])
        assert (each(texts) == alone).all() and (each([rng.integers(0, 2000, 30_000), *texts[::-1]])[:0:-1] == alone).all()
