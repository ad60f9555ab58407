import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from colloquy.llm import alignment as A
from colloquy.llm.bpe import byte_letters

ODD = ["", None, "a  b c", "▁x y", "x▁ y", "<|endoftext|> <s> x </s>", "é ñandú\n\n\tz  ", " lead", "trail ", "\x00 a\x1cb c", "　 x y", "日本語 テキスト 😀👍🏽 ok", "'s it's 't", "a\x85b c", "x" * 3000, " ", "\x00", " " * 5000 + "x" + " " * 3000, " a  " * 400, "ﬁ ½ ² x", "a b", "a b", "<0x41> A", "é ́e"]


def one(letters, a, b, text):
    """(ids of A, ids of B, linked pairs, groups) of a text, by walking over byte positions."""
    if not text:
        return [], [], [], []
    names = {i: t for t, i in a.get_vocab().items()}
    whole = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    sx = [bytes(letters[c] for c in names[i]) for i in x]
    sy = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(sx) != whole or b"".join(sy) != whole:
        return [], [], [], []
    at_x, at_y = ([k for k, s in enumerate(side) for _ in s] for side in (sx, sy))
    links = sorted(set(zip(at_x, at_y)))
    groups, gx, gy = [], set(), set()
    for p in range(len(whole)):
        gx.add(at_x[p])
        gy.add(at_y[p])
        if p + 1 == len(whole) or (at_x[p + 1] != at_x[p] and at_y[p + 1] != at_y[p]):
            groups.append(",".join(str(x[k]) for k in sorted(gx)) + "|" + ",".join(str(y[k]) for k in sorted(gy)))
            gx, gy = set(), set()
    return x, y, [(x[i], y[j]) for i, j in links], groups


def slow(rows):
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = {c: k for k, c in enumerate(byte_letters())}
    got = [one(letters, a, b, t) for _, t in rows]
    n = Counter(p for *_, links, _ in got for p in set(links))
    best_a, best_b = Counter(), Counter()
    for (x, y), c in n.items():
        best_a[x], best_b[y] = max(best_a[x], c), max(best_b[y], c)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(
        ((i, len(x), len(y), len(g), len(l), sum(n[p] == best_a[p[0]] for p in l), sum(n[p] for p in l), sha(g), sum(n[p] == best_b[p[1]] for p in l)) for (i, _), (x, y, l, g) in zip(rows, got)), key=str
    )


def test_odd_texts(spark):
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0x20, 0x17F), *range(0x370, 0x3FF), *range(0x2000, 0x2060), *range(0x4E00, 0x4E20), 0x2581, 0xA0, 0x301, 9, 10, 13]]
    texts = ODD + ["".join(rng.choices(pool + [" "] * 60, k=rng.randint(1, 60))) for _ in range(150)] + ["".join(rng.choices("thieonaders  ", k=rng.randint(1, 200))) for _ in range(100)]
    rows = [*enumerate(texts), (None, "a null id"), (3, "the same id"), (3, "the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as pair", "'y' as groups", "2 as n", "3 as id")
    got = A.alignment(df.repartition(3))
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)
    assert A.alignment(df.where(F.lit(False))).count() == 0


def test_rare_pairs_meet_their_counts_too(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(A, "FEW", 300)
    monkeypatch.setattr(A, "STEP", 500)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    assert sorted(map(tuple, A.alignment(docs).collect()), key=str) == slow([tuple(r) for r in docs.collect()])


def test_operator_gives_groups_and_links(spark):
    r = A.aligned(spark.createDataFrame([(1, "the the naïve")], "doc_id long, text string")).first()
    assert r.n_groups == r.groups.count(";") + 1 and sum(r.times) == r.n_links and len(r.pairs) == len(set(r.pairs))
    assert [len(g.split("|")) for g in r.groups.split(";")] == [2] * r.n_groups


def test_a_batch_is_taken_in_slices(spark):
    import tracemalloc

    import pandas as pd

    class Docs:
        """Hands out the function that ``aligned`` gives to the workers."""

        sparkSession, schema = spark, spark.range(1).select(F.col("id").alias("doc_id")).schema
        select = lambda self, *_: self
        mapInPandas = lambda self, work, _: work

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("thieonaders", k=rng.randint(2, 9))) for _ in range(600)) for _ in range(1000)]
    texts[3], texts[5] = None, ""
    work, f = A.aligned(Docs()), pd.DataFrame({"row": range(1000), "id": range(1000), "text": texts})
    before = [len(list(work(iter([f.head(1)]))))]  # the encoders are loaded
    tracemalloc.start()
    rows, widest = [], 0
    for out in work(iter([f, f.tail(10), f.head(0), f.iloc[3:4]])):
        rows += out["row"].tolist()
        widest = max(widest, sum(map(len, out["groups"])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert before == [1] and rows == [*range(1000), *range(990, 1000), 3]
    assert widest < 8 << 20 and peak < 100 << 20, (widest, peak)  # not the whole batch at once


def test_chunks_met_again_after_they_were_forgotten(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(A, "KNOWN", 50)
    monkeypatch.setattr(A, "SLICE", 2000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    assert sorted(map(tuple, A.alignment(docs).collect()), key=str) == slow([tuple(r) for r in docs.collect()])
