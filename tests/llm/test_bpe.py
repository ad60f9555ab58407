import hashlib
import random
import time

import public_tokenizers as P
from tokenizers import Tokenizer

from colloquy.llm.bpe import TrieEncoder, bpe_round_trip, digests

PATH = P.path("word_bpe_49k.json")
ODD = ["", None, " \n\t", "Hello, World's don't I'LL 1234 ½ ² Ⅷ", "<|endoftext|>a <|startoftext|><|endoftext|>b<|ENDOFTEXT|>", "ΟΔΟΣ Σ İstanbul ǅ ﬁ", "é å Å", "日本語テキスト 한국어 ไทย", "😀👍🏽 ok", "a\x1cb\x1fc\x85d\xa0e f​g᠎h", "x" * 5000, "ab" * 4000 + "!" * 3000, "ÀÉÎ ß ẞ Straße", "__init__ #tag @x_y-z"]


def test_encodes_as_the_library():
    lib, enc = Tokenizer.from_file(PATH), TrieEncoder(PATH)
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x20, 0x17F), *range(0x370, 0x3FF), *range(0x2000, 0x2060), *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610)]]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(pool + [" "] * 60, k=rng.randint(1, 80))) for _ in range(400)]
    texts += ["".join(rng.choices("thieonaders", k=rng.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False)
        assert enc.encode(t) == e.ids, repr(t)
        assert enc.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_unlike_words_cost_a_few_microseconds_a_symbol():
    """Words of random letters, of which tables of known words are no help: several times as quick as merging each by itself."""
    rng = random.Random(5)
    enc = TrieEncoder(PATH)
    words = [list({"".join(rng.choices("thieonaders", k=rng.randint(20, 40))) for _ in range(6000)}) for _ in range(2)]
    enc.learn(words[0])
    start = time.process_time()
    enc.learn(words[1])
    walked, start = time.process_time() - start, time.process_time()
    for w in words[1][:1000]:
        enc.merge(w)
    merged = 6 * (time.process_time() - start)
    print(walked, merged)
    assert walked < 0.9 * merged


def test_long_and_short_words_are_the_library_s():
    lib, enc = Tokenizer.from_file(PATH), TrieEncoder(PATH)
    rng = random.Random(8)
    for k in (1, 2, 31, 63, 64, 65, 66, 400):
        texts = ["".join(rng.choices("abé日!'s1", k=k)) for _ in range(40)] + ["".join(rng.choices("the", k=k)) for _ in range(40)]
        got = enc.encode_batch([*texts, " ".join(texts)])
        for t, (ids, shown) in zip([*texts, " ".join(texts)], got):
            e = lib.encode(t, add_special_tokens=False)
            assert memoryview(ids).cast("i").tolist() == e.ids and shown == lib.decode(e.ids, skip_special_tokens=False), t


def test_documents(spark, sf_dir):
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "a"), (1, None), (1, "")], "doc_id long, text string"))
    want = []
    for r in docs.collect():
        e = lib.encode(r.text or "", add_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(e.ids), sha(" ".join(map(str, e.ids))), sha(lib.decode(e.ids, skip_special_tokens=False))))
    got = [tuple(r) for r in digests(bpe_round_trip(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string, ids string")).count() == 0
