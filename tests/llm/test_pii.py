import hashlib
import random
import re

from colloquy.llm.pii import ALL, CONFIDENT, DEVIATIONS, DOUBT, KINDS, ROUNDS, base_spans, find_pii, masked_recall, mentions, report

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind in KINDS:
        for m in PLAIN[kind].finditer(text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def test_base_spans_match_plain_patterns():
    rng = random.Random(5)
    texts = ["a@b.c_d@e.f", "@a.b@c.d", "x@@b.c", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.4", "4111 1111-1111 1111", "4111111111111111 2", "+1 (988) 555-2485 or", "+1 ((((((", "é +49 30 1234567-", "0000000000255.1.1.1", "a@b", ""]
    texts += ["".join(rng.choices("ab@.-_+1 0()4é", k=rng.randint(1, 40))) for _ in range(6000)]
    texts += ["".join(rng.choices("0123456789 -", k=40)) for _ in range(500)]
    for t in texts:
        assert base_spans(t) == plain_spans(t), t


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "9" * 400_000, "1." * 200_000, "+1" * 100_000, "@a." * 100_000, "a@" * 100_000):
        base_spans(t)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "a@b.c"), (1, None), (1, "")], "doc_id long, text string"))
    got = report(find_pii(docs)).collect()
    want, joined_of = [], {}
    for r in docs.collect():
        s = plain_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        joined_of[r.doc_id, hashlib.sha256(joined.encode()).hexdigest()] = joined.split(",")
        want.append((r.doc_id, *[sum(x[0] == k for x in s) for k in KINDS], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        kept = [x for x in r.spans.split(",") if x and (x in joined_of[r.doc_id, r.base_sha256])]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256 and len(r.spans.split(",")) - (r.spans == "") == r.n_spans == len(kept) + r.n_found


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"please call {'+1 (555) 000-' + str(1000 + i)} today and thanks") for i in range(40)]
    rows += [(100, "please call 5550001234 today"), (101, "room 12345678 today"), (102, "plain words only")]
    got = {r.doc_id: r for r in report(find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100].spans == "phone:12:22" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == ""
    assert all(got[i].n_phone == 1 for i in range(40))


def slow_found(rows):
    """The pattern graph, its rounds and what it extracts, in loops."""
    graph, of = {}, {}
    for _, t in rows:
        for _, _, kind, no, _, inst, patterns in mentions(t or ""):
            of[inst] = (kind, no)
            for p in patterns:
                graph.setdefault(p, set()).add(inst)
    told, conf = {}, {}
    for _ in range(ROUNDS):
        conf = {}
        for p, insts in graph.items():
            for k in ALL:
                own = sum(of[i][0] == k for i in insts)
                open_ = [i for i in insts if of[i][0] is None and of[i][1] != k]
                got = sum(told.get((i, k), 0.0) for i in open_)
                against = sum(of[i][0] not in (None, k) for i in insts)
                hits, z = own + got, DEVIATIONS
                n = hits + against + DOUBT * (len(open_) - got)
                if hits > 0:
                    share = hits / n
                    c = (share + z * z / (2 * n) - z * (max(share * (1 - share), 0) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
                    if round(c, 6) >= CONFIDENT:
                        conf[p, k] = round(c, 6)
        told = {}
        for (p, k), c in conf.items():
            for i in graph[p]:
                if of[i][0] is None:
                    told[i, k] = 1 - (1 - told.get((i, k), 0.0)) * max(1 - c, 1e-9)
    out = []
    for d, t in rows:
        found = []
        for a, b, kind, _, looks, _, patterns in mentions(t or ""):
            if kind in (None, "secret") and (best := max(((conf[p, k], -ALL.index(k)) for p in patterns for k in looks if (p, k) in conf), default=None)):
                found.append((a, -best[1], b))
        out.append((d, sorted(found)))
    return sorted(out, key=str)


def test_found_spans_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    made = []
    for i in range(300):
        value = rng.choice([f"+1 (555) 000-{rng.randint(1000, 9999)}", f"{rng.randint(1000000000, 9999999999)}", f"id{rng.randint(0, 99)}@host", f"u{rng.randint(0, 99)}@mail.org", f"1.2.3.{rng.randint(0, 400)}", f"key={rng.getrandbits(160):040x}", f"4{rng.randint(10**14, 10**15)}"])
        made.append((10_000 + i, " ".join([*rng.choices(words, k=2), "dial" if value[0] == "+" or i % 2 and value.isdigit() else rng.choice(["call", "mail", "to", "is", "host:"]), value, rng.choice(words)])))
    docs = docs.union(spark.createDataFrame(made, docs.schema)).repartition(5)
    got = sorted(((r.doc_id, [tuple(x) for x in r.found]) for r in find_pii(docs).collect()), key=str)
    assert got == slow_found([tuple(r) for r in docs.collect()])
    assert sum(len(f) for _, f in got) > 40 and len({k for _, f in got for _, k, _ in f}) > 1


def test_hidden_seeds_are_found_again(spark):
    got = {r.kind: r for r in masked_recall(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    for kind in ALL:
        assert got[kind].wrong == 0 and got[kind].again >= 0.9 * got[kind].hidden > 0
    assert got[None].wrong == 0


def test_secrets_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r for r in report(find_pii(docs)).collect()}
    secrets = 0
    for r in docs.collect():
        planted = re.findall(r'(?i)token = "([0-9a-f]+)"', r.text or "")
        found = [r.text[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[r.doc_id].spans.split(",") if x) if k == "secret"]
        assert found == planted
        secrets += len(planted)
    assert secrets > 100


def test_empty(spark):
    assert report(find_pii(spark.createDataFrame([], "doc_id long, text string, row string"))).count() == 0
