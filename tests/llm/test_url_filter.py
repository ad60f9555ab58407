import itertools
import math
import re
from collections import Counter

import regex

from colloquy.llm import url_filter as url_filter_module
from colloquy.llm.url_filter import RULES, best_split, judge_by_rules, split_url, url_filter


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/71", "http://a.com/en/7", "http://example.com/en/7", "http://xexample.com/en/7", "https://b.net/de/8", "https://example.net/de/8x", "https://example.net?x=/de/", "https://o.org#/es/", "https://o.org/es/?q", "http://com/en/", "http://a.b/c://d/en/", "x://É.COM/en/", "http://a.com/en\n/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in judge_by_rules(split_url(df)).collect():
        want = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule_verdict, r.rule) == (*want, None, None)[:4], r


def test_each_rule_says_what_the_contract_says(spark):
    want = {"http://a.com/en/1": ("com/en/", "block"), "http://w.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block")}
    got = url_filter(spark.createDataFrame([(i, u, None) for i, u in enumerate(want)], "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(want.values()))


def test_best_split_is_the_best():
    counts, total = {"the": 50, "ring": 9, "th": 3, "er": 7, "in": 20, "g": 1, "thering": 1}, 100
    cost = lambda p: math.log(counts[p] / total) if p in counts else -math.log(total + 1) - 2.5 * len(p)
    for label in ("thering", "thexring", "g", "ringthein", "zzz"):
        cuts = [[label[a:b] for a, b in itertools.pairwise((0, *c, len(label)))] for k in range(len(label)) for c in itertools.combinations(range(1, len(label)), k)]
        best = max(sum(map(cost, c)) for c in cuts)
        got = best_split(label, counts, total)
        assert "".join(got) == label and math.isclose(sum(map(cost, got)), best)


def slow_scores(rows):
    """Word counts, segments, token counts and scores by loops over single urls."""
    words = Counter(w for _, _, html in rows for w in regex.split(r"[^\p{L}]+", re.sub("<[^>]*>", " ", html or "").lower()) if w)
    total = max(1, sum(words.values()))

    def tokens(host, path):
        out = [f"h:{w}" for label in re.split(r"[.\-:_0-9]+", host) if label for w in best_split(label, words, total)]
        shape = re.sub(r"[0-9]+", lambda m: f"/#{len(m[0])}/" if len(m[0]) < 6 else "/#long/", path)
        return [*out, *[f"p:{x.lower()}" for x in re.split(r"[/.\-_]+", shape) if x]]

    judged = [(*plain(url), None, None)[:3] for _, url, _ in rows]
    block, allow = Counter(), Counter()
    for host, path, verdict in judged:
        (block if verdict == "block" else allow).update(tokens(host, path))
    v, n_block = len(block | allow), sum(verdict == "block" for *_, verdict in judged)
    weight = lambda t: math.log((block[t] + 1) / (sum(block.values()) + v)) - math.log((allow[t] + 1) / (sum(allow.values()) + v))
    prior = math.log((n_block + 1) / (len(rows) - n_block + 1))
    return [prior + sum(map(weight, tokens(host, path))) for host, path, _ in judged]


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter_module, "HOT", 3)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()] + [(9000 + i, f"http://hot{'word' * 20}.org/a/{'12345678'[: i % 9]}", None) for i in range(12)]
    got = sorted(url_filter(spark.createDataFrame(rows, pages.schema)).collect(), key=lambda r: r.page_id)
    want = [s for _, s in sorted(zip([r[0] for r in rows], slow_scores(rows)))]
    assert all(math.isclose(r.score, s, abs_tol=1e-4) for r, s in zip(got, want, strict=True))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(None, None, None), (1, "http://x.com/en/1", None), (1, "http://x.com/en/1", ""), (2, "http://thering.org/a/b-1.html", "<p>the ring</p>")]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string, html string")).selectExpr("*", "1 as host", "2 as score")
    got = url_filter(pages).collect()
    want = [(r.page_id, *(*plain(r.url), None, None)[:4]) for r in pages.collect()]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i, h, p, n) for i, h, p, _, n in want), key=str)
    verdicts = {(h, p): v for _, h, p, v, _ in want if v}
    assert all(r.verdict == verdicts.get((r.host, r.path), "block" if r.score > 0 else "allow") for r in got)


def test_empty(spark):
    assert url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
