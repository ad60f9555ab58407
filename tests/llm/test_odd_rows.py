"""Every operator on nulls, empty and very long texts, repeated rows, ties, empty tables and columns that clash with its own names."""

import pytest

from colloquy.llm import decontam, line_dedup, near_copies, simhash
from colloquy.llm.alignment import alignment
from colloquy.llm.bpe import bpe_round_trip, digests
from colloquy.llm.lm import lm_scores
from colloquy.llm.ngram_join import jaccard_components
from colloquy.llm.pii import find_pii, report
from colloquy.llm.quality import keep_good, quality_report
from colloquy.llm.quality_rules import quality_rules
from colloquy.llm.suffix_dedup import cut_report, cut_texts
from colloquy.llm.url_filter import url_filter

NAMES = "_i _k _n _s _drop _n_lines id k h r n s fp row text_ words kind found base tail left lead root g t c host_ _id _text _words _lines _url shape salt token".split()
LONG = "the long text has many words and mail a@b.org in it\n" * 22_000  # over a megabyte


def rows():
    texts = ["one two three four five six", "", None, LONG, "one two three four five six", "call +1 (555) 000-1234 now", "1.2.3.4 is\nan address\nan address", "ties ties ties", "\x00\x1f"]
    out = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, None, None, None), (None, "null id", "de", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").selectExpr("*", *[f"'x' as {n}" for n in NAMES]).repartition(3).persist()


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (7, 0, 0), (None, 0, 1), (2, None, 1), (2, 0, None)], "doc_id long, quality int, toxic int").selectExpr("*", "1 as _quality", "2 as text", "3 as _id")
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, None), (2, ""), (3, "has many words and mail"), (4, "ties ties ties")], "item_id long, text string").selectExpr("*", "1 as item", "2 as key")
    return labels, bench


OPERATORS = {
    "contaminated": lambda d, labels, bench: decontam.contaminated(d, bench),
    "line_report": lambda d, labels, bench: line_dedup.line_report(d, min_sites=2),
    "find_pii": lambda d, labels, bench: report(find_pii(d)),
    "quality_report": lambda d, labels, bench: quality_report(d, labels),
    "simhash_components": lambda d, labels, bench: simhash.simhash_components(d),
    "cut_texts": lambda d, labels, bench: cut_report(cut_texts(d)),
    "lm_scores": lambda d, labels, bench: lm_scores(d),
    "bpe_round_trip": lambda d, labels, bench: digests(bpe_round_trip(d)),
    "url_filter": lambda d, labels, bench: url_filter(d.withColumn("html", d.text), id_col="doc_id", url_col="text"),
    "quality_rules": lambda d, labels, bench: quality_rules(d),
    "alignment": lambda d, labels, bench: alignment(d),
    "jaccard_components": lambda d, labels, bench: jaccard_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(docs, tables, name):
    got = OPERATORS[name](docs, *tables).collect()
    if name == "contaminated":
        assert {(r.id, r.item) for r in got} == {(0, 1), (4, 1), (3, 3), (7, 4)}
    else:
        assert len(got) == len(rows())
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
        one = [r for r in got if r.doc_id == 0]
        assert len(one) == 3 and (name == "line_report" or len(set(one)) == 1)  # repeated rows are judged alike
    assert OPERATORS[name](docs.limit(0), *tables).count() == 0


FILTERS = {
    "remove_boilerplate": lambda d, labels, bench: line_dedup.remove_boilerplate(d, min_sites=2),
    "remove_contaminated": lambda d, labels, bench: decontam.remove_contaminated(d, bench),
    "simhash.keep_first": lambda d, labels, bench: simhash.keep_first(d),
    "near_copies.keep_first": lambda d, labels, bench: near_copies.keep_first(d),
    "keep_good": lambda d, labels, bench: keep_good(d, labels),
}


@pytest.mark.parametrize("name", FILTERS)
def test_columns_pass_through(docs, tables, name):
    left = FILTERS[name](docs, *tables)
    got = left.collect()
    assert left.columns == docs.columns and got
    assert all(r[n] == "x" for r in got for n in NAMES)
    assert {r.doc_id for r in got} <= {r[0] for r in rows()}
    ids = [r.doc_id for r in got]
    if name == "remove_contaminated":
        assert {1, 2, 5, 6, 8, None} == set(ids)
    if name.endswith("keep_first"):
        assert ids.count(0) == 1 and 4 not in ids and {5, 6, 7} <= set(ids)
    assert FILTERS[name](docs.limit(0), *tables).count() == 0
