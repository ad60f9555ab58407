from colloquy.functions.text import content_terms
from colloquy.operators import scan, search
from colloquy.plans import queries, retrieve
from colloquy.sources.scratch import Stages, written


def test_retrieval_of_a_batch_equals_that_by_the_index(spark, sf_dir, monkeypatch):
    """Without a stored index a batch writes no bounds, whose rows grew with questions times meetings."""
    monkeypatch.setattr(scan, "QUESTIONS", 5)
    meetings, asked = queries._meetings(spark, sf_dir), queries._questions(spark, sf_dir)
    chunks = written(retrieve.analysed(queries._chunks(spark, sf_dir), meetings), "chunks")
    index = written(retrieve.indexed(chunks), "index")
    stages = Stages()
    got = [retrieve.retrieve(chunks, meetings, asked, stages=stages), retrieve.retrieve(chunks, meetings, asked, index=index)]
    shown = lambda df: sorted(map(repr, df.drop("text").collect()))
    assert shown(got[0][0]) == shown(got[1][0]) and shown(got[0][1]) == shown(got[1][1]) and got[0][0].count()
    assert not {"index", "opened"} & {s for s, *_ in stages.rows} and "frequencies" in {s for s, *_ in stages.rows}


def test_texts_are_cut_once_for_many_parts_of_the_questions(spark, monkeypatch):
    """Every part of the questions cut and stemmed all texts, and twice."""
    texts = [f"word{i % 7} other{i % 5} mi-412 running{'s' * (i % 2)} tail{i}" for i in range(60)]
    chunks = spark.createDataFrame([(f"{i:03d}", x) for i, x in enumerate(texts)], "chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"word{i % 7} tail{i} mi-412 runs") for i in range(20)], "query_id string, text string")
    terms = written(search.query_terms(asked, terms=lambda c: search.stemmed_phrases(content_terms(c))), "terms")
    real, cut, got = scan.matched, [], []
    monkeypatch.setattr(scan, "matched", lambda *a: cut.append(1) or real(*a))
    for questions in (3, 1000):
        monkeypatch.setattr(scan, "QUESTIONS", questions)
        n, df, best = retrieve._scanned(chunks, terms, 5, written)
        got.append((n, sorted(map(tuple, df.collect())), sorted(map(tuple, best.collect()))))
    assert got[0] == got[1] and got[0][2] and len(cut) == 2  # 20 questions are 7 parts of 3
    monkeypatch.setattr(scan, "QUESTIONS", 1)
    n, df, best = retrieve._scanned(chunks, terms, 5, written)
    assert (n, sorted(map(tuple, best.collect()))) == (got[0][0], got[0][2]) and len(cut) == 5  # 3 groups of parts
