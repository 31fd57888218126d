"""Stages of the corpus pipeline on null and repeated ids."""

from test_operators import rows_of, text_of

import corpus_pipeline


def test_near_duplicates_by_row(spark):
    a, b, c, d, e = (text_of(5000 + i, 80) for i in range(5))
    rows = [
        (None, a), (None, b), (None, b), (None, c + " more"), (1, c), (2, d), (2, e), (2, d + " more"), (3, e), (4, a + " x"), (5, d), (5, text_of(6000, 60)),
        (6, None), (6, None), (6, ""), (7, " \n"), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.near_duplicates(spark, docs, ""))]
    worded = sorted((x for x in got if (x[1] or "").strip()), key=str)
    ended = [(i, t) for i, t in worded if (i, t) not in ((2, d), (2, d + " more"))]  # either of the id may stand for its group
    assert len(worded) - len(ended) == 1
    assert ended == sorted([(None, b), (1, c), (2, e), (4, a + " x"), (5, text_of(6000, 60))], key=str)
    assert sorted((x for x in got if x not in worded), key=str) == sorted([(6, None), (6, ""), (7, " \n"), (None, "")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.filter("doc_id < 0"), "").count() == 0
