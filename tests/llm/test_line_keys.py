"""Line dedup of rows that share an id or have none."""

from foliolake.llm import line_dedup

RUN = "first of three\nsecond of three\nthird of three"


def test_rows_without_an_id_keep_their_own_lines(spark):
    rows = [(1, RUN), (None, RUN + "\ntail"), (None, "alone\nstands\nhere\nand more"), (None, None)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in got) == sorted(
        [("1", 0, RUN), ("None", 3, "tail"), ("None", 0, rows[2][1]), ("None", 0, "")]
    )


def test_texts_of_one_id_keep_their_own_lines(spark):
    rows = [(1, RUN), (7, RUN + "\ntail"), (7, "alone\nstands\nhere\nand more"), (2**63 - 1, "x"), (None, "head\n" + RUN)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in got) == sorted(
        [("1", 0, RUN), ("7", 3, "tail"), ("7", 0, rows[2][1]), (str(2**63 - 1), 0, "x"), ("None", 3, "head")]
    )


def test_a_run_in_two_texts_without_an_id_stays_once(spark):
    rows = [(None, RUN + "\none"), (None, "other\n" + RUN)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 3]
