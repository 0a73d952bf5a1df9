"""Repeats of one or two long lines in the pipeline's line dedup."""

import corpus_pipeline
from tests.llm.helpers import SPACE

SF = "/root/testdata/sf0.001"


def plain_cut(rows, run=3, words=50):
    """{doc_id: text}: repeated runs of ``run`` lines, or of fewer with ``words`` words, are cut."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        full = [(n, x) for n, x in enumerate(lines) if SPACE.search(x)]
        gone = set()
        for width in range(1, run + 1):
            for k in range(len(full) - width + 1):
                own = full[k : k + width]
                if width < run and sum(len(SPACE.findall(x)) for _, x in own) < words:
                    continue
                key = tuple(x for _, x in own)
                if key in seen:
                    gone.update(n for n, _ in own)
                seen.add(key)
        if not gone or len(gone) < len(full):
            out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else t
    return out


def test_long_repeats_go_and_short_ones_stay(spark):
    long, half, other = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 50), ("b", 30), ("c", 30)))
    short = " ".join(f"d{k}" for k in range(49))
    rows = [
        (1, long), (2, f"head\n{long}\ntail"), (3, long), (4, f"{half}\n\n{other}\nend"), (5, f"x\n{half}\n{other}\ny"),
        (6, f"{half}\nz\n{other}"), (7, short), (8, f"{short}\nq"), (9, f"{long}\n{long}"), (10, None),
    ]
    got = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    got = {r.doc_id: r.text for r in got.collect()}
    assert got == plain_cut(rows)
    assert got[2] == "head\ntail" and 3 not in got and got[5] == "x\ny" and got[8] == f"{short}\nq" and 9 not in got


def test_stage_equals_the_plain_version(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, documents, SF).collect()}
    want = plain_cut([(r.doc_id, r.text) for r in documents.collect()])
    assert got == want
