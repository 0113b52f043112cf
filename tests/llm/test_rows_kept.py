"""The forms that keep rows, on odd rows and columns of any name."""

import os

import pytest

from millrace.llm.decontaminate import without_contaminated
from millrace.llm.mixing import mix, mixed
from millrace.llm.paragraphs import remove_paragraphs
from millrace.llm.simhash import one_of_each
from millrace.llm.storage import Work
from millrace.llm.toxicity import without_toxic

ITEM = "Seven small boats sailed slowly past the old stone bridge at noon. Who saw them go?"
LONG = "word " * 60_000 + "end"
CLASH = "__rid __of __gone rid digest gone draws u skey block turns shard place any row d part u_".split()
ROWS = [
    (1, "one two three four five six seven", "a"), (2, None, None), (3, "", "b"), (None, "nobody knows whose text this may be", None), (None, "nobody knows whose text this may be", None),
    (5, "the same line twice here you see", "a"), (5, "another line of the same id then", "a"), (6, ITEM, "b"), (7, LONG, None), (7, LONG, None), (8, "  \n\t ", "c"), (9, "one two three four five six seven", "c"),
]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "source", *(f"{i} as `{c}`" for i, c in enumerate(CLASH)))


FORMS = {
    "toxic": lambda df: without_toxic(df, df.sparkSession.createDataFrame([(5, 0), (6, None)], "doc_id bigint, toxic int")),
    "simhash": one_of_each,
    "items": lambda df: without_contaminated(df, df.sparkSession.createDataFrame([(1, ITEM), (None, None), (1, "")], "item_id bigint, text string")),
    "mixed": mixed,
    "paragraphs": remove_paragraphs,
}


@pytest.mark.parametrize("name", FORMS)
def test_odd_rows_and_names(spark, name):
    df = frame(spark)
    out = FORMS[name](df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    assert all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in out.limit(3).collect())
    if name == "toxic":
        assert got == sorted(ROWS, key=str)
    if name == "items":
        assert got == sorted((r for r in ROWS if r[0] != 6), key=str)
    if name == "simhash":
        assert [d for d, *_ in got] == [1, 2, 5, 5, 6, 7, None]
    if name == "paragraphs":
        assert [t for d, t, _ in got if d is None] in (["", ROWS[3][1]], [ROWS[3][1], ""]) and [t for d, t, _ in got if d == 9] == [""]
        assert [t for d, t, _ in got if d in (1, 2, 6)] == [ROWS[0][1], None, ITEM] and sorted(len(t) for d, t, _ in got if d == 7) == [0, len(LONG)]
    if name == "mixed":
        assert set(got) <= set(ROWS)


def test_empty_tables(spark):
    empty = frame(spark, [])
    for form in FORMS.values():
        assert form(empty).count() == 0


def test_the_mix_is_written_by_shard_and_place(spark):
    rows = [(i, f"text {i} " + "w " * (i % 9), "abc"[i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    draws = [(x.shard, x.place, r.doc_id) for r in mix(docs, blocks=64).collect() for x in r.draws]
    assert len(set(x[1] for x in draws)) == len(draws)
    path = Work(spark, "test").path("mix")
    mixed(docs, blocks=64).write.parquet(path)
    files = sorted(f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".parquet"))
    written = [r.doc_id for f in files for r in spark.read.parquet(f"{path}/{f}").collect()]
    assert written == [d for *_, d in sorted(draws)]


def test_run_leaves_the_results_only(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from millrace.llm import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    sf = tmp_path / "sf"
    frame(spark).select("doc_id", "text", "lang", "source", "rid").write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(6, None)], "doc_id bigint, toxic int").write.parquet(str(sf / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(sf / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(sf))
    # copies and the item are gone; what the mix leaves out depends on its draw, but not the one text with nearly all words
    assert {7} <= {r.doc_id for r in out.collect()} <= {1, 2, 5, 7, None}
    left = os.listdir(tmp_path / "millrace")
    assert len(left) == 1 and len(os.listdir(tmp_path / "millrace" / left[0])) == len(corpus_pipeline.STAGES)
