import corpus_pipeline
from rowsync.llm.common import stored


def test_stages(spark):
    text = "some words about nothing in particular that make a document long enough to be told apart number "
    rows = [(k, f"{text}{k} {k * 7919} x{k * k}\nboiler plate\n", "en", "src0", 0, "more") for k in range(12)]
    rows += [(20, rows[3][1], "en", "src1", 0, "more"), (21, "write to me@mail.example.com about this other thing entirely my friend", "en", None, 0, None), (22, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns == columns
    left = {r["doc_id"]: r for r in docs.collect()}
    assert 20 not in left and 3 in left and 22 not in left  # a copy; a document without anything to tell its language
    assert all("boiler plate" not in r["text"] and r["n_chars"] == len(r["text"]) and r["extra"] in ("more", None) for r in left.values())
    assert "[EMAIL]" in left[21]["text"]
    pieces = corpus_pipeline.pack_sequences(spark, docs, "").toPandas()
    assert set(pieces["doc_id"]) == set(left)


def test_rows_go_by_themselves_not_by_their_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good, other = "the cat and the dog with the house of that man over there by the river " * 3, "another thing entirely that was said about some old stones and their makers " * 3
    rows = [(k, f"{good} {k} {k * 77}", "en", "s", 1) for k in range(3, 40)] + [(1, None, None, None, None), (1, other, "en", "s", 1), (None, None, None, None, None), (2, other + " x", "en", "s", 1), (2, other + " x", "en", "s", 1)]
    df = spark.createDataFrame(rows, schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.identify_language(spark, df, "").collect()]
    assert (1, other) in kept and (1, None) not in kept and (None, None) not in kept and kept.count((2, other + " x")) == 2
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert left.count((2, other + " x")) == 0 and left.count((1, other)) == 1 and left.count((1, None)) == 1


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
