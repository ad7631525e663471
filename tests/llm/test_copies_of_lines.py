import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_do_not_make_their_lines_boilerplate(spark):
    own = [(i, f"the menu\nfirst line of {i}\nsecond line of {i}", "en", "s", 1) for i in range(60)]
    copies = [(100 + i, "the menu\na passage of its own\nand its end", "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame([*own, *copies, (200, None, "en", "s", 1)], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, df, "").collect()}
    assert got == {i: None if t is None else t.removeprefix("the menu\n") for i, t, *_ in [*own, *copies, (200, None)]}
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_lines(spark, df, ""), "").collect()}
    assert left == {*range(60), 100, 200}
