import corpus_pipeline
from shutterlake.llm import registry


def test_stages_on_odd_rows(spark, tmp_path):
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here into the woods tonight"
    item = " ".join(f"question{k}" for k in range(20))
    rows = [(1, prose, "en", "s", 9), (2, prose.upper(), "en", "s", 9), (3, None, None, None, None), (4, "12345", "en", "s", 5), (5, f"before {item} after", "en", "s", 9), (6, "write to a.b@mail.example.com or 42.144.35.254 please my friend", "en", "s", 9), (None, "another text without an id but words", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes == [5, 4, 3, 3]
    texts = {r.doc_id: r for r in kept.collect()}
    assert set(texts) == {1, 6, None} and "a.b@mail" not in texts[6].text and texts[6].n_chars == len(texts[6].text)
    assert texts[1].text == prose and texts[1].n_chars == 9
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_all_queries_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "benchmark", "personal data", "packing"]


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here into the woods tonight"
    names = ["score", "overlaps", "n_replaced", "lang_pred", "ambiguous", "no_text", "__others", "a b", "c0"]
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, prose, "en"), (1, prose, "en"), (2, long, "en"), (3, "born on 1985-03-05 in a small town by the sea they say", "en"), (4, "una frase corta en otra lengua para aprender algo", "es")]
    docs = spark.createDataFrame([(*r, *(f"{n} of {i}" for n in names)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, "something that no document has in it at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema.simpleString() == docs.schema.simpleString()
    got = {r.doc_id: r for r in kept.collect()}
    assert sorted(got) == [1, 2, 3, 4] and kept.count() == 4
    for r in got.values():
        told = {r[n].split(" of ")[1] for n in names}
        assert len(told) == 1 and all(r[n] == f"{n} of {next(iter(told))}" for n in names)
    assert got[2].text == long and got[3].text != rows[3][1]
    places = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in places} == {1, 2, 3, 4}
