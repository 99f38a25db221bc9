import corpus_pipeline
from dasyspark.llm import stages


def test_stages_take_effect_and_keep_the_columns(spark, make):
    base = "the quick brown fox jumps over the lazy dog and runs through a wide green field near some old river bank today"
    words = base.split()
    near = " ".join([*words[:-1], "tonight"])
    passage = " ".join(f"passage{i}" for i in range(20))
    docs = [(i, f"plain text number {i} about river {i * i} and garden {i * 7} with music", "en") for i in range(40)]
    docs += [(50, base, "en"), (51, base, "en"), (52, near + " x y z", "en"), (60, None, "en"), (61, "123 456", "en"), (62, "", None)]
    docs += [(70, f"alpha beta gamma {passage} delta", "en"), (71, f"one two three {passage} four five six seven eight nine", "en")]
    table = make(docs)
    kept = stages.language_id(spark, table, "")
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {60, 61, 62}
    single = stages.near_duplicates(spark, kept, "")
    assert single.columns == table.columns
    ids = {r.doc_id for r in single.collect()}
    assert 50 in ids and 51 not in ids and {70, 71, *range(40)} <= ids
    cut = {r.doc_id: r for r in stages.suffix_array(spark, single, "").collect()}
    assert cut[70].text == f"alpha beta gamma {passage} delta"
    assert "passage5" not in cut[71].text and cut[71].text.startswith("one two three") and cut[71].n_chars == len(cut[71].text)
    assert set(cut) == ids


def test_run_equals_its_stages_and_catches_what_it_should(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    packed = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r.doc_id for r in packed}
    assert len(kept) < len(docs) and len({docs[i] for i in kept}) == len(kept)
    assert all(r.offset + r.length <= 1024 for r in packed)
