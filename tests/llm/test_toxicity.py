import numpy as np

from pyspark.sql import functions as F

from dasyspark.llm import toxicity as T


def sentences(n, rng):
    nice, rude = ["lovely", "garden", "music", "river", "bread"], ["idiot", "scum", "moron"]
    group = T.IDENTITY[1]
    rows = []
    for i in range(n):
        words = set(rng.choice(nice, 3).tolist())
        y = int(rng.random() < 0.4)
        if y:
            words.add(str(rng.choice(rude)))
        # One group is named mostly in toxic sentences.
        if rng.random() < (0.7 if y else 0.05):
            words.add(group[0])
        if rng.random() < 0.1:
            words.add(group[1])
        rows.append((T.with_stems(words), y))
    return rows


def test_swapped_identity_terms_hardly_move_the_score():
    rows = sentences(800, np.random.default_rng(5))
    words = ["idiot", "scum", "moron", "lovely", "garden", T.IDENTITY[1][0], T.IDENTITY[1][1]]
    free, bound = T.train(rows, words, penalty=0.0), T.train(rows, words, penalty=10.0)
    a, b = (T.with_stems(["river", T.IDENTITY[1][i]]) for i in (0, 3))
    assert free.logit(a) - free.logit(b) > 1.0
    assert abs(bound.logit(a) - bound.logit(b)) < 0.2
    # A neutral mention is no longer taken for abuse, and abuse is still found.
    assert bound.score("a river and " + T.IDENTITY[1][0]) < 0.5 < bound.score("you moron")
    assert free.score("a river and " + T.IDENTITY[1][0]) > bound.score("a river and " + T.IDENTITY[1][0])


def test_counterfactuals_swap_one_term_for_each_other_of_its_set():
    group = T.IDENTITY[4]
    assert T.counterfactuals({"x"}) == []
    found = T.counterfactuals(T.with_stems(["x", group[0]]))
    assert {frozenset(c) for c in found} == {frozenset(T.with_stems(["x", o])) for o in group[1:]}


def test_held_out_accuracy(spark):
    from dasyspark.llm.queries import QUERIES

    found = QUERIES["op5_counterfactual_toxicity"](spark, "/root/testdata/sf0.01")
    rows = found.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(caught) >= 5 and np.mean(caught) >= 0.6 and np.mean(clean) <= 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_odd_rows_and_missing_labels(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(4, 1), (4, None), (5, 0), (6, 0), (7, 0), (None, 1), (99, 1)], "doc_id long, toxic int"
    )
    model = T.fit(odd, labels, least=1)
    rows = T.score(odd, model).collect()
    assert len(rows) == 11 and set(rows[0].asDict()) == {*odd.columns, "score", "predicted"}
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] == by[3] and all(0 <= x <= 1 for x in by.values())
    untaught = T.fit(odd, labels.limit(0))
    assert {r.score for r in T.score(odd, untaught).collect()} == {0.5}
    assert T.score(nothing, model).count() == 0


def test_words_and_stems_are_found_as_by_the_plain_form():
    texts = ["".join(map(chr, range(256))), "ÀÉß x²y a_b c1d ½\xa0z\x85w", "漢字 idiot İ ª", "Idiots idiotic IDIO idi", "", "\ud800 lone"]
    for text in texts:
        assert T.word_set(text) == set(T.LETTERS.findall(text.lower()))
    features = ["idiots", "idio*", "idioti*", "lone", "absent", "abse*"]
    for text in texts:
        assert T.finder(features)(T.word_set(text)) == T.with_stems(T.word_set(text)) & set(features)


def test_texts_are_read_once_to_choose_words(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([("good word", 0)] * 30 + [("idiots word", 1), ("idiotic word", 1)] * 15, "text string, y int")
    words, n = T.separating_words(rows.withColumn("text", told("text")), "y", 1, 5)
    assert n == 60 and words == ["good", "good*", "idio*", "idiot*", "idioti*"] and read.value == 60
