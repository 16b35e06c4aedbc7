import random

from pyspark.sql import functions as F

from stopwise.llm import toxicity as m


def corpus(n=1500):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 9))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += f" {rng.choice(['vileword', 'nastyword', 'vilething'])}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_the_offending_sentence(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = m.fit(m.sample(docs, marks))
    got = m.score(docs, model).withColumn("out", m.held_out(F.col("doc_id"))).collect()
    toxic, texts = {i: t for i, _, t in labels}, dict(rows)
    out = [r for r in got if r.out]
    assert 250 < len(out) < 500
    assert sum((r.score >= m.THRESHOLD) == toxic[r.doc_id] for r in out) >= 0.98 * len(out)
    for r in out:
        if toxic[r.doc_id] and r.offending:
            s = r.offending[0]
            assert any(w in texts[r.doc_id][s.start : s.end] for w in ("vile", "nasty"))


def test_labels_of_the_held_out_class_are_not_read(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = marks.withColumn(
        "toxic", F.when(m.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    assert m.fit(m.sample(docs, marks)) == m.fit(m.sample(docs, flipped))


def test_odd_rows_and_columns(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 0, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    left = m.drop_toxic(odd_docs, marks)
    assert left.columns == odd_docs.columns
    scored = m.score(odd_docs, m.fit(m.sample(odd_docs, marks)))
    assert scored.count() == odd_docs.count() and scored.where("score between 0 and 1").count() == odd_docs.count()
    assert m.drop_toxic(no_docs, marks).collect() == []
    # Without labels nothing is toxic.
    assert m.drop_toxic(odd_docs, marks.limit(0)).count() == odd_docs.count()


def test_length_alone_makes_no_text_toxic(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = m.fit(m.sample(docs, marks))
    clean = [t for (i, t), (_, _, toxic) in zip(rows, labels, strict=True) if not toxic and model.document(t)[0] < m.THRESHOLD]
    long = " ".join(clean * 4)
    assert len(m.SENTENCE.findall(long)) > 10_000
    assert model.document(long)[0] < m.THRESHOLD and not model.document(long)[1]
    # One telling sentence in it is still found.
    score, spans = model.document(long + " vileword and nastyword.")
    assert score >= m.THRESHOLD and len(spans) == 1 and spans[0][0] >= len(long)
