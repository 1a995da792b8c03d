"""A labelled document of more lines than are learnt from at once still takes part in learning."""

from quillon.llm import line_crf


def test_long_documents_are_learnt_from(spark):
    good = "\n".join(f"This is sentence number {k} of an ordinary text." for k in range(60))
    bad = "\n".join("### $$$ ||| BUY NOW 123 !!!" for _ in range(60))
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = line_crf.learn(docs, labels, max_lines=10)
    (low, high), _, _ = model.scores([bad, good])
    assert low < 0.3 and high > 0.7
