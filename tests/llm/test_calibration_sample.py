"""The sample that weighs the bits: bounded, and no text in or out with all of its copies."""

from tracemill.llm import langid


def test_copies_of_a_text_are_drawn_each_for_itself(spark):
    rows = [(i, "one text" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, text string, lang string")
    drawn = langid._calibration_sample(frame, 300).collect()
    assert len(drawn) == 300 == len({r["id"] for r in drawn})
    assert 60 < sum(r["text"] == "one text" for r in drawn) < 140
    assert langid._calibration_sample(frame, 3000).count() == 3000


def test_repeated_rows_keep_the_bound(spark):
    frame = spark.createDataFrame([(7, "same", "en")] * 500 + [(8, "other", "de")] * 3, "id long, text string, lang string")
    assert langid._calibration_sample(frame, 50).count() <= 50


def test_the_model_judges_no_more_rows_than_its_bound(spark, monkeypatch):
    seen = []
    judged = langid.in_arrow
    monkeypatch.setattr(langid, "in_arrow", lambda frame, *rest: (seen.append(frame), judged(frame, *rest))[1])
    rows = [(i, "the cat is here" if i % 3 else f"der hund ist da {i}", "en" if i % 3 else "de") for i in range(600)]
    langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), calibration_rows=90)
    assert seen[-1].count() == 90
