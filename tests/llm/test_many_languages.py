"""Every language is learnt, however many there are."""

from terrella.llm.language_id import train


def test_rare_languages_are_learnt(spark):
    langs = [f"l{k:03}" for k in range(420)]
    rows = [(i, f"{chr(0x4E00 + k) * 3} {chr(0x4E00 + k)}{chr(0x5E00 + k)}", lang) for i, (k, lang) in enumerate((k, lang) for k, lang in enumerate(langs) for _ in range(3 if k < 400 else 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, docs["doc_id"].isNotNull(), epochs=1)
    assert model.languages == langs
