import re

from test_operators import docs, texts  # noqa: F401

from keyloom.llm import sentencepiece


def test_words_of_a_text_are_put_together_where_the_text_was_dealt(spark, docs):  # noqa: F811
    """Whichever words the dictionary holds, the ids are the same; no exchange stands above the words of whole texts."""
    pieces, plans = sentencepiece.Pieces("piece_bpe_32k.model"), []
    odd = spark.createDataFrame([(None, "hello rare words"), (None, "hello"), (0, ""), (0, "twice there"), (7, None)], "doc_id long, text string")
    every, keys = sentencepiece.rows_apart(docs.select("doc_id", "text").unionByName(odd), "doc_id", "text")

    def seen(rows):
        plans.append(rows._jdf.queryExecution().sparkPlan().toString() + rows._jdf.queryExecution().executedPlan().toString())
        return rows

    found = [sorted((str(r.doc_id), r.nth, r.n_words, list(r.ids)) for r in sentencepiece.gathered(every, pieces, keys, seen, dictionary=n).collect()) for n in (0, 30, 1 << 17)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(texts()) + 5
    assert len(plans) == 3 * sentencepiece.PARTS
    for plan in plans:
        above = plan.split("AdaptiveSparkPlan")[-1].split("Generate posexplode")[0]
        assert "Generate" in plan and not re.search(r"\bExchange (hash|range|single)", above)
