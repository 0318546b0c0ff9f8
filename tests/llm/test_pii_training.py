"""op5 learns from every document that offers stretches."""

from pyspark.sql import functions as F

from pivotscore.llm import op5_pii


def test_stretches_come_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(op5_pii, "made_up", lambda *a, **k: [])
    monkeypatch.setattr(op5_pii, "fit", lambda rows: sorted(z for z, _ in rows))
    docs = spark.createDataFrame([(f"write to user{k}@mail{k}.org today",) for k in range(40)], "text string")
    docs = docs.filter(F.pmod(F.xxhash64("text"), F.lit(16)) != 0)
    assert docs.count() > 20
    got = op5_pii.train(docs)
    assert len(got) == docs.count() and all("@" in z for z in got)
    assert len(op5_pii.train(docs, 7)) == 7


def test_added_cards_pass_the_checksum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    weights = op5_pii.train(docs)
    wrong = right = 0
    for r in docs.filter(F.col("text").rlike("[0-9]{4}")).collect():
        for kind, s, e in op5_pii.spans(r.text, weights)[1]:
            digits = "".join(c for c in r.text[s:e] if c.isdigit())
            ok = kind != "card" or 16 <= len(digits) <= 19 and op5_pii.luhn(digits)
            right, wrong = right + ok, wrong + (not ok)
            print(kind, repr(r.text[max(0, s - 20):e + 20]), ok)
    assert wrong == 0
    for text in ("order 1234567812345678 shipped", "a 4524132264652877 b", "4524-1322-6465-2877"):
        assert op5_pii.spans(text, weights) == ([], [])
    assert op5_pii.spans("call +1 (269) 555-3296 4524132264652876 now", weights)[1]
