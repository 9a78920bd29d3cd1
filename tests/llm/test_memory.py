"""What workers and batches hold."""

import public_tokenizers as P
from pyspark.sql import functions as F

from postwarden.llm import bytebpe, common, langid, packing, toxicity


def test_a_worker_keeps_one_memory():
    bpe = bytebpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert bytebpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN) is bpe
    words = packing.loaded(P.path("word_bpe_49k.json"))
    assert packing.loaded(P.path("word_bpe_49k.json")) is words and len(common._KEPT) == 1
    common.forget()
    assert not common._KEPT


def test_operators_let_go_of_what_others_remember(spark, docs):
    """The worker that packed holds no words of it when it has told a language."""
    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"kept": [sorted(m.__module__ for m, _ in common._KEPT)]})

    few = docs.filter("doc_id < 40").coalesce(1)
    made = packing.pieces(few, P.path("word_bpe_49k.json"), 4096, 1, "doc_id", "text")
    assert made.count() > 0
    langid.identified(few, few, P.path("byte_bpe_multi_50k.tiktoken")).collect()
    seen = few.select("doc_id").mapInArrow(look, "kept array<string>").collect()
    assert all("postwarden.llm.packing" not in r.kept for r in seen)


def test_carried_rows_hold_the_text_once(docs, crowded):
    assert common.carried(docs, "doc_id", "text", True).columns == ["row"]
    assert common.carried(docs, "doc_id", "text", False).columns == ["doc_id", "_text"]
    assert common.carried(docs.withColumn("text", F.col("n_chars")), "doc_id", "text", True).columns == ["row", "_text"]


def test_carried_rows_get_the_same_results(spark, docs, crowded):
    path, labels = P.path("byte_bpe_multi_50k.tiktoken"), docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 as int) toxic").distinct()
    numbers = docs.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    for rows in (docs, crowded, numbers):
        for of, result in (
            (lambda carry: langid.identified(rows, docs, path, carry=carry), ["lang_pred", "score"]),
            (lambda carry: toxicity.scored(rows, docs, labels, carry=carry), ["score"]),
        ):
            plain = of(False).select("doc_id", *result).collect()
            whole = of(True)
            assert sorted(map(str, whole.select("row.doc_id", *result).collect())) == sorted(map(str, plain))
            assert whole.select("row.*").exceptAll(rows).count() == 0 and whole.count() == rows.count()
