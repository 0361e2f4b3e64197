from pyspark.sql import functions as F
from spanloom.llm import langid, main_text, quality, toxicity

NAMES = ["_text", "_chars", "score", "lang_pred", "spans", "text", "_html", "n_chars", "a.b"]


def test_kept_columns_stay_beside_results_of_the_same_name(spark):
    rows = [(i, t, "en", 5, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(["some words here", "", None, "other words", "some words here"])]
    docs = spark.createDataFrame(rows, ["id", "body", "lang", "size", *NAMES])
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "id long, quality int, toxic int")
    keep = [F.col("id"), *[F.col(f"`{n}`") for n in NAMES]]
    named = docs.withColumn("doc_id", F.col("id"))
    many = labels.withColumnRenamed("id", "doc_id")
    outs = {
        "lang": (langid.identify(docs, langid.train(docs, F.lit(True), text_col="body", id_col="id"), keep, text_col="body"), ["lang_pred_", "score_", "spans_"]),
        "quality": (quality.score(named, quality.train(named, many, F.lit(True), text_col="body", chars_col="size"), keep, text_col="body", chars_col="size"), ["score_"]),
        "toxicity": (toxicity.score(named, toxicity.train(named, many, F.lit(True), text_col="body"), keep, text_col="body"), ["score_"]),
        "main": (main_text.extract(docs, keep, main_text.PRIOR, html_col="body"), ["text_", "n_chars_"]),
    }
    for df, more in outs.values():
        assert df.columns == ["id", *NAMES, *more]
        got = df.collect()
        assert len(got) == 5 and all(r[n] == f"{n}{r.id}" for r in got for n in NAMES) and all(r[m] is not None for r in got for m in more)
