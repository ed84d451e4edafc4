"""Problem 8 over tables: languages of documents and of their segments, with confidence."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.arrow import map_batches, ship

#: bounds of the labelled sample that the automata are fitted on: documents a language, characters a document, characters kept a language
SAMPLE_DOCS = 60
SAMPLE_LENGTH = (200, 20_000)
TRAIN_CHARS = 12_000


def labelled(documents: DataFrame, lang_code: DataFrame) -> DataFrame:
    """``documents`` with ``label``: the code that ``lang`` names, in any notation (case, blanks, region or script, three letters, English name), else null.

    The names are joined, so that their number has no bound; a code table of usual size is broadcast by its statistics.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    names = (
        lang_code.select("lang_code", F.explode(F.array("lang_code", "iso3", "lang_name")).alias("name"))
        .select("lang_code", name(F.col("name")).alias("name"))
        .where("name <> '' AND lang_code IS NOT NULL")
        .groupBy("name")
        .agg(F.min("lang_code").alias("code"))
    )
    whole = names.select(F.col("name").alias("_whole"), F.col("code").alias("_code"))
    first = names.select(F.col("name").alias("_first"), F.col("code").alias("_code1"))
    d = documents.withColumn("_t", name(F.col("lang")))
    d = d.join(whole, d["_t"] == whole["_whole"], "left").join(first, F.element_at(F.split(d["_t"], r"[-_.@ (]"), 1) == first["_first"], "left")
    return d.withColumn("label", F.coalesce("_code", "_code1")).drop("_t", "_whole", "_code", "_first", "_code1")


def training_sample(documents: DataFrame, lang_code: DataFrame) -> list[tuple[str, str]]:
    """At most ``SAMPLE_DOCS`` labelled texts a language, those of the smallest hash of doc_id, in hash order.

    They are chosen over all rows without their texts; then only theirs are fetched.
    """
    size = F.coalesce("n_chars", F.length("text")) if "n_chars" in documents.columns and documents.schema["n_chars"].dataType.typeName() == "long" else F.length("text")
    d = labelled(documents.select("doc_id", "lang", size.alias("size")), lang_code).where("label IS NOT NULL").where(F.col("size").between(*SAMPLE_LENGTH))
    d = d.select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    best = d.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("h", "doc_id"))).where(F.col("rn") <= SAMPLE_DOCS)
    chosen = {r.doc_id: (r.h, r.doc_id, r.label) for r in best.collect()}  # bounded by SAMPLE_DOCS rows a language
    if not chosen:
        return []
    # texts of a wrong length can only come from a stale n_chars
    rows = documents.where(F.col("doc_id").isin(list(chosen))).where(F.length("text").between(*SAMPLE_LENGTH)).select("doc_id", "text").collect()
    return [(chosen[r.doc_id][2], r.text) for r in sorted(rows, key=lambda r: chosen[r.doc_id][:2])]


def fit(documents: DataFrame, lang_code: DataFrame):
    """The suffix automata of all languages, fitted on the labelled sample, as a broadcast of some megabytes."""
    from siltstone.llm.crossparse import Languages, train

    spark = documents.sparkSession
    ship(spark)
    return spark.sparkContext.broadcast(Languages(train(training_sample(documents, lang_code), TRAIN_CHARS)))


def _documents(model):
    from siltstone.llm.crossparse import hear, present

    def batch(cols):
        for doc_id, label, heard in zip(cols["doc_id"], cols["label"], hear(model.value, cols["text"])):
            p = present(heard)
            same = set(p) == {label}
            for lang, conf in sorted(p.items()):
                yield doc_id, lang, conf, label, same

    return batch


def _segments(model):
    from siltstone.llm.crossparse import hear, segments

    def batch(cols):
        for doc_id, heard in zip(cols["doc_id"], hear(model.value, cols["text"])):
            for k, (start, lang, n, items, conf) in enumerate(segments(heard), 1):
                yield doc_id, k, start, lang, n, items, conf

    return batch


def languages(documents: DataFrame, lang_code: DataFrame) -> DataFrame:
    """``doc_id, lang_code, confidence, label, as_labelled``: one row per language of a document.

    A language counts with two whole sentences in a row outside code fences and
    front matter, or with two list items. ``label`` is what ``lang`` names, if
    anything; ``as_labelled`` tells whether the document's languages are just
    that one. Null, empty and wordless texts give no row, nor do texts in a
    script that no labelled language has; repeated documents count on their
    own. Each text is judged whole in the task that read it.
    """
    d = labelled(documents.select("doc_id", "lang", "text").where("text IS NOT NULL"), lang_code).select("doc_id", "label", "text")
    return map_batches(d, partial(_documents, fit(documents, lang_code)), "doc_id long, lang_code string, confidence double, label string, as_labelled boolean")


def language_segments(documents: DataFrame, lang_code: DataFrame) -> DataFrame:
    """``doc_id, segment_no, start, lang_code, n_sentences, n_items, confidence``: runs of sentences in one language."""
    d = documents.select("doc_id", "text").where("text IS NOT NULL")
    return map_batches(
        d, partial(_segments, fit(documents, lang_code)), "doc_id long, segment_no int, start int, lang_code string, n_sentences int, n_items int, confidence double"
    )
