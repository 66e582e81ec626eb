"""The operators of this package as queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattscope.llm import decontam, hilbert_ann, jaccard, langid, lexical, packing, pii, quality, spelling, suffix_dedup, topk, toxicity, warc
from wattscope.llm.common import held_out, new_folder, table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def archived_pages(archive):
    """A row for each record of an archive of pages."""
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return archive.where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


def op1_langid(spark, d):
    docs = table(spark, d, "documents")
    model = langid.fit(docs, ~held_out(4, 2))
    return langid.predict(docs.select("doc_id", held_out(4, 2).alias("held_out"), F.col("text").alias("_text")), model)


def op2_warc(spark, d):
    path = new_folder(spark, "warc")
    warc.write_archive(table(spark, d, "pages"), path)
    return archived_pages(warc.read_archive(spark, path, payloads=False))


def quality_model(spark, d):
    """Learned from the labels of documents that are not held out."""
    docs = table(spark, d, "documents").where(~held_out(3, 1))
    return quality.fit(docs, table(spark, d, "labels"))


def op3_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", held_out(3, 1).alias("held_out"), "text")
    return quality.judged(docs, quality_model(spark, d)).select("doc_id", "held_out", "score", "predicted")


def op4_pii(spark, d):
    found = pii.find(table(spark, d, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*pii.PATTERNS)).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op5_topk(spark, d):
    vectors = topk.integer_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def toxicity_model(spark, d):
    """Learned from the labels of documents that are not held out."""
    docs = table(spark, d, "documents").where(~held_out(3, 1))
    return toxicity.fit(docs, table(spark, d, "labels"))


def op6_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", held_out(3, 1).alias("held_out"), "text")
    return toxicity.judged(docs, toxicity_model(spark, d)).select("doc_id", "held_out", "score", "predicted")


def op7_jaccard(spark, d):
    return jaccard.near_copies(table(spark, d, "documents"))


def op8_decontam(spark, d):
    marked = decontam.mark(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    items = F.col("contamination.items")
    return marked.select("doc_id", "contamination.n_words", F.size("contamination.positions").cast("long").alias("n_hit"),
                         F.size(items).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                         decontam.is_contaminated().alias("contaminated"))


def op9_suffix(spark, d):
    cut = suffix_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), word_vocabulary())


def op11_spelling(spark, d):
    return spelling.variants(table(spark, d, "documents"))


def op12_ann(spark, d):
    return hilbert_ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_lexical(spark, d):
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = (op1_langid, op2_warc, op3_quality, op4_pii, op5_topk, op6_toxicity, op7_jaccard, op8_decontam, op9_suffix, op10_packing, op11_spelling,
           op12_ann, op13_lexical)


def queries():
    return {f.__name__: f for f in QUERIES}
