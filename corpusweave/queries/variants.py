"""Variant queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import variants as ops
from corpusweave.queries import Family
from corpusweave.session import small_table
from corpusweave.sources import views
from corpusweave.sources.views import with_views

QUERIES = Family()
FORMATS = ["", "nopic", "nopic:nopic-alias", "nopic,nopdf", "nopic,nopdf:pdf-alias", "nopic:", "novid", "nodet", "nodet,nopic", "novid,nodet"]


@QUERIES.add("""
WITH f(format, nopic, novid, nopdf, nodet, flavour) AS (VALUES ('', FALSE, FALSE, FALSE, FALSE, ''), ('nopic', TRUE, FALSE, FALSE, FALSE, 'nopic'),
  ('nopic:nopic-alias', TRUE, FALSE, FALSE, FALSE, 'nopic-alias'), ('nopic,nopdf', TRUE, FALSE, TRUE, FALSE, 'nopic'), ('nopic,nopdf:pdf-alias', TRUE, FALSE, TRUE, FALSE, 'pdf-alias'),
  ('nopic:', TRUE, FALSE, FALSE, FALSE, ''), ('novid', FALSE, TRUE, FALSE, FALSE, 'novid'), ('nodet', FALSE, FALSE, FALSE, TRUE, 'nodet'),
  ('nodet,nopic', TRUE, FALSE, FALSE, TRUE, 'nopic-nodet'), ('novid,nodet', FALSE, TRUE, FALSE, TRUE, 'nodet'))
SELECT page_id, l.lang_variant, f.* FROM pages, f, (VALUES (''), ('zh-cn')) l(lang_variant)""")
def variant_fanout(spark, sf_dir):
    return ops.fan_out(views.table(spark, sf_dir, "pages").select("page_id"), FORMATS, ["", "zh-cn"])


@QUERIES.add(with_views("pages", body="""
h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'en.wikipedia.org' WHEN 1 THEN host ELSE 'localhost' END AS host, lang FROM v_pages),
p AS (SELECT page_id, host, lang, string_split(host, '.') AS a FROM h),
c AS (SELECT *, CASE WHEN len(a) > 1 AND (a[2] = 'wikipedia' OR length(a[1]) < length(a[2])) THEN a[2] ELSE a[1] END AS n FROM p)
SELECT page_id, upper(n[1:1]) || n[2:] AS creator, CASE WHEN list_contains(a, 'blog') THEN 'blog' ELSE lang END AS lang_label FROM c"""))
def host_creator(spark, sf_dir):
    k = F.col("page_id") % 3
    pages = views.pages(spark, sf_dir).withColumn("host", F.when(k == 0, F.lit("en.wikipedia.org")).when(k == 1, F.col("host")).otherwise(F.lit("localhost")))
    return ops.host_labels(pages, F.col("lang"), F.lit("blog")).select("page_id", "creator", "lang_label")


@QUERIES.add("""
SELECT page_id, v.format FROM pages, (VALUES (''), ('nopic'), ('nodet')) v(format)
WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = page_id AND ((lang <> 'en' AND v.format = 'nopic') OR (lang = 'en' AND v.format = '')))""")
def resume_skip(spark, sf_dir):
    work = ops.fan_out(views.table(spark, sf_dir, "pages").select("page_id"), ["", "nopic", "nodet"]).select("page_id", "format")
    docs = views.table(spark, sf_dir, "documents")
    written = docs.filter("lang <> 'en'").select(F.col("doc_id").alias("page_id"), F.lit("nopic").alias("format")).unionByName(
        docs.filter("lang = 'en'").select(F.col("doc_id").alias("page_id"), F.lit("").alias("format")))
    return ops.still_to_do(work, written, ["page_id", "format"])


LABELS = {
    "en": {"empty": "Empty category", "next": "next page", "files": {"one": "1 file", "other": "n files"}},
    "fr": {"empty": "Catégorie vide", "files": {"other": "n fichiers"}},
    "de": {"next": "nächste Seite"},
}


@QUERIES.add("""
WITH l(lang, key, text) AS (VALUES ('en', 'empty', 'Empty category'), ('en', 'next', 'next page'), ('en', 'files_one', '1 file'), ('en', 'files_other', 'n files'),
  ('fr', 'empty', 'Catégorie vide'), ('fr', 'files_other', 'n fichiers'), ('de', 'next', 'nächste Seite'))
SELECT doc_id, k.key, coalesce(o.text, e.text) AS text FROM documents d CROSS JOIN (VALUES ('empty'), ('next'), ('files_one'), ('files_other')) k(key)
LEFT JOIN l o ON o.lang = d.lang AND o.key = k.key LEFT JOIN l e ON e.lang = 'en' AND e.key = k.key""")
def label_fallback(spark, sf_dir):
    rows = [(lang, key, text) for lang, strings in LABELS.items() for key, text in ops.flatten_plurals(strings).items()]
    labels = small_table(spark, ["lang", "key", "text"], rows)
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ops.localised(docs, labels, ["empty", "next", "files_one", "files_other"]).select("doc_id", "key", "text")
