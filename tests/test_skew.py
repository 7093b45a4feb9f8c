"""The same queries on tables where one key holds a third of all rows, with broadcasts off so that joins shuffle."""

import os

import duckdb
import pytest

from corpusweave.queries import registry
from tools.check import TABLES, compare

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no benchmark tables")

SKEWED = {
    "pages": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN (SELECT url FROM pages WHERE page_id = 0) ELSE url END AS url, "
             "CASE WHEN page_id % 3 = 0 THEN (SELECT html FROM pages WHERE page_id = 0) ELSE html END AS html FROM pages",
    "documents": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM documents WHERE doc_id = 0) ELSE text END AS text, lang, source, n_chars FROM documents",
    "part": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'small ring' ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#2' ELSE p_brand END AS p_brand, "
            "CASE WHEN p_partkey % 3 = 0 THEN 'ECONOMY' ELSE p_type END AS p_type, p_size, p_retailprice FROM part",
    "lineitem": "SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) * FROM (SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_partkey END AS l_partkey, "
                "CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey) FROM lineitem)",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM events",
    "conversations": "SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id END AS conv_id, conv_id * 100 + turn AS turn) FROM conversations",
    "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_nationkey END AS c_nationkey) FROM customer",
}
QUERIES = [
    "merge_continuations", "merge_continuation_items", "merge_continuation_objects", "select_by_title", "select_by_namespace", "catalogue_upsert", "main_page_check",
    "redirect_explode", "redirect_moved", "move_log_lookup", "redirect_admit", "redirect_report", "category_closure", "member_restrict", "member_counts", "member_pages",
    "member_groups", "member_partials", "page_category_list", "category_flags", "link_resolve", "link_fanin", "asset_refs", "asset_req_width", "asset_dedup", "video_source",
    "audio_source", "host_rollup", "module_edges", "module_union", "module_minus_css", "resume_skip", "failure_survivors", "attempt_outcome", "cursor_cycles",
    "stall_sessions", "entry_manifest", "entry_stats", "index_path", "index_select", "stream_ingest",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SOURCE}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"COPY ({SKEWED.get(t, f'SELECT * FROM {t}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, out


@pytest.fixture(scope="module")
def shuffling(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_skewed_tables(shuffling, skewed, name):
    folder, con = skewed
    query = registry()[name]
    result = compare(query.build(shuffling, folder), con.sql(query.sql))
    assert result.startswith("ok"), result
