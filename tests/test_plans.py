"""Plan helpers against plain Python, with one group holding most of the rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusweave.functions.urls import Site
from corpusweave.operators import assets, content
from corpusweave.plans import closure, intervals, keyed, layout, ranks
from corpusweave.queries import registry
from corpusweave.session import shared_folder, small_table
from corpusweave.sources import html_tokens, wiki_html


def hot_rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", rng.randrange(50), i) for i in range(n)]


def test_rank_in_group_with_a_hot_group(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {(r.g, r.id): (r.rank, r.n) for r in ranks.rank_in_group(df, ["g"], ["v", "id"], total="n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        want.update({(g, r[2]): (i + 1, len(members)) for i, r in enumerate(members)})
    assert got == want


def test_rank_spreads_the_hot_group(spark):
    # at this size Spark would join the pieces again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([("hot", i) for i in range(4000)], "g string, id int").repartition(8)
        with_parts = ranks.rank_in_group(df, ["g"], ["id"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in with_parts.groupBy("p").count().collect()]
        assert len(sizes) > 2 and max(sizes) < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_of_everything(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    assert sorted((r.v, r.rank) for r in ranks.rank_in_group(df, [], ["v"]).collect()) == [(i, i + 1) for i in range(101)]


def test_best_per_key_ignores_row_order(spark):
    rows = hot_rows()
    want = {}
    for g, v, i in rows:
        want[g] = max(want.get(g, (-1, -1)), (v, i))
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "g string, v int, id int").repartition(parts, "id")
        got = {r.g: (r.v, r.id) for r in keyed.best_per_key(df, ["g"], [F.col("v"), F.col("id")]).collect()}
        assert got == want


def test_reach_ends_on_cycles_and_ignores(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "title string")
    assert {r.title for r in closure.reach(seeds, edges, "title").collect()} == set("abcde")
    ignored = spark.createDataFrame([("d",)], "title string")
    assert {r.title for r in closure.reach(seeds, edges, "title", ignored).collect()} == set("abc")


def test_a_long_chain_takes_as_many_rounds_as_it_crosses_blocks(spark):
    edges = spark.range(5000).selectExpr("format_string('n%05d', id) AS src", "format_string('n%05d', id + 1) AS dst").repartition(5)
    seeds = spark.createDataFrame([("n00000",), ("nowhere",)], "title string")
    whole = closure.reach(seeds, edges, "title")
    assert whole.count() == 5002 and whole.agg(F.max("round")).first()[0] == 1
    parted = closure.reach(seeds, edges, "title", block=1000)
    assert parted.distinct().count() == parted.count() == 5002 and parted.agg(F.max("round")).first()[0] <= 6


@pytest.mark.parametrize("block", [7, 60, 10_000])
def test_reach_over_blocks_against_plain_search(spark, block):
    # a hub with a third of all edges, which lies in several blocks; repeated edges, cycles, edges without an end
    rng = random.Random(block)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(110)] + [(5, i) for i in range(100, 160)] + [(159, 1), (1, 5), (3, 3), (None, 4), (6, None)] + [(7, 8)] * 50
    ignored, seeds = {104, 130, 9}, [5, 9, 200, 5]
    seen, ahead = {5, 200}, [5, 200]
    while ahead:
        node = ahead.pop()
        for src, dst in edges:
            if src == node and dst is not None and dst not in seen | ignored:
                seen.add(dst)
                ahead.append(dst)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = closure.reach(spark.createDataFrame([(s,) for s in seeds], "id long"), df, "id", spark.createDataFrame([(i,) for i in ignored], "id long"), block)
    assert sorted(r.id for r in got.collect()) == sorted(seen)
    assert closure.reach(spark.createDataFrame([(1,)], "id long"), df.limit(0), "id").count() == 1


def depth_first(edges, root):
    order, seen = [], set()

    def visit(node):
        if node in seen:
            return
        seen.add(node)
        order.append(node)
        for _, dst in sorted((p, d) for s, p, d in edges if s == node):
            visit(dst)

    visit(root)
    return order


@pytest.mark.parametrize("seed", range(3))
def test_first_positions_is_depth_first_order(spark, seed):
    rng = random.Random(seed)
    # diamonds, shared targets and cycles
    edges = [(s, p, rng.randrange(9)) for s in range(9) for p in range(rng.randrange(4))]
    df = spark.createDataFrame(edges or [(0, 0, 0)], "src int, pos int, dst int")
    roots = spark.createDataFrame([(0,), (4,)], "root int")
    rows = closure.first_positions(roots, df).collect()
    for root in (0, 4):
        placed = sorted((list(r.place), r.node) for r in rows if r.root == root)
        assert [node for _, node in placed] == depth_first(edges, root)


HTML = "<div class='a'><p>one<b>two</b></p><div class='x'><p>in<span></span></p></div></div><p>last</p>"


def tokens_of(spark, html):
    return html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))


def test_drop_subtrees_leaves_balanced_markup(spark):
    left = intervals.drop_subtrees(tokens_of(spark, HTML), F.array_contains(html_tokens.css_classes(), "x"))
    assert html_tokens.serialise(left).first().html == '<div class="a"><p>one<b>two</b></p></div><p>last</p>'


def test_unwrap_keeps_content(spark):
    left = intervals.unwrap_elements(tokens_of(spark, HTML), F.col("tag").isin("b", "p"))
    assert html_tokens.serialise(left).first().html == '<div class="a">onetwo<div class="x">in<span></span></div></div>last'


def test_next_hit_of_each_element(spark):
    tokens = tokens_of(spark, "<ul><li><b>x</b></li><li></li></ul><b>y</b>")
    found = intervals.with_next(tokens, "n", intervals.is_start("b")).withColumn("held", intervals.followed_inside("n"))
    assert [(r.tag, r.held) for r in found.filter("kind = 'start'").orderBy("seq").collect()] == [("ul", True), ("li", True), ("b", False), ("li", False), ("b", False)]


def test_boxes_without_content_are_found_with_one_sort(spark):
    tokens = tokens_of(spark, HTML)
    for step in (content.remove_empty_frames, content.remove_linkless, content.remove_empty_galleries):
        assert step(tokens)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_sections_take_two_sorts(spark):
    assert sorts(content.remove_empty_sections(tokens_of(spark, HTML))) == 2  # by element twice: 3


def test_reference_spans_and_map_links_take_two_sorts(spark):
    assert sorts(content.globe_map_links(content.reference_spans(tokens_of(spark, HTML)))) == 2  # in turns by element and by number: 4


def test_language_sections_take_three_sorts(spark):
    assert sorts(content.keep_language_section(tokens_of(spark, HTML), "fr")) == 3  # 7, all of which a task holds memory for


def test_lines_are_not_split_for_counting_words(spark, tmp_path):
    rows = [(i, text, "en") for i, text in enumerate(["a b c", "a b c d\na  b \n\na b", "a b c ", ""])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = wiki_html.wiki_pages(spark, str(tmp_path), ["<hr>"])
    assert 'split(lambda' not in pages._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.page_id, r.html.count("<hr>")) for r in pages.orderBy("page_id").collect()] == [(0, 0), (1, 2), (2, 1), (3, 0)]


def test_tags_without_attributes_need_no_lambda(column):
    tag = html_tokens.markup(F.lit("start"), F.lit("p"), F.col("a"), F.lit(None).cast("string"))
    assert column([({},), ({"b": 'c"'},), (None,)], "a map<string,string>", tag) == ["<p>", '<p b="c&quot;">', None]


def test_children_are_told_from_what_lies_deeper(spark):
    tokens = tokens_of(spark, "<ul><li><ul><b>x</b></ul></li></ul><ul><b>y</b></ul><ul></ul><b>z</b>")
    tokens = tokens.union(tokens)  # a page may come twice
    found = intervals.with_child(tokens, "held", intervals.is_start("b")).filter("kind = 'start' AND tag = 'ul'").orderBy("seq")
    assert [r.held for r in found.collect()] == [False, False, True, True, True, True, False, False]


def test_files_are_sought_among_few_tokens(spark):
    tokens = tokens_of(spark, '<p>a<video poster="/p.png"><source src="/a.webm"></video></p><p>b</p>')
    site = Site(origin="https://en.wikipedia.org")
    plan = assets.media_sources(tokens, site)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rstrip().split("MapInArrow")[0].rstrip(" +-\n").split("\n")[-1].lstrip(" +-").startswith("Filter")  # before any window
    assert assets.file_elements(tokens).count() == 2
    assert [(r.url, r.seq) for r in assets.media_sources(tokens, site).collect()] == [("https://en.wikipedia.org/a.webm", 2)]


def test_urls_of_media_and_frames_are_resolved_once(spark):
    site = Site(origin="https://en.wikipedia.org")
    media = content.media_attributes(tokens_of(spark, HTML), site, F.lit("A/b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in media  # lost images are no rows to begin with; a filter would look for every path a second time
    frame = tokens_of(spark, HTML).select(content.iframe_parts(F.col("attrs")["src"], site))._jdf.queryExecution().optimizedPlan().toString()
    assert frame.count("[src], (?s)") <= 2  # once for each thing asked of it: 52


def test_count_inside_and_nearest(spark):
    tokens = tokens_of(spark, "<ul><li><ul><li>x</li><li>y</li></ul></li><li>z</li></ul>")
    text = F.col("kind") == "text"
    inside = intervals.count_inside(tokens, {"n": text}).filter("kind = 'start' AND tag = 'ul'").orderBy("seq")
    nearest = intervals.count_nearest(tokens, "ul", text, "n").filter("kind = 'start' AND tag = 'ul'").orderBy("seq")
    assert [r.n for r in inside.collect()] == [3, 2]
    assert [r.n for r in nearest.collect()] == [1, 2]


def test_bucketed_tokens_are_cleaned_without_a_shuffle(spark, tmp_path):
    pages = spark.createDataFrame([(i, HTML) for i in range(40)], "page_id int, html string")
    table = layout.write_by_key(html_tokens.tokenize(pages), "tokens_by_page", str(tmp_path / "tokens"), "page_id", "seq", 4)
    cleaned = html_tokens.serialise(content.remove_empty_galleries(content.remove_linkless(table)))
    assert "Exchange" not in cleaned._jdf.queryExecution().executedPlan().toString()
    assert cleaned.count() == 40
    spark.sql("DROP TABLE tokens_by_page")


def test_spread_leaves_shuffled_and_split_input_alone(spark):
    split = spark.range(100, numPartitions=64)
    assert layout.spread(split) is split
    shuffled = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    assert layout.spread(shuffled) is shuffled
    assert layout.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_folder_is_read_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)


# query -> at most so many scans of landed tables; intermediate tables that a query writes itself count too
SCANS = {
    "index_select": 0, "redirect_route": 0, "redirect_admit": 0, "redirect_report": 0, "redirect_moved": 0, "progress_steps": 0, "link_media": 1, "page_list_intake": 1,
    "filter_ignored": 4, "hook_transform": 1, "hook_language": 1, "empty_sections": 1, "clean_gallery": 1, "link_rewrite": 4, "render_pages": 4, "css_text": 3,
}


def test_a_rank_shuffles_its_rows_once(spark):
    """Ranges are the one shuffle; the finished ranks join a broadcast table of at most one row per partition, without an exchange of the rows."""
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 7}", i % 11, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(6)
    ranked = ranks.rank_in_group(df, ["g"], ["v", "id"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange" not in plan.split("BroadcastExchange")[0]
    want = {}
    for g, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(g, []).append((v, i))
    assert {(r.g, r.id): r.rank for r in ranked.collect()} == {(g, i): n for g, order in want.items() for n, (_, i) in enumerate(order, 1)}
    assert ranks.rank_in_group(df.filter("id < 0"), ["g"], ["id"], total="n").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no benchmark tables")
@pytest.mark.parametrize("name", SCANS)
def test_tables_are_read_no_oftener_than_needed(spark, name):
    """What is used several times is computed once and kept (``session.cut``); HTML is parsed once, and tokens are shuffled by page."""
    plan = registry()[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= SCANS[name] and plan.count("MapInArrow") <= 1
    if name in ("hook_transform", "hook_language", "empty_sections", "clean_gallery"):
        assert plan.count("Exchange hashpartitioning") == 1


def test_lookup_takes_nested_maps_and_splits_a_hot_key_of_equal_rows(spark):
    rows = spark.range(200_000).selectExpr("'hot' AS k", "struct(map('a', 1) AS m) AS v").union(spark.range(100).selectExpr("cast(id AS string)", "struct(map('a', 2) AS m)"))
    table = spark.range(3000).selectExpr("cast(id AS string) AS k", "id AS n").union(spark.range(1).selectExpr("'hot'", "-1L"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = keyed.lookup(rows.repartition(8), table, ["k"])
        assert joined.filter("n = -1").count() == 200_000 and joined.filter("n IS NULL").count() == 0
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
