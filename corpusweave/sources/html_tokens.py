"""HTML to a token table, the form every content operator works on.

Each element is an interval [seq, end_seq] of its page's token numbers, so a subtree is a range of
numbers. The parse (``html_tree``) is one Arrow-batched pass over the pages; everything after it is relational.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.plans.layout import spread
from corpusweave.sources.html_tree import VOID, Tokens

TOKEN_COLUMNS = ("seq int, kind string, elem_id int, parent_id int, tag string, attrs map<string,string>, "
                 "text string, depth int, end_seq int")

# rows held before a batch is handed on; a batch exceeds it by at most one page
BATCH_ROWS = 20000

def tokenize(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key plus the token columns, one row per start tag, end tag, text run, comment or doctype."""
    key_type = pages.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, {TOKEN_COLUMNS}"
    key_arrow = pa.int64() if key_type == "bigint" else pa.int32() if key_type == "int" else pa.string()
    names = [part.strip().split(" ")[0] for part in (key, "seq", "kind", "elem_id", "parent_id", "tag", "attrs", "text", "depth", "end_seq")]

    def batch(tokens: Tokens, keys: list, seqs: list[int]) -> pa.RecordBatch:
        kinds, elements, parents, tags, begins, attr_names, attr_values, texts, depths, ends = tokens.lists
        begins.append(len(attr_names))
        attrs = pa.MapArray.from_arrays(pa.array(begins, pa.int32()), pa.array(attr_names, pa.string()), pa.array(attr_values, pa.string()))
        ints = [pa.array(column, pa.int32()) for column in (seqs, elements, parents, depths, ends)]
        kind, tag, text = (pa.array(column, pa.string()) for column in (kinds, tags, texts))
        return pa.RecordBatch.from_arrays([pa.array(keys, key_arrow), ints[0], kind, *ints[1:3], tag, attrs, text, *ints[3:]], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, seqs = Tokens(), [], []
        for incoming in batches:
            for page, body in zip(incoming.column(0).to_pylist(), incoming.column(1).to_pylist()):
                if body is None:
                    continue
                n = tokens.add(body)
                keys += [page] * n
                seqs += range(n)
                if len(tokens) > BATCH_ROWS:
                    yield batch(tokens, keys, seqs)
                    tokens, keys, seqs = Tokens(), [], []
        if len(tokens):
            yield batch(tokens, keys, seqs)

    return spread(pages.select(key, html)).mapInArrow(with_rare_collections(parse), schema)


def with_rare_collections(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work``, while which Python looks for cycles less often: it would go through all rows of a batch again and again, which hold none."""

    def steadily(batches: Iterator) -> Iterator:
        before = gc.get_threshold()
        gc.set_threshold(200_000, *before[1:])
        try:
            yield from work(batches)
        finally:
            gc.set_threshold(*before)

    return steadily


def tokenize_to_table(pages: DataFrame, path: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """``tokenize`` written to ``path`` and read again: a chain of steps over it parses no page a second time."""
    tokenize(pages, key, html).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def css_classes(attrs: Column | str = "attrs") -> Column:
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), lambda w: w != "")


def markup(kind: Column, tag: Column, attrs: Column, text: Column) -> Column:
    """A token written back as HTML."""
    void = tag.isin(*sorted(VOID))

    def quoted(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))

    pairs = F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), quoted(e["value"]), F.lit('"')))
    # most elements have no attributes, and lambdas are run row by row outside generated code
    opening = F.when(F.size(attrs) == 0, F.concat(F.lit("<"), tag, F.lit(">"))).otherwise(F.concat(F.lit("<"), tag, F.array_join(pairs, ""), F.lit(">")))
    return (
        F.when(kind == "start", opening)
        .when((kind == "end") & ~void, F.concat(F.lit("</"), tag, F.lit(">")))
        .when(kind == "text", text)
        .when(kind == "comment", F.concat(F.lit("<!--"), text, F.lit("-->")))
        .when(kind == "decl", F.concat(F.lit("<!"), text, F.lit(">")))
        .otherwise(F.lit(""))
    )


def serialise(tokens: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, html: the tokens of each page put together again; a page is one input document, so its list is as long as that."""
    piece = markup(F.col("kind"), F.col("tag"), F.col("attrs"), F.col("text"))
    # sorted without a comparator of lambdas, which is run row by row outside generated code
    pieces = F.sort_array(F.collect_list(F.struct("seq", piece.alias("piece"))))
    return tokens.groupBy(key).agg(F.array_join(pieces["piece"], "").alias(html))


def runs(batches: Iterable[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with the ends of runs of equal values in column ``at``. A run is given as a whole, so the last one of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []  # of one run

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column(at)).run_ends.to_numpy()
        if held and held[-1].column(at)[0] != batch.column(at)[0]:
            yield whole(held), np.array([sum(b.num_rows for b in held)])
            held = []
        if len(ends) == 1:
            held.append(batch)
            continue
        if held:
            yield whole([*held, batch.slice(0, ends[0])]), np.array([sum(b.num_rows for b in held) + ends[0]])
            begin = ends[0]
        else:
            begin = 0
        if begin < ends[-2]:
            yield batch.slice(begin, ends[-2] - begin), ends[ends > begin][:-1] - begin
        held = [batch.slice(ends[-2])]
    if held:
        yield whole(held), np.array([sum(b.num_rows for b in held)])
