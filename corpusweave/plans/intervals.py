"""Work on nested intervals: an element is the token range [seq, end_seq] of its page.

All windows are partitioned by the page, that is, by one input document, and the second kind by page and
element, which the same partitioning serves: a chain of these steps shuffles the tokens once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# places are levels of so many token numbers
LEVEL = 1 << 32


def _running(key: str) -> Window:
    return Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def is_start(*tags: str) -> Column:
    start = F.col("kind") == "start"
    return start & F.col("tag").isin(*tags) if tags else start


@dataclass(frozen=True)
class Drop:
    """What was dropped from ``tokens`` last. It stays with the result, so that a drop or a running value that comes next shares its pass over the page."""

    tokens: DataFrame
    key: str
    hidden: tuple[Column, ...]  # per token the number up to which it is hidden
    removed: Column | None  # starts of elements that go
    helpers: tuple[str, ...]  # columns that only the conditions need

    def result(self, values: Mapping[str, Column] | None = None) -> DataFrame:
        window = _running(self.key)
        ends = [*self.hidden, *([] if self.removed is None else [F.max(F.when(is_start() & self.removed, F.col("end_seq"))).over(window)])]
        names = [f"__to{i}" for i in range(len(ends))]
        staged = self.tokens.withColumns(dict(zip(names, ends)) | {n: v.over(window) for n, v in (values or {}).items()})
        kept = staged.filter(" AND ".join(f"({n} IS NULL OR {n} < seq)" for n in names)) if names else staged
        out = kept.drop(*names, *self.helpers)
        if not values:
            out._last_drop = self  # a fact about this very result: whatever is made of it by other ways is without
        return out


def _last_drop(tokens: DataFrame, key: str) -> Drop:
    last = vars(tokens).get("_last_drop")
    return last if last is not None and last.key == key else Drop(tokens, key, (), None, ())


def drop_subtrees(tokens: DataFrame, removed: Column, key: str = "page_id", helpers: tuple[str, ...] = ()) -> DataFrame:
    """Drop every element whose start token satisfies ``removed``, with all it contains, and columns that only this condition needs.

    Drops that follow one another are one pass: what lies in an element that goes has no say in the order either way.
    """
    last = _last_drop(tokens, key)
    return replace(last, removed=removed if last.removed is None else last.removed | removed, helpers=(*last.helpers, *helpers)).result()


def drop_first(tokens: DataFrame, chosen: Sequence[Column], key: str = "page_id") -> DataFrame:
    """Drop, for each of these conditions, the first element of each page whose start token satisfies it."""
    firsts = tuple(F.min(F.when(is_start() & c, F.struct("seq", "end_seq"))).over(_running(key))["end_seq"] for c in chosen)
    return Drop(tokens, key, firsts, None, ()).result()


def with_running(tokens: DataFrame, values: Mapping[str, Column], key: str = "page_id") -> DataFrame:
    """Adds aggregates over the tokens from the page's start up to each one; right after a drop they take no pass of their own.

    They see what is dropped there too, so they must be such that elements which are over don't matter.
    """
    return _last_drop(tokens, key).result(values)


def before_drops(tokens: DataFrame, name: str, key: str = "page_id") -> DataFrame:
    """``tokens`` before the drops that were last, which ``name`` marks for a later drop: for steps that undo the order of the tokens."""
    last = _last_drop(tokens, key)
    if last.hidden:
        return tokens.withColumn(name, F.lit(False))
    gone = F.lit(False) if last.removed is None else F.coalesce(last.removed, F.lit(False))
    return last.tokens.withColumn(name, gone).drop(*last.helpers)


def of_element(chosen: Column, key: str = "page_id") -> Column:
    """Whether a token is the start or end of an element whose start token satisfies ``chosen``."""
    flag = F.max(F.when(is_start() & chosen, 1).otherwise(0)).over(Window.partitionBy(key, "elem_id"))
    return (flag == 1) & F.col("elem_id").isNotNull()


def count_inside(tokens: DataFrame, hits: Mapping[str, Column], key: str = "page_id") -> DataFrame:
    """Adds to each element's tokens, per entry of ``hits``, the number of satisfying tokens strictly inside it (null elsewhere)."""
    element = Window.partitionBy(key, "elem_id")
    runs = {f"__run_{name}": F.sum(F.when(hit, 1).otherwise(0)).over(_running(key)) for name, hit in hits.items()}
    counts = {name: F.when(F.col("elem_id").isNotNull(), F.max(f"__run_{name}").over(element) - F.min(f"__run_{name}").over(element)) for name in hits}
    return tokens.withColumns(runs).withColumns(counts).drop(*runs)


def with_next(tokens: DataFrame, name: str, hit: Column, key: str = "page_id") -> DataFrame:
    """Adds the number of the next token after each that satisfies ``hit``, null if none does. It runs in the order of ``drop_subtrees``, so both share one sort."""
    following = F.expr(f"lead(`{name}`) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY seq)")
    return tokens.withColumn(name, F.when(hit, F.col("seq"))).withColumn(name, following)


def followed_inside(following: str) -> Column:
    """Whether an element, seen at its start token, holds the token whose number ``with_next`` gave."""
    return F.coalesce(F.col(following) <= F.col("end_seq"), F.lit(False))


def with_child(tokens: DataFrame, name: str, hit: Column, key: str = "page_id") -> DataFrame:
    """Adds whether an element, seen at its start token, has a satisfying start token among its children (of no meaning on other tokens).

    A child lies one level below its element. So, by level and number, the first hit a whole level or more on is the first child, or beyond the element's end.
    """
    place = F.col("depth").cast("long") * LEVEL + F.col("seq")
    # from the last token to the first, so that the window grows and is not gone through anew for each token
    further = Window.partitionBy(key).orderBy(F.desc("__place")).rangeBetween(Window.unboundedPreceding, -LEVEL)
    placed = tokens.withColumn("__place", place).withColumn(name, F.min(F.when(hit, F.col("__place"))).over(further))
    end = (F.col("depth").cast("long") + 1) * LEVEL + F.col("end_seq")
    return placed.withColumn(name, F.coalesce(F.col(name) <= end, F.lit(False))).drop("__place")


def count_nearest(tokens: DataFrame, tag: str, hit: Column, name: str, key: str = "page_id") -> DataFrame:
    """Like ``count_inside`` for ``tag`` elements, but a token counts only for the nearest one around it.

    The nesting level of ``tag`` at a token names that element: inside one element, all tokens of its own
    level are its own, and the next end of its level is its end. Two sorts, the second of which is that of most other steps.
    """
    started, ended = is_start(tag), (F.col("kind") == "end") & (F.col("tag") == tag)
    step = F.when(started, 1).when(ended, -1).otherwise(0)
    levelled = tokens.withColumn("__level", F.sum(step).over(_running(key)) + F.when(ended, 1).otherwise(0))
    level = Window.partitionBy(key, "__level").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = levelled.withColumn("__run", F.sum(F.when(hit, 1).otherwise(0)).over(level))
    own = f"IGNORE NULLS OVER (PARTITION BY `{key}`, `__level` ORDER BY seq)"
    paired = counted.withColumns({"__low": F.when(started, F.col("__run")), "__high": F.when(ended, F.col("__run"))}).withColumns({
        "__low": F.when(started, F.col("__run")).otherwise(F.expr(f"lag(`__low`) {own}")),
        "__high": F.when(ended, F.col("__run")).otherwise(F.expr(f"lead(`__high`) {own}"))})
    # rows of one number are one element, also where a page comes several times, whose copies then lie on levels of their own
    same = Window.partitionBy(key).orderBy("seq").rangeBetween(Window.currentRow, Window.currentRow)
    inside = F.max("__high").over(same) - F.min("__low").over(same)
    return paired.withColumn(name, F.when((started | ended) & F.col("elem_id").isNotNull(), inside)).drop("__run", "__level", "__low", "__high")


def unwrap_elements(tokens: DataFrame, chosen: Column, key: str = "page_id") -> DataFrame:
    """Drop the start and end token of chosen elements and keep their content."""
    element = Window.partitionBy(key, "elem_id")
    flag = F.max(F.when(is_start() & chosen, 1).otherwise(0)).over(element)
    return tokens.withColumn("__unwrap", flag).filter("elem_id IS NULL OR __unwrap = 0").drop("__unwrap")
