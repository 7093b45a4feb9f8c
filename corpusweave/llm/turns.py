"""Repair of conversation structure at the least cost, by a checkpointed dynamic program.

Rows of a conversation stand in the order of their turns. A conversation is in order if its role initials are ``(s?(ua)+)?``, which an automaton of four states
reads: nothing yet, after s, after u, after a. Edits: Keep (0), Rerole to user or assistant (2), Delete (3), Insert an empty user or assistant (2); a kept or
reroled truncated row costs 1 more; blank and repeated rows can only be deleted. Of all cheapest lists of edits the ASCII-least is taken.

A conversation of n rows is cut into blocks of about sqrt(n). Backward state-cost vectors, the least cost from each state to the end, are stored only where blocks meet:

1. each block, on its own, gives the least cost from each state before it to each state after it (a 4 x 4 min-plus matrix);
2. the matrices of one conversation, about sqrt(n) of them, are combined from the end, which gives the vector at the end of each block;
3. each block computes its own backward vectors anew from that one, and walks forward over tight edits (those whose cost is the difference of
   the vectors), once for each state it may be entered in;
4. the entry states follow from block to block, and select one of the four walks.

So a conversation that holds a third of all rows is worked on by as many tasks as it has blocks, and no task holds more than about sqrt(n) of its rows.
The texts take no part in this: a row is one letter. Only the SHA-256 of the repaired text, which is sequential by nature, passes over a conversation's
texts in one task, as a stream that holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.llm.rows import map_documents, slices
from corpusweave.plans.ranks import rank_in_group
from corpusweave.session import cut

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: What may follow in a state: role initial -> next state.
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Least cost to a good end when no row is left.
AT_END = (0, 4, 2, 0)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The role that Rerole and Insert give in a state, and the state after it.
GIVEN = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
FAR = 1 << 60
SPACES = " \t\n\v\f\r"

# ---- costs: a row is one letter for its role initial (s, u, a, other: x), in upper case if it is truncated, or "-" if it can only be deleted


def inserted(vector: list[int]) -> list[int]:
    """Least costs when turns may be inserted first. From any state two inserts lead round to the same kind of state, so three rounds settle it."""
    out = list(vector)
    for _ in range(3):
        for q in STATES:
            out[q] = min(out[q], INSERT + out[GIVEN[q][1]])
    return out


def before(letter: str, vector: list[int]) -> list[int]:
    """The vector in front of a row from the one after it."""
    out = [DELETE + v for v in vector]
    if letter != "-":
        more = TRUNCATED if letter.isupper() else 0
        for q in STATES:
            kept = NEXT[q].get(letter.lower())
            out[q] = min(out[q], more + REROLE + vector[GIVEN[q][1]], FAR if kept is None else more + vector[kept])
    return inserted(out)


def matrix(letters: str) -> list[int]:
    """Least cost from each state before the rows to each state after them; row by row. Inserts behind the last row belong to what follows."""
    columns = []
    for goal in STATES:
        vector = [0 if q == goal else FAR for q in STATES]
        for letter in reversed(letters):
            vector = before(letter, vector)
        columns.append(vector)
    return [min(columns[goal][q], FAR) for q in STATES for goal in STATES]


def walk(letters: str, end: list[int], last: bool) -> tuple[list[list[str]], list[int]]:
    """For each entry state: the edits of each row (inserts before it, and its own; after the last row of all also those that follow), and the state after."""
    vectors = [end]
    for letter in reversed(letters):
        vectors.append(before(letter, vectors[-1]))
    vectors.reverse()
    edits, states = [], []
    for entry in STATES:
        q, found = entry, []
        for i, letter in enumerate(letters):
            here, after, done = vectors[i], vectors[i + 1], ""
            more = TRUNCATED if letter.isupper() else 0
            while True:
                given = GIVEN[q][1]
                kept = NEXT[q].get(letter.lower()) if letter != "-" else None
                if DELETE + after[q] == here[q]:
                    done += "D"
                elif INSERT + here[given] == here[q]:
                    done, q = done + "I", given
                    continue
                elif kept is not None and more + after[kept] == here[q]:
                    done, q = done + "K", kept
                else:
                    done, q = done + "R", given
                break
            found.append(done)
        if last:
            tail = ""
            while AT_END[q]:
                tail, q = tail + "I", GIVEN[q][1]
            found.append(tail)
        edits.append(found)
        states.append(q)
    return edits, states


# ---- rows

def damaged(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, fate of all rows, with the damage that ``fate``, a crc32 of their place, does to them; fate 3 stands twice. Nulls
    become one space, but for turns, which keep their place in front of all others. ``conv`` is the id as text."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    given = rows.select(as_text[0].alias("conv"), "conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")),
                        (F.crc32(F.concat_ws(":", *as_text).cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return given.select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(
        F.when(F.col("fate") == 0, F.array().cast("array<int>")).when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` in order: rank and total in the conversation, and the first fault of each. Rows of one turn are ordered by role, then text."""
    ranked = cut(rank_in_group(rows, ["conv"], ["turn", "role", "text", "copy"], total="total"))
    same = ["conv", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role").alias("h2")]
    seen = ranked.select(*same, "rank").groupBy("conv", "h1", "h2").agg(F.min("rank").alias("first"))
    words = F.rtrim(F.translate("text", SPACES, " " * len(SPACES)))
    fault = (F.when(words == "", "blank").when(F.col("rank") > F.col("first"), "duplicate").when(~F.right(words, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return ranked.select("*", *same[1:]).join(seen, ["conv", "h1", "h2"]).select(*ranked.columns, fault.alias("fault"))


def letter() -> Column:
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


def edits_of(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with conv, rank, total and letter: (conv, block, first, edits, state: the edits of each row of a block and the state before its first), and (conv, cost)."""
    size = F.ceil(F.sqrt("total")).cast("long")
    blocks = marked.select("conv", "rank", "letter", size.alias("size"), F.floor((F.col("rank") - 1) / size).alias("block"))
    letters = F.array_join(F.sort_array(F.collect_list(F.struct("rank", "letter")))["letter"], "")
    blocks = cut(blocks.groupBy("conv", "block").agg(letters.alias("letters"), F.min("rank").alias("first")))

    with_costs = map_documents(blocks, ["conv", "block", "letters"], pa.schema([("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))]),
                               lambda: lambda conv, block, letters: [(conv, block, matrix(letters))])
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("end", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())])

    def backward(conv, numbers, costs):
        vector, out = list(AT_END), []
        for i, table in reversed(list(zip(numbers, costs, strict=True))):
            out.append((conv, i, vector, i == numbers[-1]))
            vector = inserted([min(table[4 * q + goal] + vector[goal] for goal in STATES) for q in STATES])
        return [(*row, vector[NOTHING]) for row in out]

    chain = with_costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("all"))
    ends = map_documents(chain, ["conv", F.col("all.block"), F.col("all.costs")], schema, lambda: backward)

    kinds = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("edits", pa.list_(pa.list_(pa.string()))), ("states", pa.list_(pa.int64())), ("cost", pa.int64())])

    def forward(conv, block, first, letters, end, last, cost):
        return [(conv, block, first, *walk(letters, end, last), cost)]

    walked = cut(map_documents(blocks.join(ends, ["conv", "block"]), ["conv", "block", "first", "letters", "end", "last", "cost"], kinds, lambda: forward))

    def follow(conv, numbers, states):
        q, out = NOTHING, []
        for i, after in zip(numbers, states, strict=True):
            out.append((conv, i, q))
            q = after[q]
        return out

    chain = walked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "states"))).alias("all"))
    entries = map_documents(chain, ["conv", F.col("all.block"), F.col("all.states")], pa.schema([("conv", pa.string()), ("block", pa.int64()), ("state", pa.int64())]), lambda: follow)
    chosen = walked.join(entries, ["conv", "block"]).select("conv", "block", "first", F.col("edits")[F.col("state")].alias("edits"), "state")
    return cut(chosen), walked.select("conv", "cost").distinct()


def repaired_texts(ordered_rows: DataFrame) -> DataFrame:
    """conv, repaired_sha256 from conv, rank, kind, role, text, edits, sorted by these: the edits of a row come right before it (kind 0 and 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, started, state, edits, done = None, None, False, NOTHING, "", []

        def add(role: str, text: str) -> None:
            nonlocal started
            digest.update(f"{chr(10) if started else ''}{role}:{text}".encode())
            started = True

        def finish() -> None:
            if conv is not None:
                done.append((conv, digest.hexdigest()))

        for values in slices(batches):
            for name, kind, role, text, given in zip(*values, strict=True):
                if name != conv:
                    finish()
                    conv, digest, started, state = name, hashlib.sha256(), False, NOTHING
                if kind == 0:
                    edits = given
                    for edit in edits:
                        if edit != "I":
                            break
                        add(GIVEN[state][0], "")
                        state = GIVEN[state][1]
                elif edits[-1] == "K":
                    add(role, text)
                    state = NEXT[state][role[0]]
                elif edits[-1] == "R":
                    add(GIVEN[state][0], text)
                    state = GIVEN[state][1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["conv", "repaired_sha256"])
                done = []
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["conv", "repaired_sha256"])

    return ordered_rows.select("conv", "kind", "role", "text", "edits").mapInArrow(work, "conv string, repaired_sha256 string")


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``conversations[conv_id, turn, role, text]`` after damage.

    Rows without an id are one conversation. One whose rows are all gone has zeros, an empty audit and the hash of nothing. Any role may occur; only
    those that begin with s, u or a can be kept.
    """
    marked = cut(faults(damaged(conversations)).withColumn("letter", letter()))
    blocks, costs = edits_of(marked.select("conv", "rank", "total", "letter"))

    # neighbours: windows of a block, and its first row against the last one of the block before
    size = F.ceil(F.sqrt("total")).cast("long")
    initials = marked.select("conv", "rank", F.left("role", F.lit(1)).alias("initial"), F.floor((F.col("rank") - 1) / size).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("rank")
    pairs = initials.select("conv", "block", F.concat(F.lag("initial").over(inside), "initial").alias("pair"))
    edges = initials.groupBy("conv", "block").agg(F.min_by("initial", "rank").alias("first"), F.max_by("initial", "rank").alias("last"))
    between = edges.select("conv", "block", F.concat(F.lag("last").over(Window.partitionBy("conv").orderBy("block")), "first").alias("pair"))
    illegal = pairs.union(between).groupBy("conv").agg(F.count_if(~F.col("pair").isin("su", "ua", "au")).alias("illegal"))

    counts = marked.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))

    each = blocks.select("conv", F.posexplode("edits").alias("at", "edits"), "first").select("conv", (F.col("first") + F.col("at")).alias("rank"), F.lit(0).alias("kind"),
                                                                                            F.lit("").alias("role"), F.lit("").alias("text"), "edits")
    rows = marked.select("conv", "rank", F.lit(1).alias("kind"), "role", "text", F.lit("").alias("edits"))
    in_order = each.union(rows).repartition("conv").sortWithinPartitions("conv", "rank", "kind")
    audits = blocks.groupBy("conv").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", F.array_join("edits", "").alias("part"))))["part"], "").alias("audit"))

    found = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    for more in (counts, illegal, costs, audits, repaired_texts(in_order)):
        found = found.join(more, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
