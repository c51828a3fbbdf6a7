"""Chat formatting by quotation linking.

A message's lines carry nested quote levels (``>`` marks). Runs of lines of one
level are cut into passages at blank lines; a passage is normalised (case and
blanks) and hashed. What a message says itself, whole and by paragraph and
line, is hashed the same way, but only hashes that are quoted somewhere travel.
A quoted passage belongs to the first message of its own conversation that said
it, if that is an earlier turn, or else to the first message of all that said
it, if that comes earlier by (conversation, turn) and the passage has
``FAR_WORDS`` words or more: a mere "yes" links no strangers. A passage that
links to none as a whole is looked for, by the same rule, among the runs of
consecutive lines and sentences of what messages say: their words are hashed
from any start of a line or sentence to any end of one, for the numbers of
words that such passages have. A quote that leaves out lines between others,
or cuts a sentence, links to none. A message replies to the message that its
first linked passage of the lowest level came from. Links only lead to smaller
(conversation, turn), so there are no rings; roots and depths come from pointer
jumping, which doubles the hops in each round.

A message's place in its thread is its number in reply order: each message is
followed by its replies, the earlier before the later, each with all of its own
replies before the next. Entering and leaving each message is a step of one
walk around the thread, and pointer jumping over the walk counts the messages
still to come.

First sayers are minima with a map-side part, joined back from written tables:
a passage that a third of all messages quote, or a first turn that all reply
to, is split over tasks. Replies to one message are put in order by one sort of
all, by ranges, and never gathered.

Defined results: messages without quotes, or with none that link, are roots of
their own with depth 0; null texts count as empty; rows without a conversation
or a turn have null roots, depth and place 0 and are never linked to; rows that
repeat a (conversation, turn) share one link, the smallest, and one place; a
text of quotes alone has an empty text left; input columns other than the four
named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.llm.shared import Tables, partitions, text_batches

MARKS = re.compile(r"[ \t]*>[> \t]*")
BLANK = re.compile(r"\s+")
#: Words of a passage that may link to another conversation.
FAR_WORDS = 5

END = re.compile(r"[.!?…][\"'”’)\]]*$")

PARSED = pa.struct(
    [
        ("own", pa.string()),
        ("said", pa.list_(pa.binary())),
        ("quoted", pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int32()), ("words", pa.int32()), ("hash", pa.binary())]))),
    ]
)
PARSED_DDL = "own string, said array<binary>, quoted array<struct<level: int, at: int, words: int, hash: binary>>"


def level_of(line: str) -> tuple[int, str]:
    """The quote level of a line and what follows its marks."""
    marks = MARKS.match(line)
    return (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)


def hashed(passage: str) -> bytes | None:
    """128 bits of a normalised passage; none for a blank one."""
    plain = BLANK.sub(" ", passage).strip().casefold()
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest() if plain else None


def passages(lines: list[str]) -> list[str]:
    """Lines cut at blank ones."""
    found: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            found[-1].append(line)
        elif found[-1]:
            found.append([])
    return ["\n".join(x) for x in found if x]


def parse(text: str | None) -> dict:
    """The text without quotes, the hashes of what it says, and its quoted passages in order."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        level, rest = level_of(line)
        if level == 0:
            own.append(line)
            runs.append((0, []))
        elif runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    units = ["\n".join(own), *passages(own), *own]
    quoted = [(level, p) for level, lines in runs if level for p in passages(lines)]
    return {
        "own": "\n".join(own).strip("\n"),
        "said": sorted({h for u in units if (h := hashed(u))}),
        "quoted": [{"level": level, "at": k, "words": len(p.split()), "hash": hashed(p)} for k, (level, p) in enumerate(quoted)],
    }


def parsed(text: Column | str) -> Column:
    @F.arrow_udf(PARSED_DDL)
    def quotes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([parse(t.as_py()) for t in texts], PARSED)

    return quotes(F.col(text) if isinstance(text, str) else text)


def runs_of(text: str | None, lengths: frozenset[int]) -> list[bytes]:
    """The hashes of all runs of consecutive lines and sentences that have one of the given numbers of words."""
    words: list[str] = []
    starts = {0}
    for line in (text or "").split("\n"):
        for word in line.split():
            words.append(word)
            if END.search(word):
                starts.add(len(words))
        starts.add(len(words))
    return sorted({hashed(" ".join(words[a : a + n])) for a in starts for n in lengths if a + n in starts})


def said_runs(text: Column | str, lengths: frozenset[int]) -> Column:
    @F.arrow_udf("array<binary>")
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([runs_of(t.as_py(), lengths) for t in texts], pa.list_(pa.binary()))

    return runs(F.col(text) if isinstance(text, str) else text)


def _sayers(quoted: DataFrame, said: DataFrame, tables: Tables, name: str, far_words: int) -> DataFrame:
    """quoted with the message that each passage came from, up. said: (key, hash)."""
    wanted = tables.write(quoted.select("hash").distinct(), f"wanted_{name}")
    said = tables.write(said.join(wanted, "hash", "left_semi"), f"said_{name}")
    near = tables.write(said.groupBy(F.col("key.conv").alias("conv"), "hash").agg(F.min("key.turn").alias("turn")), f"near_{name}")
    far = tables.write(said.groupBy("hash").agg(F.min("key").alias("far")), f"far_{name}")
    places = quoted.withColumn("conv", F.col("key.conv")).join(near, ["conv", "hash"], "left").join(far, "hash", "left")
    up = F.when(F.col("turn") < F.col("key.turn"), F.struct("conv", "turn")).when((F.col("words") >= far_words) & (F.col("far") < F.col("key")), F.col("far"))
    return tables.write(places.select("key", "level", "at", "words", "hash", up.alias("up")), f"places_{name}")


def _roots(links: DataFrame, tables: Tables) -> DataFrame:
    """(key, root, depth) for each linked message. links: (key, up), up < key, one row for each key.

    A round only moves messages that have not reached their root; the others are there to be looked up.
    """
    moving = tables.write(links.select("key", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "hops_0")
    done, k = moving.limit(0), 0
    while not moving.isEmpty():
        k += 1
        above = moving.unionByName(done).select(F.col("key").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = moving.join(above, "root", "left")
        step = joined.select("key", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("went"))
        now = tables.write(step, f"hops_{k}")
        done = done.unionByName(now.where("NOT went").drop("went"))
        moving = now.where("went").drop("went")
    return done


def _next_siblings(links: DataFrame, tables: Tables) -> DataFrame:
    """(key, up, sibling): the next larger key of the same up, null for the last. One sort by ranges, then neighbours by number."""
    order = "up.conv", "up.turn", "key.conv", "key.turn"
    ranged = links.select("key", "up").repartitionByRange(partitions(links.sparkSession), *order).sortWithinPartitions(*order)
    ranged = tables.write(ranged.select("key", "up", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "sorted")
    ends = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("n"), F.max("n")).collect())  # one row a partition
    after = [(last, first) for (_, _, last), (_, first, _) in zip(ends, ends[1:], strict=False)]
    jumps = F.broadcast(links.sparkSession.createDataFrame(after, "n long, jump long"))
    numbered = ranged.join(jumps, "n", "left").withColumn("at", F.coalesce("jump", F.col("n") + 1))
    following = ranged.select(F.col("n").alias("at"), F.col("key").alias("sibling"), F.col("up").alias("of"))
    return numbered.join(following, "at", "left").select("key", "up", F.when(F.col("of") == F.col("up"), F.col("sibling")).alias("sibling"))


def _places(links: DataFrame, roots: DataFrame, tables: Tables) -> DataFrame:
    """(key, place) of the messages that have or are replies.

    links: (key, up), up < key, one row for each key; roots: (key, root, depth) of them. A thread of n messages is a
    walk of 2n steps and so takes log2(2n) rounds; a round holds only threads that still need it.
    """
    siblings = tables.write(_next_siblings(links, tables), "siblings")
    children = links.groupBy(F.col("up").alias("key")).agg(F.min("key").alias("child"))
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("size"))
    nodes = siblings.join(children, "key", "full").join(roots.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    nodes = tables.write(nodes.join(sizes, "root"), "nodes")
    rounds = F.ceil(F.log2(2 * F.col("size"))).cast("int").alias("rounds")
    enter = lambda c: F.struct(F.col(c).alias("key"), F.lit(False).alias("left"))
    leave = lambda c: F.struct(F.col(c).alias("key"), F.lit(True).alias("left"))
    entering = F.struct(enter("key").alias("step"), F.coalesce(F.when(F.col("child").isNotNull(), enter("child")), leave("key")).alias("next"), F.lit(1).cast("long").alias("n"))
    leaving = F.struct(leave("key").alias("step"), F.when(F.col("sibling").isNotNull(), enter("sibling")).when(F.col("up").isNotNull(), leave("up")).alias("next"), F.lit(0).cast("long").alias("n"))
    now = tables.write(nodes.select(rounds, "size", F.explode(F.array(entering, leaving)).alias("s")).select("rounds", "size", "s.*"), "walk_0")
    most = now.agg(F.coalesce(F.max("rounds"), F.lit(0))).first()[0]
    parts = [now.limit(0)]
    for k in range(1, most + 1):
        after = now.select(F.col("step").alias("next"), F.col("next").alias("then"), F.col("n").alias("more"))
        moved = now.join(after, "next", "left").select("rounds", "size", "step", F.col("then").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        now = tables.write(moved, f"walk_{k}")
        parts.append(now.where(F.col("rounds") == k))
        now = now.where(F.col("rounds") > k)
    walked = reduce(DataFrame.unionByName, parts)
    return walked.where(~F.col("step.left")).select(F.col("step.key").alias("key"), (F.col("size") - F.col("n")).alias("place"))


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", far_words: int = FAR_WORDS) -> DataFrame:
    """One row per message: its columns, the text without quotes, and the place in reply order.

    Returns conv, turn, role, text (without quotes), n_quotes, n_linked,
    reply_conv and reply_turn (null for roots), root_conv, root_turn, depth,
    place. Conversations read in reply order when sorted by root_conv,
    root_turn, place (from 0).
    """
    text_batches(messages.sparkSession)
    tables = Tables(messages.sparkSession, "quotes")
    rows = messages.select(F.struct(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn")).alias("key"), F.col(role_col).alias("role"), parsed(text_col).alias("p"))
    rows = tables.write(rows.select("key", "role", F.col("p.own").alias("text"), F.col("p.said").alias("said"), F.col("p.quoted").alias("quoted")), "parsed")
    whole = F.col("key.conv").isNotNull() & F.col("key.turn").isNotNull()
    quoted = tables.write(rows.where(whole).select("key", F.explode("quoted").alias("q")).select("key", "q.level", "q.at", "q.words", "q.hash"), "quoted")
    linked = _sayers(quoted, rows.where(whole).select("key", F.explode("said").alias("hash")), tables, "whole", far_words)
    left = linked.where("up IS NULL").drop("up")
    lengths = frozenset(r.words for r in left.select("words").distinct().collect())  # one small number for each length of a passage
    if lengths:
        said = rows.where(whole).select("key", F.explode(said_runs("text", lengths)).alias("hash"))
        linked = linked.where("up IS NOT NULL").unionByName(_sayers(left, said, tables, "runs", far_words))
    best = linked.groupBy("key").agg(F.count("*").alias("n_quotes"), F.count("up").alias("n_linked"), F.min(F.when(F.col("up").isNotNull(), F.struct("level", "at", "up"))).alias("best"))
    best = tables.write(best.select("key", "n_quotes", "n_linked", F.col("best.up").alias("up")), "links")
    links = best.where("up IS NOT NULL").select("key", "up")
    roots = tables.write(_roots(links, tables), "roots")
    places = tables.write(_places(links, roots, tables), "places")
    placed = tables.write(best.join(roots, "key", "left").join(places, "key", "full"), "placed")
    out = rows.drop("said", "quoted").join(placed, "key", "left")
    root = F.coalesce("root", F.when(whole, F.col("key")))
    none = F.lit(0).cast("long")
    return out.select(
        F.col("key.conv").alias(conv_col),
        F.col("key.turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("text").alias(text_col),
        F.coalesce("n_quotes", none).alias("n_quotes"),
        F.coalesce("n_linked", none).alias("n_linked"),
        F.col("up.conv").alias("reply_conv"),
        F.col("up.turn").alias("reply_turn"),
        root["conv"].alias("root_conv"),
        root["turn"].alias("root_turn"),
        F.coalesce("depth", none).alias("depth"),
        F.coalesce("place", none).alias("place"),
    )


def mailed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The messages as mail programs would send them: above its own text each quotes the message before it, below the quote of the one before that.

    A message is found by the turn before it, the smallest text of that turn;
    a missing or blank one is not quoted. All columns stay but the text.
    """
    turns = messages.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn")).agg(F.min(text_col).alias("_said"))

    def quote(text: str, marks: str) -> Column:
        said = F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.col(text))
        return F.concat(F.lit(marks), F.regexp_replace(said, "\n", "\n" + marks), F.lit("\n"))

    out = messages.select(F.struct(*messages.columns).alias("_row"))
    conv, turn = F.col("_row")[conv_col], F.col("_row")[turn_col]
    for back in (1, 2):
        before = turns.select(F.col("_conv").alias(f"_c{back}"), (F.col("_turn") + back).alias(f"_t{back}"), F.col("_said").alias(f"_said{back}"))
        out = out.join(before, (conv == F.col(f"_c{back}")) & (turn == F.col(f"_t{back}")), "left")
    none = F.lit("")
    body = F.concat(F.coalesce(quote("_said2", ">> "), none), F.coalesce(quote("_said1", "> "), none), F.col("_row")[text_col])
    return out.select(*[(body if c == text_col else F.col("_row")[c]).alias(c) for c in messages.columns])
