"""Chat formatting by quotation linking, in DataFrame functions only.

The lines of a message are cut into runs of one quote level (the number of leading ``>``). A quoted run and each of its
lines are normalised (lower case, single spaces) and hashed; the hashes meet those of the unquoted texts and lines of
earlier messages of the conversation. A run belongs to the message that holds it whole, else to the one that holds most
of its lines, in doubt the latest; the original of a hash is the first message that has it. A message answers the
latest message that its shallowest linked quotes belong to. Answers stay with what they answer: conversations are
ordered by the turn of the first message of a reply tree and, within the tree, by turn, with all quotes removed.

Defined results: a null text is empty; a message without a linked quote begins a tree of its own, so a conversation
without quotes keeps its turns in order; quotes without an original are removed too, and listed in ``unlinked``; lines
such as "On ... wrote:" before a quote go with it; rows that share a turn share its root and are ordered by role and
text; repeated rows get equal results but for their positions; messages of many lines, deep quotes and any number of
blank lines take linear time; other columns may have any name; a turn or conversation is any BIGINT; a null conversation
is one of its own, a null turn comes first and is no other turn's, a null role is ``unknown``; an empty table gives no
rows. Joins are salted and positions come from ranges of the order, so a conversation of any length is dealt over many
tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import needs, salted_lookup, stored, text_of

# possessive, so that Java matches repeated groups in a loop: as many signs or blank lines as there are, in linear time
_MARKS = r"^((?:[ \t]*+>)++)"
_ATTRIBUTION = r"(?imd)^(?:on .+ wrote:|-{2,} ?original message ?-{2,})[ \t]*+\n?+(?=(?:[ \t]*+\n)*+[ \t]*+>)"
#: Stands for a missing conversation or turn inside, where both are decimals of 20 digits: one below every BIGINT.
NONE = -(1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often lambdas in it look at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs_of(text: Column) -> Column:
    """Runs of lines of one level: array of (level, text). Each line is copied once, so the time is linear in a message."""
    kind = "array<struct<level:int,text:string>>"
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))
    body = lambda line: F.regexp_replace(line, _MARKS + " ?", "")
    plain = F.array(F.struct(F.lit(0).alias("level"), text.alias("text"))).cast(kind)
    quoted = text.rlike(r"(?m)^[ \t]*>")
    split = F.transform(F.split(F.regexp_replace(text, _ATTRIBUTION, ""), "\n", -1), lambda line: F.struct(level(line).alias("level"), body(line).alias("text")))
    begins = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

    def run(lines: Column, at: Column, begin: Column, k: Column) -> Column:
        own = F.slice(lines, begin + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - begin)
        return F.struct(F.get(lines, begin)["level"].alias("level"), F.array_join(F.transform(own, lambda line: line["text"]), "\n").alias("text"))

    runs = _once(split, lambda lines: _once(begins(lines), lambda at: F.transform(at, lambda begin, k: run(lines, at, begin, k))))
    return F.when(quoted, runs.cast(kind)).otherwise(plain)


def _units(text: Column) -> Column:
    """Hashes of a text: whole first, then its lines."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: x != "")
    return F.transform(F.concat(F.array(normalised(text)), lines), lambda x: F.xxhash64(x))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, turn, role, row (a hash that tells repeated rows apart), own text and quotes: array of (level, text)."""
    d = needs(messages, conv_id="bigint", turn="bigint", role="string", text="string").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), runs_of(text_of()).alias("_runs"), F.xxhash64("role", "text").alias("row"))
    own = F.array_join(F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    said = F.when(F.size("_runs") > 1, F.btrim(F.regexp_replace(own, r"\n{3,}", "\n\n"), F.lit(" \t\n"))).otherwise(own)
    return d.select("conv_id", "turn", "role", "row", said.alias("own"), F.filter("_runs", lambda r: (r["level"] > 0) & (normalised(r["text"]) != "")).alias("quotes"))


def links(messages: DataFrame) -> DataFrame:
    """One row per quote: conv_id, turn, row, quote (its number), level, quoted text, and origin, the turn it comes from or null."""
    quotes = messages.where(F.size("quotes") > 0).dropDuplicates(["conv_id", "turn", "row"]).select("conv_id", "turn", "row", F.posexplode("quotes").alias("quote", "q"))
    quotes = quotes.select("conv_id", "turn", "row", "quote", F.col("q.level").alias("level"), F.col("q.text").alias("quoted"))
    key = F.struct("conv_id", "unit").alias("key")
    asked = quotes.select("conv_id", "turn", "row", "quote", F.posexplode(_units(F.col("quoted"))).alias("n", "unit"))
    asked = asked.select("conv_id", "turn", "row", "quote", (F.col("n") == 0).alias("whole"), key)
    there = quotes.select("conv_id").distinct().withColumn("_quoted", F.lit(True))
    texts = salted_lookup(messages.where(normalised(F.col("own")) != ""), there, "conv_id", "row").where("_quoted")
    first = texts.select("conv_id", "turn", F.explode(F.array_distinct(_units(F.col("own")))).alias("unit")).groupBy(key).agg(F.min("turn").alias("origin"))
    met = salted_lookup(asked, first, "key", "turn").where("origin < turn")
    held = met.groupBy("conv_id", "turn", "row", "quote", "origin").agg(F.max("whole").alias("whole"), F.count("*").alias("lines"))
    best = held.groupBy("conv_id", "turn", "row", "quote").agg(F.max_by("origin", F.struct("whole", "lines", "origin")).alias("origin"))
    return quotes.join(best, ["conv_id", "turn", "row", "quote"], "left")


def _positions(d: DataFrame) -> DataFrame:
    """Add ``position``, a message's place in its conversation, from 0.

    The rows are cut into ranges of their order, so a conversation of any length, whatever its turns, is as many ranges
    as its size asks for, and copies are told apart by where they are stored. A range counts on from the ones before.
    """
    order = ["conv_id", "root_turn", "turn", "role", "row", "_copy"]
    cut = d.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut = stored(cut, "ranges")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("conv_id", "_range").agg(F.count("*").alias("_n")).select("conv_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("conv_id", "_range").orderBy(*order)
    return cut.withColumn("_place", F.row_number().over(own)).join(counts, ["conv_id", "_range"]).withColumn("position", F.col("_before") + F.col("_place") - 1)


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position, root_turn, reply_to, n_quotes, n_linked, text, unlinked, chat."""
    m = stored(parsed(messages), "messages")
    whole = lambda c: F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(str(NONE)).cast("decimal(20,0)"))
    m = m.withColumns({"conv_id": whole("conv_id"), "turn": whole("turn")})
    found = stored(links(m), "quote_links")
    origin = F.col("origin").isNotNull()
    shallow = F.struct(-F.col("level"), "origin")
    per = found.groupBy("conv_id", "turn", "row").agg(
        F.count("*").alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.max(F.when(origin, shallow))["origin"].alias("reply_to"),
        F.sort_array(F.collect_list(F.when(~origin, F.struct("quote", "quoted")))).alias("_lost"),
    )
    # roots of reply trees: each message points to an earlier one, and pointers are doubled until they end
    jumps = per.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    jumps = stored(jumps.select(F.struct("conv_id", "turn").alias("node"), F.struct("conv_id", F.col("up").alias("turn")).alias("up")), "replies")
    for k in range(64):
        further = jumps.select(F.col("node").alias("up"), F.col("up").alias("_further"))
        jumps_next = salted_lookup(jumps.select("node", "up", F.col("node.turn").alias("_turn")), further, "up", "_turn")
        jumps_next = stored(jumps_next.select("node", F.coalesce("_further", "up").alias("up"), F.col("_further").isNotNull().alias("_moved")), f"replies{k + 1}")
        jumps = jumps_next.select("node", "up")
        if jumps_next.where("_moved").isEmpty():
            break
    d = m.join(per, ["conv_id", "turn", "row"], "left")
    d = d.join(jumps.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("up.turn").alias("_root")), ["conv_id", "turn"], "left")
    d = d.withColumn("root_turn", F.coalesce("_root", "turn"))
    ranked = _positions(stored(d.select("conv_id", "turn", "row", "role", "root_turn", "own", "reply_to", "n_quotes", "n_linked", "_lost"), "trees"))
    shown = lambda c: F.when(F.col(c) != F.lit(str(NONE)).cast("decimal(20,0)"), F.col(c).cast("bigint")).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return ranked.select(
        shown("conv_id"), shown("turn"), "role", F.col("position").cast("bigint").alias("position"), shown("root_turn"), shown("reply_to"),
        zero("n_quotes"), zero("n_linked"), F.col("own").alias("text"), F.transform(F.coalesce("_lost", F.array().cast("array<struct<quote:int,quoted:string>>")), lambda q: q["quoted"]).alias("unlinked"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "own", F.lit("\n")).alias("chat"),
    )


def render(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole conversation as one text. A conversation becomes one value, so each must fit in memory."""
    turns = F.sort_array(F.collect_list(F.struct("position", "chat")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["chat"]), "").alias("chat"))
