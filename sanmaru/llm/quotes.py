"""Quotation linking: quoted passages point to the messages they come from, which puts messages in reply order.

Neighbouring lines of one quote level are a passage, however they are wrapped. Its normalised words are hashed, every run
of ``RUN`` words of a long passage and a short one as a whole, and the hashes are joined to those of what messages say
themselves. The parent of a message comes from its lowest quote level; a deeper level tells what the quoted message itself
replied to, where that message quotes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.llm.common import LOWER, UPPER, WORD, broadcast_upto, cut
from sanmaru.llm.components import components

#: Hashes and links that may be broadcast.
HASHES_BROADCAST, LINKS_BROADCAST = 500_000, 500_000
#: Words of a run.
RUN = 8
#: Leading quote marks of a line, with blanks between them.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
BREAKS = r"\r\n|\r|\n"


def _words(text: Column) -> Column:
    """Words as they are compared: A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def _runs(words: Column) -> Column:
    """Distinct hashes of all runs of ``RUN`` words; none for fewer words."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - RUN + 1))
    return F.when(F.size(words) >= RUN, F.array_distinct(F.transform(at, lambda i: _hash(F.slice(words, i, RUN))))).otherwise(F.array().cast("array<bigint>"))


def _own_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda x: ~x.rlike(MARKS))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, words`` of each passage: neighbouring lines with the same number of quote marks, not blank."""
    quoting = messages.filter(F.col("text").rlike("(?m)" + MARKS)).select("conv_id", "turn", "text").distinct()
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", BREAKS)).alias("no", "raw"))
    marks = F.regexp_extract("raw", MARKS, 0)
    lines = lines.select("conv_id", "turn", "mark", "no", F.regexp_count(marks, F.lit(">")).alias("level"), _words(F.expr("substr(raw, length(regexp_extract(raw, '" + MARKS + "', 0)) + 1)")).alias("words"))
    lines = lines.filter("level > 0 and size(words) > 0")
    island = F.col("no") - F.row_number().over(W.partitionBy("conv_id", "turn", "mark", "level").orderBy("no"))
    passages = lines.withColumn("island", island).groupBy("conv_id", "turn", "mark", "level", "island").agg(F.array_sort(F.collect_list(F.struct("no", "words"))).alias("lines"))
    return passages.select("conv_id", "turn", "level", F.flatten(F.transform("lines", lambda s: s["words"])).alias("words"))


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_conv, parent_turn, quoted``: each message with the message that it answers.

    A hash's original is the first message of the conversation that says it, if that comes before. Else it is the first
    message of another conversation, by turn and conversation: of all for long passages, and for short ones only if no
    more than one conversation says them. Which conversation began first isn't known, so a message may answer one of any other
    conversation. The original with most hashes of a level wins, ones of the same conversation and later turns first.
    Where answers go round in a ring, the message with the smallest turn and conversation in the ring starts the thread.
    """
    spark = messages.sparkSession
    messages = messages.filter("conv_id is not null and turn is not null")
    short = F.when(F.size("words") < RUN, F.array(_hash(F.col("words")))).otherwise(F.array().cast("array<bigint>"))
    quoted = quoted_passages(messages).select("conv_id", "turn", "level", (F.size("words") >= RUN).alias("long"), F.explode(F.concat(_runs(F.col("words")), short)).alias("hash"))
    quoted = cut(quoted.groupBy("conv_id", "turn", "level", "hash", "long").agg(F.count(F.lit(1)).alias("n")))
    schema = "conv_id long, turn long, parent_conv long, parent_turn long, quoted long"
    if not quoted.limit(1).count():
        return spark.createDataFrame([], schema)
    lines = _own_lines(F.col("text"))
    brief = F.transform(F.filter(F.transform(lines, _words), lambda w: (F.size(w) > 0) & (F.size(w) < RUN)), _hash)
    said = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(_runs(_words(F.array_join(lines, " "))), brief))).alias("hash"))
    said = cut(said.join(broadcast_upto(cut(quoted.select("hash").distinct()), HASHES_BROADCAST), "hash", "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn")))
    here = quoted.join(said, ["conv_id", "hash"]).filter("parent_turn < turn").select("*", F.col("conv_id").alias("parent_conv"))
    # the first two conversations that say a hash tell the first other one of any message
    place = F.struct("parent_turn", "conv_id")
    one = said.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("convs"))
    two = said.join(one.select("hash", F.col("first.conv_id").alias("c_")), "hash").filter("conv_id <> c_").groupBy("hash").agg(F.min(place).alias("second"))
    known = cut(one.join(two, "hash", "left"))
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    there = quoted.join(known, "hash").withColumn("o", other).filter("o is not null and (long or convs = 1)")
    there = there.withColumn("parent_turn", F.col("o.parent_turn")).withColumn("parent_conv", F.col("o.conv_id")).select(*here.columns)
    votes = here.union(there).groupBy("conv_id", "turn", "level", "parent_conv", "parent_turn").agg(F.sum("n").alias("quoted"))
    rank = F.struct((F.col("parent_conv") == F.col("conv_id")).alias("same"), "quoted", "parent_turn", "parent_conv")
    best = cut(votes.groupBy("conv_id", "turn", "level").agg(F.max(rank).alias("b")).select("conv_id", "turn", "level", "b.parent_conv", "b.parent_turn", "b.quoted"))

    direct = best.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "parent_conv", "parent_turn", "quoted")).alias("b")).select("conv_id", "turn", "b.parent_conv", "b.parent_turn", "b.quoted")
    by_level = W.partitionBy("conv_id", "turn").orderBy("level")
    deeper = best.select("parent_conv", "parent_turn", F.lead("parent_conv").over(by_level).alias("above_conv"), F.lead("parent_turn").over(by_level).alias("above_turn"), F.lead("quoted").over(by_level).alias("quoted"))
    itself = (F.col("above_conv") == F.col("parent_conv")) & (F.col("above_turn") >= F.col("parent_turn"))
    deeper = deeper.filter(F.col("above_conv").isNotNull() & ~itself).groupBy("parent_conv", "parent_turn", "above_conv", "above_turn").agg(F.sum("quoted").alias("quoted"))
    told = deeper.groupBy(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn")).agg(F.max(F.struct("quoted", "above_turn", "above_conv")).alias("b"))
    told = told.select("conv_id", "turn", F.col("b.above_conv").alias("parent_conv"), F.col("b.above_turn").alias("parent_turn"), F.lit(0).cast("long").alias("quoted"))
    return without_rings(cut(direct.unionByName(told.join(direct, ["conv_id", "turn"], "left_anti"))))


def without_rings(links: DataFrame) -> DataFrame:
    """``links`` less one link of each ring: that of the ring's message with the smallest turn and conversation.

    Each message has one parent at most, so a connected component without a message that has none holds exactly one ring.
    Such components are rare; in them pointers are doubled until every message points into its ring.
    """
    own, top = F.struct("conv_id", "turn"), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))
    pairs = cut(links.select(own.alias("a"), top.alias("b")))
    if not pairs.join(pairs.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
        return links  # no parent has a parent
    groups = components(pairs)
    rooted = groups.join(pairs.select(F.col("a").alias("id")), "id", "left_anti").select("label").distinct()
    ringed = cut(groups.join(rooted, "label", "left_anti"))
    longest = ringed.groupBy("label").count().agg(F.max("count").alias("n")).first().n
    if longest is None:
        return links
    state = cut(pairs.join(ringed.withColumnRenamed("id", "a"), "a").select("a", "b", "label"))
    for _ in range(longest.bit_length()):
        state = cut(state.join(state.select(F.col("a").alias("b"), F.col("b").alias("further")), "b").select("a", F.col("further").alias("b"), "label"))
    first = state.groupBy("label").agg(F.min(F.struct("b.turn", "b.conv_id")).alias("m")).select("m.conv_id", "m.turn")
    return links.join(first, ["conv_id", "turn"], "left_anti")


def reply_paths(links: DataFrame) -> DataFrame:
    """``conv_id, turn, path``: messages ``(conv_id, turn)`` from the thread's first down to each linked one.

    Pointer doubling: a message's path and its end's path join, so rounds grow with the logarithm of the depth.
    """
    own, top = F.struct("conv_id", "turn"), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))
    state = cut(links.select(own.alias("m"), top.alias("top"), F.array(own).alias("path"), F.lit(False).alias("ended")))
    while state.filter("not ended").limit(1).count():
        up = state.select(F.col("m").alias("top"), F.col("top").alias("higher"), F.col("path").alias("before"), F.col("ended").alias("done"))
        joined, stop = state.join(up, "top", "left"), F.col("ended") | F.col("before").isNull()
        state = cut(joined.select("m", F.when(stop, F.col("top")).otherwise(F.col("higher")).alias("top"), F.when(stop, F.col("path")).otherwise(F.concat("before", "path")).alias("path"), stop.alias("ended")))
    return state.select("m.conv_id", "m.turn", F.concat(F.array("top"), "path").alias("path"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row for each message: ``conv_id, turn, role, text, parent_conv, parent_turn, depth, reply_path, quoted``.

    ``text`` is the message without its quoted lines (blank lines at the ends go; null texts become empty), ``quoted`` how
    many hashes of its parent it quotes. A message without a quote, or whose quotes match no other message, starts a
    thread: its parent is null and its depth 0. Sorted by ``reply_path``, every reply stands after the message it quotes
    and that message's earlier replies. Rows that share conversation and turn are one message for links and keep their own
    texts; null keys match nothing. An empty table gives no rows; other columns are ignored.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    links = cut(quote_links(messages))
    paths = links.join(reply_paths(links), ["conv_id", "turn"])
    text = F.regexp_replace(F.array_join(_own_lines(F.col("text")), "\n"), r"^(?:[ \t]*\n)+|\s+$", "")
    alone = F.array(F.struct("conv_id", "turn"))
    return messages.join(broadcast_upto(cut(paths), LINKS_BROADCAST), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", text.alias("text"), "parent_conv", "parent_turn", F.coalesce(F.size("path") - 1, F.lit(0)).alias("depth"), F.coalesce("path", alone).alias("reply_path"), F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted")
    )


def write_conversations(linked: DataFrame, path: str) -> None:
    """Write messages in reply order: files hold ranges of threads, split inside a long one."""
    linked.repartitionByRange("reply_path").sortWithinPartitions("reply_path").write.parquet(path)
