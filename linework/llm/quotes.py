"""Chat formatting by linking quotations to the messages they come from.

A line's quote level is the number of ``>`` before its text. Consecutive lines of one level make a
passage. Passages are normalised (lower case, white space as one space) and hashed; so are the units
of every message's own text: all of it, its paragraphs and its lines. A passage belongs to the first
message of its conversation that has it as own text, if that comes before. A passage of several lines
without such a message is an excerpt: it belongs to the first message that holds its paragraphs in
order, each as one paragraph or line, or by its lines in order (others may lie between them). A message
replies to the original of its first linked passage of the lowest level; threads follow these links to
their roots by pointer doubling, so long chains take few rounds. A conversation is ordered by thread,
then turn.

Everything is DataFrame functions. Passages and units are cut and hashed in the message's row, so what
moves are hashes, conversations and turns; units are pre-aggregated before they meet passages, and
positions are numbered over (conversation, turn) counts by ranges, so neither a frequent line nor a long
conversation lands in one task. The texts are read where they lie and move once, to get their place (a
message that quotes moves twice). An excerpt is compared only with the messages that have its rarest
unit; equal excerpts of a conversation are compared once. Hashes of 96 bits stand for texts.

Defined results: a null text is empty and has no quotations; a null turn comes first and links to
nothing; a null conversation is a conversation; a null role is written as ``user``; repeated rows stay
repeated, and a reply to a repeated turn names that turn; messages of one conversation and turn are in
the order of their formatted text; white space around ``>`` does not matter; a mark or a line may be of any
length; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.plans.numbering import numbered
from linework.plans.tables import materialise

#: What stands before the text of a quoted line.
MARK = r"^[ \t>]*>[ \t]*"
#: What tells messages of a conversation and turn apart: hashes of their text.
SAME = ["conv", "turn", "h1", "h2"]


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _key(text: Column) -> Column:
    """96 bits of a normalised passage."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)


def without_quotes(text: Column) -> Column:
    """The lines of a message that are its own, trimmed."""
    own = F.array_join(F.filter(_lines(text), lambda line: ~line.rlike(MARK)), "\n")
    return F.trim(own, F.lit(" \t\n\x0b\f\r"))  # one pass, whatever runs of white space are within


def _pieces(text: Column) -> Column:
    """The paragraphs of a text: for each its key and those of its lines, without empty ones."""
    parts = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: normalised(p) != "")
    own = lambda p: F.filter(F.transform(F.split(p, "\n"), normalised), lambda x: x != "")
    return F.transform(parts, lambda p: F.struct(_key(normalised(p)).alias("key"), F.transform(own(p), _key).alias("lines")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, h1, h2, level, at, key, pieces) for every quoted passage of (conv, turn, text); the pieces
    of one line are null. Passages are cut in the row; only their hashes leave it."""
    rows = messages.select("conv", "turn", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), _lines(F.col("text")).alias("lines"))
    mark = lambda line: F.regexp_extract(line, MARK, 0)
    level = lambda m: F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))
    rows = rows.select(*SAME, F.transform("lines", lambda x: level(mark(x))).alias("levels"), F.transform("lines", lambda x: F.regexp_replace(x, MARK, "")).alias("rest"))
    at, of = F.sequence(F.lit(0), F.size("levels") - 1), lambda i: F.get("levels", i)
    begins = F.filter(at, lambda i: (of(i) > 0) & ~of(i - 1).eqNullSafe(of(i)))
    ends = F.filter(at, lambda i: (of(i) > 0) & ~of(i + 1).eqNullSafe(of(i)))
    rows = rows.select(*SAME, "levels", "rest", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("x"))
    rows = rows.select(*SAME, of(F.col("x.a")).alias("level"), F.col("x.a").alias("at"), F.slice("rest", F.col("x.a") + 1, F.col("x.b") - F.col("x.a") + 1).alias("part"))
    rows = rows.withColumn("raw", F.array_join("part", "\n")).withColumn("text", normalised(F.col("raw"))).where("text != ''")
    several = F.size(F.filter("part", lambda x: normalised(x) != "")) > 1
    found = rows.select(*SAME, "level", "at", _key(F.col("text")).alias("key"), F.when(several, _pieces(F.col("raw"))).alias("pieces"))
    return found.dropDuplicates([*SAME, "at"])


def originals(messages: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, key, first): the first turn with a unit of own text, in the conversations ``convs`` (c)."""
    body = without_quotes(F.col("text"))
    rows = messages.select("conv", "turn", body.alias("body"))
    units = F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    units = F.filter(F.array_distinct(F.transform(units, normalised)), lambda u: u != "")
    keys = rows.select("conv", "turn", F.explode(F.transform(units, _key)).alias("key")).groupBy("conv", "key").agg(F.min("turn").alias("first"))
    return keys.join(convs, F.col("conv").eqNullSafe(F.col("c")), "left_semi")


def _holds(units: Column, pieces: Column) -> Column:
    """Whether a message's units (its paragraphs' lines, each paragraph after its lines) hold all pieces in order."""

    def step(s: Column, u: Column) -> Column:
        piece = F.get(pieces, s["i"])
        same = lambda key: F.coalesce(key == u["key"], F.lit(False))
        whole = same(piece["key"]) & (~u["part"] | (s["i"] == s["start"]))  # a paragraph that began after the piece before
        line = ~u["part"] & same(F.get(piece["lines"], s["n"]))
        done = whole | (line & (s["n"] + 1 == F.size(piece["lines"])))
        i = s["i"] + done.cast("int")
        return F.struct(i.alias("i"), F.when(done, 0).otherwise(s["n"] + line.cast("int")).alias("n"), F.when(u["part"], i).otherwise(s["start"]).alias("start"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("start"))
    return F.aggregate(units, zero, step, lambda s: s["i"] == F.size(pieces))


def excerpts(linked: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv, pieces, held): the first turn that holds an excerpt, for the passages of several lines that have no original."""
    left = linked.where("first is null and pieces is not null and turn is not null")
    left = left.groupBy("conv", "pieces").agg(F.max("turn").alias("last")).withColumn("id", F.monotonically_increasing_id())
    left = materialise(left, "excerpts")
    convs = left.select(F.col("conv").alias("c")).distinct()
    unit = lambda part, key: F.struct(F.lit(part).alias("part"), key.alias("key"))
    units = F.flatten(F.transform(_pieces(without_quotes(F.col("text"))), lambda p: F.concat(F.transform(p["lines"], lambda k: unit(False, k)), F.array(unit(True, p["key"])))))
    searched = messages.where("turn is not null").select("conv", "turn", units.alias("units"))
    searched = searched.join(convs, F.col("conv").eqNullSafe(F.col("c")), "left_semi").withColumn("row", F.monotonically_increasing_id())
    searched = materialise(searched, "units")
    where = searched.select("row", F.col("conv").alias("c"), F.col("turn").alias("t"), F.explode(F.array_distinct(F.transform("units", lambda u: u["key"]))).alias("k"))
    uses = where.groupBy("c", "k").agg(F.count(F.lit(1)).alias("uses"))
    # each piece is met as a whole or by all its lines: its candidates have the whole or its rarest line
    pieces = left.select("id", "conv", F.posexplode("pieces").alias("piece", "p"))
    asked = pieces.select("id", "conv", "piece", F.explode(F.array_distinct(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("p.key").alias("key"))), F.transform("p.lines", lambda k: F.struct(F.lit(False).alias("whole"), k.alias("key")))))).alias("q"))
    asked = asked.join(uses, F.col("conv").eqNullSafe(F.col("c")) & (F.col("q.key") == F.col("k")), "left")
    asked = asked.select("id", "conv", "piece", "q.whole", "q.key", F.coalesce("uses", F.lit(0)).alias("uses"))
    best = asked.groupBy("id", "conv", "piece", "whole").agg(F.min(F.struct("uses", "key")).alias("best"))
    best = best.groupBy("id", "conv", "piece").agg(F.sum("best.uses").alias("uses"), F.collect_set("best.key").alias("keys"))
    best = best.groupBy("id", "conv").agg(F.min_by("keys", F.struct("uses", "piece")).alias("keys"))
    anchors = materialise(best.select("id", "conv", F.explode("keys").alias("key")), "anchors")
    pairs = anchors.join(where, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).select("id", "row", "t").distinct()
    pairs = pairs.join(left.select("id", "pieces", "last"), "id").where("t < last")
    held = pairs.join(searched.select("row", "units"), "row").where(_holds(F.col("units"), F.col("pieces"))).groupBy("id").agg(F.min("t").alias("held"))
    return materialise(left.join(held, "id").select("conv", "pieces", "held"), "held")


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) from (conv, turn, parent); a parent's turn is smaller. A round doubles the
    steps of those that have not reached their root."""
    step = materialise(replies.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(True).alias("open")), "threads")
    while not step.where("open").isEmpty():
        up = step.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        joined = step.where("open").join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        moved = joined.select("conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("d").isNotNull().alias("open"))
        step = materialise(moved.unionByName(step.where("not open")), "threads")
    return step.drop("open")


def _linked(rows: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv, turn, h1, h2, n_quotes, n_linked, parent) of the messages with the passages ``quoted``."""
    convs = quoted.select(F.col("conv").alias("c")).distinct()
    first = materialise(originals(rows, convs).select(F.col("conv").alias("c"), F.col("key").alias("k"), "first"), "originals")
    linked = quoted.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("first") < F.col("turn")), "left")
    linked = materialise(linked.select(*SAME, "level", "at", "pieces", "first"), "linked")
    held = excerpts(linked, rows).select(F.col("conv").alias("c"), F.col("pieces").alias("p"), "held")
    linked = linked.join(held, F.col("first").isNull() & F.col("conv").eqNullSafe(F.col("c")) & (F.col("pieces") == F.col("p")) & (F.col("held") < F.col("turn")), "left")
    linked = linked.withColumn("first", F.coalesce("first", "held"))
    replies = linked.groupBy(*SAME).agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("first").alias("n_linked"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("level", "at", "first")))["first"].alias("parent"),
    )
    return materialise(replies, "replies")


def _together(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on columns of the same names, nulls alike."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in on})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return a.join(b, same, how).drop(*[f"_{c}" for c in on])


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: its conversation and turn, role, reply_to (a turn), thread (the root's turn),
    depth, position in the reply-ordered conversation, n_quotes, n_linked, body without quotes and the
    formatted message."""
    rows = messages.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    marked = F.col("text").rlike("(?m)" + MARK)
    quoted = materialise(passages(rows.where(marked)), "passages")
    turns = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
    if quoted.isEmpty():
        none = F.lit(None).cast(rows.schema["turn"].dataType)
        turns = turns.select("*", F.col("turn").alias("thread"), F.lit(0).alias("depth"))
        rows = rows.withColumns({"parent": none, "n_quotes": F.lit(0), "n_linked": F.lit(0)})
    else:
        replies = _linked(rows, quoted)
        known = replies.where("parent is not null").groupBy("conv", "turn").agg(F.min("parent").alias("parent"))
        turns = _together(turns, threads(known), ["conv", "turn"], "left")
        turns = turns.select("conv", "turn", "n", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
        quoting = rows.where(marked).withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})
        quoting = _together(quoting, replies, SAME, "left").drop("h1", "h2")
        rows = rows.where(~marked).unionByName(quoting, allowMissingColumns=True)
    turns = materialise(numbered(turns, ["conv"], ["thread", "turn"], "upto", F.col("n")), "turns")
    body = without_quotes(F.col("text"))
    placed = _together(rows, turns, ["conv", "turn"], "inner").withColumn("body", body).drop("text")
    placed = placed.withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body"))
    if turns.where("n > 1").isEmpty():
        placed = placed.withColumn("k", F.lit(1))
    else:
        tied = numbered(placed.where("n > 1"), ["conv", "turn"], ["formatted"], "k")
        placed = placed.where("n = 1").withColumn("k", F.lit(1)).unionByName(tied)
    return placed.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("parent").alias("reply_to"),
        "thread",
        F.col("depth").cast("int").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "body",
        "formatted",
        (F.col("upto") - F.col("n") + F.col("k")).cast("long").alias("position"),
    )


def op5_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """All messages of conversations, in reply order and without quotations."""
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quoted_replies(spark, sf_dir: str) -> DataFrame:
    """The same on messages that Spark first lets quote the message before them, and what that one quotes."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    quote = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    back = lambda k: messages.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"text{k}"))
    quoting = messages.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    text = F.concat(F.coalesce(quote(F.col("text2"), ">> "), F.lit("")), F.coalesce(quote(F.col("text1"), "> "), F.lit("")), F.lit("\n"), "text")
    return format_chat(quoting.select("conv_id", "turn", "role", text.alias("text")))


OP5_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
l AS (
  SELECT id, conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS lines FROM m)),
v AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^[ \t]*(>[ \t]*)+', '') AS rest FROM l),
own AS (
  SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS body FROM v GROUP BY id),
p AS (
  SELECT id, conv_id, turn, level, min(pos) AS pos, lower(trim(regexp_replace(string_agg(rest, ' ' ORDER BY pos), '\s+', ' ', 'g'))) AS unit
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY id, level ORDER BY pos) AS island FROM v WHERE level > 0)
  GROUP BY id, conv_id, turn, level, island),
u AS (
  SELECT conv_id, turn, lower(trim(regexp_replace(unnest(list_distinct([body] || regexp_split_to_array(body, '\n[ \t]*\n') || string_split(body, chr(10)))), '\s+', ' ', 'g'))) AS unit
  FROM own JOIN m USING (id)),
o AS (SELECT conv_id, unit, min(turn) AS orig FROM u WHERE unit != '' GROUP BY ALL),
k AS (
  SELECT p.id, p.conv_id, p.turn, count(*) AS n_quotes, count(orig) AS n_linked, min(struct_pack(level := level, pos := pos, orig := orig)) FILTER (WHERE orig IS NOT NULL) AS best
  FROM p LEFT JOIN o ON p.conv_id = o.conv_id AND p.unit = o.unit AND orig < p.turn WHERE p.unit != '' GROUP BY ALL),
e AS (SELECT conv_id, turn, min(best.orig) AS parent FROM k WHERE best IS NOT NULL GROUP BY ALL),
t AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM e
  UNION ALL SELECT t.conv_id, t.turn, e.parent, t.depth + 1 FROM t JOIN e ON t.conv_id = e.conv_id AND t.root = e.turn),
r AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM t GROUP BY ALL),
x AS (
  SELECT m.conv_id, m.turn, m.role, k.best.orig AS reply_to, coalesce(r.root, m.turn) AS thread, coalesce(r.depth, 0)::INT AS depth,
         coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, body, '<|' || m.role || '|>' || chr(10) || body AS formatted
  FROM m JOIN own USING (id) LEFT JOIN k USING (id) LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, formatted) AS position FROM x
"""

#: quoted_replies' messages, then as above.
QUOTED_SQL = OP5_SQL.replace(
    "SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations)",
    "SELECT row_number() OVER () AS id, a.conv_id, a.turn, coalesce(a.role, 'user') AS role, "
    "coalesce('>> ' || replace(c.text, chr(10), chr(10) || '>> ') || chr(10), '') || "
    "coalesce('> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10), '') || chr(10) || a.text AS text "
    "FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn "
    "LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn + 2 = a.turn)",
)
