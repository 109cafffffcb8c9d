"""Chat formatting from event logs, in DataFrame operations only.

``fold`` rebuilds messages from an event-sourced log ``(conv_id, seq, op, turn, role, text)``: ``message``
and ``edit`` set a turn's text, ``delta`` appends to it, ``regenerate`` empties it and removes the turns
after it that existed then. ``render`` turns messages into training text with a loss mask; ``parse``
reads rendered text back.

A conversation is rendered in pieces of ``PIECE`` turn numbers, one row each, in order; a very long
conversation is therefore many rows, gathered by many tasks, and offsets of the mask count from the
start of their piece. Only a digest over a whole conversation brings its pieces together.

The template marks a turn as ``<s>[INST]role[/INST]text</s>``. Inside roles and texts the control strings
``<s> </s> [INST] [/INST]`` get a backslash code for their first character, and a backslash itself
is coded as well, so no text can end a turn and every text comes back as it was.

Defined results: a null text or role is empty; a null turn or sequence number comes first; ties are
ordered by role and text; repeated rows are turns of their own (in ``fold``: events applied again); a
conversation without messages is not rendered; an empty table gives an empty result; a null conv_id is
a conversation of its own; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PIECE = 64
LEARNED = "assistant"
_OPEN, _MID, _END = "<s>[INST]", "[/INST]", "</s>"


def escape(text) -> F.Column:
    """Code backslashes and the first character of control strings."""
    t = F.replace(text, F.lit("\\"), F.lit("\\s"))
    t = F.regexp_replace(t, r"<(/?s>)", r"\\l$1")
    return F.regexp_replace(t, r"\[(/?INST\])", r"\\b$1")


def unescape(text) -> F.Column:
    """The inverse of ``escape``: after coding, a backslash only ever starts a code."""
    t = F.replace(text, F.lit("\\l"), F.lit("<"))
    t = F.replace(t, F.lit("\\b"), F.lit("["))
    return F.replace(t, F.lit("\\s"), F.lit("\\"))


def _alive(events: DataFrame) -> DataFrame:
    """``events`` without those of turns that a later event of the conversation cuts off.

    The events are dealt by ranges of conversation and sequence, so a long conversation is many tasks'
    work: each looks at its own range and takes over the least turn that later ranges regenerate.
    """
    dealt = shared.save(events.repartitionByRange("conv_id", "seq").withColumn("part", F.spark_partition_id()), "ranges")
    turn = F.when(F.col("op") == "regenerate", F.col("turn"))
    per = dealt.groupBy("conv_id", "part").agg(F.min(turn).alias("m"))
    after = per.withColumn("beyond", F.min("m").over(Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)))
    after = after.where("beyond is not null").select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), "beyond")
    later = Window.partitionBy("conv_id", "part").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("cut", F.min(turn).over(later))
    both = near.join(after, near["conv_id"].eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")), "left")
    return both.withColumn("cut", F.least("cut", "beyond")).where("cut is null or turn is null or cut >= turn").select(*events.columns)


def fold(events: DataFrame) -> DataFrame:
    """``events(conv_id, seq, op, turn, role, text)`` -> ``(conv_id, turn, role, text)``, final messages.

    A further column ``nth`` tells apart the messages that share a turn number; without it there are none.
    A turn's text is that of its last setting event, in order of sequence, role and text, with the later
    deltas; events of equal sequence set first and append then.
    """
    nth = F.col("nth") if "nth" in events.columns else F.lit(0)
    e = events.select(
        "conv_id", F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), "op", F.col("turn").cast("long").alias("turn"), nth.cast("long").alias("nth"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    again = shared.save(e.where("op = 'regenerate'").select(F.col("conv_id").alias("__c")).distinct(), "regenerated")
    if not again.isEmpty():
        same = e["conv_id"].eqNullSafe(again["__c"])
        e = e.join(again, same, "left_anti").unionByName(_alive(e.join(again, same, "left_semi")))
    # the last role, which an edit need not repeat
    role = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"]
    one = F.struct("seq", (F.col("op") == "delta").alias("after"), F.coalesce("role", F.lit("")).alias("role"), "text")
    turns = e.groupBy("conv_id", "turn", "nth").agg(role.alias("role"), F.array_sort(F.collect_list(one)).alias("parts"))
    since = F.greatest(F.array_max(F.transform("parts", lambda p, i: F.when(p["after"], 0).otherwise(i + 1))), F.lit(1))
    kept = F.slice("parts", since, F.size("parts"))
    return turns.select("conv_id", "turn", "role", F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"))


def log(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` as an event log for ``fold``: every row is a message with the first half of its text, and a delta that streams the rest."""
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    told = messages.select("conv_id", "turn", "role", "text", F.row_number().over(w).alias("nth")).withColumn("seq", 2 * F.monotonically_increasing_id())
    half = F.when(F.char_length("text") > 1, F.floor(F.char_length("text") / 2).cast("int")).otherwise(F.char_length("text"))
    events = F.array(
        F.struct(F.lit("message").alias("op"), F.col("role"), F.substring("text", F.lit(1), half).alias("text"), F.col("seq")),
        F.struct(F.lit("delta").alias("op"), F.lit(None).cast("string").alias("role"), F.substring("text", half + 1, F.char_length("text")).alias("text"), (F.col("seq") + 1).alias("seq")),
    )
    return told.select("conv_id", "turn", "nth", F.explode(F.when(F.char_length("text") > 1, events).otherwise(F.slice(events, 1, 1))).alias("e")).select("conv_id", "turn", "nth", "e.*")


def render(messages: DataFrame, learned: str = LEARNED, piece: int = PIECE) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` -> ``(conv_id, piece, formatted, loss)``; ``loss`` is an array of (start, length)."""
    m = messages.select("conv_id", F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / piece).alias("piece"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("body", escape("text"))
    m = m.withColumn("head", F.concat(F.lit(_OPEN), escape("role"), F.lit(_MID)))
    one = F.struct("turn", "role", "text", F.concat("head", "body", F.lit(_END)).alias("part"), F.char_length("head").alias("before"), F.char_length("body").alias("length"), (F.col("role") == learned).alias("loss"))
    rows = m.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc, t):
        span = F.struct((acc["at"] + t["before"]).alias("start"), t["length"].alias("length"))
        spans = F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + t["before"] + t["length"] + len(_END)).alias("at"), spans.alias("spans"))

    return rows.select(
        "conv_id", "piece", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), F.aggregate("turns", zero, add)["spans"].alias("loss")
    )


def parse(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns``, an array of (role, text), and ``learned``, the texts under the mask, both unescaped."""
    whole = F.slice(F.split("formatted", _END, -1), 1, F.size(F.split("formatted", _END, -1)) - 1)

    def turn(p):
        at = F.instr(p, F.lit(_MID))
        return F.struct(unescape(F.substring(p, F.lit(len(_OPEN) + 1), at - len(_OPEN) - 1)).alias("role"), unescape(F.substring(p, at + len(_MID), F.char_length(p))).alias("text"))

    spans = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return rendered.withColumn("turns", F.transform(whole, turn)).withColumn("learned", spans)


def digests(rendered: DataFrame) -> DataFrame:
    """Contract columns of each conversation, from rendered pieces."""
    p = parse(rendered).select(
        "conv_id", "piece", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("learned", "").alias("learned"),
    )
    g = p.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.char_length("learned")).alias("loss_chars"), F.array_sort(F.collect_list(F.struct("piece", "turns", "learned"))).alias("pieces"))
    joined = lambda c: F.sha2(F.array_join(F.transform("pieces", lambda x: x[c]), "").cast("binary"), 256)
    return g.select("conv_id", "n_turns", joined("turns").alias("turns_sha256"), "loss_chars", joined("learned").alias("loss_sha256"), "formatted_chars")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over the whole of ``conversations`` and conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql("select -1L as conv_id, t.* from values (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') as t(turn, role, text)")
    return digests(shared.save(render(fold(log(rows.unionByName(extra)))), "chat"))


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded as (
  select *, length(text) + length(text) - length(replace(text, chr(92), ''))
    + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\[/?INST\]')) as n,
    length(role) + length(role) - length(replace(role, chr(92), ''))
    + len(regexp_extract_all(role, '</?s>')) + len(regexp_extract_all(role, '\[/?INST\]')) as r
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + r + 20) as bigint) as formatted_chars
from coded group by conv_id
"""
