"""Conversation structure repair at least cost, by a lazily determinised weighted automaton.

A repaired conversation reads, by role initials, ``(s?(ua)+)?``. Edits of its rows cost: Keep 0, Rerole
(to user or assistant) 2, Delete 3, Insert (an empty user or assistant message) 2; rows that are blank or
repeat an earlier one must go, truncated rows that stay cost 1 more. The automaton of what was emitted so
far has four states (nothing, s, u, a). The vector of the costs still to come from each of them, less
its least one, is a state of the determinised automaton; its transitions by kind of row are worked out
when first met and kept in a table (``Table``), so a scan over the rows from the last to the first is a
look-up a row. Going back over the scan along tight arcs, taking the least letter at each step, spells
the edits: among cheapest edits those whose initials are least in ASCII order.

A conversation is cut into segments of at most ``SEGMENT`` rows. A segment's scans from each end state
give a four-by-four cost matrix; products of these along a conversation give every segment its right-hand
vector; segments are then traced from each state that they may be entered in, and the entries are chained.
So a conversation of any length is the work of many tasks; its matrices (a row per segment) and its audit
(a letter per row) meet in one value, its digest reads its rows in order as a stream.

Defined results: null roles and texts read as one space; rows are ordered by turn (nulls first), role and
text; a null conv_id is a conversation of its own; rows that repeat whole are duplicates of the first;
conversations all of whose rows are dropped have zeros; an empty table gives an empty result; further
columns are ignored whatever their names; texts may have any length.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rows a segment, a power of two.
SEGMENT = 1 << 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_NONE, _S, _U, _A = range(4)
#: The state after a user or assistant message, by state before it; None if there is no such step.
_NEXT = (_U, _U, _A, _U)
_FAR = 1 << 60
_SPACE = r"\x20\x09-\x0D"


def damage(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with the faults of the contract, by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 cuts ``.!?``, 3 repeats, 4 makes a user's."""
    told = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = told.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1)).alias("copies"))
    return hurt.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their place in order of conversation and turn, found by ranges, and ``seg``, their segment within the conversation."""
    order = ["conv_id", "turn", "role", "text", "uid"]
    told = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = told.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    pos = F.monotonically_increasing_id()
    return shared.save(dealt.select("conv_id", "turn", "role", "text", pos.alias("pos")), "turns").withColumn("seg", F.shiftright("pos", SEGMENT.bit_length() - 1))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` -> ``(conv_id, pos, seg, turn, initial, fault)``; ``fault`` is the first of blank, duplicate, truncated, or null."""
    same = F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text").cast("binary"))
    slim = rows.select(
        "conv_id", "pos", "seg", "turn", F.substring("role", 1, 1).alias("initial"), same.alias("same"),
        (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("open"),
    )
    first = slim.groupBy(F.col("conv_id").alias("__c"), F.col("same").alias("__s")).agg(F.min("pos").alias("first"))
    told = slim.join(first, slim["conv_id"].eqNullSafe(F.col("__c")) & (F.col("same") == F.col("__s")))
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    return told.select("conv_id", "pos", "seg", "turn", "initial", fault.alias("fault"))


def segments(told: DataFrame) -> DataFrame:
    """``(conv_id, seg, start, kinds)``: the rows of each segment as numbers; 0 to 3 for s, u, a or other, 4 more if a row must go, 8 more if it is truncated."""
    who = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")), F.lit(0)), F.lit(4)) - 1
    who = F.when(F.char_length("initial") == 0, 3).otherwise(who)
    kind = who + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    one = F.struct("pos", kind.cast("int").alias("kind"))
    g = told.groupBy("conv_id", "seg").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(one)).alias("rows"))
    return g.select("conv_id", "seg", "start", F.col("rows.kind").alias("kinds"))


def arcs(kind: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row of that kind in that state, but for Insert: ``(letter, cost, next state)``, letters in order."""
    out = [("D", DELETE, state)]
    if not kind & 4:
        more = TRUNCATED if kind & 8 else 0
        who = kind & 3
        if (who == 0 and state == _NONE) or (who in (1, 2) and _NEXT[state] == who + 1):
            out.append(("K", KEEP + more, who + 1))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


def closed(v: list[int]) -> list[int]:
    """Costs to come, with messages inserted first where that is cheaper."""
    for _ in range(3):
        v = [min(c, INSERT + v[_NEXT[x]]) for x, c in enumerate(v)]
    return v


class Table:
    """The determinised automaton: cost vectors less their least entry as states, transitions worked out when first met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}

    def state(self, v) -> tuple[int, int]:
        """Number of the state of a vector, and what was taken off."""
        least = min(v)
        key = tuple(min(c - least, _FAR) if c < _FAR else _FAR for c in v)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def move(self, state: int, kind: int) -> tuple[int, int]:
        """The state before a row of that kind, and the cost taken off."""
        got = self.moves.get((state, kind))
        if got is None:
            v = self.vectors[state]
            before = [min(cost + v[to] for _, cost, to in arcs(kind, x)) for x in range(4)]
            got = self.moves[state, kind] = self.state(closed(before))
        return got

    def scan(self, kinds, right) -> tuple[list[int], list[int]]:
        """From the last row to the first: the state before each row and behind the last, and the costs taken off up to there (from the right)."""
        at, cost = self.state(right)
        states, costs = [at], [cost]
        for kind in reversed(kinds):
            at, more = self.move(at, kind)
            cost += more
            states.append(at)
            costs.append(cost)
        return states[::-1], costs[::-1]

    def costs(self, kinds, right) -> list[int]:
        """Costs to come before the first row, by state."""
        states, costs = self.scan(kinds, right)
        return [costs[0] + c if c < _FAR else _FAR for c in self.vectors[states[0]]]

    def trace(self, kinds, right, entries) -> list[tuple[int, str] | None]:
        """For each entry state the state behind the last row, and the letters of the cheapest edits, the least by ASCII; None where no edits lead on."""
        states, costs = self.scan(kinds, right)
        out = []
        for x in entries:
            if self.vectors[states[0]][x] >= _FAR:
                out.append(None)
                continue
            letters = []
            for i, kind in enumerate(kinds):
                here, there, off = self.vectors[states[i]], self.vectors[states[i + 1]], costs[i] - costs[i + 1]
                while True:
                    tight = [(a, to) for a, c, to in arcs(kind, x) if there[to] < _FAR and here[x] + off == c + there[to]]
                    if here[_NEXT[x]] < _FAR and here[x] == INSERT + here[_NEXT[x]]:
                        tight.append(("I", _NEXT[x]))
                    letter, x = min(tight)
                    letters.append(letter)
                    if letter != "I":
                        break
            out.append((x, "".join(letters)))
        return out


#: Costs to come behind the last row: nothing or a whole number of turns is the end, anything else needs messages.
END = closed([0, _FAR, _FAR, 0])


def _tail(x: int) -> str:
    """Messages inserted behind the last row."""
    return "" if x in (_NONE, _A) else "I" + _tail(_NEXT[x])


def _illegal(initials: list[int]) -> int:
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))


def _arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(row as a dict) -> rows as tuples`` over all rows of ``df``, a few hundred at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(out)
        table = Table()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                got = [x for row in b.slice(k, 500).to_pylist() for x in work(table, row)]
                if got:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in got], schema=kind)

    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(schema)
    return df.mapInArrow(run, out)


def edits(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``told`` of ``faults`` -> ``(conv_id, cost, audit, illegal)`` and ``(conv_id, seg, start, done)``.

    ``done`` has for each row of the segment the initials of the messages inserted before it and then
    ``-`` if it goes, ``.`` if it stays, or its new role's initial; and last the messages behind it.
    """
    kind = told.schema["conv_id"].dataType.simpleString()
    cut = shared.save(segments(told), "segments")

    def matrix(table, r):
        rows = [table.costs(r["kinds"], [0 if y == x else _FAR for y in range(4)]) for x in range(4)]
        return [(r["conv_id"], r["seg"], [rows[y][x] for x in range(4) for y in range(4)])]

    def rights(table, r):
        v, out = END, []
        for s in reversed(r["all"]):
            out.append((r["conv_id"], s["seg"], v, s is r["all"][0], s is r["all"][-1]))
            m = s["m"]
            v = [min(m[4 * x + y] + v[y] for y in range(4)) for x in range(4)]
        return out

    def traced(table, r):
        got = table.trace(r["kinds"], r["right"], [0] if r["first"] else range(4))
        if r["last"]:
            got = [g and (g[0], g[1] + _tail(g[0])) for g in got]
        cost = table.costs(r["kinds"], r["right"])[0] if r["first"] else None
        who = [k & 3 for k in r["kinds"]]
        return [(r["conv_id"], r["seg"], r["start"], cost, [g[0] if g else -1 for g in got], [g[1] if g else None for g in got], _illegal(who), who[0], who[-1])]

    def chained(table, r):
        x, entries, letters, illegal, before = 0, [], [], 0, None
        for s in r["all"]:
            at = 0 if before is None else x
            entries.append((s["seg"], s["start"], x, s["letters"][at]))
            letters.append(s["letters"][at])
            illegal += s["illegal"] + (0 if before is None else _illegal([before, s["head"]]))
            x, before = s["exits"][at], s["tail"]
        return [(r["conv_id"], r["all"][0]["cost"], "".join(letters), illegal, [dict(zip(("seg", "start", "entry", "letters"), e, strict=True)) for e in entries])]

    def spelt(table, r):
        x, done, cur = r["entry"], [], ""
        roles = " sua"
        kinds = iter(r["kinds"])
        for letter in r["letters"]:
            if letter == "I":
                x = _NEXT[x]
                cur += roles[x]
                continue
            k = next(kinds)
            if letter == "K":
                x = (k & 3) + 1
            elif letter == "R":
                x = _NEXT[x]
            done.append(cur + {"D": "-", "K": "."}.get(letter, roles[x]))
            cur = ""
        return [(r["conv_id"], r["seg"], r["start"], [*done, cur])]

    ordered = lambda df, *c: df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", *c))).alias("all"))
    m = _arrow(cut.select("conv_id", "seg", "kinds"), matrix, f"conv_id {kind}, seg bigint, m array<bigint>")
    right = _arrow(ordered(m, "m"), rights, f"conv_id {kind}, seg bigint, right array<bigint>, first boolean, last boolean")
    same = cut["conv_id"].eqNullSafe(right["conv_id"]) & (cut["seg"] == right["seg"])
    t = _arrow(cut.join(right, same).select(cut["conv_id"], cut["seg"], "start", "kinds", "right", "first", "last"), traced, f"conv_id {kind}, seg bigint, start bigint, cost bigint, exits array<int>, letters array<string>, illegal bigint, head int, tail int")
    chain = _arrow(ordered(t, "start", "cost", "exits", "letters", "illegal", "head", "tail"), chained, f"conv_id {kind}, cost bigint, audit string, illegal bigint, entries array<struct<seg:bigint,start:bigint,entry:int,letters:string>>")
    chain = shared.save(chain, "edits")
    e = chain.select(F.col("conv_id").alias("__c"), F.explode("entries").alias("e")).select("__c", F.col("e.seg").alias("__s"), "e.entry", "e.letters")
    pieces = cut.join(e, cut["conv_id"].eqNullSafe(F.col("__c")) & (cut["seg"] == F.col("__s"))).select("conv_id", "seg", "start", "kinds", "entry", "letters")
    return chain.drop("entries"), _arrow(pieces, spelt, f"conv_id {kind}, seg bigint, start bigint, done array<string>")


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` and their edits -> ``(conv_id, pos, nth, role, text)``, the messages of repaired conversations; ``pos`` and ``nth`` give their order."""
    d = done.select(F.col("conv_id").alias("__c"), F.col("seg").alias("__s"), "start", "done")
    at = (F.col("pos") - F.col("start")).cast("int")
    told = rows.join(d, rows["conv_id"].eqNullSafe(F.col("__c")) & (rows["seg"] == F.col("__s"))).select("conv_id", "pos", "role", "text", F.element_at("done", at + 1).alias("do"), F.when(at == F.size("done") - 2, F.element_at("done", -1)).otherwise("").alias("behind"))
    full = lambda x: F.when(x == "u", "user").otherwise("assistant")
    inserted = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(full(x).alias("role"), F.lit("").alias("text")))
    op = F.right("do", F.lit(1))
    own = F.array(F.struct(F.when(op == ".", F.col("role")).otherwise(full(op)).alias("role"), F.col("text").alias("text")))
    before = F.substring("do", F.lit(1), F.char_length("do") - 1)
    lines = F.concat(inserted(before), F.when(op == "-", F.slice(own, 1, 0)).otherwise(own), inserted(F.col("behind")))
    return told.select("conv_id", "pos", F.posexplode(lines).alias("nth", "x")).select("conv_id", "pos", "nth", "x.role", "x.text")


def digests(messages: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines; a task reads its conversations in order as a stream."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    dealt = messages.select("conv_id", "pos", "nth", line).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth")

    def run(batches):
        cur, sha = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([cur], pa_kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

        pa_kind = None
        for b in batches:
            pa_kind, done = b.schema.field(0).type, []
            for c, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if sha is None or c != cur:
                    if sha is not None:
                        done.append((cur, sha.hexdigest()))
                    cur, sha = c, hashlib.sha256(text)
                else:
                    sha.update(b"\n" + text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa_kind), pa.array([x for _, x in done])], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield told()

    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each of ``convs(conv_id)``: counts of the faults of its ``rows``, the least cost, the audit of the edits and the digest of the repaired conversation."""
    placed = numbered(rows)
    told = shared.save(faults(placed), "faults")
    counts = told.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = told.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    chain, done = edits(told)
    sha = digests(repaired(placed, done))
    # one grouping in place of four joins; each part has a conversation once
    parts = [convs.select("conv_id").distinct(), counts, turns, chain, sha]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 12 over the whole of ``conversations``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return report(rows.select("conv_id"), damage(rows))
