"""Operator 11, conversation structure repair: bidirectional Dijkstra over the
edit lattice.

A conversation's role initials must read ``(s?(ua)+)?``. A lattice node is (rows
read, state of that pattern); its edges are the edits: keep a row, give it the
role the state asks for, delete it, or insert a row of that role with an empty
text. A forward heap starts at (0, start), a backward heap at the accepting ends;
each node is settled with its least cost and, among those, its least audit. Once
the two tops add up to more than the best crossing, all crossings of that cost
are known, and the least audit over them is taken.

Rows are dealt out by ranges of (conversation, turn, role, text's first
characters, place), so a conversation of any length is cut into pieces of
``PIECE`` rows. A conversation inside one range is searched as a whole. For the
others each piece is searched from every state to every state; then the pieces'
costs are chained in order: prefixes that end on a row's edit are never prefixes
of each other, so their order is carried as a rank and no text is moved. Only the
costs, the audits and at last the hash of a cut conversation pass through one
task, as a stream.

Defined results: rows go by turn (nulls first), role, the first 256 characters of
the text, and place in the table; a null role or text is one blank; a null conv_id
is a conversation of its own; any other role can't be kept; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from opslens.llm.common import stage

PIECE = 256             # rows of a conversation searched together, where it is cut
PIECE_CHARS = 1 << 20   # and characters, or one row
HEAD = 256              # characters of a text that order rows of one turn and role

#: States of the pattern (0 start, 1 after s, 2 after u, 3 after a)
#: and where a row of each initial leads.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
RIGHT = {0: 2, 1: 2, 2: 3, 3: 2}       # where a row of the role asked for leads
ROLE = {2: "user", 3: "assistant"}     # and that role, by the state after it
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

_SOLID = re.compile(r"[^\x20\x09-\x0D]")


# --------------------------------------------------------------- the lattice

def search(rows: list[tuple[str, int]], start: int, goals: tuple[int, ...], closing: bool) -> tuple[int, str] | None:
    """Least cost from (0, start) to (len(rows), any of goals) and the least
    audit of that cost. ``rows``: (role initial, fault). ``closing``: rows may
    be inserted after the last."""
    n = len(rows)

    def row_edits(initial: str, fault: int, s: int):
        """(cost, letter, state after) of the edits of one row."""
        yield DELETE, "D", s
        if fault in (BLANK, DUPLICATE):
            return
        more = CUT_SHORT if fault == TRUNCATED else 0
        if (s, initial) in STEP:
            yield more, "K", STEP[s, initial]
        yield more + REROLE, "R", RIGHT[s]

    def onward(i: int, s: int):
        if i < n:
            for cost, letter, t in row_edits(*rows[i], s):
                yield cost, letter, i + 1, t
        if i < n or closing:
            yield INSERT, "I", i, RIGHT[s]

    def back(i: int, t: int):
        for s in range(4):
            if i:
                for cost, letter, u in row_edits(*rows[i - 1], s):
                    if u == t:
                        yield cost, letter, i - 1, s
            if (i < n or closing) and RIGHT[s] == t:
                yield INSERT, "I", i, s

    best = (0, "") if n == 0 and start in goals else None
    # of equal costs, nodes go in the order of the rows: keeping a row costs nothing
    ahead = [(0, 0, "", start)]
    behind = [(0, -n, "", s) for s in goals]
    heapq.heapify(behind)
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    reaching: dict[tuple[int, int], tuple[int, str]] = {}

    def forward():
        nonlocal best
        cost, i, audit, s = heapq.heappop(ahead)
        if (i, s) in reached:
            return
        reached[i, s] = cost, audit
        for more, letter, j, t in onward(i, s):
            end = reaching.get((j, t))
            if end is not None:
                found = cost + more + end[0], audit + letter + end[1]
                best = found if best is None else min(best, found)
            if (j, t) not in reached:
                heapq.heappush(ahead, (cost + more, j, audit + letter, t))

    def backward():
        nonlocal best
        cost, i, audit, t = heapq.heappop(behind)
        i = -i
        if (i, t) in reaching:
            return
        reaching[i, t] = cost, audit
        for more, letter, j, s in back(i, t):
            begin = reached.get((j, s))
            if begin is not None:
                found = begin[0] + more + cost, begin[1] + letter + audit
                best = found if best is None else min(best, found)
            if (j, s) not in reaching:
                heapq.heappush(behind, (cost + more, -j, letter + audit, s))

    for _ in goals:  # the goals themselves
        backward()
    while ahead or behind:
        low = ahead[0][0] if ahead else float("inf")
        high = behind[0][0] if behind else float("inf")
        if best is not None and low + high > best[0]:
            break
        if low <= high:
            forward()
        else:
            backward()
    return best


def between(rows: list[tuple[str, int]]) -> list[tuple[int, str] | None]:
    """Cost and audit of a piece from each state to each state, row by row of a
    4 x 4 table; a piece ends with its last row's edit."""
    return [search(rows, s, (t,), False) for s in range(4) for t in range(4)]


def apply_audit(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The rows (role, text) that the audit's edits leave, from a state on."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            row = rows[i]
            state = STEP[state, row["role"][:1]]
        else:
            state = RIGHT[state]
            row = {"role": ROLE[state], "text": rows[i]["text"] if letter == "R" else ""}
        out.append({"role": row["role"], "text": row["text"]})
        i += letter != "I"
    return out


# --------------------------------------------------------------- pass by rows

_ROW = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


class _Piece:
    """Rows of one conversation that stand together, and what is counted of them."""

    def __init__(self):
        self.rows, self.marks, self.chars = [], [], 0
        self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = None
        self.first = self.last = None
        self.counts = [0, 0, 0, 0]

    def add(self, turn, role, text, again):
        solid = _SOLID.search(text) is not None
        fault = BLANK if not solid else DUPLICATE if again else TRUNCATED if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else NONE
        initial = role[:1]
        self.rows.append({"role": role, "text": text})
        self.marks.append((initial, fault))
        self.chars += len(text)
        if fault:
            self.counts[fault - 1] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts[3] += 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:  # turns ascend
            if turn != self.last_turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.first_turn = self.low
            self.high = self.last_turn = turn


def _schema(conv: StructField) -> StructType:
    long = LongType()
    return StructType([
        StructField("conv_id", conv.dataType), StructField("part", IntegerType()), StructField("seq", long), StructField("open", BooleanType()),
        StructField("low", long), StructField("high", long), StructField("turns", long),
        *[StructField(c, long) for c in _COUNTS], StructField("first", StringType()), StructField("last", StringType()),
        StructField("costs", ArrayType(long)), StructField("audits", ArrayType(StringType())), StructField("rows", _ROW)])


def _read_pieces(schema: StructType, most: int):
    """Rows in order -> pieces; those of a partition's first and last
    conversation, and of one with several, are open."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def read(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq, out, held, now, conversations = 0, [], [], None, 0

        def record(conv, piece, is_open):
            nonlocal seq
            if is_open:
                found = between(piece.marks)
                costs, audits = [f[0] if f else None for f in found], [f[1] if f else None for f in found]
                rows = piece.rows
            else:
                cost, audit = search(piece.marks, 0, ENDS, True)
                costs, audits, rows = [cost], [audit], apply_audit(piece.rows, audit, 0)
            seq += 1
            out.append({"conv_id": conv, "part": part, "seq": seq, "open": is_open, "low": piece.low, "high": piece.high, "turns": piece.turns,
                        **dict(zip(_COUNTS, piece.counts)), "first": piece.first, "last": piece.last, "costs": costs, "audits": audits, "rows": rows})

        def batch_of():
            made = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return made

        for batch in batches:
            for conv, turn, role, text, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "again"))):
                if now is None or conv != now[0]:
                    for k, piece in enumerate(held):
                        record(now[0], piece, conversations == 1 or len(held) > 1 or now[1])
                    now, held, conversations = (conv, False), [_Piece()], conversations + 1
                elif len(held[-1].rows) >= most or held[-1].chars > PIECE_CHARS:
                    if len(held) > 1 or now[1]:  # what is before is open in any case
                        record(conv, held.pop(0), True)
                        now = (conv, True)
                    held.append(_Piece())
                held[-1].add(turn, role, text, again)
                if len(out) >= 512:
                    yield batch_of()
        for piece in held:
            record(now[0], piece, True)
        if out:
            yield batch_of()
    return read


def _chain(conv_type):
    """Open pieces by conversation, in order -> each piece's audit and state, with
    the numbers of its conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_chain_schema())

    def solve(pieces):
        states = {0: (0, 0)}  # state -> (cost, rank of its audit)
        steps = []
        for p in pieces:
            ends = {}
            for t in range(4):
                ways = [(c + p["costs"][4 * s + t], rank, s) for s, (c, rank) in states.items() if p["costs"][4 * s + t] is not None]
                if ways:
                    cost, rank, s = min(ways)
                    ends[t] = cost, rank, s, p["audits"][4 * s + t]
            order = sorted(ends, key=lambda t: (ends[t][1], ends[t][3]))
            steps.append({t: (e[2], e[3]) for t, e in ends.items()})
            states = {t: (ends[t][0], order.index(t)) for t in ends}
        close = {0: "", 3: "", 2: "I", 1: "II"}
        cost, _, state = min((c + INSERT * len(close[s]), rank, s) for s, (c, rank) in states.items())
        tail, audits = close[state], []
        for step in reversed(steps):
            before, audit = step[state]
            audits.append((before, audit + tail))
            state, tail = before, ""
        counts = {c: sum(p[c] for p in pieces) for c in _COUNTS}
        turns, last_turn = 0, None
        for a, b in zip(pieces, pieces[1:]):
            counts["illegal"] += a["last"] + b["first"] not in LEGAL
        for p in pieces:
            turns += p["turns"] - (p["low"] is not None and p["low"] == last_turn)
            last_turn = p["high"] if p["high"] is not None else last_turn
        lows = [p["low"] for p in pieces if p["low"] is not None]
        gaps = last_turn - lows[0] + 1 - turns if lows else 0
        return [{"part": p["part"], "seq": p["seq"], "piece": k, "n_pieces": len(pieces), "gaps": gaps, **counts,
                 "cost": cost, "audit": audit, "state": state}
                for k, (p, (state, audit)) in enumerate(zip(pieces, reversed(audits)))]

    def chain(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is not None and r["conv_id"] != now[0]:
                    out += solve(held)
                    held = []
                now = (r["conv_id"],)
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(solve(held), schema=arrow)
    return chain


def _chain_schema() -> StructType:
    long = LongType()
    return StructType([StructField("part", IntegerType()), StructField("seq", long), StructField("piece", long), StructField("n_pieces", long),
                       StructField("gaps", long), *[StructField(c, long) for c in _COUNTS], StructField("cost", long),
                       StructField("audit", StringType()), StructField("state", IntegerType())])


# ------------------------------------------------------------------ operator

def repair(conversations: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one row a piece of each conversation:
    conv_id, piece (from 0), n_pieces, gaps, blank, duplicate, truncated, illegal,
    cost (of the whole conversation), audit and repaired (role, text) of the piece.
    """
    filled = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                                  F.coalesce("text", F.lit(" ")).alias("text"))
    rows = stage(filled.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", F.sha2("text", 256)), "turns")
    # a text said again: all but the first of its conversation and role
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    firsts = rows.groupBy("conv_id", "role", "key").agg(F.min(place).alias("p"), F.count("*").alias("c")).where("c > 1") \
        .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("key").alias("_k"), F.col("p.uid").alias("_u"))
    marked = rows.join(firsts, rows["conv_id"].eqNullSafe(firsts["_c"]) & (rows["role"] == firsts["_r"]) & (rows["key"] == firsts["_k"]), "left") \
        .select("conv_id", "turn", "role", "text", "uid", F.coalesce(F.col("_u") != F.col("uid"), F.lit(False)).alias("again"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, HEAD), F.col("uid")]
    schema = _schema(conversations.schema["conv_id"])
    pieces = stage(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_read_pieces(schema, piece_rows), schema), "pieces")
    whole = pieces.where("NOT open").select(
        "conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("n_pieces"),
        F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).cast("long").alias("gaps"), *_COUNTS,
        F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("rows").alias("repaired"))
    cut = pieces.where("open")
    chained = stage(cut.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
                    .mapInArrow(_chain(schema["conv_id"].dataType), _chain_schema()), "chain")

    @F.arrow_udf(_ROW)
    def applied(rows: pa.Array, audit: pa.Array, state: pa.Array) -> pa.Array:
        return pa.array([apply_audit(r, a, s) for r, a, s in zip(rows.to_pylist(), audit.to_pylist(), state.to_pylist())], rows.type)

    joined = cut.select("conv_id", "part", "seq", "rows").join(chained, ["part", "seq"]).select(
        "conv_id", "piece", "n_pieces", "gaps", *_COUNTS, "cost", "audit", applied("rows", "audit", "state").alias("repaired"))
    return whole.unionByName(joined)


def lines(repaired: Column) -> Column:
    """``role:text`` of each repaired row."""
    return F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"]))


def _fold(schema: StructType):
    """Pieces in order -> one row a conversation: audit and hash, as a stream."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = ["conv_id", "gaps", *_COUNTS, "cost"]

    def fold(batches):
        now, audit, digest, some = None, [], None, False

        def done():
            return pa.RecordBatch.from_pylist([{**now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if r["piece"] == 0:
                    if now is not None:
                        yield done()
                    now, audit, digest, some = {c: r[c] for c in names}, [], hashlib.sha256(), False
                audit.append(r["audit"])
                for line in r["lines"]:
                    digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                    some = True
        if now is not None:
            yield done()
    return fold


def digest(pieces: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row for each of ``conv_ids``: counts, cost, audit, repaired_sha256."""
    pieces = stage(pieces, "repaired")
    columns = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    one = pieces.where("n_pieces = 1").withColumn("repaired_sha256", F.sha2(F.array_join(lines(F.col("repaired")), "\n"), 256)).select(columns)
    many = pieces.where("n_pieces > 1").withColumn("lines", lines(F.col("repaired"))).drop("repaired")
    folded = many.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_fold(one.schema), one.schema)
    found = one.unionAll(folded).withColumnRenamed("conv_id", "_id")
    ids = conv_ids.select("conv_id").distinct()
    zero = {**{c: F.lit(0).cast("long") for c in ["gaps", *_COUNTS, "cost"]}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.join(found, ids["conv_id"].eqNullSafe(found["_id"]), "left") \
        .select("conv_id", *[F.coalesce(F.col(c), zero[c]).alias(c) for c in columns[1:]])


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's faults by crc32 of ``conv_id:turn``: a row dropped, its
    text emptied, its sentence ends removed, the row repeated, its role user."""
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", kind.alias("_kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text")).where("_kind <> 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .select("conv_id", "turn", "role", "text")
