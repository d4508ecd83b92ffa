"""Repair of the turn structure of conversations by the cheapest edits, as a rank-compressed dynamic program.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``. Each row is kept (0), given
the role user or assistant (2) or deleted (3, which blank rows and duplicates require), empty
turns of user or assistant are inserted anywhere (2), and a truncated row that stays adds 1. Of
the cheapest edits those whose initials, D, I, K, R, read least in ASCII are taken.

What is done to a row is one macro edit: a run of inserts and then the row's own edit. Their
codes (D, ID, …, R) are prefix-free and ordered, so of two different strings of equally many
codes neither starts the other: which is less shows at the first code that differs. So no
string is kept. After each row a state (start, system, user, assistant) holds its cost and the
rank of its string among the states, and a pointer to the state and code it came from; the
cheapest end is followed back afterwards. Runs of over two inserts never pay, and states of
which the cost is more than ``SLACK`` above the least never win, so that layers, up to their least cost, are few and
steps between them are remembered.

Rows are dealt by range of (conversation, turn, role, hash of the text), so that a conversation
of any size spans tasks, and numbered in that order. Pieces of at most ``PIECE`` rows of one conversation are
each reduced to what a conversation needs of them: from each state to each state the cost and
the rank. A conversation joins its pieces' tables, a hundred bytes for ``PIECE`` rows, and tells each the states it
begins and ends with; each then finds its own edits. Only hashes and flags enter this; texts
are fetched for the repaired rows.

Edge cases: a null role or text counts as one space; a null turn comes before all others, a
null conv_id is a conversation of its own. Rows tied in turn are taken by role, then by the hash of their
text; of equal rows all but the first are duplicates. Very long texts are hashed, not compared. Empty tables give
empty results. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import id_of, stored

START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that is inserted in a state, or that a row is made, and the state after it.
TURN, AFTER = "uuau", (USER, USER, ASSISTANT, USER)
LEGAL = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: From any state the rest costs at most so much more than from any other.
SLACK = 7
PIECE_BITS = 12
PIECE = 1 << PIECE_BITS
KEY = ["no_id", "id"]
FULL_ROLE = {"u": "user", "a": "assistant"}


# ------------------------------------------------------------------ the program


@cache
def macros(kind: str) -> dict[tuple[int, int], tuple[int, int]]:
    """(cost, number of the code) of the best macro edit between two states; kind: a role's initial or o, upper case if truncated, x if the row must go."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for begin in range(4):
        state = begin
        for run in range(3):
            edits = [("D", state, 3)]
            if kind != "x":
                edits.append(("R", AFTER[state], 2 + kind.isupper()))
                if kind.lower() in LEGAL[state]:
                    edits.append(("K", LEGAL[state][kind.lower()], int(kind.isupper())))
            for edit, end, cost in edits:
                found = (2 * run + cost, CODES.index("I" * run + edit))
                out[begin, end] = min(found, out.get((begin, end), found))
            state = AFTER[state]
    return out


def _layer(best: list) -> tuple[tuple, int, tuple]:
    """From (cost, rank, step, parent) of each state: the layer above its least cost, that cost, and (parent, step) of each state."""
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] <= least + SLACK else None for b in best]
    ranks = {x: i for i, x in enumerate(sorted(b[1:3] for b in best if b))}
    return tuple(b and (b[0] - least, ranks[b[1:3]]) for b in best), least, tuple(b and (b[3], b[2]) for b in best)


@lru_cache(1 << 16)
def step(layer: tuple, kind: str) -> tuple[tuple, int, tuple]:
    best: list = [None] * 4
    for (begin, end), (cost, code) in macros(kind).items():
        if layer[begin]:
            found = (layer[begin][0] + cost, layer[begin][1], code, begin)
            best[end] = min(found, best[end] or found)
    return _layer(best)


def only(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def run(layer: tuple, kinds: str) -> tuple[tuple, int]:
    total = 0
    for kind in kinds:
        layer, least, _ = step(layer, kind)
        total += least
    return layer, total


def summary(kinds: str) -> list[int]:
    """From each state: the least cost, then cost above it (-1: none) and rank of each state at the end."""
    out = []
    for begin in range(4):
        layer, total = run(only(begin), kinds)
        out += [total, *(x for s in layer for x in (s or (-1, -1)))]
    return out


def join(layer: tuple, piece: list[int]) -> tuple[tuple, int, tuple]:
    """The layer after a piece, from its summary."""
    best: list = [None] * 4
    for begin in range(4):
        if layer[begin]:
            total, *ends = piece[9 * begin : 9 * begin + 9]
            for end in range(4):
                if ends[2 * end] >= 0:
                    found = (layer[begin][0] + total + ends[2 * end], layer[begin][1], ends[2 * end + 1], begin)
                    best[end] = min(found, best[end] or found)
    return _layer(best)


#: What a state still needs at the end of a conversation.
TAIL = ("", "II", "I", "")


def choose(pieces: list[list[int]]) -> tuple[list[tuple[int, int]], str, int]:
    """The states each piece begins and ends with, the inserts at the end, the cost."""
    layer, cost, back = only(START), 0, []
    for piece in pieces:
        layer, least, parents = join(layer, piece)
        cost += least
        back.append(parents)
    extra, _, state = min((s[0] + 2 * len(TAIL[q]), s[1], q) for q, s in enumerate(layer) if s)
    tail, spans = TAIL[state], []
    for parents in reversed(back):
        begin = parents[state][0]
        spans.append((begin, state))
        state = begin
    return spans[::-1], tail, cost + extra


def retrace(kinds: str, begin: int, end: int, tail: str = "") -> list[tuple[str, str]]:
    """(code, the role's initial that each of its edits leaves: a dot for deleted, a dash for kept) of each row, and of the tail."""
    layer, back = only(begin), []
    for kind in kinds:
        layer, _, parents = step(layer, kind)
        back.append(parents)
    codes, state = [], end
    for parents in reversed(back):
        state, code = parents[state]
        codes.append(CODES[code])
    out = []
    for kind, code in zip(kinds + "x" * bool(tail), codes[::-1] + [tail] * bool(tail), strict=True):
        roles = ""
        for edit in code:
            if edit == "D":
                roles += "."
            elif edit == "K":
                roles, state = roles + "-", LEGAL[state][kind.lower()]
            else:
                roles, state = roles + TURN[state], AFTER[state]
        out.append((code, roles))
    return out


# -------------------------------------------------------------------- the tables


@dataclass
class Repair:
    """rows: the conversations' rows, numbered in order (``pos``), with their first fault. edits: a macro edit for each row, and at the
    end (place 1) what a conversation still needs. totals: cost and illegal neighbours of each conversation that has rows."""

    rows: DataFrame
    edits: DataFrame
    totals: DataFrame


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows numbered in order, dealt by range whatever a conversation's size, with flags and hashes beside the texts."""
    c, space = conversations, F.lit(" ")
    role, text = F.coalesce(c["role"].cast("string"), space), F.coalesce(c["text"].cast("string"), space)
    rows = c.select(
        c["conv_id"].isNull().alias("no_id"), F.coalesce(c["conv_id"].cast("long"), F.lit(0).cast("long")).alias("id"), c["turn"].cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_at"),
    )
    order = ["no_id", "id", "turn", "role", "_h", "_at"]
    core = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise(F.lit("o"))
    # equal keys would share a range: _at parts rows that repeat
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select(
        "no_id", "id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("and"), "role", "text").alias("h2"),
        initial.alias("initial"), (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Beside rows of ``ordered``, without texts: the first fault of each, blank, duplicate or truncated, or null."""
    light = rows.select(*KEY, "turn", "pos", "h1", "h2", "initial", "blank", "open_end")
    said = [*KEY, "h1", "h2"]
    again = light.where("not blank").groupBy(*said).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open_end"), "truncated")
    return light.join(again, said, "left").select(*KEY, "turn", "pos", "initial", fault.alias("fault"))


def _mapped(f, schema: pa.Schema):
    """A mapInArrow function from f(row as a dict) -> dicts."""

    def over(batches):
        for batch in batches:
            held = []
            for row in batch.to_pylist():
                held += f(row)
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return over


_ID = [("no_id", pa.bool_()), ("id", pa.int64())]
_ID_SQL = "no_id boolean, id long"


def _summarised(row: dict) -> list[dict]:
    kinds, initials = row["kinds"], row["initials"]
    illegal = sum(pair not in ("su", "ua", "au") for pair in map(str.__add__, initials[:-1], initials[1:]))
    return [{k: row[k] for k in ("no_id", "id", "piece")} | {"summary": summary(kinds), "illegal": illegal, "ends": initials[0] + initials[-1]}]


def _chosen(row: dict) -> list[dict]:
    pieces = row["pieces"]
    spans, tail, cost = choose([p["summary"] for p in pieces])
    illegal = sum(p["illegal"] for p in pieces) + sum(a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(pieces, pieces[1:], strict=False))
    last, own = len(pieces) - 1, {k: row[k] for k in ("no_id", "id")}
    return [own | {"piece": p["piece"], "begin": b, "end": e, "tail": tail if i == last else "", "cost": 0 if i else cost, "illegal": 0 if i else illegal} for i, (p, (b, e)) in enumerate(zip(pieces, spans, strict=True))]


def _retraced(row: dict) -> list[dict]:
    n, own = len(row["kinds"]), {k: row[k] for k in ("no_id", "id")}
    edits = retrace(row["kinds"], row["begin"], row["end"], row["tail"])
    return [own | {"pos": row["start"] + min(i, n - 1), "place": i // n, "code": code, "roles": roles} for i, (code, roles) in enumerate(edits)]


def repair(conversations: DataFrame) -> Repair:
    """The cheapest repair of conversations(conv_id, turn, role, text)."""
    texts = stored(ordered(conversations))
    rows = stored(with_faults(texts))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    flagged = rows.select(*KEY, "pos", F.shiftrightunsigned("pos", PIECE_BITS).alias("piece"), kind.alias("kind"), "initial")
    # at most PIECE rows of a conversation share a piece; their numbers are consecutive
    pieces = flagged.groupBy(*KEY, "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "initial"))).alias("rows"))
    pieces = stored(pieces.select(*KEY, "piece", F.expr("rows[0].pos").alias("start"), F.array_join("rows.kind", "").alias("kinds"), F.array_join("rows.initial", "").alias("initials")))
    schema = pa.schema([*_ID, ("piece", pa.int64()), ("summary", pa.list_(pa.int64())), ("illegal", pa.int64()), ("ends", pa.string())])
    summed = pieces.mapInArrow(_mapped(_summarised, schema), f"{_ID_SQL}, piece long, summary array<long>, illegal long, ends string")
    whole = summed.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("piece", "summary", "illegal", "ends"))).alias("pieces"))
    schema = pa.schema([*_ID, ("piece", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("tail", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
    chosen = stored(whole.mapInArrow(_mapped(_chosen, schema), f"{_ID_SQL}, piece long, begin int, end int, tail string, cost long, illegal long"))
    schema = pa.schema([*_ID, ("pos", pa.int64()), ("place", pa.int32()), ("code", pa.string()), ("roles", pa.string())])
    told = pieces.select(*KEY, "piece", "start", "kinds").join(chosen.drop("cost", "illegal"), [*KEY, "piece"])
    edits = told.mapInArrow(_mapped(_retraced, schema), f"{_ID_SQL}, pos long, place int, code string, roles string")
    totals = chosen.groupBy(*KEY).agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    full = texts.select("pos", "role", "text").join(rows, "pos")
    return Repair(full, edits, totals)


def _edited(done: Repair) -> DataFrame:
    """Each edit with the role and text of its row; none for those at the end."""
    own = done.rows.select("pos", F.lit(0).alias("place"), "role", "text")
    return done.edits.join(own, ["pos", "place"], "left")


def repaired(done: Repair) -> DataFrame:
    """The repaired conversations, a row a turn: conv_id, pos, nth (rows of one conversation are in order of both), edit, role, text."""
    turns = F.expr("filter(transform(sequence(1, length(code)), i -> struct(i as nth, substr(code, i, 1) as edit, substr(roles, i, 1) as new)), x -> x.edit != 'D')")
    rows = _edited(done).select(*KEY, "pos", "place", "role", "text", F.explode(turns).alias("t"))
    role = F.when(F.col("t.edit") == "K", F.col("role")).when(F.col("t.new") == "u", FULL_ROLE["u"]).otherwise(FULL_ROLE["a"])
    text = F.when(F.col("t.edit") == "I", "").otherwise(F.col("text"))
    return rows.select(id_of(F.col("no_id"), F.col("id")).alias("conv_id"), "pos", (F.col("place") * 3 + F.col("t.nth")).alias("nth"), F.col("t.edit").alias("edit"), role.alias("role"), text.alias("text"))


_HASHED = pa.schema([*_ID, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _hashed(batches):
    """Rows sorted by conversation and place -> a row a conversation; what is held is one hash, one audit and one batch."""
    now, audit, sha, first, out = None, [], None, True, []
    for batch in batches:
        for r in batch.to_pylist():
            if (key := (r["no_id"], r["id"])) != now:
                if now is not None:
                    out.append(dict(zip(_HASHED.names, (*now, "".join(audit), sha.hexdigest()), strict=True)))
                now, audit, sha, first = key, [], hashlib.sha256(), True
            audit.append(r["code"])
            for edit, new in zip(r["code"], r["roles"], strict=True):
                if edit != "D":
                    line = f"{r['role'] if edit == 'K' else FULL_ROLE[new]}:{'' if edit == 'I' else r['text']}"
                    sha.update((line if first else "\n" + line).encode())
                    first = False
        if out:
            yield pa.RecordBatch.from_pylist(out, _HASHED)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_HASHED.names, (*now, "".join(audit), sha.hexdigest()), strict=True))], _HASHED)


def digest(original: DataFrame, done: Repair) -> DataFrame:
    """A row for each conv_id of original: gaps, faults, illegal neighbours, cost, audit, hash of the repaired rows.

    The hash and the audit of a conversation are one value each, so its rows stream through one task.
    """
    is_ = lambda f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f)
    kinds = ("blank", "duplicate", "truncated")
    turns = done.rows.groupBy(*KEY, "turn").agg(*(is_(f) for f in kinds))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("turn")
    counts = turns.groupBy(*KEY).agg(F.coalesce(gaps, F.lit(0)).try_cast("long").alias("gaps"), *(F.sum(f).alias(f) for f in kinds))
    hashed = _edited(done).repartition(*KEY).sortWithinPartitions(*KEY, "pos", "place").select(*KEY, "code", "roles", "role", "text")
    hashed = hashed.mapInArrow(_hashed, f"{_ID_SQL}, audit string, repaired_sha256 string")
    ids = original.select(original["conv_id"].isNull().alias("no_id"), F.coalesce(original["conv_id"].cast("long"), F.lit(0).cast("long")).alias("id")).distinct()
    out = ids.join(counts, KEY, "left").join(done.totals, KEY, "left").join(hashed, KEY, "left")
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", *kinds, "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(id_of(F.col("no_id"), F.col("id")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage: by crc32 of conv_id:turn modulo 20 a row is dropped, emptied, loses its ends of sentences, is doubled or becomes user."""
    c, space = conversations, F.lit(" ")
    own = [F.coalesce(c[x].cast("string"), space) for x in ("conv_id", "turn", "role", "text")]
    how = F.crc32(F.concat(own[0], F.lit(":"), own[1]).cast("binary")) % 20
    rows = c.select(c["conv_id"], c["turn"], own[2].alias("role"), own[3].alias("text"), how.alias("_how")).where("_how != 0")
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
