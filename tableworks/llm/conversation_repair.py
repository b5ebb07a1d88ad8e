"""Conversation repair: faults of each turn, the cheapest edits that give every user turn its answer, repaired texts.

Turns are counted, marked and range-partitioned by (conversation, turn), so a conversation of any length is cut
into pieces like every other row. Most conversations lie inside one partition. Of the first and the last one of each
partition, which may go on in its neighbours, a short summary (what the piece does for every cost vector behind
it) is composed over the partitions; then every piece traces its own edits, and pieces of one conversation are joined
as ready strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.llm.batches import arrow_schema, slices
from tableworks.llm.edit_blocks import CUT, DELETE, GONE, INSERT, ONWARD, REROLE, summary, symbol, trace
from tableworks.session import pin

#: White space of the rules, and what a finished text ends with.
_SPACE, _ENDS = r"\x20\x09-\x0D", "[.!?]"
_NAMES = {2: "user", 3: "assistant"}
#: Bytes of repaired text in a row, for conversations that are cut.
CHUNK = 16_384

_PIECE = ("conv_id long, part int, chunk int, low long, high long, turns long, blank long, duplicate long, "
          "truncated long, illegal long, cost long, audit string, lines binary, sha string")
_DIGEST = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_EDITS = "conv_id long, piece int, step long, edit string, turn long, role string, text string"


def turns(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """The turns of a table as ``conv_id, turn, role, text, copies``; a null role or text is one space.

    ``copies`` is the number of times a row stands in its place, 1 by default; a row of 0 copies only names its
    conversation.
    """
    copies = F.lit(1) if copies is None else copies
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        copies.cast("long").alias("copies"))
    here = F.col("copies") > 0
    return plain.select("conv_id", F.when(here, F.col("turn")).alias("turn"),
                        *(F.when(here, F.col(c)).otherwise("").alias(c) for c in ("role", "text")), "copies")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns of ``conversations`` after damage by crc32(``conv_id:turn``) % 20, as ``turns`` gives them.

    0 drops a row, 1 empties its text, 2 removes its marks of sentence ends, 3 repeats it, 4 makes it the user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    changed = conversations.select(
        F.col("conv_id"), F.col("turn"), F.when(harm == 4, "user").otherwise(F.col("role").cast("string")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, _ENDS, "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"))
    return turns(changed, F.col("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Equal turns once with their number, and for each the kind of its role and the fault of its first copy.

    ``fault`` is 0 for none, 1 blank, 2 duplicate, 3 truncated. Only the first of all turns of a conversation with the
    same role and text is no duplicate; it is found by one small row per (conversation, role and text), which meets the
    turns on keys that repeat nowhere.
    """
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    counted = rows.groupBy("conv_id", (F.col("copies") > 0).alias("here"), "turn", "role", "text").agg(
        F.sum("copies").alias("copies")).withColumn("said", said)
    counted = counted.select("*", F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("no_c"),
                             F.coalesce("turn", F.lit(0)).alias("t"), F.col("turn").isNull().alias("no_t"))
    firsts = counted.filter("here").groupBy("c", "no_c", "said").agg(F.min("turn").alias("low"), F.max("no_t").alias("no_t"))
    firsts = firsts.select("c", "no_c", "said", "no_t", F.when(F.col("no_t"), 0).otherwise(F.col("low")).alias("t"),
                           F.lit(True).alias("first"))
    found = counted.join(firsts, ["c", "no_c", "said", "no_t", "t"], "left")
    initial = F.substring("role", 1, 1)
    first = F.coalesce("first", F.lit(False))
    fault = (F.when(~F.col("text").rlike(f"[^{_SPACE}]"), 1).when(~first, 2)
             .when(~F.col("text").rlike(f"{_ENDS}[{_SPACE}]*\\z"), 3).otherwise(0))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return found.select("conv_id", "turn", "role", "said", "text", "copies", kind.alias("kind"), fault.alias("fault"),
                        (first & F.col("here")).alias("first"))


def _pieces(rows: DataFrame) -> DataFrame:
    """The marked turns in order, in range partitions that stay as they are; nulls first, ties by role and digest."""
    order = ["conv_id", "turn", "role", "said"]
    ranged = marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return pin(ranged.select("conv_id", F.spark_partition_id().alias("part"), *"turn role text copies kind fault first".split()))


def _symbols(kinds: list[int], faults: list[int], copies: list[int]) -> bytes:
    """One symbol per turn; all copies but the first are duplicates or blank."""
    out = bytearray()
    for kind, fault, n in zip(kinds, faults, copies):
        if n:
            out.append(GONE if fault in (1, 2) else symbol(kind, fault == 3))
            out += bytes([GONE]) * (n - 1)
    return bytes(out)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """``(conv_id, part, columns as lists)`` of each conversation of a partition, in order."""
    now, part, held = None, 0, None
    for batch in slices(batches):
        ids, lists = batch.column("conv_id").to_pylist(), [batch.column(c).to_pylist() for c in columns]
        part, start = batch.column("part")[0].as_py(), 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or ids[end] != ids[start]:
                mine = [x[start:end] for x in lists]
                if held is not None and now == ids[start]:
                    for have, more in zip(held, mine):
                        have.extend(more)
                else:
                    if held is not None:
                        yield now, part, held
                    now, held = ids[start], mine
                start = end
    if held is not None:
        yield now, part, held


_BORDER = "part int, place int, conv_id long, front binary, state binary, kind int, turn long, any boolean, dated boolean"


def _borders(pieces: DataFrame) -> list:
    """Summaries of the first and the last conversation of each partition: at most two rows for a partition."""
    schema = arrow_schema(pieces.sparkSession, _BORDER)

    def run(batches):
        first = last = None
        for last in _runs(batches, ["kind", "fault", "copies", "turn"]):
            first = first or last
        found = [] if first is None else [(0, first)] if first is last else [(0, first), (1, last)]
        rows = []
        for place, (conv, part, (kinds, faults, copies, dates)) in found:
            front, state = summary(_symbols(kinds, faults, copies))
            here = [i for i, n in enumerate(copies) if n]
            dated = [dates[i] for i in here if dates[i] is not None]
            rows.append((part, place, conv, front, state, kinds[here[-1]] if here else 3, dated[-1] if dated else None,
                         bool(here), bool(dated)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)],
                                         schema=schema)

    narrow = pieces.select("conv_id", "part", "kind", "fault", "copies", "turn")
    return sorted(narrow.mapInArrow(run, _BORDER).collect(), key=lambda r: (r["part"], r["place"]))


def _context(borders: list) -> dict:
    """(part, conversation) of the pieces that are cut → vector behind, state in front, is last, is first, kind
    and turn before.

    Vectors are handed on from the last piece to the first, then states from the first to the last.
    """
    chains: list[list] = []
    for r in borders:
        if chains and chains[-1][-1]["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    found = {}
    for chain in chains:
        if len(chain) < 2:
            continue
        behind, vector = [], 0
        for r in reversed(chain):
            behind.append(vector)
            vector = r["front"][vector]
        state, kind, turn = 0, None, None
        for n, (r, vector) in enumerate(zip(chain, reversed(behind))):
            found[(r["part"], r["conv_id"])] = (vector, state, n + 1 == len(chain), n == 0, kind, turn)
            state = r["state"][4 * vector + state]
            kind, turn = r["kind"] if r["any"] else kind, r["turn"] if r["dated"] else turn
    return found


def _counts(kinds, faults, copies, firsts, dates, kind, turn) -> tuple:
    """``low, high, turns, blank, duplicate, truncated, illegal`` of a piece, after a turn of ``kind`` and number
    ``turn``."""
    low = high = None
    days = blank = duplicate = cut = illegal = 0
    for k, fault, n, first, date in zip(kinds, faults, copies, firsts, dates):
        if not n:
            continue
        if date is not None:
            days += date != turn
            low, high, turn = date if low is None else low, date, date
        blank += n if fault == 1 else 0
        duplicate += 0 if fault == 1 else n - first
        cut += fault == 3
        illegal += (kind is not None and (kind, k) not in ((0, 1), (1, 2), (2, 1))) + n - 1
        kind = k
    return low, high, days, blank, duplicate, cut, illegal


def _edited(letters: str, state: int, signs: bytes, dates, roles, texts, copies) -> Iterator[tuple]:
    """``(edit, turn, role, text)`` in order; deleted turns have neither role nor text."""
    at, row, left = 0, -1, 0
    for letter in letters:
        if letter == "I":
            state = ONWARD[state]
            yield "I", None, _NAMES[state], ""
            continue
        while not left:
            row += 1
            left = copies[row]
        left -= 1
        if letter == "D":
            yield "D", dates[row], None, None
        else:
            kind = (signs[at] - 1) // 2
            state = (1 if kind == 0 else ONWARD[state]) if letter == "K" else ONWARD[state]
            yield letter, dates[row], roles[row] if letter == "K" else _NAMES[state], texts[row]
        at += 1


_READ = ["kind", "fault", "copies", "first", "turn", "role", "text"]


def _traced(pieces: DataFrame):
    """A generator function over the batches of a partition: each piece with its edits."""
    context = pieces.sparkSession.sparkContext.broadcast(_context(_borders(pieces)))

    def traced(batches):
        for conv, part, lists in _runs(batches, _READ):
            known = context.value.get((part, conv))
            vector, state, last, first, kind, turn = known or (0, 0, True, True, None, None)
            kinds, faults, copies, firsts, dates, roles, texts = lists
            signs = _symbols(kinds, faults, copies)
            letters, _ = trace(signs, vector, state, last)
            yield (conv, part, known is None, letters, signs,
                   _counts(kinds, faults, copies, firsts, dates, kind, turn),
                   _edited(letters, state, signs, dates, roles, texts, copies))

    return traced


def repaired_turns(rows: DataFrame) -> DataFrame:
    """One row per edit: ``conv_id, piece, step, edit, turn, role, text``, ordered by (piece, step) in a conversation.

    ``rows`` are turns as ``turns`` or ``damaged`` gives them. Kept and changed turns carry their repaired role and
    text, inserted ones an empty text, deleted ones (``D``) neither.
    """
    pieces = _pieces(rows)
    traced, schema = _traced(pieces), arrow_schema(rows.sparkSession, _EDITS)

    def run(batches):
        out: list[tuple] = []
        for conv, part, _, _, _, _, edited in traced(batches):
            for step, edit in enumerate(edited):
                out.append((conv, part, step, *edit))
                if len(out) >= 512:
                    yield _batch(out, schema)
                    out = []
        yield _batch(out, schema)

    return pieces.mapInArrow(run, _EDITS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _cost(letters: str, signs: bytes) -> int:
    at = cost = 0
    for letter in letters:
        if letter == "I":
            cost += INSERT
            continue
        cut = signs[at] != GONE and (signs[at] - 1) % 2
        cost += DELETE if letter == "D" else (REROLE if letter == "R" else 0) + CUT * cut
        at += 1
    return cost


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    ``rows`` are turns as ``turns`` or ``damaged`` gives them, in order of turn, nulls first; of one turn, in order of
    role and of the digest of role and text, equal ones next to each other. The first fault of a turn counts. The
    edits are the cheapest ones that leave roles ``(s?(ua)+)?``, ties ASCII-least. Null identifiers are one
    conversation; a null role or text is one space, so such a text is blank; an empty text is blank too. A conversation
    with rows of 0 copies only has zeros, an empty audit and the digest of the empty string. An empty table gives an
    empty result; other columns are ignored.

    A conversation of any length is marked, traced and written in pieces; only the digest of its repaired lines, which
    has to read them in order, and the one string of its audit are made in one task, from chunks of lines.
    """
    pieces = _pieces(rows)
    traced = _traced(pieces)
    schema, digest = arrow_schema(rows.sparkSession, _PIECE), arrow_schema(rows.sparkSession, _DIGEST)

    def run(batches):
        out: list[tuple] = []
        for conv, part, whole, letters, signs, counts, edited in traced(batches):
            numbers = (*counts, _cost(letters, signs), letters)
            lines, size, chunk = [], 0, 0
            for _, _, role, text in edited:
                if role is None:
                    continue
                lines.append(f"{role}:{text}".encode())
                size += len(lines[-1])
                if size >= CHUNK and not whole:  # the numbers stand in the first chunk only
                    out.append((conv, part, chunk, *numbers, b"\n".join(lines), None))
                    numbers, lines, size, chunk = (None,) * len(numbers), [], 0, chunk + 1
                    yield _batch(out, schema)
                    out = []
            # of a conversation that is not cut only the digest goes on
            last = (None, hashlib.sha256(b"\n".join(lines)).hexdigest()) if whole else (b"\n".join(lines), None)
            out.append((conv, part, chunk, *numbers, *last))
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    def join(batches):
        now, held, out, empty = None, None, [], True

        def close():
            sums, low, high, audits, sha, ready = held
            gaps = 0 if low is None else high - low + 1 - sums[0]
            out.append((now[0], gaps, *sums[1:], "".join(audits), ready or sha.hexdigest()))

        for batch in slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in schema.names)):
                conv, low, high, numbers, audit, lines, ready = row[0], row[3], row[4], row[5:11], *row[11:]
                if held is None or now[0] != conv:
                    if held is not None:
                        close()
                    now, held = (conv,), [[0] * 6, None, None, [], hashlib.sha256(), ready]
                    empty = True
                if audit is not None:
                    held[0] = [a + b for a, b in zip(held[0], numbers)]
                    held[3].append(audit)
                if low is not None:
                    held[1], held[2] = low if held[1] is None else held[1], high
                if lines:
                    held[4].update(lines if empty else b"\n" + lines)
                    empty = False
            yield _batch(out, digest)
            out.clear()
        if held is not None:
            close()
        yield _batch(out, digest)

    ready = pieces.mapInArrow(run, _PIECE)
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(join, _DIGEST)
