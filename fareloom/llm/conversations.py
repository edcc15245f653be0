"""Repair of conversation structure at least cost, by a recursive DuckDB query over blocks of turns.

A repaired conversation's role initials are ``(s?(ua)+)?``: nothing, or user and assistant in turns behind one
system turn at most. Rows are kept (cost 0), given another role (3), deleted (4; blank and repeated rows must be), and
empty rows inserted (3); a truncated row that stays costs 3 more. Of the cheapest repairs the one with the
least audit (initials of the edits in order: D, I, K, R) is taken. An audit determines its repair.

The grammar has four states (start, behind s, u or a). Edits of one row are moves between states. A conversation's rows are
dealt out in blocks; a block's repair is, for each state it may begin in and each it can end in, the least cost and audit. Inside
a hash-partitioned batch of blocks one recursive query walks all blocks at once, a turn each recursion. Blocks of one
conversation are then walked in the same way, a block each recursion, until one is left: a conversation of any length is
spread over tasks. That is exact, as of two audits of equal cost for the same rows none begins with the other.
"""

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.storage import materialize

#: Rows of a block (a power of two), and blocks that are put together at a time.
BLOCK_ROWS, FAN_IN = 128, 32
#: Rows, or blocks in later rounds, that one recursive query walks.
BATCH_ROWS = 16_384
#: Bytes of text that the repaired rows of one batch hold, about.
OUT_BYTES = 4 << 20

_SPACES = "\\x20\\x09-\\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row whose role has this initial, by the state before it.
_BEHIND = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Codes of rows that must be deleted: blank ones and repeated ones.
BLANK, DUPLICATE = "b", "d"

REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@cache
def moves() -> tuple[tuple, ...]:
    """(code, entry, exit, cost, audit) of the best edits of one row with that code and of the rows inserted before it.

    A code is a role's initial (x for all but s, u and a), as a capital if the row is truncated, or ``BLANK`` or ``DUPLICATE``.
    """
    best: dict[tuple, tuple] = {}

    def offer(code, entry, leave, cost, audit):
        if leave is not None:
            best[code, entry, leave] = min(best.get((code, entry, leave), (cost, audit)), (cost, audit))

    for entry in range(4):
        reached = [(entry, 0, "")]
        for _ in range(2):
            state, cost, audit = reached[-1]
            reached.append((_BEHIND[state, "a" if state == USER else "u"], cost + INSERT, audit + "I"))
        for state, cost, audit in reached:
            for code in "suaxSUAX" + BLANK + DUPLICATE:
                offer(code, entry, state, cost + DELETE, audit + "D")
                if code in BLANK + DUPLICATE:
                    continue
                more = cost + (TRUNCATED if code.isupper() else 0)
                offer(code, entry, _BEHIND.get((state, code.lower())), more + KEEP, audit + "K")
                for role in "ua":
                    offer(code, entry, _BEHIND.get((state, role)), more + REROLE, audit + "R")
    return tuple((*key, *value) for key, value in sorted(best.items()))


#: The recursive query. ``steps``: the moves of each place of a block; ``begins``: a block's number of places and the states it may begin in.
WALK = """
WITH RECURSIVE walk AS (
  SELECT block, entry, entry AS state, 0::BIGINT AS done, 0::BIGINT AS cost, '' AS audit FROM begins
  UNION ALL
  SELECT block, entry, state, done, best.cost, best.audit FROM (
    SELECT w.block, w.entry, s.exit AS state, w.done + 1 AS done, min({'cost': w.cost + s.cost, 'audit': w.audit || s.audit}) AS best
    FROM walk w JOIN steps s ON s.block = w.block AND s.place = w.done AND s.entry = w.state GROUP BY 1, 2, 3, 4))
SELECT w.block, w.entry, w.state AS exit, w.cost, w.audit FROM walk w JOIN begins b ON b.block = w.block AND b.entry = w.entry AND b.places = w.done
ORDER BY w.block, w.entry, exit"""

#: Blocks of rows: ``blocks`` has block, codes (a character a row), first (no rows of the conversation before it).
OF_ROWS = {
    "steps": """SELECT r.block, r.place, m.entry, m.exit, m.cost, m.audit
FROM (SELECT block, unnest(string_split(codes, '')) AS code, unnest(range(length(codes))) AS place FROM blocks) r JOIN moves m USING (code)""",
    "begins": "SELECT block, length(codes) AS places, unnest(CASE WHEN first THEN [0] ELSE [0, 1, 2, 3] END) AS entry FROM blocks",
}
#: Blocks of blocks: ``blocks`` has block and parts (number, entry, exit, cost, audit).
OF_BLOCKS = {
    "steps": """SELECT block, dense_rank() OVER (PARTITION BY block ORDER BY p.number) - 1 AS place, p.entry, p.exit, p.cost, p.audit
FROM (SELECT block, unnest(parts) AS p FROM blocks)""",
    "begins": "SELECT block, max(place) + 1 AS places, unnest(list_distinct(list(entry) FILTER (WHERE place = 0))) AS entry FROM steps GROUP BY block",
}


def _walker(kind: dict[str, str], size: str, kept: list[str], schema: str):
    """A function over Arrow batches: the columns ``kept`` of each block with its entries, exits, costs and audits. ``size``: SQL of a block's places."""

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        con.register("moves", pa.Table.from_pylist([dict(zip(("code", "entry", "exit", "cost", "audit"), m, strict=True)) for m in moves()]))
        for batch in batches:
            con.register("sized", batch)
            sizes = [n for (n,) in con.execute(f"SELECT {size} FROM sized").fetchall()]
            con.unregister("sized")
            at = 0
            while at < len(sizes):
                end, rows = at + 1, sizes[at]
                while end < len(sizes) and rows + sizes[end] <= BATCH_ROWS:
                    rows += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                con.register("blocks", part.append_column("block", pa.array(range(len(part)), pa.int64())))
                for name, sql in kind.items():
                    con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {sql}")
                found = con.sql(WALK).to_arrow_table()
                con.unregister("blocks")
                rows = part.select(kept).take(found.column("block").combine_chunks())
                types = {"entry": pa.int32(), "exit": pa.int32(), "cost": pa.int64(), "audit": pa.string()}
                yield pa.RecordBatch.from_arrays([*rows.columns, *(found.column(c).combine_chunks().cast(t) for c, t in types.items())], names=[*kept, *types])
                at = end
        con.close()

    return run, f"{schema}, entry int, exit int, cost bigint, audit string"


def _laid_out(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (ascending by conversation, turn, role and text) and code of each row; turns in order of conversation are dealt to tasks by ranges."""
    conv, order = F.col("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = turns.withColumn("digest", F.sha2("text", 256))
    first = rows.groupBy(conv.alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    first = materialize(first.where("_n > 1").drop("_n"), "conversation-repeats")
    rows = rows.join(first, conv.eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    alike = Window.partitionBy("conv_id", "turn", "role").orderBy("text")
    again = F.coalesce(order > F.col("_first"), F.lit(False)) | F.coalesce(F.lag("text").over(alike) == F.col("text"), F.lit(False))
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), F.upper(known)).otherwise(known)
    laid = rows.repartitionByRange("conv_id", "turn", "role").withColumn("code", code).withColumn("pos", F.monotonically_increasing_id())
    return materialize(laid.select("conv_id", "turn", "role", "text", "pos", "code"), "conversation-rows")


def _cheapest(laid: DataFrame, conv_type: str) -> DataFrame:
    """conv_id, cost and audit of each conversation that has rows."""
    pos = F.array_sort(F.collect_list(F.struct("pos", "code")))
    codes = F.array_join(F.transform(pos, lambda x: x["code"]), "").alias("codes")
    shift = BLOCK_ROWS.bit_length() - 1
    block = F.shiftright("pos", shift).alias("number")
    # a block that doesn't begin at a boundary of numbers has no rows of its conversation before it
    blocks = laid.groupBy("conv_id", block).agg(codes, (F.min("pos") % BLOCK_ROWS != 0).alias("first"))
    walked = materialize(blocks.mapInArrow(*_walker(OF_ROWS, "length(codes)", ["conv_id", "number"], f"conv_id {conv_type}, number bigint")), "conversation-blocks")
    of_conv = Window.partitionBy("conv_id")
    numbered = walked.withColumn("number", (F.dense_rank().over(of_conv.orderBy("number")) - 1).cast("long"))
    # blocks, not rows, meet here: a hundredth of a long conversation
    open_ = materialize(numbered.withColumn("last", F.max("number").over(of_conv)), "conversation-numbers")
    found = open_.where("last = 0")
    open_ = open_.where("last > 0")
    while not open_.isEmpty():
        up = lambda c: F.floor(F.col(c) / FAN_IN).cast("long")
        parts = F.collect_list(F.struct("number", "entry", "exit", "cost", "audit")).alias("parts")
        grouped = open_.groupBy("conv_id", up("number").alias("up"), up("last").alias("last")).agg(parts).withColumnRenamed("up", "number")
        run = _walker(OF_BLOCKS, "len(parts)", ["conv_id", "number", "last"], f"conv_id {conv_type}, number bigint, last bigint")
        walked = materialize(grouped.mapInArrow(*run), "conversation-blocks")
        found, open_ = found.unionByName(walked.where("last = 0"), allowMissingColumns=True), walked.where("last > 0")
    # what is left open behind s or u is closed by inserted rows
    missing = F.when(F.col("exit") == SYSTEM, 2).when(F.col("exit") == USER, 1).otherwise(0)
    closed = F.struct((F.col("cost") + INSERT * missing).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), missing)).alias("audit"))
    return found.where(F.col("entry") == START).groupBy("conv_id").agg(F.min(closed).alias("best")).select("conv_id", "best.cost", "best.audit")


def _stream(batches):
    """Rows in order of conv_id and pos, a conversation's first with its audit: the repaired rows, then one row with the report."""
    out: dict[str, list] = {c: [] for c in ["conv_id", "place", "role", "text", *REPORT, "audit"]}
    size = 0

    def put(**row):
        for name, column in out.items():
            column.append(row.get(name))

    def flush(arrow=pa.RecordBatch):
        kinds = [conv_kind, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(REPORT), pa.string()]
        batch = arrow.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
        for column in out.values():
            column.clear()
        return batch

    now = None

    def emit(role, text):
        nonlocal size
        put(conv_id=now["conv"], place=now["place"], role=role, text=text)
        now["place"] += 1
        now["state"] = _BEHIND[now["state"], role[0]]
        size += len(text) + 64

    def inserts():
        while now["at"] < len(now["audit"]) and now["audit"][now["at"]] == "I":
            emit("assistant" if now["state"] == USER else "user", "")
            now["at"] += 1

    def close():
        inserts()
        gaps = now["most"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
        put(conv_id=now["conv"], gaps=gaps, cost=now["cost"], audit=now["audit"], **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal")})

    for batch in batches:
        conv_kind = batch.column(0).type
        for conv, turn, role, text, pos, code, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pos < 0:
                if now is not None:
                    close()
                now = {"conv": conv, "audit": text, "cost": cost, "at": 0, "place": 0, "state": START, "before": None, "least": None, "most": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            else:
                if turn is not None and turn != now["most"]:
                    now["turns"] += 1
                    now["least"], now["most"] = turn if now["least"] is None else now["least"], turn
                now["blank"] += code == BLANK
                now["duplicate"] += code == DUPLICATE
                now["truncated"] += code.isupper()
                now["illegal"] += now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au")
                now["before"] = role[:1]
                inserts()
                edit = now["audit"][now["at"]]
                now["at"] += 1
                if edit != "D":
                    emit(role if edit == "K" else "assistant" if now["state"] == USER else "user", text)
            if size > OUT_BYTES or len(out["role"]) >= 8192:
                yield flush()
                size = 0
    if now is not None:
        close()
        yield flush()


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The repaired rows of each conversation in order, then one row with its report.

    ``turns``: conv_id (any type that can be sorted), turn (whole number), role, text; other columns are not read. Result: conv_id, place (from
    0), role, text of repaired rows; in the closing row, where place is null, gaps (turns missing between the
    least and the greatest), blank, duplicate and truncated (rows by their first fault), illegal (neighbours whose initials are not
    su, ua or au), cost and audit. The rows of a conversation are neighbours in one partition, in that order.

    Rows go by turn (null first), then role and text. A null role or text is one space. Blank: nothing but white space;
    duplicate: its role and text came before; truncated: its last character isn't one of ``.!?``. Rows with a null
    conv_id are one conversation. ``conversations`` (conv_id) names those to report that have no rows: zeros and an empty audit.
    Repeated rows are duplicates; an empty table gives no rows. Roles other than system, user and assistant count by their first letter.

    Texts are shuffled three times (repeats, ranges, result) and stream through the last task of their conversation.
    """
    conv_type = dict(turns.dtypes)["conv_id"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    laid = _laid_out(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text")))
    ids = turns.select("conv_id") if conversations is None else turns.select("conv_id").unionByName(conversations.select("conv_id"))
    cheapest = _cheapest(laid, conv_type).unionByName(ids.distinct().select("conv_id", F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")))
    decided = cheapest.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("audit").alias("text"))
    heads = decided.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), "text", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("code"), "cost")
    rows = heads.unionByName(laid.withColumn("cost", F.lit(None).cast("long"))).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = ", ".join([f"conv_id {conv_type}, place bigint, role string, text string", *(f"{c} bigint" for c in REPORT), "audit string"])
    return rows.mapInArrow(_stream, schema)


def reports(repaired: DataFrame) -> DataFrame:
    """The closing rows of ``repair`` with repaired_sha256: of the conversation's ``role:text``, joined by new lines (UTF-8)."""

    def run(batches):
        digest, any_row = hashlib.sha256(), False
        for batch in batches:
            hashes, closing = [], []
            for k, (place, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "role", "text")), strict=True)):
                if place is None:
                    hashes.append(digest.hexdigest())
                    closing.append(k)
                    digest, any_row = hashlib.sha256(), False
                else:
                    digest.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
                    any_row = True
            kept = batch.take(pa.array(closing, pa.int64())).select(["conv_id", *REPORT, "audit"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hashes, pa.string())], names=[*kept.schema.names, "repaired_sha256"])

    conv_type = dict(repaired.dtypes)["conv_id"]
    return repaired.mapInArrow(run, ", ".join([f"conv_id {conv_type}", *(f"{c} bigint" for c in REPORT), "audit string, repaired_sha256 string"]))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the fixed damage by d = crc32(``conv_id:turn``) % 20; a null is one space in the key, role and text.

    d 0 drops the row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats the row, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), damage.alias("damage")).where("damage != 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
