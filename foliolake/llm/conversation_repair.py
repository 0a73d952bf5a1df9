"""Repair of the structure of conversations.

Each conversation is put in order of its turns. A row's first fault counts: blank (no word character of the white
space rule), duplicate (its role and text were seen earlier) or truncated (it does not end in ``.``, ``!`` or
``?``). The cheapest edits that make the roles read ``(s?(ua)+)?`` are found by branch and bound (``edit_search``).

Method. First sights of (conversation, role, text) come from map-side minima over 128-bit text hashes; only those
that occur twice are joined back. Rows are then partitioned by ranges of (conversation, turn, role, text), so a
conversation of any size is spread over as many tasks as its rows need, and each task streams its rows. A
conversation that lies in one task and has at most ``BLOCK`` rows is solved there. The others become parts of at
most ``BLOCK`` rows: each gives the best edits for every state before and after it, parts are composed in order,
and a last pass streams the parts of a conversation through the hash with the edits that were chosen. A task holds
one part and the running edit strings of one conversation, never its rows.

Order of rows with one turn: by role, then text; null turns first. Rows that are equal altogether are adjacent.
Nulls in role and text are one space.

Defined results: a null conv_id is a conversation of its own. A conversation all of whose rows were dropped has
zeros, no edits and the hash of the empty string. Repeated rows are duplicates. Empty texts are blank; an empty
role has no initial and fits nowhere. Texts may be as long as a row can be. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import written
from foliolake.llm.edit_search import ANSWERED, START, outputs, repaired, transfers

BLOCK = 1024
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_TAIL = " \t\n\x0b\x0c\r"
_EMPTY = hashlib.sha256(b"").hexdigest()

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_SCHEMA = (
    "conv_id bigint, whole boolean, part bigint, number bigint, first_turn bigint, last_turn bigint, n_turns bigint, "
    "first_initial string, last_initial string, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, edits array<struct<before:int,after:int,cost:bigint,audit:string>>, "
    "roles array<string>, texts array<string>, cost bigint, audit string, repaired_sha256 string"
)
_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage; a dropped row stays as one that is not ``present``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    marked = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"),
        role.alias("role"), text.alias("text"),
    )
    return marked.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _has_turn(turn: Column) -> Column:
    return turn.isNotNull()


def with_sights(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: whether an earlier turn of the conversation had this role and text."""
    hashed = rows.withColumn("near", F.xxhash64("text")).withColumn("far", F.xxhash64(F.lit("far"), "text"))
    keys = ["conv_id", "role", "near", "far"]
    first = hashed.filter("present").groupBy(*keys).agg(
        F.min(F.struct(_has_turn(F.col("turn")).alias("some"), "turn")).alias("first"), F.count("*").alias("n")
    ).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("near").alias("h"), F.col("far").alias("g"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("near") == F.col("h")) & (F.col("far") == F.col("g"))
    own = F.struct(_has_turn(F.col("turn")).alias("some"), "turn")
    return hashed.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", "present", F.coalesce(own > F.col("first"), F.lit(False)).alias("again")
    )


class _Part:
    """Consecutive rows of one conversation, and what their neighbours need to know of them."""

    def __init__(self, conv_id, earlier: _Part | None = None):
        self.conv_id, self.number = conv_id, earlier.number + 1 if earlier else 0
        #: The row and turn before this part, where this task has seen them.
        self.before = earlier.before if earlier else None
        self.first_turn = self.last_turn = None
        self.n_turns = 0
        self.letters, self.roles, self.texts = [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, again: bool) -> None:
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.n_turns += turn != self.last_turn
            self.last_turn = turn
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        row = (turn, role, text)
        again, self.before = again or row == self.before, row
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not _WORD.search(text):
            self.blank += 1
            letter = "x"
        elif again:
            self.duplicate += 1
            letter = "x"
        elif text.rstrip(_TAIL)[-1] not in ".!?":
            self.truncated += 1
            letter = letter.upper()
        self.letters.append(letter)
        self.roles.append(role)
        self.texts.append(text)

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns

    def row(self, whole: bool, part: int) -> dict:
        letters = "".join(self.letters)
        own = {
            "conv_id": self.conv_id, "whole": whole, "part": part, "number": self.number, "first_turn": self.first_turn,
            "last_turn": self.last_turn, "n_turns": self.n_turns, "n_rows": len(self.roles),
            "first_initial": self.roles[0][:1] if self.roles else None,
            "last_initial": self.roles[-1][:1] if self.roles else None, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal,
        }
        if whole:
            cost, audit = repaired(letters)
            text = "\n".join(outputs(audit, self.roles, self.texts)[0])
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            return own | {"cost": cost, "audit": audit, "repaired_sha256": digest}
        edits = [dict(zip(("before", "after", "cost", "audit"), t)) for t in transfers(letters)]
        return own | {"edits": edits, "roles": self.roles, "texts": self.texts}


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _solver(schema: pa.Schema, block: int):
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows: list[dict] = []
        part, edge, size = None, True, 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "again")]
            for conv_id, turn, role, text, present, again in zip(*columns):
                if part is None or conv_id != part.conv_id:
                    if part is not None:
                        # The first conversation of a task may have begun in the one before.
                        rows.append(part.row(not edge and not part.number, task))
                        edge = False
                    part = _Part(conv_id)
                elif len(part.roles) == block:
                    rows.append(part.row(False, task))
                    part = _Part(conv_id, part)
                if present:
                    part.add(turn, role, text, again)
                    size += len(text)
                if size > 1 << 22 or len(rows) >= 4096:
                    yield flushed()
                    rows, size = [], 0
        if part is not None:
            rows.append(part.row(False, task))
        yield flushed()

    return solved


def _illegal(left: str | None, right: str | None) -> int:
    return int(left is not None and right is not None and left + right not in ("su", "ua", "au"))


class _Chain:
    """The parts of one conversation composed in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.n_turns = 0
        self.best = {START: (0, "")}
        #: Per part: its number, and per state after it the state before.
        self.parts: list[tuple[int, int, dict[int, tuple[int, int]]]] = []

    def add(self, row: dict) -> None:
        for name in self.totals:
            self.totals[name] += row[name]
        if row["n_rows"]:
            self.totals["illegal"] += _illegal(self.last_initial, row["first_initial"])
            self.last_initial = row["last_initial"]
        if row["first_turn"] is not None:
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.n_turns += row["n_turns"] - (row["first_turn"] == self.last_turn)
            self.last_turn = row["last_turn"]
        best: dict[int, tuple[int, str]] = {}
        came: dict[int, tuple[int, int]] = {}
        for edit in row["edits"]:
            if (known := self.best.get(edit["before"])) is not None:
                new = (known[0] + edit["cost"], known[1] + edit["audit"])
                if edit["after"] not in best or new < best[edit["after"]]:
                    best[edit["after"]], came[edit["after"]] = new, (edit["before"], len(edit["audit"]))
        self.best = best
        self.parts.append((row["part"], row["number"], came))

    def rows(self) -> list[dict]:
        """One row with the whole result, and one for each part with its state and edits."""
        state = min((s for s in (START, ANSWERED) if s in self.best), key=lambda s: self.best[s])
        cost, audit = self.best[state]
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns
        out = [self.totals | {"conv_id": self.conv_id, "gaps": gaps, "cost": cost, "audit": audit}]
        stop = len(audit)
        for part, number, came in reversed(self.parts):
            before, size = came[state]
            out.append({"conv_id": self.conv_id, "part": part, "number": number, "before": before, "audit": audit[stop - size : stop]})
            stop, state = stop - size, before
        return out


def _composer(schema: pa.Schema):
    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for batch in batches:
            for row in batch.to_pylist():
                if chain is not None and row["conv_id"] != chain.conv_id:
                    yield pa.RecordBatch.from_pylist(chain.rows(), schema=schema)
                    chain = None
                chain = chain or _Chain(row["conv_id"])
                chain.add(row)
        if chain is not None:
            yield pa.RecordBatch.from_pylist(chain.rows(), schema=schema)

    return composed


def _hasher(schema: pa.Schema):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, led, out = None, None, False, []
        for batch in batches:
            for conv_id, before, audit, roles, texts in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "before", "audit", "roles", "texts"))):
                if digest is None or conv_id != current:
                    if digest is not None:
                        out.append({"conv_id": current, "repaired_sha256": digest.hexdigest()})
                    current, digest, led = conv_id, hashlib.sha256(), False
                rows, _ = outputs(audit, roles, texts, before)
                if rows:
                    digest.update((("\n" if led else "") + "\n".join(rows)).encode("utf-8", "surrogatepass"))
                    led = True
        if digest is not None:
            out.append({"conv_id": current, "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return hashed


def repaired_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, present): faults, edits and repaired hash."""
    ordered = with_sights(rows)
    # Nulls come first in both the ranges and the order inside a task.
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    solved = written(ordered.mapInArrow(_solver(_arrow(_SCHEMA), block), _SCHEMA), "conversation_parts")
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"))
    whole = solved.filter("whole").withColumn("gaps", gaps).select("conv_id", *_COUNTS, "cost", "audit", "repaired_sha256")

    order = ["conv_id", "part", "number"]
    parts = solved.filter("not whole")
    light = parts.drop("roles", "texts").repartition("conv_id").sortWithinPartitions(*order)
    schema = f"{_RESULT}, part bigint, number bigint, before int"
    chains = written(light.mapInArrow(_composer(_arrow(schema)), schema), "conversation_chains")
    totals = chains.filter("part IS NULL").select("conv_id", *_COUNTS, "cost", "audit")
    chosen = chains.filter("part IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("number").alias("k"), "before", "audit")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("number") == F.col("k"))
    texts = parts.select(*order, "roles", "texts").join(chosen, same).select(*order, "before", "audit", "roles", "texts")
    texts = texts.repartition("conv_id").sortWithinPartitions(*order)
    schema = "conv_id bigint, repaired_sha256 string"
    hashes = texts.mapInArrow(_hasher(_arrow(schema)), schema).select(F.col("conv_id").alias("c"), "repaired_sha256")
    long = totals.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return whole.unionByName(long)
