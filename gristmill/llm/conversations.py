"""Conversation structure repair by a suffix-shared automaton of role and fault signatures.

A row is a symbol: the class of its role's initial (s, u, a, other) and its first fault (none, blank, duplicate,
truncated).  A conversation is the string of its symbols, and what the cheapest edits are depends on that string alone.

1. Rows become records without text (turn, digest of role and text, symbol); duplicates are found by the first turn of
   each digest.  Records are sorted by ranges of (conversation, turn, digest), so a long conversation is many tasks,
   which return pieces of its signature.
2. Signatures are sorted from their ends, by ranges.  A node of the automaton is a suffix; along that order a task
   keeps the nodes of the present signature and builds only those that the one before doesn't share, so each distinct
   suffix is worked out once, from the end: for each of the four grammar states the cost to go and the first letter of
   the best audit.  A letter leads to one node and state, so letters are all that a best suffix needs.  Nodes whose
   costs differ by a constant behave alike; that finite set of classes is worked out once a worker.
3. Texts are shuffled once, by conversation, and stream past their audit into the digest.

SHA-256 has to read a conversation's text in order, and its audit is one value: so the rows of one conversation stream
through one task in step 3, one row in memory at a time.  All other steps split a conversation of any length.

Defined results: null ids, turns, roles and texts count as one space (a null ``conv_id`` is a conversation and comes
back null); rows of one turn are ordered by the digest of role and text, so equal rows are adjacent; repeated rows are
rows like any other, the later ones duplicates; a role that is empty or has another initial can't be kept; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r "
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES, NAMES = "sua", {1: "user", 2: "assistant"}
REROLE, DELETE, INSERT, FLAW = 1, 2, 5, 5

# Grammar states: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.  Where a role leads, and the role that may be put in.
LEADS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
PUT = (1, 1, 2, 1)

_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_OUT = f"conv_id long, {_RESULT}, repaired_sha256 string"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(table: DataFrame) -> DataFrame:
    """``key`` (the conversation), ``turn``, ``role``, ``text``, ``times``: rows after damage, dropped ones with 0 times."""
    code = F.crc32(F.concat(F.col("key"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = undamaged(table).withColumn("code", code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("key", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def undamaged(table: DataFrame) -> DataFrame:
    return table.select(
        _text("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"),
        F.lit(1).alias("times"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def _symbol(fault: Column) -> Column:
    return F.char(F.lit(ord("a")) + 4 * F.col("class") + fault)


def symbols(rows: DataFrame) -> DataFrame:
    """``key``, ``turn``, ``digest``, ``piece``: the symbols of all rows that are alike in these, in order."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    kept = F.col("times") > 0
    class_ = F.coalesce(*(F.when(initial == r, F.lit(k)) for k, r in enumerate(ROLES)), F.lit(3))
    fault = F.when(tail == "", BLANK).when(tail.isin(*".!?"), NONE).otherwise(TRUNCATED)
    records = rows.select(
        "key", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, _digest()).alias("digest"),
        F.when(kept, class_).alias("class"), F.when(kept, fault).alias("fault"), "times",
    )
    records = records.groupBy("key", "turn", "digest", "class", "fault").agg(F.sum("times").alias("times"))
    first = records.where("times > 0").groupBy("key", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    first = first.where("turns > 1").select(F.col("key").alias("k"), F.col("digest").alias("d"), "first")
    records = records.join(first, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")), "left")
    fresh = F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))
    again = F.when(F.col("fault") == BLANK, _symbol(F.lit(BLANK))).otherwise(_symbol(F.lit(DUPLICATE)))
    one = F.when(fresh, _symbol(F.col("fault"))).otherwise(again)
    piece = F.when(F.col("times") > 0, F.concat(one, F.repeat(again, (F.col("times") - 1).cast("int")))).otherwise("")
    return records.select("key", "turn", "digest", piece.alias("piece"))


def signatures(records: DataFrame) -> DataFrame:
    """``key``, ``gaps``, ``signature`` of every conversation."""

    def run(batches):
        key, pieces, turns = None, [], []
        schema = pa.schema([("key", pa.string()), ("piece", pa.string()), *((c, pa.int64()) for c in ("turns", "first", "last"))])

        def row():
            return {"key": key, "piece": "".join(pieces), "turns": turns[0], "first": turns[1], "last": turns[2]}

        for batch in batches:
            out = []
            for own, turn, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "piece"))):
                if own != key:
                    if key is not None:
                        out.append(row())
                    key, pieces, turns = own, [], [0, None, None]
                pieces.append(piece)
                if turn is not None and turn != turns[2]:
                    turns = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    order = ["key", "turn", "digest"]
    parts = records.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "piece")
    parts = parts.mapInArrow(run, "key string, piece string, turns long, first long, last long").withColumn("part", F.spark_partition_id())
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "first", "last", "turns"))).alias("parts"))
    # A turn at the end of one piece may go on in the next one.
    once = F.expr("aggregate(parts, struct(cast(null AS long) AS last, 0L AS n), (s, p) -> struct(p.last AS last, s.n + p.turns - if(p.first = s.last, 1, 0) AS n)).n")
    ends = F.array_max("parts.last") - F.array_min("parts.first") + 1
    return whole.select("key", F.coalesce(ends - once, F.lit(0)).alias("gaps"), F.array_join("parts.piece", "").alias("signature"))


# --- the automaton ---------------------------------------------------------------------------------------------------


def _with_inserts(costs: list[int], letters: list[str]) -> tuple[tuple[int, ...], str]:
    """Cheapest costs and first letters once a row may be put in before the node's own."""
    changed = True
    while changed:
        changed = False
        for q in range(4):
            option = (costs[LEADS[q][PUT[q]]] + INSERT, "I")
            if option < (costs[q], letters[q]):
                costs[q], letters[q] = option
                changed = True
    return tuple(costs), "".join(letters)


def _node(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost to go and first letter in each grammar state, before a row with this symbol."""
    role, fault = divmod(ord(symbol) - ord("a"), 4)
    costs, letters = [], []
    for q in range(4):
        options = [(DELETE + after[q], "D")]
        if fault in (NONE, TRUNCATED):
            flaw = FLAW if fault == TRUNCATED else 0
            if role in LEADS[q]:
                options.append((flaw + after[LEADS[q][role]], "K"))
            options.append((flaw + REROLE + after[LEADS[q][PUT[q]]], "R"))
        cost, letter = min(options)
        costs.append(cost)
        letters.append(letter)
    return _with_inserts(costs, letters)


class Automaton:
    """The suffixes of one signature as a path from the end; the next signature keeps those that it shares."""

    classes: dict = {}

    def __init__(self):
        self.text, self.built = "", 0
        # Behind the last row there is nothing to do where the grammar may end, else the missing rows; "." is the end.
        self.path = [((0, 2 * INSERT, INSERT, 0), 0, ".II.")]

    def read(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of the signature whose reverse is given."""
        same = 0
        for x, y in zip(self.text, backwards):
            if x != y:
                break
            same += 1
        path = self.path
        del path[same + 1 :]
        self.built += len(backwards) - same
        for symbol in backwards[same:]:
            after, offset, _ = path[-1]
            found = self.classes.get((symbol, after))
            if found is None:
                costs, letters = _node(symbol, after)
                found = self.classes[symbol, after] = (tuple(c - min(costs) for c in costs), min(costs), letters)
            path.append((found[0], offset + found[1], found[2]))
        self.text = backwards
        return path[-1][0][0] + path[-1][1], self._audit()

    def _audit(self) -> str:
        out, state, at = [], 0, len(self.path) - 1
        while True:
            letter = self.path[at][2][state]
            if letter == ".":
                return "".join(out)
            out.append(letter)
            if letter == "I":
                state = LEADS[state][PUT[state]]
                continue
            if letter == "K":
                state = LEADS[state][(ord(self.text[at - 1]) - ord("a")) // 4]
            elif letter == "R":
                state = LEADS[state][PUT[state]]
            at -= 1


def audits(conversations: DataFrame) -> DataFrame:
    """``key`` and the counts, cost and audit of every conversation, from ``key``, ``gaps``, ``signature``."""

    def run(batches):
        automaton, last, result = Automaton(), None, None
        for batch in batches:
            out = []
            for key, gaps, backwards in zip(*(batch.column(c).to_pylist() for c in ("key", "gaps", "backwards"))):
                if backwards != last:
                    cost, audit = automaton.read(backwards)
                    result, last = (*_counts(backwards), cost, audit), backwards
                out.append((key, gaps, *result))
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    # The id is part of the order, so that conversations alike are many tasks.
    rows = conversations.select("key", "gaps", F.reverse("signature").alias("backwards"))
    rows = rows.repartitionByRange("backwards", "key").sortWithinPartitions("backwards", "key")
    return rows.mapInArrow(run, f"key string, {_RESULT}")


_LEGAL = {"su", "ua", "au"}


def _counts(backwards: str) -> tuple[int, int, int, int]:
    faults = [sum(backwards.count(chr(ord("a") + 4 * role + fault)) for role in range(4)) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    roles = backwards[::-1].translate(_INITIALS)
    return (*faults, sum(roles[k : k + 2] not in _LEGAL for k in range(len(roles) - 1)))


_INITIALS = {ord("a") + 4 * role + fault: (ROLES + "-")[role] for role in range(4) for fault in range(4)}


# --- applying audits -------------------------------------------------------------------------------------------------


class _Applied:
    """Rows of one conversation on their way through its audit."""

    def __init__(self, audit: str, put):
        self.audit, self.put, self.at, self.state = audit, put, 0, 0

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(NAMES[PUT[self.state]], "", PUT[self.state])

    def _write(self, role: str, text: str, kind: int) -> None:
        self.put(role, text)
        self.state = LEADS[self.state][kind]
        self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        if letter == "D":
            self.at += 1
        elif letter == "K":
            self._write(role, text, ROLES.index(role[0]))
        else:
            self._write(NAMES[PUT[self.state]], text, PUT[self.state])

    def end(self) -> None:
        self._insert()


class _Digest:
    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False


def _streamed(rows: DataFrame, results: DataFrame) -> DataFrame:
    """A conversation's result, then its rows in order; conversations one after the other."""
    kept = rows.where("times > 0").withColumn("digest", _digest())
    texts = kept.select("key", F.lit(1).alias("kind"), "turn", "digest", "role", "text", "times", F.lit(None).cast(f"struct<{_struct()}>").alias("result"))
    heads = results.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("times"), F.struct(*[c.split()[0] for c in _RESULT.split(", ")]).alias("result"),
    )
    both = heads.union(texts).repartition("key").sortWithinPartitions("key", "kind", "turn", "digest")
    return both.select("key", "kind", "role", "text", "times", "result")


def _struct() -> str:
    return ", ".join(":".join(c.split()) for c in _RESULT.split(", "))


def _columns(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "role", "text", "times", "result")))


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of every conversation of ``damaged`` or ``undamaged`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_OUT))

    def run(batches):
        head = applied = digest = None

        def done():
            applied.end()
            return {"conv_id": None if head[0] == " " else int(head[0]), **head[1], "repaired_sha256": digest.sha.hexdigest()}

        for batch in batches:
            out = []
            for key, kind, role, text, times, result in _columns(batch):
                if kind == 0:
                    if head:
                        out.append(done())
                    head, digest = (key, result), _Digest()
                    applied = _Applied(result["audit"], digest.put)
                else:
                    for _ in range(times):
                        applied.row(role, text)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if head:
            yield pa.RecordBatch.from_pylist([done()], schema=arrow)

    results = audits(signatures(symbols(rows)))
    return _streamed(rows, results).mapInArrow(run, _OUT)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``role``, ``text`` of every repaired conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        applied, out, place, key = None, [], 0, None

        def put(role, text):
            nonlocal place
            place += 1
            out.append({"conv_id": None if key == " " else int(key), "place": place, "role": role, "text": text})

        for batch in batches:
            for own, kind, role, text, times, result in _columns(batch):
                if kind == 0:
                    if applied:
                        applied.end()
                    key, place, applied = own, 0, _Applied(result["audit"], put)
                else:
                    for _ in range(times):
                        applied.row(role, text)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
        if applied:
            applied.end()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _streamed(rows, audits(signatures(symbols(rows)))).mapInArrow(run, "conv_id long, place long, role string, text string")


# The checksum byte by byte over a table made from its polynomial; cost to go from each signature's end, one row at a
# time; then the audit's letters are matched with rows.  Roles put in alternate, whatever the letters.
def _pay(best: str, letter: str, cost) -> str:
    """SQL of a best (cost, audit) with one more letter in front."""
    return f"lpad((left({best}, 7)::INT + {cost})::VARCHAR, 7, '0') || ':{letter}' || substr({best}, 9)"


ORACLE_SQL = rf"""
WITH RECURSIVE
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(b))),
rows_ AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS code FROM rows_, crc_table),
damaged AS (
  SELECT conv_id, turn, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM coded),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nth) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM numbered),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
-- Per conversation and row from the end: best (cost, audit) in each state, as text that sorts by cost and then audit.
walk AS (
  SELECT conv_id, n AS pos, '0000000:' AS q0, '0000010:II' AS q1, '0000005:I' AS q2, '0000000:' AS q3 FROM facts
  UNION ALL
  SELECT conv_id, pos - 1, least(p0, to2), least(p1, to2), least(p2, to3), least(p3, to2) FROM (
    SELECT *, {_pay(f"least(p2, {_pay('p3', 'I', 5)})", "I", 5)} AS to2, {_pay(f"least(p3, {_pay('p2', 'I', 5)})", "I", 5)} AS to3 FROM (
      SELECT w.conv_id, w.pos,
        least({_pay("q0", "D", 2)}, CASE WHEN fine AND f.i = 's' THEN {_pay("q1", "K", "flaw")} END,
          CASE WHEN fine AND f.i = 'u' THEN {_pay("q2", "K", "flaw")} END, CASE WHEN fine THEN {_pay("q2", "R", "flaw + 1")} END) AS p0,
        least({_pay("q1", "D", 2)}, CASE WHEN fine AND f.i = 'u' THEN {_pay("q2", "K", "flaw")} END, CASE WHEN fine THEN {_pay("q2", "R", "flaw + 1")} END) AS p1,
        least({_pay("q2", "D", 2)}, CASE WHEN fine AND f.i = 'a' THEN {_pay("q3", "K", "flaw")} END, CASE WHEN fine THEN {_pay("q3", "R", "flaw + 1")} END) AS p2,
        least({_pay("q3", "D", 2)}, CASE WHEN fine AND f.i = 'u' THEN {_pay("q2", "K", "flaw")} END, CASE WHEN fine THEN {_pay("q2", "R", "flaw + 1")} END) AS p3
      FROM walk w JOIN (SELECT *, fault NOT IN ('b', 'd') AS fine, CASE fault WHEN 't' THEN 5 ELSE 0 END AS flaw FROM faulty) f
        ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.nth = w.pos))),
best AS (SELECT conv_id, split_part(q0, ':', 1)::BIGINT AS cost, split_part(q0, ':', 2) AS audit FROM walk WHERE pos = 0),
letters AS (
  SELECT conv_id, k, audit[k] AS letter, k - length(replace(audit[:k], 'I', '')) AS puts, length(replace(audit[:k], 'I', '')) AS nth
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
written AS (
  SELECT l.conv_id, l.k, l.letter, f.role, CASE WHEN l.letter = 'I' THEN '' ELSE f.text END AS text,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) - CASE WHEN first_value(CASE WHEN l.letter = 'K' THEN f.i END) OVER (PARTITION BY l.conv_id ORDER BY l.k) = 's' THEN 1 ELSE 0 END AS place
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.nth = l.nth AND l.letter <> 'I' WHERE l.letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole
  FROM written GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
