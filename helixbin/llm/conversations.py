"""Conversation structure repair: a fold over each conversation's turns that carries four (cost, audit) structs.

Turns are sorted by range over (conversation, turn, role, text) and numbered, so that no conversation, however long, is sorted in one
task; windows over content mark the faults. The turns of a conversation are folded in blocks of ``BLOCK`` turns: ``aggregate``
carries for each state of the grammar ``(s?(ua)+)?`` (nothing yet; after s; after u; after a) the cheapest cost and edits
that lead to it, and native ``least`` over (cost, audit) structs picks among them. The first block starts from the first state
only, later ones from each of the four; a second fold joins the blocks of a conversation.

``least`` on a prefix is right for the whole: two audits of one prefix have the same number of K, R and D; if one began with the other
it would have the same letters and fewer insertions, so be cheaper; so audits of equal cost first differ at a letter of both. One
insertion between turns is enough: a second one costs 5 more and leads to a state that serves nothing cheaper.

Defined results: null ids, turns, roles and texts are read as one space (a null turn sorts before all others; null ids are one
conversation, whose id stays null). Turns of one number are in order of role and text after the damage; repeated rows are rows of
their own. An initial is a role's first character, in its own case. A conversation without turns (or an empty table) has zeros,
an empty audit and the digest of the empty string, or no row. An audit is a string, so that it holds 2**31 edits at most. Of other
columns none is read, so that they may have any name. Texts are never gathered: digests are taken from sorted rows as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.llm.common import broadcast_if_small, materialize

NAMES = ("conv_id", "turn", "role", "text")
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns that are folded at a time; it changes no result.
BLOCK = 256
#: Cost of a state that cannot be reached.
NEVER = 1 << 40
WORD, TRIMMED = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+$"
STEP = "struct<cost:bigint,audit:string>"


def damaged(turns: DataFrame, salt: int = 20) -> DataFrame:
    """Turns after the damage that crc32(`conv_id:turn`) % 20 names; other columns are left out."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(salt))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """Turns with their place in the conversation from 0, in a table of shared storage: ranges are counted, then numbered inside."""
    order = ("conv_id", "turn", "role", "text")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}))
    in_range = Window.partitionBy("part", "conv_id").orderBy("line")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where("before > 0")  # conversations that begin in an earlier range
    spread = broadcast_if_small(materialize(offsets.select(F.col("conv_id").alias("o_conv"), F.col("part").alias("o_part"), "before")))
    same = F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part"))
    place = F.coalesce("before", F.lit(0)) + F.row_number().over(in_range) - 1
    out = dealt.join(spread, same, "left").withColumn("place", place)
    return out.select(*order, "place", F.floor(F.col("place") / BLOCK).alias("block"))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, block, initial, fault) of numbered turns: the first of b(lank), d(uplicate), t(runcated), or '-'."""
    last = F.substring(F.regexp_replace("text", TRIMMED, ""), -1, 1)
    own = F.when(~F.col("text").rlike(WORD), "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    same = Window.partitionBy("conv_id", "content").orderBy("place")
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    light = rows.select("conv_id", "turn", "place", "block", F.substring("role", 1, 1).alias("initial"), own.alias("own"), F.unhex(content).alias("content"))
    repeated = (F.col("own") != "b") & (F.row_number().over(same) > 1)
    return light.withColumn("fault", F.when(repeated, "d").otherwise(F.col("own"))).drop("own", "content")


def _plus(step: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((step["cost"] + cost).alias("cost"), F.concat(step["audit"], F.lit(letter)).alias("audit")).cast(STEP)


def _filled(c: Column) -> tuple[Column, Column, Column, Column]:
    """States with an insertion where that is cheaper: a user turn leads to the third, an assistant turn from there to the fourth."""
    return c["n"], c["s"], F.least(c["u"], *(_plus(c[k], INSERT, "I") for k in "nsa")), F.least(c["a"], _plus(c["u"], INSERT, "I"))


def _turn(carried: Column, turn: Column) -> Column:
    """The four structs after one more turn."""
    none, system, user, assistant = _filled(carried)
    initial, fault = turn["initial"], turn["fault"]
    stays = F.when(fault.isin("b", "d"), NEVER).when(fault == "t", TRUNCATED).otherwise(0).cast("long")
    is_ = lambda k: initial == k
    keep_or_rerole = lambda step, k: F.when(is_(k), _plus(step, stays, "K")).otherwise(_plus(step, stays + REROLE, "R"))
    dropped = lambda step: _plus(step, DELETE, "D")
    before_user = F.least(none, system, assistant)
    return F.struct(
        dropped(none).alias("n"),
        F.least(dropped(system), F.when(is_("s"), _plus(none, stays, "K"))).alias("s"),
        F.least(dropped(user), keep_or_rerole(before_user, "u")).alias("u"),
        F.least(dropped(assistant), keep_or_rerole(user, "a")).alias("a"),
    )


def _step(reached: Column) -> Column:
    return F.struct(F.when(reached, 0).otherwise(NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).cast(STEP)


def _illegal(initials: Column) -> Column:
    """Adjacent initials that may not follow each other."""
    pairs = F.when(F.length(initials) > 1, F.sequence(F.lit(1), F.length(initials) - 1))
    return F.coalesce(F.size(F.filter(pairs, lambda i: ~F.substr(initials, i, F.lit(2)).isin("su", "ua", "au"))).cast("long"), F.lit(0).cast("long"))


def blocks_folded(light: DataFrame) -> DataFrame:
    """A row a block: the faults, the initials at its ends, and the fold from each state in which it can start."""
    turn = F.struct("place", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(".").alias("initial"), "fault")
    rows = light.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    starts = F.when(F.col("block") == 0, F.array(F.lit("n"))).otherwise(F.array(*(F.lit(k) for k in "nsua")))
    fold = lambda start: F.aggregate("turns", F.struct(*(_step(start == k).alias(k) for k in "nsua")), _turn)
    initials = F.array_join(F.transform("turns", lambda t: t["initial"]), "")
    count = lambda k: F.size(F.filter("turns", lambda t: t["fault"] == k)).cast("long")
    rows = rows.withColumns({"initials": initials, "folds": F.transform(starts, fold), "blank": count("b"), "duplicate": count("d"), "truncated": count("t")})
    return rows.withColumns({"illegal": _illegal(F.col("initials")), "first": F.substring("initials", 1, 1), "last": F.substring("initials", -1, 1)}).drop("turns", "initials")


def audited(folded: DataFrame) -> DataFrame:
    """A row a conversation: faults, cost, audit, and ``pieces``: (block, state at its start, its edits)."""
    piece = "struct<block:bigint,start:string,edits:string>"
    step = f"struct<cost:bigint,audit:string,pieces:array<{piece}>>"
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    rows = folded.groupBy("conv_id").agg(*sums, F.array_sort(F.collect_list(F.struct("block", "first", "last", "folds"))).alias("blocks"))

    def joined(carried: Column, block: Column) -> Column:
        def to(end: str) -> Column:
            ways = []
            for at, start in enumerate("nsua"):
                way = F.get(block["folds"], F.lit(at))[end]  # null from the later states of a first block
                pieces = F.concat(carried[start]["pieces"], F.array(F.struct(block["block"], F.lit(start), way["audit"]).cast(piece)))
                ways.append(F.when(way.isNotNull(), F.struct(carried[start]["cost"] + way["cost"], F.concat(carried[start]["audit"], way["audit"]), pieces).cast(step)))
            return F.least(*ways).alias(end)

        return F.struct(*(to(end) for end in "nsua"))

    begin = F.struct(*(F.struct(F.lit(0 if k == "n" else NEVER), F.lit(""), F.array().cast(f"array<{piece}>")).cast(step).alias(k) for k in "nsua"))
    rows = rows.withColumn("f", F.aggregate("blocks", begin, joined))
    end_insert = F.array(F.struct(F.size("blocks").cast("long"), F.lit("u"), F.lit("I")).cast(piece))
    inserted = F.struct(F.col("f.u.cost") + INSERT, F.concat("f.u.audit", F.lit("I")), F.concat("f.u.pieces", end_insert)).cast(step)
    rows = rows.withColumn("best", F.least("f.n", "f.a", inserted))
    seam = F.transform(F.slice("blocks", 2, F.greatest(F.size("blocks") - 1, F.lit(0))), lambda b, i: F.concat(F.get("blocks", i)["last"], b["first"]))
    seams = F.size(F.filter(seam, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    return rows.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + seams).alias("illegal"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.col("best.pieces").alias("pieces"))


def repaired_blocks(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, block, out): the repaired turns of each block as structs (edit, role, text), in order."""
    turns = rows.groupBy(F.col("conv_id").alias("t_conv"), F.col("block").alias("t_block")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    pieces = audits.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", "p.*")
    both = pieces.join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("block") == F.col("t_block")), "left")
    dropped_first = F.length("edits") - F.length(F.ltrim(F.col("edits"), F.lit("D")))
    opener = (F.col("start") == "n") & (F.substr("edits", dropped_first + 1, F.lit(1)) == "K") & F.get("turns", dropped_first)["role"].startswith("s")
    # of the turns that come out, numbered from 1, those at this parity are the user's
    both = both.withColumn("odd", F.when(F.col("start") == "u", 0).when(F.coalesce(opener, F.lit(False)), 0).otherwise(1))

    def out(k: Column) -> Column:
        so_far = F.substr("edits", F.lit(1), k)
        turn = F.get("turns", F.length(F.translate(so_far, "I", "")) - 1)
        edit = F.substr("edits", k, F.lit(1))
        due = F.when(F.length(F.translate(so_far, "D", "")) % 2 == F.col("odd"), "user").otherwise("assistant")
        return F.struct(edit.alias("edit"), F.when(edit == "K", turn["role"]).otherwise(due).alias("role"), F.when(edit == "I", "").otherwise(turn["text"]).alias("text"))

    every = F.transform(F.when(F.length("edits") > 0, F.sequence(F.lit(1), F.length("edits"))), out)
    return both.select("conv_id", "block", F.filter(every, lambda t: t["edit"] != "D").alias("out"))


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns after damage and repair, numbered from 0 in each block of the conversation."""
    rows = numbered(damaged(turns))
    audits = materialize(audited(blocks_folded(with_faults(rows))))
    return repaired_blocks(rows, audits).select("conv_id", "block", F.posexplode("out").alias("place", "t")).select("conv_id", "block", "place", "t.*")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of each conversation, which come in order; only the running digest is kept."""
    last: tuple | None = None
    digest = hashlib.sha256()
    rows = lambda done: pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["d_conv", "repaired_sha256"])
    for batch in batches:
        done = []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(2)):
            if last is not None and last[0] == conv:
                digest.update(b"\n")
            else:
                if last is not None:
                    done.append((last[0], digest.hexdigest()))
                last, digest = (conv,), hashlib.sha256()
            digest.update(line.as_buffer())
        yield rows(done)
    if last is not None:
        yield rows([(last[0], digest.hexdigest())])


def judged(turns: DataFrame) -> DataFrame:
    """A row for every conversation of the undamaged table: gaps, faults, cost, audit and the digest of the repaired turns."""
    rows = numbered(damaged(turns))
    light = with_faults(rows)
    audits = materialize(audited(blocks_folded(light)))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy(F.col("conv_id").alias("g_conv")).agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    lines = repaired_blocks(rows, audits).select(F.col("conv_id").cast("long").alias("conv_id"), "block", F.posexplode("out").alias("place", "t"))
    lines = lines.select("conv_id", F.struct("block", "place").alias("at"), F.concat("t.role", F.lit(":"), "t.text").alias("line"))
    # a digest is taken in one task, which reads a conversation's lines one after the other
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_digest, "d_conv long, repaired_sha256 string")
    every = turns.select("conv_id").distinct()
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    out = every.join(gaps, same("g_conv"), "left").join(audits.drop("pieces").withColumnRenamed("conv_id", "a_conv"), same("a_conv"), "left").join(digests, same("d_conv"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    sha = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), sha)


def sql() -> str:
    """The query in DuckDB SQL: CRC-32 bit by bit, faults by windows, and the fold as a recursion over the turns' places."""
    crc = """xor(list_reduce([ord(x) FOR x IN string_split(conv || ':' || turn_s, '')], lambda c, b: xor(c >> 8,
        list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b) & 255)), CAST(4294967295 AS BIGINT)), 4294967295)"""
    new, user, assistant = "chr(10) || {} || ':' || text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    filled_u = "list_min([w.u, " + ", ".join(f"{{'c': w.{k}.c + 5, 'a': w.{k}.a || 'I', 'o': w.{k}.o || {user}}}" for k in "nsa") + "])"
    filled_a = f"list_min([w.a, {{'c': w.u.c + 5, 'a': w.u.a || 'I', 'o': w.u.o || {assistant}}}])"
    drop = lambda k: (k, "2", "D", "''")
    stay = lambda k, to: (k, f"x.stays + CASE WHEN x.initial = '{to[0]}' THEN 0 ELSE 1 END", "{}", new.format(f"CASE WHEN x.initial = '{to[0]}' THEN x.role ELSE '{to}' END"))

    def ways(*given: tuple[str, str, str, str]) -> str:
        parts = []
        for s, c, letter, o in given:
            if letter == "{}":
                to = "u" if "'user'" in o else "a"
                parts.append(f"{{'c': e.{s}.c + {c}, 'a': e.{s}.a || CASE WHEN x.initial = '{to}' THEN 'K' ELSE 'R' END, 'o': e.{s}.o || {o.replace('text', 'x.text')}}}")
            else:
                parts.append(f"{{'c': e.{s}.c + {c}, 'a': e.{s}.a || '{letter}', 'o': e.{s}.o || {o}}}")
        return "list_min([" + ", ".join(parts) + "])"

    system = f"CASE WHEN x.initial = 's' THEN list_min([{{'c': e.s.c + 2, 'a': e.s.a || 'D', 'o': e.s.o}}, {{'c': e.n.c + x.stays, 'a': e.n.a || 'K', 'o': e.n.o || {new.format('x.role').replace('text', 'x.text')}}}]) ELSE {ways(drop('s'))} END"
    state = lambda c: f"{{'c': CAST({c} AS BIGINT), 'a': '', 'o': ''}}"
    never = str(NEVER)
    return f"""
    WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, coalesce(CAST(turn AS VARCHAR), ' ') AS turn_s,
        coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
    marked AS (SELECT *, {crc} % 20 AS kind FROM raw),
    changed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM marked WHERE kind <> 0),
    placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM changed),
    faults AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM placed),
    x AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN {never} WHEN fault = 't' THEN 5 ELSE 0 END AS stays,
        place > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM faults),
    fold AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, {{'n': {state(0)}, 's': {state(never)}, 'u': {state(never)}, 'a': {state(never)}}} AS w FROM (SELECT DISTINCT conv_id FROM x)
        UNION ALL
        SELECT e.conv_id, x.place, {{'n': {ways(drop('n'))}, 's': {system}, 'u': {ways(drop('u'), stay('n', 'user'), stay('s', 'user'), stay('a', 'user'))}, 'a': {ways(drop('a'), stay('u', 'assistant'))}}}
        FROM (SELECT conv_id, place, w.n AS n, w.s AS s, {filled_u} AS u, {filled_a} AS a FROM fold) e JOIN x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.place = e.place + 1),
    ended AS (SELECT conv_id, list_min([w.n, w.a, {{'c': w.u.c + 5, 'a': w.u.a || 'I', 'o': w.u.o || {assistant}}}]) AS best FROM fold
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM x GROUP BY conv_id)
    SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM raw) r LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM r.conv_id
    """
