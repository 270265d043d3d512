"""Repair of the structure of conversations by the cheapest edits.

A repaired conversation has the roles (system? (user assistant)+)?. Its turns are kept, given another
role, deleted, or joined by inserted empty ones. Windows flag the faults of turns; the turns of a
conversation are gathered as small structs in order, without their texts, and aggregate() carries the
cheapest edits so far for each of four states: nothing yet, after a system turn, after a user's,
after an assistant's. The edits then meet the texts row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.llm.common import joined_sha256, stored

#: What edits cost; a truncated turn that is not deleted costs TRUNCATED more.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space; its complement makes a turn that is not blank.
SPACE = r"\x20\x09-\x0D"
#: More than any sum of costs.
NEVER = 1 << 40


def faults(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text, ...) with row (a number of each), mark (a hash of role and text) and
    fault: "blank", "duplicate" (role and text stood earlier in the conversation), "truncated" or null.

    Order is by turn, nulls first; turns of one number are in order of their role, a hash of their text, and row."""
    keyed = turns.withColumn("row", F.monotonically_increasing_id())
    keyed = keyed.withColumn("mark", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    earlier = F.row_number().over(Window.partitionBy("conv", "mark").orderBy(F.col("turn").asc_nulls_first(), "row")) > 1
    return keyed.withColumn("fault", F.when(blank, "blank").when(earlier, "duplicate").when(truncated, "truncated"))


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _edits(turns: Column) -> Column:
    """struct(cost, audit, illegal) of an array of turns (initial, fault) in order."""

    def state(cost: Column, audit: Column) -> Column:
        return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))

    def then(s: Column, cost: Column, letter: Column) -> Column:
        return state(s["cost"] + cost, F.concat(s["audit"], letter))

    never = state(F.lit(NEVER), F.lit(""))
    put = lambda s: then(s, F.lit(INSERT), F.lit("I"))

    def inserted(s: Column) -> Column:
        """The states with turns inserted: a user's from any state, an assistant's behind a user's."""
        with_user = F.least(s["user"], put(s["none"]), put(s["system"]), put(s["assistant"]))
        return _let(with_user, lambda u: F.struct(s["none"].alias("none"), s["system"].alias("system"), u.alias("user"), F.least(s["assistant"], put(u)).alias("assistant"), s["before"].alias("before"), s["illegal"].alias("illegal")))

    def step(s: Column, x: Column) -> Column:
        may_stay = x["fault"].isNull() | (x["fault"] == "truncated")
        extra = F.when(x["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
        gone = lambda of: then(of, F.lit(DELETE), F.lit("D"))

        def turn(of: Column, initial: str) -> Column:
            same = x["initial"] == initial
            return F.when(may_stay, then(of, extra + F.when(same, 0).otherwise(RENAME), F.when(same, "K").otherwise("R"))).otherwise(never)

        system = F.when(may_stay & (x["initial"] == "s"), then(s["none"], extra, F.lit("K"))).otherwise(never)
        first = F.least(s["none"], s["system"], s["assistant"])
        pair = F.concat(s["before"], x["initial"])
        illegal = s["illegal"] + F.when(s["before"].isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)
        after = F.struct(gone(s["none"]).alias("none"), F.least(gone(s["system"]), system).alias("system"), F.least(gone(s["user"]), turn(first, "u")).alias("user"), F.least(gone(s["assistant"]), turn(s["user"], "a")).alias("assistant"), x["initial"].alias("before"), illegal.cast("long").alias("illegal"))
        return _let(after, inserted)

    start = F.struct(state(F.lit(0), F.lit("")).alias("none"), never.alias("system"), state(F.lit(INSERT), F.lit("I")).alias("user"), state(F.lit(2 * INSERT), F.lit("II")).alias("assistant"), F.lit(None).cast("string").alias("before"), F.lit(0).cast("long").alias("illegal"))
    done = lambda s: _let(F.least(s["none"], s["assistant"]), lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"), s["illegal"].alias("illegal")))
    return F.aggregate(turns, start, step, done)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest repair of each conversation, and the repaired turns.

    Nulls of role and text count as one space, a null conversation as one of its own. Costs: keep 0, another
    role (user or assistant) 1, delete 2, insert an empty turn (user or assistant) 5; blank and duplicate
    turns must go, a truncated one that stays costs 5 more. Of equally cheap edits those whose initials
    (K, R, D, I) come first as text are taken, and they say which turns result.

    Returns (conversations, lines). conversations: conv_col, gaps (numbers missing between the least and
    greatest turn), blank, duplicate, truncated (turns by their first fault), illegal (neighbours
    whose roles may not follow), cost, audit (the initials). lines: conv_col, place (from 0), role, text.
    `every` may have a column conv_col with more conversations: those without turns have zeros and an empty audit.
    Repeated rows are duplicates of one another. Other columns are not read; no rows give no rows.

    A conversation's turns travel without their texts, as one array of some 40 bytes a turn. The audit grows
    by a letter a turn in each of four states, so that the fold's time grows with the square of a conversation.
    """
    given = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(k) for c, k in ((role_col, "role"), (text_col, "text"))])
    flagged = stored(faults(given), "turns")
    small = flagged.select("conv", "turn", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", F.xxhash64("mark").alias("mark"), "row", "fault").alias("t"))
    if every is not None:
        small = small.unionByName(every.select(F.col(conv_col).alias("conv")), allowMissingColumns=True)
    count = lambda fault: F.count_if(F.col("t.fault") == fault).alias(fault)
    listed = small.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"), *map(count, ("blank", "duplicate", "truncated")))
    numbers = F.array_distinct(F.filter(F.transform("ts", lambda t: t["turn"]), lambda n: n.isNotNull()))
    listed = listed.withColumn("numbers", numbers)
    gaps = F.when(F.size("numbers") == 0, 0).otherwise(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size("numbers")).cast("long")
    initials = F.transform("ts", lambda t: F.struct(F.substring(t["role"], 1, 1).alias("initial"), t["fault"].alias("fault")))
    found = listed.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", _edits(initials).alias("e"), "ts")
    # Only turns that go stand before the first repaired one; a system turn there shifts those behind it.
    opens, lead = F.regexp_extract("e.audit", "^D*(.?)", 1), F.get("ts", F.length(F.regexp_extract("e.audit", "^D*", 0)))["role"]
    lag = F.coalesce((opens == "K") & F.startswith(lead, F.lit("s")), F.lit(False)).cast("int")
    # Each turn with the insertions before it, and those behind the last turn.
    pieces = F.concat(F.regexp_extract_all("e.audit", F.lit("I*[KRD]"), F.lit(0)), F.array(F.regexp_extract("e.audit", r"I*\z", 0)))
    found = stored(found.select("conv", "gaps", "blank", "duplicate", "truncated", "e", lag.alias("lag"), F.arrays_zip(F.transform("ts", lambda t: t["row"]).alias("row"), pieces.alias("edits")).alias("edits")), "repairs")
    each = found.select("conv", "lag", F.posexplode("edits").alias("at", "x")).select("conv", "lag", "at", F.col("x.row").alias("row"), F.col("x.edits").alias("edits"))
    makes = F.length(F.replace("edits", F.lit("D"), F.lit("")))
    before = F.coalesce(F.sum(makes).over(Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("conv", "lag", "row", before.alias("before"), F.posexplode(F.filter(F.split("edits", ""), lambda c: c != "")).alias("i", "edit")).filter("edit <> 'D'")
    place = F.col("before") + F.col("i")
    role = F.when((place - F.col("lag")) % 2 == 0, "user").otherwise("assistant")
    each = stored(each.select("conv", place.alias("place"), F.when(F.col("edit") != "I", F.col("row")).alias("row"), F.when(F.col("edit") != "K", role).alias("new")), "edits")
    taken = each.filter("row is not null").hint("merge").join(flagged.select("row", "role", "text"), "row").select("conv", "place", F.coalesce("new", "role").alias("role"), "text")
    put = each.filter("row is null").select("conv", "place", F.col("new").alias("role"), F.lit("").alias("text"))
    out = found.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "e.illegal", "e.cost", "e.audit")
    return out, taken.unionByName(put).withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by a hash of their rows; nulls of role
    and text become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def digests(turns: DataFrame) -> DataFrame:
    """The repair of damaged conversations, with the SHA-256 of the repaired ones: role:text, a line each."""
    out, lines = repaired(damaged(turns), every=turns.select("conv_id").distinct())
    made = joined_sha256(lines.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("piece")), "conv_id", ["place"], "\n")
    made = made.select(F.col("conv_id").alias("of"), "sha256")
    return out.join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*out.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _state_sql(name: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {name}.c + ({cost}), 'a': {name}.a || {letter}, 't': {name}.t || {line}}}"


def _inserted_sql(source: str) -> str:
    """The states of a table with turns inserted."""
    put = lambda of, role: _state_sql(of, str(INSERT), "'I'", f"chr(10) || '{role}:'")
    with_user = f"select conv, i, e, s, least(u, {put('e', 'user')}, {put('s', 'user')}, {put('a', 'user')}) as u, a from {source}"
    return f"select conv, i, e, s, u, least(a, {put('u', 'assistant')}) as a from ({with_user})"


_NEVER_SQL = f"{{'c': {NEVER}::bigint, 'a': '', 't': ''}}"
_STAYS_SQL = "(fault is null or fault = 'truncated')"
_DELETED_SQL = {of: _state_sql(of, str(DELETE), "'D'") for of in "esua"}


def _turn_sql(of: str, role: str) -> str:
    same = f"x.role[1] = '{role[0]}'"
    kept = _state_sql(f"({of})", f"x.extra + case when {same} then 0 else {RENAME} end", f"case when {same} then 'K' else 'R' end", f"chr(10) || case when {same} then x.role else '{role}' end || ':' || x.text")
    return f"case when {_STAYS_SQL} then {kept} else {_NEVER_SQL} end"


_SYSTEM_SQL = f"case when x.role[1] = 's' and {_STAYS_SQL} then {_state_sql('e', 'x.extra', "'K'", 'chr(10) || x.role || chr(58) || x.text')} else {_NEVER_SQL} end"
_START_SQL = f"(select distinct conv_id as conv, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': ''}} as e, {_NEVER_SQL} as s, {_NEVER_SQL} as u, {_NEVER_SQL} as a from conversations)"
_STEP_SQL = f"""(select x.conv, x.seq as i, {_DELETED_SQL["e"]} as e, least({_DELETED_SQL["s"]}, {_SYSTEM_SQL}) as s,
        least({_DELETED_SQL["u"]}, {_turn_sql("least(e, s, a)", "user")}) as u, least({_DELETED_SQL["a"]}, {_turn_sql("u", "assistant")}) as a
        from steps p join turns x on x.conv is not distinct from p.conv and x.seq = p.i + 1)"""

#: The damage, the faults and the same four states, by recursion over the turns of all conversations at once.
DIGESTS_SQL = rf"""
with recursive
crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, b: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
kinds as (
    select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
    from conversations),
hashed as (
    select kinds.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::bigint), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as kind
    from kinds, crc),
hurt as (
    select conv, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy
    from hashed where kind <> 0),
seated as (select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as seq from hurt),
flagged as (
    select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
        when row_number() over (partition by conv, role, text order by seq) > 1 then 'duplicate'
        when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault,
        lag(role[1]) over (partition by conv order by seq) || role[1] as pair
    from seated),
turns as (select *, case when fault = 'truncated' then {TRUNCATED} else 0 end as extra from flagged),
steps as (
    {_inserted_sql(_START_SQL)}
    union all
    {_inserted_sql(_STEP_SQL)}),
last as (select conv, i, least(e, a) as r from steps qualify row_number() over (partition by conv order by i desc) = 1),
counts as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
        count_if(fault = 'truncated') as truncated, count_if(pair not in ('su', 'ua', 'au')) as illegal
    from turns group by conv)
select l.conv as conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, r.c::bigint as cost, r.a as audit, sha256(substr(r.t, 2)) as repaired_sha256
from last l left join counts c on l.conv is not distinct from c.conv
"""
