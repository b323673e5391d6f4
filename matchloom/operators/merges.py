"""Merging of partial and late records without losing richer or later state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import empty_value, rank_of, shrink

TERMINAL = ("FINISHED",)
#: The scalar columns of a poll's row that merges decide on.
SCALARS = ("status", "minute", "display_clock", "score_home", "score_away")


def merge_payload(base: Column, incoming: Column) -> Column:
    """Payload of both as JSON with ordered keys: new keys are added, non-empty values win, empty ones leave what is there."""
    old, new = shrink(base), shrink(incoming)
    pick = lambda k: F.when(F.map_contains_key(new, k) & ~(empty_value(new[k]) & F.map_contains_key(old, k)), new[k]).otherwise(old[k])
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    # JSON null of a key is a value of its own, which a map of variants keeps and a null would lose.
    pair = lambda k: F.concat(F.to_json(F.array(k)), F.lit("\0"), F.coalesce(F.to_json(pick(k)), F.lit("null")))
    texts = F.transform(keys, lambda k: F.regexp_replace(pair(k), "^\\[(.*)\\]\0", "$1:"))
    return F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))


def _filled(base: Column, incoming: Column, names: tuple[str, ...]) -> dict[str, Column]:
    return {n: F.coalesce(incoming[n], base[n]) for n in names}


def merge_detail(board: Column, detail: Column, identity: tuple[str, ...] = ("kickoff_utc",), payload: bool = False) -> dict[str, Column]:
    """Columns of one poll's scoreboard row and detail row merged.

    The detail wins; what it leaves null is filled, except the clock, where null
    is data. If the detail is behind in its lifecycle, the scoreboard gives
    status and clock, and its non-null scores win. ``identity`` names further
    columns to fill; ``payload`` merges payloads so that nothing rich is lost.
    """
    behind = rank_of(detail["status"]) < rank_of(board["status"])
    pick = lambda c: F.when(behind, board[c]).otherwise(detail[c])
    score = lambda c: F.when(behind & board[c].isNotNull(), board[c]).otherwise(F.coalesce(detail[c], board[c]))
    merged = {"status": pick("status"), "minute": pick("minute"), "display_clock": pick("display_clock"), "score_home": score("score_home"), "score_away": score("score_away")}
    return merged | _filled(board, detail, identity) | ({"payload": merge_payload(board["payload"], detail["payload"])} if payload else {})


def merge_over_base(base: Column, snapshot: Column, identity: tuple[str, ...] = (), payload: bool = False) -> dict[str, Column]:
    """Columns of a snapshot over an earlier one: its own status and clock stand, null scores and identity are filled."""
    merged = {n: snapshot[n] for n in ("status", "minute", "display_clock")} | _filled(base, snapshot, ("score_home", "score_away", *identity))
    return merged | ({"payload": merge_payload(base["payload"], snapshot["payload"])} if payload else {})


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def not_regressing(stored: Column, candidate: Column, force_terminal: bool = True) -> dict[str, Column]:
    """Columns of a closing row over the stored one: scores never fall, a finished row stays finished.

    Forced, a row that is not finished becomes so and loses its clock. A null clock
    is filled from a stored row that is finished.
    """
    done, genuine = is_terminal(stored["status"]), is_terminal(candidate["status"])
    status = F.when(done & ~genuine, stored["status"]).when(~genuine & F.lit(force_terminal), F.lit("FINISHED")).otherwise(candidate["status"])
    clock = lambda c: F.coalesce(F.when(genuine | F.lit(not force_terminal), candidate[c]), F.when(done, stored[c]))
    return {
        "status": status, "minute": clock("minute"), "display_clock": clock("display_clock"),
        "score_home": F.greatest(stored["score_home"], candidate["score_home"]), "score_away": F.greatest(stored["score_away"], candidate["score_away"]),
    }


def paired_clock(winner: Column, other: Column, shut: Column) -> dict[str, Column]:
    """minute and display_clock of the winner, a null one filled by the other side unless ``shut``.

    The other side counts if it has the winner's status, or both are finished, and
    if its other clock field does not contradict the winner's.
    """
    open_ = ~shut & (other["status"].eqNullSafe(winner["status"]) | (is_terminal(winner["status"]) & is_terminal(other["status"])))
    agree = lambda c: winner[c].isNull() | other[c].isNull() | (winner[c] == other[c])
    fill = lambda c, by: F.coalesce(winner[c], F.when(open_ & agree(by), other[c]))
    return {"minute": fill("minute", "display_clock"), "display_clock": fill("display_clock", "minute")}


def _accrue_step(old: Column, new: Column, identity: tuple[str, ...], payload: bool, events: bool) -> list[Column]:
    was, now = is_terminal(old["status"]), is_terminal(new["status"])
    falls = F.coalesce(new["score_home"] < old["score_home"], F.lit(False)) | F.coalesce(new["score_away"] < old["score_away"], F.lit(False))
    vetoed = (was == now) & falls
    keeps = vetoed | (was & ~now)  # the older side wins
    sure = vetoed | (was != now)  # and the winner is believed in everything
    clocks = [paired_clock(*sides, vetoed) for sides in ((old, new), (new, old))]
    clock = lambda c: F.when(keeps, clocks[0][c]).otherwise(clocks[1][c])
    out = {"status": F.when(keeps, old["status"]).otherwise(new["status"]), "minute": clock("minute"), "display_clock": clock("display_clock")}
    out |= {c: F.greatest(old[c], new[c]) for c in ("score_home", "score_away")}
    out |= {c: F.when(keeps, F.coalesce(old[c], new[c])).otherwise(F.coalesce(new[c], old[c])) for c in identity}
    if payload:
        out["payload"] = F.when(keeps, merge_payload(new["payload"], old["payload"])).otherwise(merge_payload(old["payload"], new["payload"]))
    if events:
        some = lambda x: F.coalesce(F.size(x["events"]) > 0, F.lit(False))
        longer = F.coalesce(F.size(new["events"]), F.lit(0)) >= F.coalesce(F.size(old["events"]), F.lit(0))
        winner = F.when(keeps, F.when(some(old), old["events"]).otherwise(new["events"])).otherwise(F.when(some(new), new["events"]).otherwise(old["events"]))
        out["events"] = F.when(sure | (some(new) & now), winner).when(~some(new), old["events"]).when(~some(old) | longer, new["events"]).otherwise(old["events"])
    return [c.alias(n) for n, c in out.items()]


def accrue(rows: DataFrame, keys: list[str], order: str, identity: tuple[str, ...] = ()) -> DataFrame:
    """Order-dependent fold of a key's rows into the best known state.

    Scores never fall. Between two finished or two open states a row with a lower
    score is vetoed and adds only what is missing; a finished state wins over an
    open one in everything; else the newer row wins, a longer list of events
    being kept over a shorter one unless the newer is final. ``payload`` and
    ``events`` are folded if rows have them. The fold runs in the executors over
    each key's own rows, of which there are as many as polls.
    """
    parts = [n for n in (*SCALARS, *identity, "payload", "events") if n in rows.columns]
    polls = rows.groupBy(*keys).agg(F.collect_list(F.struct(order, *parts)).alias("polls"))
    # Ordered by the order column alone: events and payloads need no order of their own.
    ranked = F.array_sort("polls", lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))
    kind = "struct<" + ",".join(f"{n}:{rows.schema[n].dataType.simpleString()}" for n in parts) + ">"
    plain = lambda x: F.struct(*[x[n].alias(n) for n in parts]).cast(kind)
    step = lambda old, new: F.struct(*[c for c in _accrue_step(old, new, identity, "payload" in parts, "events" in parts)]).cast(kind)
    folded = F.aggregate(F.slice(F.col("ranked"), 2, F.size("ranked")), plain(F.col("ranked")[0]), step)
    return polls.select(*keys, ranked.alias("ranked")).select(*keys, folded.alias("r")).select(*keys, *[f"r.{n}" for n in parts])


def give_up(force_terminal: bool = True, identity: tuple[str, ...] = ()) -> dict[str, Column]:
    """Columns of a closing row from the struct columns fallback, fresh, baseline and stored, any of them null.

    The candidate is fallback and fresh accrued, else what there is of them, else
    baseline, else stored; it lies over the best other base and never regresses
    behind what is stored.
    """
    fallback, fresh, baseline, stored = map(F.col, ("fallback", "fresh", "baseline", "stored"))
    names = (*SCALARS, *identity)
    both = F.struct(*_accrue_step(fallback, fresh, identity, False, False))
    candidate = F.when(fallback.isNotNull() & fresh.isNotNull(), both).otherwise(F.coalesce(*[F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in names])) for x in (fresh, fallback, baseline, stored)]))
    base = F.coalesce(*[F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in names])) for x in (baseline, fallback, stored)])
    over = merge_over_base(base, candidate, identity)
    merged = F.struct(*[over[n].alias(n) for n in names])
    return not_regressing(stored, merged, force_terminal) | {n: over[n] for n in identity}


def worth_retaining(row: Column, events: bool = False) -> Column:
    """Whether a captured row says something: events, a score, or that the match is over."""
    some = F.coalesce(F.size(row["events"]) > 0, F.lit(False)) if events else F.lit(False)
    return some | row["score_home"].isNotNull() | row["score_away"].isNotNull() | is_terminal(row["status"])


def supersedes(live: Column, captured: Column) -> Column:
    """Whether a live row proves a captured end false: no known score falls, and one rises or, all being equal, its minute is later."""
    falls = lambda c: captured[c].isNotNull() & (live[c].isNull() | (live[c] < captured[c]))
    rises = lambda c: F.coalesce(live[c] > captured[c], F.lit(False))
    later = captured["score_home"].isNotNull() & captured["score_away"].isNotNull() & F.coalesce(live["minute"] > captured["minute"], F.lit(False))
    return ~falls("score_home") & ~falls("score_away") & (rises("score_home") | rises("score_away") | later)


def went_off(before: Column, now: Column) -> Column:
    """Whether a live match is live no more."""
    live = lambda x: F.coalesce(x["status"].isin("IN_PLAY", "PAUSED"), F.lit(False))
    return live(before) & ~live(now)


def first_sight_finished(now: Column, before: Column, stored: Column) -> Column:
    """Whether a match is over that was never seen nor stored."""
    return is_terminal(now["status"]) & before.isNull() & stored.isNull()


def masked_upsert(log: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Current row of a change log whose ``provided`` array names the columns each change supplies.

    A supplied null wins, an unsupplied column keeps its value.
    """
    current = [F.max_by(c, F.when(F.array_contains("provided", c), F.col(version))).alias(c) for c in columns]
    return log.groupBy(*keys).agg(*current)


def flip(df: DataFrame, turned: Column) -> DataFrame:
    """Sides swapped where ``turned``: every home_ and away_ column with its counterpart."""
    names = df.columns
    other = lambda n: n.replace("home", "\0").replace("away", "home").replace("\0", "away")
    return df.select(*[F.when(turned, F.col(other(n))).otherwise(F.col(n)).alias(n) if other(n) in names and other(n) != n else F.col(n) for n in names])


def nearest_in_window(left: DataFrame, right: DataFrame, keys: list[str], at: str, minutes: int) -> DataFrame:
    """Per left row (column ``id``) the right row (column ``rid``) of the same keys nearest in time within the window; of equals the smaller id.

    Both sides are dealt into buckets as wide as the window, so the range join is
    an equi-join with three buckets and no key's rows meet all others.
    """
    width = minutes * 60
    bucket = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / width)
    l_side = left.select(*keys, F.col("id"), F.col(at).alias("l_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    r_side = right.select(*keys, F.col("rid"), F.col(at).alias("r_at"), bucket.alias("b"))
    apart = F.abs(F.timestamp_diff("SECOND", F.col("l_at"), F.col("r_at")))
    near = l_side.join(r_side, [*keys, "b"]).withColumn("apart", apart).where(F.col("apart") <= width)
    return near.groupBy("id").agg(F.min(F.struct("apart", "rid")).alias("m")).select("id", F.col("m.rid").alias("rid"), F.col("m.apart").alias("apart"))


def authority(arms: DataFrame, key: str) -> DataFrame:
    """One row per key by rank, latest update and id; ``arms`` has rank, updated_at and match_id."""
    order = Window.partitionBy(key).orderBy("rank", F.desc_nulls_last("updated_at"), "match_id")
    return arms.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
