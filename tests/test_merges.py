"""The fold of polls and its parts against a plain fold in Python."""

import json
import random

from pyspark.sql import functions as F

from matchloom.operators import merges

FIELDS = ("status", "minute", "display_clock", "score_home", "score_away", "kickoff_utc", "payload", "events")
STATE = "struct<status:string,minute:int,display_clock:string,score_home:int,score_away:int,kickoff_utc:string,payload:string,events:array<int>>"


def any_state(dice):
    return {
        "status": dice.choice(["FINISHED", "IN_PLAY", "PAUSED", None]), "minute": dice.choice([None, 10, 90]), "display_clock": dice.choice([None, "10'", "90'"]),
        "score_home": dice.choice([None, 0, 1, 2]), "score_away": dice.choice([None, 0, 1]), "kickoff_utc": dice.choice([None, "a", "b"]),
        "payload": dice.choice([None, "{}", '{"x": 1}', '{"x": "", "y": [2]}', '{"y": null, "z": "q"}', "broken"]), "events": dice.choice([None, [], [1], [1, 2], [3]]),
    }


def rich(base, incoming):
    def read(t):
        try:
            return json.loads(t or "{}")
        except ValueError:
            return {}

    out = dict(read(base))
    for k, v in read(incoming).items():
        if k not in out or v not in (None, "", [], {}):
            out[k] = v
    return out


def most(a, b):
    return max((x for x in (a, b) if x is not None), default=None)


def folded(states):
    best = dict(states[0], payload=rich(states[0]["payload"], None))
    for new in states[1:]:
        new = dict(new)
        over = [x["status"] == "FINISHED" for x in (best, new)]
        lower = any(best[c] is not None and new[c] is not None and new[c] < best[c] for c in ("score_home", "score_away"))
        veto = over[0] == over[1] and lower
        first, second = (best, new) if veto or over == [True, False] else (new, best)
        sure = veto or over[0] != over[1]
        out = {"status": first["status"], **{c: most(best[c], new[c]) for c in ("score_home", "score_away")}}
        clock = {"minute": first["minute"], "display_clock": first["display_clock"]}
        if not veto and (first["status"] == second["status"] or all(over)):
            for c, by in (("minute", "display_clock"), ("display_clock", "minute")):
                if first[c] is None and (first[by] is None or second[by] is None or first[by] == second[by]):
                    clock[c] = second[c]
        out |= clock
        out["kickoff_utc"] = first["kickoff_utc"] if first["kickoff_utc"] is not None else second["kickoff_utc"]
        out["payload"] = rich(json.dumps(second["payload"]) if second is best else second["payload"], json.dumps(first["payload"]) if first is best else first["payload"])
        if sure:
            out["events"] = first["events"] or second["events"]
        elif new["events"] and over[1]:
            out["events"] = new["events"]
        else:
            out["events"] = new["events"] if new["events"] and len(new["events"]) >= len(best["events"] or []) else best["events"]
        best = out
    return best


def test_accrue_is_the_fold(spark):
    dice = random.Random(1)
    histories = [[any_state(dice) for _ in range(dice.randint(1, 5))] for _ in range(200)]
    rows = [(k, n, *[s[c] for c in FIELDS]) for k, states in enumerate(histories) for n, s in enumerate(states)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, n int, " + STATE[7:-1].replace(":", " ").replace(",", ", "))
    for r in merges.accrue(df, ["k"], "n", ("kickoff_utc",)).collect():
        want = folded(histories[r.k])
        got = r.asDict()
        if len(histories[r.k]) > 1:  # the payload of a single row stays as written
            assert json.loads(got["payload"]) == want["payload"], histories[r.k]
        assert {c: got[c] for c in FIELDS if c not in ("payload", "events")} == {c: want[c] for c in FIELDS if c not in ("payload", "events")}, histories[r.k]
        assert (got["events"] or []) == (want["events"] or []), histories[r.k]


def closed(fallback, fresh, baseline, stored, force):
    pick = lambda *xs: next((x for x in xs if x), None)
    plain = lambda x: x and dict(x, payload=None, events=None)
    candidate = folded([plain(fallback), plain(fresh)]) if fallback and fresh else pick(fresh, fallback, baseline, stored)
    if not candidate:
        return None
    base = pick(baseline, fallback, stored) or {}
    out = dict(candidate)
    for c in ("score_home", "score_away"):
        out[c] = out[c] if out[c] is not None else base.get(c)
    real, done = out["status"] == "FINISHED", bool(stored) and stored["status"] == "FINISHED"
    if force and not real:
        out |= {"status": "FINISHED", "minute": None, "display_clock": None}
    if done:
        if not real:
            out["status"] = stored["status"]
        for c in ("minute", "display_clock"):
            out[c] = out[c] if out[c] is not None else stored[c]
    for c in ("score_home", "score_away"):
        out[c] = most(out[c], stored and stored[c])
    return {c: out[c] for c in merges.SCALARS}


def test_closing_rows(spark):
    dice = random.Random(2)
    sets = [[any_state(dice) if dice.random() < 0.7 else None for _ in range(4)] for _ in range(300)]
    rows = [(k, *[x and tuple(x[c] for c in FIELDS) for x in four]) for k, four in enumerate(sets)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} {STATE}" for n in ("fallback", "fresh", "baseline", "stored")))
    for force in (True, False):
        for r in df.select("k", *[c.alias(n) for n, c in merges.give_up(force).items()]).collect():
            want = closed(*sets[r.k], force)
            if want:
                assert {c: r[c] for c in merges.SCALARS} == want, (force, sets[r.k])


def test_payloads(spark):
    texts = [None, "", "x", "[1]", "{}", '{"a": 1}', '{"a": null, "b": ""}', '{"b": [], "a": {"z": 1, "c": "é"}}', '{"q\\"": "[]", "b": 0}', '{"b": false}']
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", merges.merge_payload(F.col("a"), F.col("b")).alias("m")).collect():
        objects = [t if t and t.startswith("{") else None for t in (r.a, r.b)]
        want = rich(*objects)
        assert json.loads(r.m) == want and list(json.loads(r.m)) == sorted(want)
