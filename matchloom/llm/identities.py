"""Variant spellings: which names mean one team or one player.

Names are taken apart (squad, place, kind of club; given name, surname). The
places of all team names are joined to the stated cities by an exact edit-radius
join over pivot cells. Players live in a product of two metrics: what they must
share (team, birthday, or shirt where one of the two has no team) is at distance
0 or infinity, their surnames are at edit distance. Every such stratum is parted
by as many pivots as its rows ask for, names near a boundary are placed on both
sides of it, and a true edit metric decides inside the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.metric import COUNTED, PIVOTS, letter_counts, pivot_table, radius_join
from matchloom.llm.names import GivenNames, Person, parse_person, parse_team, same_given, same_surname
from matchloom.llm.typography import plain
from matchloom.session import cut_lineage, shuffle_width

#: Edit radius within which a misspelled place is looked for.
PLACE_RADIUS = 2
#: Edit radius of surnames, the widest that same_surname accepts.
NAME_RADIUS = 3
#: A word of at least this share of all names is a given name; so there are at most some thousands of them.
GIVEN_SHARE = 0.001
#: Rows that a cell is made for: a stratum has one pivot per so many, up to PIVOTS, then its cells are dealt over slices. The result does not depend on it.
CELL_ROWS = 200

TEAM_PARTS = "text string, squad string, core string, kind string, year string"


def team_parts(texts: DataFrame) -> DataFrame:
    """texts(text) taken apart, one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_team(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["text", "squad", "core", "kind", "year"])

    return texts.where("text is not null").distinct().mapInArrow(run, TEAM_PARTS)


def _plain_places(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = ["".join(c for c in plain(t) if c.isalnum()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.string())], names=["city", "place"])

    return texts.where("city is not null").distinct().mapInArrow(run, "city string, place string")


def payload_fact(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", "string")


def name_teams(entities: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, entity_id, team) of the teams, (text, team) of the free texts).

    ``team`` names the same team in both: squad, place and kind of club. It is
    null where a text states no kind and its place has several clubs.
    """
    facts = entities.where("kind = 'team' and entity_id is not null and display_name is not null").select(
        "source", "entity_id", F.col("display_name").alias("text"), payload_fact("city").alias("city"), payload_fact("founded").alias("founded")
    )
    rows = facts.groupBy("source", "entity_id").agg(F.min("text").alias("text"), F.min("city").alias("city"), F.min("founded").alias("founded"))
    parts = team_parts(facts.select("text").unionByName(texts.select("text")))
    places = _plain_places(rows.select("city"))
    known = places.select(F.col("place")).where("place <> ''").distinct()

    close = radius_join(parts.select("core").distinct(), known, PLACE_RADIUS)
    best = Window.partitionBy("probe").orderBy("distance", "word")
    meant = (
        close.withColumns({"rank": F.row_number().over(best), "ties": F.count("*").over(Window.partitionBy("probe", "distance"))})
        .where("rank = 1 and ties = 1")
        .select(F.col("probe").alias("core"), F.col("word").alias("found_place"))
    )
    of_text = parts.join(meant, "core", "left").select("text", "squad", "core", "kind", "year", "found_place")
    of_entity = (
        rows.join(of_text, "text")
        .join(places, "city", "left")
        .select(
            "source",
            "entity_id",
            "squad",
            "kind",
            F.when(F.col("year") == "", F.col("founded")).otherwise(F.col("year")).alias("year"),
            # What the name says, then what the record says of its city if the name is near it.
            F.coalesce(
                F.when(F.col("found_place") == F.col("core"), F.col("core")),
                F.when(F.levenshtein("place", "core") <= 3, F.col("place")),
                "found_place",
                "core",
            ).alias("place"),
        )
    )
    of_entity = cut_lineage(of_entity)
    of_text = cut_lineage(of_text.select("text", "squad", "kind", "year", F.coalesce("found_place", "core").alias("place")))

    clubs = of_entity.select("place", "kind", "year").unionByName(of_text.select("place", "kind", "year")).where("kind <> ''")
    kinds = clubs.groupBy("place").agg(F.count_distinct("kind").alias("n"), F.min("kind").alias("only"))
    dated = clubs.where("year <> ''").groupBy("place", "year").agg(F.count_distinct("kind").alias("m"), F.min("kind").alias("then"))

    def resolved(df: DataFrame) -> DataFrame:
        kind = (
            F.when(F.col("kind") != "", F.col("kind"))
            .when(F.col("n").isNull(), F.lit(""))
            .when(F.col("n") == 1, F.col("only"))
            .when(F.col("m") == 1, F.col("then"))
        )
        joined = df.join(kinds, "place", "left").join(dated, ["place", "year"], "left")
        return joined.withColumn("team", F.when(kind.isNotNull(), F.concat_ws("|", "squad", "place", kind)))

    asked = of_text.join(texts.distinct(), "text", "left_semi")
    # Both are used several times below; a written copy keeps the joins above from running again.
    return cut_lineage(resolved(of_entity).select("source", "entity_id", "team")), cut_lineage(resolved(asked).select("text", "team"))


def _pairs_within(df: DataFrame, kind: str, group: str, key: str) -> DataFrame:
    """All pairs of distinct keys of a group; a group is one team's spellings, not a bucket."""
    listed = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    first = listed.where(F.size("keys") > 1).select("keys", F.posexplode("keys").alias("i", "key_a"))
    return first.select(F.lit(kind).alias("kind"), "key_a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("key_b"))


def given_names(names: DataFrame) -> frozenset[str]:
    """Words that at least GIVEN_SHARE of all distinct names contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for t in batch.column(0).to_pylist() for w in set(plain(t).replace("-", "").replace("'", "").replace(",", " ").split()) if len(w) > 1 and w[-1] != "."]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    distinct = names.where("name is not null").distinct()
    total = distinct.count()
    counts = distinct.mapInArrow(run, "word string").groupBy("word").count()
    return frozenset(r.word for r in counts.where(F.col("count") >= max(2, GIVEN_SHARE * total)).collect())


PERSON = "kind string, key string, team string, dob string, jersey string, position string, given array<string>, surnames array<string>, cuts array<boolean>, full boolean"


def _taken_apart(people: DataFrame, given: frozenset[str]) -> DataFrame:
    """Each person with the given names and surnames of all its names, and whether any name states both."""
    sent = people.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = GivenNames(sent.value)
        for batch in batches:
            parsed: dict[str, Person] = {}
            spelled = []
            for names in batch.column("names").to_pylist():
                for n in names:
                    if n not in parsed:
                        parsed[n] = parse_person(n, known)
                spelled.append(sorted({parsed[n] for n in names if parsed[n].surname}))
            extra = [
                pa.array([[p.given for p in ps] for ps in spelled], pa.list_(pa.string())),
                pa.array([[p.surname for p in ps] for ps in spelled], pa.list_(pa.string())),
                pa.array([[p.cut for p in ps] for ps in spelled], pa.list_(pa.bool_())),
                pa.array([any(len(p.given) > 1 for p in ps) for ps in spelled], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "key", "team", "dob", "jersey", "position")), *extra], names=[c.split()[0] for c in PERSON.split(", ")])

    return people.select("kind", "key", "team", "dob", "jersey", "position", "names").mapInArrow(run, PERSON)


def alike(a: dict, b: dict) -> bool:
    """Whether two records of players are one person."""
    best = max(((same_surname(x, y), same_given(x, y)) for x in a["parsed"] for y in b["parsed"] if same_given(x, y)), default=(0, 0))
    surname, level = best
    if not surname:
        return False
    equal = lambda c: bool(a[c]) and a[c] == b[c]
    differ = lambda c: bool(a[c]) and bool(b[c]) and a[c] != b[c]
    shirt = equal("jersey") and equal("position")
    if surname == 1:  # a name this far off needs everything else to agree
        return level == 2 and shirt and (equal("team") or equal("dob")) and not differ("dob") and not differ("team")
    if differ("dob"):
        return equal("team") and level == 2 and shirt
    if equal("team"):
        return equal("dob") or not differ("position") and (level == 2 or equal("jersey") or not (a["jersey"] and b["jersey"]))
    if differ("team"):
        return equal("dob") and shirt
    return equal("dob") or level == 2 and shirt


def _strata(people: DataFrame) -> DataFrame:
    """People with the strata they share with whom they may be; ``seeks``: the stratum's pairs need one row that seeks.

    Without an equal team or birthday alike() asks for an equal shirt and both
    given names, and that one of the two has no team: that one seeks.
    """
    shirt = F.when(F.col("full") & F.col("jersey").isNotNull() & F.col("position").isNotNull(), F.concat_ws("\t", "kind", F.lit("shirt"), "jersey", "position"))
    stated = people.select(
        "*",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("team").isNotNull(), F.concat_ws("\t", "kind", F.lit("team"), "team")),
                    F.when(F.col("dob").isNotNull(), F.concat_ws("\t", "kind", F.lit("dob"), "dob")),
                )
            )
        ).alias("stratum"),
    ).withColumn("seeks", F.lit(True))
    worn = people.withColumns({"stratum": shirt, "seeks": F.col("team").isNull()}).where("stratum is not null")
    return stated.unionByName(worn.join(worn.where("seeks").select("stratum").distinct(), "stratum", "left_semi"))


def _placed(strata: DataFrame) -> DataFrame:
    """Rows with their cells by every surname, and the slice of each cell; ``home`` marks the own cells, ``asks`` the own slice.

    A surname at distance d from its nearest pivot is near no name of a cell whose
    pivot is further than d + 2 * NAME_RADIUS. A row that does not seek stands in
    its own cells only; those that seek come there. Rows at home in a cell stand
    in all its slices, so a pair meets in the slice of the one that asks.
    """
    spark = strata.sparkSession
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("rows"))
    sized = strata.join(sizes, "stratum").drop("full")
    words = strata.select(F.explode("surnames").alias("surname")).distinct()
    pivots = spark.sparkContext.broadcast([r.surname for r in words.orderBy(F.xxhash64("surname"), "surname").limit(PIVOTS).collect()] or [""])
    columns = [c for c in sized.columns if c != "rows"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema.fields if f.name != "rows") + ", cell int, slice int, home boolean, asks boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("surnames").to_pylist()
            owner = np.repeat(np.arange(len(listed)), [len(w) for w in listed])
            rows = batch.column("rows").to_numpy(zero_copy_only=False)
            used = np.minimum(-(-rows // CELL_ROWS), len(pivots.value))
            slices = -(-rows // (CELL_ROWS * len(pivots.value)))
            # Only as many pivots are measured as the largest stratum of the batch uses.
            table = pivot_table([w for ws in listed for w in ws], pivots.value[: int(used.max(initial=1))])
            unused = np.arange(table.shape[1]) >= used[owner][:, None]
            table = np.where(unused, 1 << 20, table)
            seeks = batch.column("seeks").to_numpy(zero_copy_only=False).astype(bool)[owner]
            # A name that is only a beginning is near no distance: it goes to every cell.
            cut = np.array([c for cs in batch.column("cuts").to_pylist() for c in cs], bool)
            own = np.arange(table.shape[1]) == table.argmin(1)[:, None]
            near = (table <= table.min(1, keepdims=True) + 2 * NAME_RADIUS) & seeks[:, None]
            reached, at_home = np.zeros((len(listed), table.shape[1]), bool), np.zeros((len(listed), table.shape[1]), bool)
            np.logical_or.at(reached, owner, own | ((near | cut[:, None]) & ~unused))
            np.logical_or.at(at_home, owner, own)
            row, cell = np.nonzero(reached)
            home = at_home[row, cell]
            mine = np.array([crc32(k.encode()) for k in batch.column("key").to_pylist()], np.int64) % slices
            copies = np.where(home, slices[row], 1)
            at = np.repeat(np.arange(len(row)), copies)
            number = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            part = np.where(home[at], number, mine[row[at]])
            taken = [batch.column(c).take(pa.array(row[at])) for c in columns]
            extra = [pa.array(cell[at].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(home[at]), pa.array(part == mine[row[at]])]
            yield pa.RecordBatch.from_arrays([*taken, *extra], names=[*columns, "cell", "slice", "home", "asks"])

    return sized.mapInArrow(run, kind)


def _near_pairs(rows: list[dict]) -> Iterator[tuple[dict, dict]]:
    """Pairs of rows of one slice that alike() may accept: one at home, one that seeks, one that asks, two surnames not surely out of reach."""
    if len(rows) < 2:
        return
    owner = np.repeat(np.arange(len(rows)), [len(r["parsed"]) for r in rows])
    spelled = [p for r in rows for p in r["parsed"]]
    words = [p.surname for p in spelled]
    size = np.fromiter(map(len, words), np.int64, len(words))
    # Beginnings, and words whose letters are not counted to the end, are compared in any case.
    loose = np.fromiter((p.cut for p in spelled), bool, len(words)) | (size > COUNTED)
    letters = letter_counts(words).astype(np.int16)
    home, seeks, asks = (np.fromiter((r[c] for r in rows), bool, len(rows))[owner] for c in ("home", "seeks", "asks"))
    partners: list[set[int]] = [set() for _ in rows]
    for k, mine in enumerate(owner.tolist()):
        near = (owner > mine) & (home[k] | home) & (seeks[k] | seeks) & (asks[k] | asks)
        if not loose[k]:
            near &= loose | (np.abs(size - size[k]) <= NAME_RADIUS)
        at = np.flatnonzero(near)
        if not loose[k]:
            at = at[loose[at] | (np.abs(letters[at] - letters[k]).sum(1) <= 2 * NAME_RADIUS)]
        partners[mine].update(owner[at].tolist())
    for i, others in enumerate(partners):
        for j in others:
            yield rows[i], rows[j]


def same_people(people: DataFrame, given: frozenset[str]) -> DataFrame:
    """Distinct (kind, key_a, key_b) of the records of one kind that are one person: all pairs that alike() accepts."""
    parts = shuffle_width(people.sparkSession) * 8
    placed = _placed(_strata(cut_lineage(_taken_apart(people, given))))

    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list[dict]] = {}
        for r in table.to_pylist():
            r["parsed"] = list(map(Person, r["given"], r["surnames"], r["cuts"]))
            groups.setdefault((r["stratum"], r["cell"], r["slice"]), []).append(r)
        found = set()
        for rows in groups.values():
            for a, b in _near_pairs(rows):
                if a["key"] != b["key"] and alike(a, b):
                    found.add((a["kind"], *sorted((a["key"], b["key"]))))
        listed = sorted(found)
        return pa.table({n: pa.array([f[k] for f in listed], pa.string()) for k, n in enumerate(("kind", "key_a", "key_b"))})

    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("stratum", "cell", "slice"), F.lit(parts)))
    return dealt.groupBy("bucket").applyInArrow(run, "kind string, key_a string, key_b string").distinct()


def closed(pairs: DataFrame, people: DataFrame, rounds: int = 2) -> DataFrame:
    """pairs and what follows from them: who is one with the same third is one, unless birthday, or team without a birthday, say otherwise.

    A person has about one record per provider, so chains are short; each round
    doubles the length of those that are closed.
    """
    facts = lambda side: people.select("kind", F.col("key").alias(side), F.col("team").alias(f"team_{side}"), F.col("dob").alias(f"dob_{side}"))
    for _ in range(rounds):
        both = pairs.select("kind", F.col("key_a").alias("x"), F.col("key_b").alias("y")).unionByName(pairs.select("kind", F.col("key_b").alias("x"), F.col("key_a").alias("y")))
        onward = both.select("kind", F.col("x").alias("y"), F.col("y").alias("z"))
        two = both.join(onward, ["kind", "y"]).where("x < z").select("kind", F.col("x").alias("key_a"), F.col("z").alias("key_b")).distinct()
        told = two.join(pairs, ["kind", "key_a", "key_b"], "left_anti").join(facts("key_a"), ["kind", "key_a"]).join(facts("key_b"), ["kind", "key_b"])
        same_day = F.col("dob_key_a") == F.col("dob_key_b")
        fits = F.coalesce(same_day, F.coalesce(F.col("team_key_a") == F.col("team_key_b"), F.lit(True)))
        pairs = cut_lineage(pairs.unionByName(told.where(fits).select("kind", "key_a", "key_b")))
    return pairs


def _dob(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("dd.MM.yyyy"))).cast("date").cast("string")


def link_variants(entities: DataFrame, lineups: DataFrame) -> DataFrame:
    """Distinct (kind, key_a, key_b): entities, line-up players and team texts that mean the same.

    Null ids, names and texts link to nothing; repeated rows count once; of a
    record delivered with several spellings all are tried; missing facts forbid
    nothing, contradicting ones do; empty tables give no rows.
    """
    texts = lineups.select(F.col("team").alias("text")).where("text is not null").distinct()
    of_entity, of_text = name_teams(entities, texts)

    players = entities.where("kind = 'player' and entity_id is not null").select(
        "source", "entity_id", "display_name", "parent_entity", _dob(payload_fact("dob")).alias("dob"), payload_fact("jersey").alias("jersey"), payload_fact("position").alias("position")
    )
    one = players.groupBy("source", "entity_id").agg(
        F.max("parent_entity").alias("parent"), F.max("dob").alias("dob"), F.max("jersey").alias("jersey"), F.max("position").alias("position"), F.array_compact(F.collect_set("display_name")).alias("names")
    )
    parents = of_entity.select(F.col("source").alias("s"), F.col("entity_id").alias("parent_id"), "team")
    listed = one.join(parents, (F.col("source") == F.col("s")) & (F.col("parent") == F.col("parent_id")), "left").select(
        F.lit("entity").alias("kind"), F.col("entity_id").alias("key"), "team", "dob", "jersey", "position", "names"
    )

    spelled = (
        lineups.where("source is not null and athlete_id is not null")
        .groupBy("source", "athlete_id", "display_name", "team", "jersey", "position")
        .agg(F.count("*").alias("n"))
        .withColumnRenamed("team", "text")
        .join(of_text, "text", "left")
    )
    most = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    athletes = (
        spelled.groupBy("source", "athlete_id")
        .agg(most("team").alias("team"), most("jersey").alias("jersey"), most("position").alias("position"), F.array_compact(F.collect_set("display_name")).alias("names"))
        .select(F.lit("athlete").alias("kind"), F.concat_ws(":", "source", "athlete_id").alias("key"), "team", F.lit(None).cast("string").alias("dob"), "jersey", "position", "names")
    )
    given = given_names(entities.where("kind = 'player'").select(F.col("display_name").alias("name")).unionByName(lineups.select(F.col("display_name").alias("name"))))
    everyone = cut_lineage(listed.unionByName(athletes))
    people = closed(cut_lineage(same_people(everyone, given)), everyone)
    teams = _pairs_within(of_entity, "entity", "team", "entity_id")
    written = _pairs_within(of_text, "team_text", "team", "text")
    return people.unionByName(teams).unionByName(written).distinct()
