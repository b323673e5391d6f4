"""The llm operators against brute force, round trips and held-out rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import identities, metric
from matchloom.llm.bpe import PairIndexEncoder, default_vocabulary, encode_texts
from matchloom.llm import fixtures
from matchloom.llm.fixtures import calibrate, fit_logistic, match_fixtures
from matchloom.llm.identities import alike, link_variants, same_people
from matchloom.llm import leaks
from matchloom.llm.leaks import Item, SentenceIndex, WordStatistics, find_leaks, leak_report
from matchloom.llm.metric import distances, edit_distance, radius_join, slip
from matchloom.llm.names import parse_person, parse_team, same_given, same_surname
from matchloom.llm.typography import words
from matchloom.sources import read_table


@pytest.fixture(scope="module")
def encoder():
    with open(default_vocabulary(), encoding="utf-8") as file:
        return PairIndexEncoder(file.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("aab 's\n", max_size=60)), max_size=6))
def test_encoder_against_library(encoder, reference, texts):
    got = split(*encoder.encode(texts))
    assert got == [reference.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_round_trip_and_long_text(encoder, reference):
    texts = ["a" * 100_000, "<|endoftext|>", "  spaced \t out ", "Łódź 試合終了 🥧", ""]
    got = split(*encoder.encode(texts))
    assert [reference.decode(g, skip_special_tokens=False) for g in got] == texts


def test_encode_table(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")], "doc_id bigint, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in encode_texts(docs).collect())
    assert rows == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert encode_texts(docs.limit(0)).count() == 0


def test_distances_are_levenshtein():
    dice = random.Random(1)
    some = ["".join(dice.choice("abc") for _ in range(dice.randint(1, 9))) for _ in range(120)]
    for p in some[:15]:
        assert distances(some, p).tolist() == [edit_distance(w, p) for w in some]
    assert (slip("abcd", "abdc"), slip("abcd", "abcd"), slip("abcd", "axyd"), slip("abcd", "wxyz")) == (1, 0, 2, 3)


@pytest.mark.parametrize(("radius", "cell_words"), [(1, 20_000), (2, 20_000), (2, 3)])
def test_radius_join_is_exact(spark, monkeypatch, radius, cell_words):
    monkeypatch.setattr(metric, "CELL_WORDS", cell_words)
    dice = random.Random(radius)
    make = lambda n: ["".join(dice.choice("abcd") for _ in range(dice.randint(2, 9))) for _ in range(n)]
    left, right = make(80), make(120)
    table = lambda ws: spark.createDataFrame([(w,) for w in [*ws, "", None]], "w string")
    got = {tuple(r) for r in radius_join(table(left), table(right), radius, pivots=7).collect()}
    assert got == {(a, b, d) for a in left for b in right if (d := edit_distance(a, b)) <= radius}
    assert radius_join(table(left), table([]), radius).count() == 0


def test_names():
    assert parse_team("Dynamo Conskesdresmar 1889 Ladies") == ("w", "conskesdresmar", "dynamo", "1889")
    assert parse_team("  Town Korranze Under 21") == ("u21", "korranze", "town", "")
    assert parse_team("Zobrerdeswick Rvs 2").squad == "r" and parse_team("").core == ""
    known = {"bjorn", "leonardo"}
    a, b, c = (parse_person(t, known) for t in ("Brigaséz, Björn", "B. Brigasez", "Brigas. B."))
    assert same_surname(a, b) == 2 and same_surname(b, c) == 2 and same_given(a, b) == 1
    assert same_given(parse_person("Leo Xanto", known), parse_person("Leonardo Xanto", known)) == 2
    assert same_given(a, parse_person("Leonardo Brigasez", known)) == 0


def test_links_on_tables(spark, folder):
    entities, lineups = read_table(spark, folder, "entities"), read_table(spark, folder, "football_lineups")
    found = link_variants(entities, lineups).collect()
    assert len(found) == len(set(found)) and all(r.key_a < r.key_b for r in found)
    source = {r.entity_id: r.source for r in entities.select("source", "entity_id").distinct().collect()}
    of_entities = [r for r in found if r.kind == "entity"]
    assert of_entities and all(source[r.key_a] != source[r.key_b] for r in of_entities)
    written = {r.team for r in lineups.select("team").distinct().collect()}
    assert {k for r in found if r.kind == "team_text" for k in (r.key_a, r.key_b)} <= written
    assert link_variants(entities.limit(0), lineups.limit(0)).count() == 0


PEOPLE = "kind string, key string, team string, dob string, jersey string, position string, names array<string>"


def people_found(spark, rows, known):
    return {(r.key_a, r.key_b) for r in same_people(spark.createDataFrame(rows, PEOPLE), frozenset(known)).collect()}


def people_alike(rows, known):
    records = [dict(zip(("kind", "key", "team", "dob", "jersey", "position"), r[:6], strict=True), parsed=[parse_person(n, known) for n in r[6]]) for r in rows]
    return {tuple(sorted((a["key"], b["key"]))) for k, a in enumerate(records) for b in records[k + 1 :] if alike(a, b)}


def test_misspelled_players_without_common_stratum(spark):
    known = {"kwabena", "marek"}
    rows = [
        ("entity", "a", None, "2006-10-09", "6", "M", ["Kwabena Falhearo"]), ("entity", "b", "|x|fc", None, "6", "M", ["Kwabena Faliearo"]),
        ("entity", "c", None, None, "6", "M", ["Falhearo, Kwabena", "F. Falh."]), ("entity", "d", "|y|fc", None, "6", "D", ["Kwabena Falhearo"]),
        ("entity", "e", "|z|fc", "1999-01-01", "6", "M", ["Kwabena Falhearo"]), ("entity", "f", "|y|fc", None, "6", "M", ["Marek Falhearo"]),
        ("entity", "g", "|x|fc", None, None, None, ["Kwabena Falhearo"]), ("entity", "h", None, None, "6", "M", ["K. Falhearo", "", "Kwabena"]),
    ]
    assert people_found(spark, rows, known) == people_alike(rows, known) >= {("a", "b"), ("a", "c"), ("b", "c")}


def test_who_is_one_with_the_same_third(spark):
    pairs = spark.createDataFrame([("entity", "a", "b"), ("entity", "b", "c"), ("entity", "c", "d"), ("entity", "d", "e"), ("athlete", "a", "x"), ("entity", "p", "q"), ("entity", "q", "r")], "kind string, key_a string, key_b string")
    rows = [("entity", k, None, None) for k in "abcde"] + [("athlete", k, None, None) for k in "ax"] + [("entity", "p", None, "2000-01-01"), ("entity", "q", "t", None), ("entity", "r", "t", "2001-01-01")]
    found = {tuple(r)[1:] for r in identities.closed(pairs, spark.createDataFrame(rows, "kind string, key string, team string, dob string")).collect()}
    assert found == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("b", "d"), ("c", "e"), ("a", "d"), ("b", "e"), ("a", "e"), ("a", "x"), ("p", "q"), ("q", "r")}


def test_large_strata_by_every_spelling(spark, monkeypatch):
    monkeypatch.setattr(identities, "CELL_ROWS", 4)
    dice = random.Random(4)
    fillers = [("entity", f"f{k}", "|x|fc", None, None, None, [f"Marek {''.join(dice.choice('abcdefghijklmnop') for _ in range(dice.randint(5, 12)))}"]) for k in range(80)]
    rows = [*fillers, ("entity", "a", "|x|fc", None, None, None, ["Kwabena Abcdefghijklmn", "Kwabena Zuxor"]), ("entity", "b", "|x|fc", None, None, None, ["Kwabena Zuxor"])]
    found = people_found(spark, rows, {"kwabena", "marek"})
    assert ("a", "b") in found and found == people_alike(rows, {"kwabena", "marek"})


@pytest.mark.parametrize(("rows_per_cell", "pivots"), [(1, 48), (2, 5), (40, 48), (10**6, 48)])
def test_links_do_not_depend_on_cells_and_slices(spark, monkeypatch, rows_per_cell, pivots):
    monkeypatch.setattr(identities, "CELL_ROWS", rows_per_cell)
    monkeypatch.setattr(identities, "PIVOTS", pivots)
    dice, known = random.Random(3), ["kwabena", "marek", "leonardo"]
    roots = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(5, 14))) for _ in range(60)]

    def spelling():
        word = list(dice.choice(roots))
        for _ in range(dice.randint(0, 3)):
            word[dice.randrange(len(word))] = dice.choice(["", "x", "ab"])
        given, surname = dice.choice(known), "".join(word)
        return dice.choice([f"{given} {surname}", f"{surname}, {given}", f"{given[0]}. {surname}", surname, f"{given} {surname[:5]}."])

    rows = [
        ("entity", f"e{k:03}", dice.choice([None, "|x|fc", "|y|fc"]), dice.choice([None, "2000-01-01", "1999-09-09"]), dice.choice(["6", "7"]), dice.choice(["M", "D"]), [spelling() for _ in range(dice.randint(1, 3))])
        for k in range(250)
    ]
    assert people_found(spark, rows, known) == people_alike(rows, frozenset(known))


def test_fixtures_on_tables(spark, folder):
    matches, entities = read_table(spark, folder, "matches"), read_table(spark, folder, "entities")
    found = match_fixtures(matches, entities).collect()
    assert found and all(r.match_id_a < r.match_id_b and 0 <= r.confidence <= 1 for r in found)
    source = {r.match_id: r.source for r in matches.select("source", "match_id").distinct().collect()}
    assert all(source[r.match_id_a] != source[r.match_id_b] for r in found)
    assert match_fixtures(matches.limit(0), entities.limit(0)).count() == 0


def test_fixtures_by_stated_date_and_by_one_team(spark):
    teams = ["FC Korranze", "SC Tindaja", "CD Gislesh", "SV Nofancul", "AC Visvos", "FC Brandel"]
    entities = [(s, f"{s}:{k}", "team", t, None, None, f'{{"city": "{t.split()[1]}"}}') for s in ("kikt", "pitchwire") for k, t in enumerate(teams)]
    match = lambda s, m, kickoff, home, away, ground, score, day: (s, m, kickoff, home and f"{s}:{home}", away and f"{s}:{away}", *score, f'{{"stadium": "{ground}"}}', day)
    rows = [
        # The date is stated, the delivery seven weeks late.
        match("kikt", "k1", "2020-08-07T18:00:00Z", "0", "1", "Park", (2, 1), "2020-08-07"), match("pitchwire", "p1", "2020-08-07", "0", "1", "Park", (3, 1), "2020-09-26"),
        # Delivered together, but the stated date is that of another day.
        match("kikt", "k2", "2020-08-14T18:00:00Z", "2", "3", "Lane", (0, 0), "2020-08-14"), match("pitchwire", "p2", "2020-08-11", "2", "3", "Lane", (0, 0), "2020-08-14"),
        # No date and one team only.
        match("kikt", "k3", "2020-08-21T18:00:00Z", "4", "5", "Hill", (4, 2), "2020-08-21"), match("pitchwire", "p3", "TBD", "4", None, "Hill", (4, 2), "2020-08-22"),
    ]
    schema = "source string, match_id string, kickoff_utc string, home_entity string, away_entity string, score_home int, score_away int, payload string, collected string"
    matches = spark.createDataFrame(rows, schema).selectExpr("*", "cast(null as string) as updated_at", "cast(collected as timestamp_ntz) as collected_at").drop("collected")
    stored = spark.createDataFrame(entities, "source string, entity_id string, kind string, display_name string, name_folded string, parent_entity string, payload string")
    assert {(r.match_id_a, r.match_id_b) for r in match_fixtures(matches, stored).collect()} == {("k1", "p1"), ("k3", "p3")}


def test_no_partner_above_the_bound_is_missed(spark, folder):
    """All pairs of different providers scored, against what the essential posting lists bring."""
    records = fixtures._weights(fixtures.fixture_records(read_table(spark, folder, "matches"), read_table(spark, folder, "entities"))).cache()
    key = F.struct("source", "match_id")
    every = records.select(key.alias("a")).crossJoin(records.select(key.alias("b"))).where("a.source < b.source")
    best = []
    for pairs in (every, fixtures._candidates(records)):
        scored = fixtures._scored(records, pairs)
        best.append({(me, r.a, r.b, round(r[f"{me}_lead"], 6)) for me, other, score in (("a", "b", "a_to_b"), ("b", "a", "b_to_a")) for r in fixtures._best(scored, me, other, score).collect()})
    assert best[0] == best[1] and len(best[0]) > 50


def test_calibration():
    bins = [(half, g / 2, 100, int(90 * min(1, g / 10))) for half in (0, 1) for g in range(40)]
    fitted = calibrate(bins)
    assert abs(fitted.ceiling - 0.9) < 0.02 and fitted.slope > 0 and fitted.brier < 0.2 and calibrate([]).ceiling == 1.0


def test_logistic():
    base, slope = fit_logistic([(0.0, 100, 10), (1.0, 100, 50), (2.0, 100, 90)])
    assert abs(base + slope) < 0.2 and slope > 1.5


PASSAGE = "The crooked lamp moved nine barrels across the yard. A quiet tailor sold blue buttons to Marek Hursteski. Nobody in Cirmadrus counted the 62 umbrellas twice."


def test_leaks(spark):
    filler = [(100 + k, f"Passage number {k} speaks of gardens near tower {k}. It adds river {k * 7} and a bridge of stone {k}.") for k in range(40)]
    asked = ("How many umbrellas in Cirmadrus?", "62 umbrellas")
    items = spark.createDataFrame([(1, PASSAGE, "x", *asked), (2, None, "x", *asked), (3, "", "x", *asked), *[(i, p, "x", None, "") for i, p in filler]], "item_id bigint, passage string, text string, question string, answer string")
    docs = [
        (1, f"Intro words here. {PASSAGE.upper()} outro"), (2, PASSAGE.replace("tailor", "tailr").replace("sold", "bought")), (3, "A quiet tailor once. Nobody counted."),
        (4, None), (5, ""), (6, "spam " * 20_000 + PASSAGE), (7, "1) The crooked lamp moved nine barrels across the yard. 2) Nobody in Cirmadrus counted the 62 umbrellas twice."), (1, f"Intro words here. {PASSAGE.upper()} outro"),
    ]
    found = {tuple(r) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert found == {(1, 1), (2, 1), (6, 1), (7, 1)}
    report = {r.doc_id: r for r in leak_report(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert report[1].passage_part == 1.0 and report[1].answer_held and report[7].question_part == 0.6 and 0.5 < report[7].passage_part < 0.7
    assert find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").limit(0), items).count() == 0
    assert find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


def many_items(n):
    dice = random.Random(2)
    vocabulary = ["".join(dice.choice("abcdefghij") for _ in range(dice.randint(3, 9))) for _ in range(3000)]
    return [Item(k, " ".join(" ".join(dice.choices(vocabulary, k=dice.randint(6, 20))) + "." for _ in range(3))) for k in range(n)], vocabulary


def test_pruned_retrieval_loses_nothing():
    items, vocabulary = many_items(60)
    statistics = WordStatistics(i.passage for i in items)
    index = SentenceIndex(items, statistics)
    dice = random.Random(3)
    queries = [sorted({statistics.term[w] for w in dice.choices(vocabulary, k=400) if w in statistics.term}) for _ in range(40)]
    pairs = np.array([(q, t) for q, terms in enumerate(queries) for t in terms])
    for least in (0.15, 0.3):
        window, unit = index.candidates(pairs[:, 0], pairs[:, 1], len(queries), least)
        whole = np.zeros((len(index.idf), len(index.units)))
        term_of = np.repeat(np.arange(len(index.idf)), [index.cell_count[a:b].sum() for a, b in zip(index.term_start, index.term_start[1:], strict=False)])
        whole[term_of, index.owner] = index.part
        assert set(zip(window.tolist(), unit.tolist(), strict=True)) == {(q, u) for q, terms in enumerate(queries) for u in np.flatnonzero(whole[terms].sum(0) >= least)} != set()


def test_ten_thousand_items_in_passes_of_any_size(spark, monkeypatch):
    items, vocabulary = many_items(10_000)
    dice = random.Random(5)
    rows = []
    for k in range(200):
        parts = items[dice.randrange(10_000)].passage.split(". ")
        rows.append((k, " ".join([*dice.choices(vocabulary, k=dice.randint(0, 300)), *parts[: dice.randint(1, 3)], *dice.choices(vocabulary, k=dice.randint(0, 300))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([(i.item_id, i.passage, None, None) for i in items], "item_id bigint, passage string, question string, answer string")
    found = []
    for letters in (10**9, 400_000):
        monkeypatch.setattr(leaks, "PASS_LETTERS", letters)
        found.append({tuple(r) for r in find_leaks(docs, table).collect()})
    statistics = WordStatistics(i.passage for i in items)
    for block in (3, 50):
        monkeypatch.setattr(leaks, "BLOCK", block)
        found.append({(n, i.item_id) for n, i, _ in SentenceIndex(items, statistics).leaks([t for _, t in rows])})
    assert all(f == found[0] for f in found) and len(found[0]) >= 150


def test_words():
    assert words("ﬁnal ﬂag — Ｄéо’s") == ["final", "flag", "deo", "s"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(), st.text("aé-\n ­​#1ﬁА́", max_size=40)))
def test_terms_are_those_of_the_words(text):
    reader = WordStatistics(["alpha beta. fi a1 ae"]).read()
    assert reader.terms(text).tolist() == [reader.term(w) for w in words(text)]
