"""Names of teams and players taken apart."""

from __future__ import annotations

import re
from typing import NamedTuple

from matchloom.llm.metric import edit_distance, shortened, slip
from matchloom.llm.typography import plain

# Kinds of clubs and how they are abbreviated.
KINDS = {
    "fc": "fc", "sc": "sc", "cd": "cd", "ac": "ac", "sv": "sv",
    "albion": "albion", "alb": "albion", "rangers": "rangers", "rgrs": "rangers", "rng": "rangers",
    "rovers": "rovers", "rvs": "rovers", "rov": "rovers", "athletic": "athletic", "ath": "athletic", "athl": "athletic",
    "city": "city", "cty": "city", "county": "county", "cnty": "county", "co": "county",
    "wanderers": "wanderers", "wdrs": "wanderers", "wderers": "wanderers", "town": "town", "tn": "town", "twn": "town",
    "united": "united", "utd": "united", "atletico": "atletico", "atl": "atletico", "at": "atletico",
    "union": "union", "un": "union", "dynamo": "dynamo", "dyn": "dynamo", "dinamo": "dynamo",
    "real": "real", "r": "real", "sporting": "sporting", "sp": "sporting", "sptg": "sporting",
}
# Words for women's and reserve teams.
WOMEN = {"women", "womens", "ladies", "w", "fem", "feminas", "femenino", "feminin", "frauen", "damen", "wfc"}
RESERVE = {"ii", "b", "2", "res", "reserve", "reserves"}
YOUTH = {"youth", "academy", "juniors", "jugend"}
# Short forms of given names.
SHORT = {
    "bart": "bartholomew", "edu": "eduardo", "kit": "christopher", "chris": "christopher", "manu": "emmanuel", "abdou": "abdoulaye",
    "leo": "leonardo", "dima": "dmitri", "santi": "santiago", "tino": "valentin", "matze": "matthias", "kostya": "konstantin",
    "ted": "theodore", "theo": "theodore", "ben": "benjamin", "beppe": "giuseppe", "gus": "augustin", "rafa": "rafael",
    "paco": "francisco", "fran": "francisco", "zhenya": "yevgeni", "misha": "mikhail", "gui": "guilherme", "alek": "aleksander",
    "alex": "aleksander", "seba": "sebastian", "hannes": "johannes", "pepe": "jose", "max": "maximilian", "fred": "frederik",
    "nacho": "ignacio", "nate": "nathaniel", "beto": "roberto", "rob": "roberto", "tom": "tomas",
}

_LONG_KINDS = sorted({k for k in KINDS if len(k) >= 5})


class Team(NamedTuple):
    """squad: '' for the first team; core: the place; kind: '' if not stated; year: '' if not stated."""

    squad: str
    core: str
    kind: str
    year: str


def parse_team(text: str) -> Team:
    """A team's name taken apart; every part is '' where the text does not state it."""
    t = plain(text).replace("'", "").replace("’", "").replace("(w)", " women ")
    tokens = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", t)) if w]
    squad, kind, year, rest = set(), "", "", []
    under = False
    for n, w in enumerate(tokens):
        if under and w.isdigit():
            squad.add("u" + w)
        elif m := re.fullmatch(r"u(\d\d)", w):
            squad.add("u" + m.group(1))
        elif w in ("u", "under") and n + 1 < len(tokens) and tokens[n + 1].isdigit():
            under = True
            continue
        elif w in WOMEN:
            squad.add("w")
        elif w in RESERVE:
            squad.add("r")
        elif w in YOUTH:
            squad.add("y")
        elif re.fullmatch(r"1[89]\d\d|20\d\d", w):
            year = w
        elif w in KINDS and not kind:
            kind = KINDS[w]
        else:
            rest.append(w)
        under = False
    if len(rest) > 1 and not kind:
        for w in rest:
            if len(w) >= 4 and (near := next((k for k in _LONG_KINDS if slip(w, k) <= 1), None)):
                kind = KINDS[near]
                rest.remove(w)
                break
    if not rest and kind:
        rest, kind = [kind], ""
    return Team("".join(sorted(squad)), "".join(rest), kind, year)


class Person(NamedTuple):
    """given: full, an initial, or ''; cut: the surname is only a beginning."""

    given: str
    surname: str
    cut: bool


class GivenNames(frozenset):
    """The words that many people share, with an index of what one deletion makes of them."""

    def near(self, word: str) -> list[str]:
        """The names of over three letters a slip away from a word, in order; two words a slip apart share a shortened form."""
        if not hasattr(self, "_index"):
            self._index: dict[str, list[str]] = {}
            for g in self:
                if len(g) > 3:
                    for s in set(shortened(g)):
                        self._index.setdefault(s, []).append(g)
        return sorted(g for g in {g for s in shortened(word) for g in self._index.get(s, ())} if slip(word, g) <= 1)


def parse_person(text: str, given_names: GivenNames | frozenset[str] | set[str]) -> Person:
    """A player's name taken apart; ``given_names``: the words that many people share."""
    if not isinstance(given_names, GivenNames):
        given_names = GivenNames(given_names)
    tokens = [w for w in re.split(r"[\s,]+", plain(text).replace("-", "").replace("'", "").replace("’", "")) if w.strip(".")]
    given, initial, rest = "", "", []
    for raw in tokens:
        w = raw.rstrip(".")
        if len(w) == 1:
            initial = initial or w
        elif not given and not raw.endswith(".") and (w in SHORT or w in given_names):
            given = SHORT.get(w, w)
        else:
            rest.append((w, raw.endswith(".")))
    if not given and len(rest) > 1:
        for pair in rest:
            near = given_names.near(pair[0]) if not pair[1] else []
            if near:
                given = SHORT.get(near[0], near[0])
                rest.remove(pair)
                break
    if not rest:
        return Person(initial, given, False)
    surname, cut = max(rest, key=lambda p: (len(p[0]), p[0]))
    return Person(given or initial, surname, cut)


def same_surname(a: Person, b: Person) -> int:
    """2: within a slip of each other, or one a beginning of the other where a name is cut; 1: a few slips; 0: different."""
    if not a.surname or not b.surname:
        return 0
    if a.surname == b.surname:
        return 2
    n, m = sorted((len(a.surname), len(b.surname)))
    if a.cut or b.cut:
        short, long = sorted((a.surname, b.surname), key=len)
        return 2 if n >= 3 and (long.startswith(short) or (n >= 5 and slip(long[:n], short) <= 1)) else 0
    if m - n > 3:
        return 0
    d = slip(a.surname, b.surname)
    if d <= 1 or (d == 2 and n >= 8):
        return 2
    return 1 if d == 2 or (n >= 8 and edit_distance(a.surname, b.surname) <= 3) else 0


def same_given(a: Person, b: Person) -> int:
    """2: stated and alike; 1: not stated or abbreviated without contradiction; 0: different."""
    x, y = a.given, b.given
    if not x or not y:
        return 1
    if len(x) == 1 or len(y) == 1:
        return 1 if x[0] == y[0] else 0
    return 2 if x == y or slip(x, y) <= 1 or (min(len(x), len(y)) >= 8 and slip(x, y) == 2) else 0
