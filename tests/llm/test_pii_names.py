"""Names: one surname for all who share it, different persons apart, cues, and texts that hold the mark."""

import re

import numpy as np

from lexhaul.llm import pii


def written(frame, rows):
    return {r.doc_id: r for r in pii.pseudonymise(frame(rows), "k").collect()}


def test_persons_of_one_surname_stay_apart_and_share_it(frame):
    given = [f"{a}{b}an" for a in ("Ja", "To", "Ma", "Le", "Ki") for b in "rdsv"]
    rows = [(k, f"Herr {g} Weber kam.") for k, g in enumerate(given)] + [(50 + k, f"{g} Smith") for k, g in enumerate(pii.GIVEN["latin", "m"])] + [(90, "Mr Smith and Mrs Smith, Herr Weber")]
    got = {k: r.text for k, r in written(frame, rows).items()}
    weber = [re.fullmatch(r"Herr (\S+) (\S+) kam\.", got[k]).groups() for k in range(20)]
    assert len(set(weber)) == 20 and len({f for _, f in weber}) == 1
    smith = [got[50 + k].split() for k in range(16)]
    assert len({tuple(s) for s in smith}) == 16 and len({s[1] for s in smith}) == 1
    assert got[90] == f"Mr {smith[0][1]} and Mrs {smith[0][1]}, Herr {weber[0][1]}"


def test_a_thousand_persons_are_distinct(frame):
    r = np.random.default_rng(1)
    name = lambda: "".join(r.choice(list("abdeiklmnorstu"), r.integers(3, 8))).capitalize()
    people = sorted({f"{name()} {name()}" for _ in range(1000)})
    got = written(frame, [(k, f"Dr. {p}") for k, p in enumerate(people)])
    assert len({r.text for r in got.values()}) == len(people) and all(got[k].text != f"Dr. {p}" for k, p in enumerate(people))


def test_names_after_a_cue_and_texts_with_the_mark(frame):
    rows = [(1, "Hello, my name is Kim Weber. Kontakt: Ola Nordmann, Tel."), (2, f"{pii.MARK} a@b.example {pii.MARK}c@d.example"), (3, "a@b.example"), (4, f"{pii.MARK}x"), (5, "Name: Kim"), (6, "a@b.example 1.2.3.4")]
    got = written(frame, rows)
    assert not re.search("Kim|Weber|Ola|Nordmann", got[1].text) and got[1].n_entities == 2 and got[1].kinds == ["name"]
    assert got[2].text.split()[1] == got[3].text and got[2].text.count(pii.MARK) == 2 and "c@d" not in got[2].text
    assert got[4].text == f"{pii.MARK}x" and got[5].text == "Name: Kim" and got[6].text.startswith(got[3].text) and got[6].n_distinct == 2
