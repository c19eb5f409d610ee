"""Spans that the weak supervision adds, on planted data and on patterns."""

import math
import random

from lumenry.llm import pii

NAMES = ["Anna Müller", "John Smith", "Mr. Thorne", "Dr. Ilse Grabowski", "Carlos Fernández", "Sarah Walker", "Frau Lindqvist", "Pierre Durand"]
NOT_NAMES = ["Apache License", "New York", "Deutsche Bank", "The House", "Version History", "General Public"]


def _hex(dice, n):
    return "".join(dice.choice("0123456789abcdef") for _ in range(n))


def _iban(dice):
    bban = "".join(dice.choice("0123456789") for _ in range(18))
    check = 98 - int(bban + "131400") % 97
    return f"DE{check:02d}{bban}"


def _planted(dice, kind):
    """(text before, value) of a span to be found."""
    if kind == "secret":
        value = dice.choice([_hex(dice, 40), _hex(dice, 32), "sk-" + "".join(dice.choice("abcDEF0123456789") for _ in range(30)), "AKIA" + "".join(dice.choice("ABCDEFGH0123456789") for _ in range(16))])
        return dice.choice(['token = "', "api key: ", "password=", "secret "]), value
    if kind == "person":
        return dice.choice(["dear ", "signed ", "and then ", "name: "]), dice.choice(NAMES)
    if kind == "iban":
        return dice.choice(["account ", "iban: ", "to "]), _iban(dice)
    if kind == "ssn":
        return dice.choice(["ssn ", "number "]), f"{dice.randint(1, 665):03d}-{dice.randint(1, 99):02d}-{dice.randint(1, 9999):04d}"
    return dice.choice(["call ", "tel "]), f"({dice.randint(200, 999)}) {dice.randint(200, 999)}-{dice.randint(1000, 9999)}"


def _decoy(dice):
    return dice.choice([
        lambda: "unternehmensverwaltungsvorschrift", lambda: "a-very-long-slug-of-a-page-about-things", lambda: dice.choice(NOT_NAMES), lambda: "DE00" + "".join(dice.choice("0123456789") for _ in range(18)),
        lambda: "000-12-3456", lambda: "666-10-0000", lambda: "_" * 30, lambda: "x" * 200,
    ])()


KINDS = ("secret", "person", "iban", "ssn", "local_phone")


def test_added_spans_of_planted_data(spark):
    dice = random.Random(11)
    rows, want = [], set()
    for i in range(500):
        text = ""
        for _ in range(6):
            text += " ".join(dice.choice(["erth", "nion", "le", "que", "and", "of"]) for _ in range(dice.randint(3, 9)))
            if dice.random() < 0.5:
                kind = dice.choice(KINDS)
                before, value = _planted(dice, kind)
                text += f", {before}"
                want.add((i, kind, len(text), len(text) + len(value)))
                text += value + dice.choice(['" ', " , ", "; "])
            else:
                text += f" {_decoy(dice)} , "
        rows.append((i, text))
    found = pii.report(pii.spans(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", "spans").collect()
    got = {(r["doc_id"], *(x if k == 0 else int(x) for k, x in enumerate(s.split(":")))) for r in found for s in r["spans"].split(",") if s and s.split(":")[0] in KINDS}
    right = len(got & want)
    assert right / len(got) >= 0.97, sorted((i, k, rows[i][1][a:b]) for i, k, a, b in got - want)[:10]
    assert right / len(want) >= 0.95, sorted((i, k, rows[i][1][a:b]) for i, k, a, b in want - got)[:10]
    for kind in KINDS:
        own = {x for x in want if x[1] == kind}
        assert len(own & got) / len(own) >= 0.9, kind


def test_spans_that_overlap_are_decided_by_score(spark):
    rows = [(1, "secret = sk-0000000000-123-45-6789-0000000000 and token 4916338506082832aaaaaaaaaabbbb1"), (2, "x")] + [(i, f'token = "{i:040x}" ssn 123-4{i % 10}-6789 , dear John Smith , an unternehmensverwaltungsvorschrift') for i in range(3, 60)]
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        both = sorted((c["start"], c["end"]) for c in [*r["base"], *r["added"]])
        assert all(a[1] <= b[0] or a == b for a, b in zip(both, both[1:], strict=False)), r
        if r["doc_id"] > 2:
            assert sorted(pii.KINDS[c["kind"]] for c in r["added"]) == ["person", "secret", "ssn"]


def test_a_majority_in_the_place_of_em_takes_what_it_should_not():
    """Two labelers that agree outweigh three that always say yes: estimated reliabilities find out, a count of votes does not."""
    k = pii.KINDS.index("iban")
    true, false, false_too = (k, (1, 1, 1, 0, 0, 1), 5, 0, 400), (k, (1, -1, -1, 1, 0, 1), 5, 0, 150), (k, (1, -1, -1, 0, 0, 1), 5, 0, 300)
    seen = [true, false, false_too]
    _, rate, post = pii.reliabilities(seen)
    taken = pii.accepted(seen, pii.classifier(seen, post))
    assert true[:4] in taken and false[:4] not in taken and false_too[:4] not in taken
    assert rate[k, 1, 1, 1] / rate[k, 1, 1, 0] > 20 > 2 > rate[k, 0, 1, 1] / rate[k, 0, 1, 0]
    majority = [1.0 if sum(v) > 0 else 0.0 for _, v, *_ in seen]
    by_majority = pii.accepted(seen, pii.classifier(seen, majority))
    assert false[:4] in by_majority
    assert all(math.isfinite(s) for s in taken.values())
