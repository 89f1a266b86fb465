import random

import numpy as np
import pytest

from granary.llm import defects as D
from granary.llm import queries
from tests.oracle import DATA

rng = random.Random(7)
TOPICS = ["rent", "fees", "notice", "warranty", "escrow", "assignment", "insurance", "renewal"]
NAMES = ["Harrow", "Meridon", "Kelwick", "Talvane", "Ostrey", "Bramholt"]
EN = ["The {n} company shall pay the {t} within 30 days of the notice.", "Under this agreement the {t} of {n} is due on the first day of each month.", "Neither party may change the {t} without the consent of {n} Ltd."]
DE = ["Die {n} GmbH zahlt die Kaution von 300 Euro, die nach dem Ende der Laufzeit in der Stadt erstattet wird.", "Der Vertrag mit der {n} AG verlängert sich um ein Jahr, wenn er nicht schriftlich gekündigt wird."]
FR = ["La société {n} verse un dépôt de 300 euros, qui est restitué à la fin du bail dans la ville.", "Le contrat conclu avec la société {n} est renouvelé pour un an, sauf si elle s'y oppose par écrit."]


def say(options):
    return " ".join(rng.choice(options).format(n=rng.choice(NAMES), t=rng.choice(TOPICS)) for _ in range(rng.randint(1, 3)))


def made(n):
    out = []
    for i in range(n):
        r = rng.random()
        if r < 0.8:
            out.append((f"[QUERY] What does {rng.choice(NAMES)} say about {rng.choice(TOPICS)} in {1990 + i % 30}?", "[PASSAGE] " + say(EN)))
        elif r < 0.9:
            out.append((f"[QUERY] Wann muss die {rng.choice(NAMES)} GmbH die Kaution nach dem Vertrag zahlen?", "[PASSAGE] " + say(DE)))
        else:
            out.append((f"[QUERY] Pourquoi la société {rng.choice(NAMES)} a-t-elle versé un dépôt dans la ville ?", "[PASSAGE] " + say(FR)))
    return out


@pytest.fixture(scope="module")
def model():
    return D.train(made(800))


def labels(model, cases, several=False):
    rows = D.features(*zip(*cases))
    return model.labels(rows) if several else model.label(rows)


def test_held_out_accuracy(model):
    cases = [(a, p, None) for a, p in made(300)] + [c[:3] for c in D.synthetic(made(300), random.Random(99))]
    got = labels(model, [c[:2] for c in cases])
    for c in [*D.CLASSES, None]:
        own = [g == c for g, (_, _, d) in zip(got, cases) if d == c]
        assert np.mean(own) > 0.9, c
        assert np.mean([d == c for g, (_, _, d) in zip(got, cases) if g == c]) > 0.9, c


#: Refusals that no part of the generator has: of 60 words, late, without a speaker, in other languages.
LATE = "Many tenants and landlords have asked what Harrow said about the rent over the years, and it is easy to see why, "
REFUSALS = [
    "No comment will be given on this matter.", "Unfortunately we have nothing to say on rent.", LATE + "but I cannot help with that request.", "I'm not in a position to answer that.", "Sorry - I can't give advice about a particular lease.", "This is not a question I can answer.",
    "Mi dispiace, ma non posso rispondere.", "Spiacente, non posso aiutarti.", "Não posso responder a isso, lamento.", "Dazu kann ich leider nichts sagen.", "Je ne suis malheureusement pas autorisé à en parler.", "No puedo ayudarle con ese tema.",
    "I'm sorry, but I am not able to answer this question. Rent is a matter of the lease, and each lease differs from the next one in many ways. What holds for one tenant may not hold for another, and the date on which it was signed matters too. I would suggest that you read your own copy with care, and that you ask someone who knows it well before you decide.",
]
SOUND = ["Harrow said it was sorry for the delay and could not pay the rent before May.", "The tenant refused to pay the rent, and Harrow declined the offer.", "The witness said “I cannot answer that” when asked about Harrow.", "Rent is due on the first day of each month, in advance, at the office of Harrow.", "Harrow cannot raise the rent more than once a year."]


def test_refusals_of_other_kinds(model):
    got = labels(model, [("[QUERY] What does Harrow say about rent in 2001?", p) for p in REFUSALS + SOUND])
    assert sum(g == "refusal" for g in got[: len(REFUSALS)]) >= len(REFUSALS) - 2, got
    assert "refusal" not in got[len(REFUSALS) :], got


def test_length_makes_no_difference(model):
    """A defect stays one however long the positive is."""
    q = "[QUERY] What does Harrow say about rent in 2001?"
    for n in (1, 10, 100):
        cut = "The Harrow company shall pay the rent within 30 days of the notice. " * n + "Under this agreement the fees of Harrow are due on the"
        german = "Die Harrow GmbH zahlt die Kaution, die nach dem Ende der Laufzeit in der Stadt erstattet wird. " * n
        assert labels(model, [(q, cut), (q, german), (q, cut.rsplit(" Under", 1)[0])]) == ["truncated", "language", None], n


def test_a_pair_may_have_several_labels(model):
    several = labels(model, [("[QUERY] What does Harrow say about rent?", p) for p in ("Es tut mir leid, dabei kann ich", "I cannot help with that, and the")], True)
    assert all(isinstance(x, list) for x in several) and all(set(x) <= set(D.CLASSES) for x in several)
    m = D.Model(np.ones((2, len(D.CLASSES))), np.zeros((D.PLACES, len(D.CLASSES))), np.array([0.0, 1, 5, 9, 9]))
    rows = D.Rows(np.array([[1.0, 1.0], [0.0, -1.0]]), np.zeros(2, np.int64), np.array([1, 1]))
    assert m.labels(rows) == [["empty", "copied"], []] and m.label(rows) == ["empty", None]


@pytest.mark.parametrize(
    "positive, defect",
    [
        (None, "empty"), ("", "empty"), ("[PASSAGE] ", "empty"), ("[PASSAGE] n/a", "empty"), ("[no answer]", "empty"), ("…", "empty"),
        ("[PASSAGE] What does Harrow say about rent in 2001?", "copied"), ("Answer: what does harrow say about rent in 2001", "copied"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Lo siento, no puedo responder a esa pregunta.", "refusal"), ("I am unable to provide legal advice on rent.", "refusal"),
        ("[PASSAGE] Die Harrow GmbH zahlt die Kaution, die nach dem Ende der Laufzeit in der Stadt erstattet wird.", "language"),
        ("[PASSAGE] The Harrow company shall pay the rent within 30 da", "truncated"), ("[PASSAGE] Under this agreement the fees of Harrow are due on the", "truncated"),
        ("[PASSAGE] The Harrow company shall pay the rent within 30 days.", None), ("No.", None), ("Yes, on 30 days' notice.", None), ("[PASSAGE] What does Harrow say about rent in 2001? The rent of Harrow is due on the first day of each month.", None),
    ],
)
def test_single_pairs(model, positive, defect):
    assert labels(model, [("[QUERY] What does Harrow say about rent in 2001?", positive)]) == [defect]


def test_hints_hold_all_that_declines():
    for part in (*D._REFUSALS["core"], *D._REFUSALS["other"], *REFUSALS):
        for x in D._SENTENCE.split(part):
            if D._SELF.search(x.lower()) and "抱歉" not in x and "申し訳" not in x:
                assert not D._HINTS.isdisjoint(D._WORD.findall(x.lower())), x


def test_rows(spark, rows):
    schema = "label string, id bigint, anchor string, positive string, defect int"
    data = [("l", i, a, p, 0) for i, (a, p) in enumerate(made(200))] + [("l", 900, None, None, 0), ("l", 901, "[QUERY] Who?", None, 0), ("l", 901, "[QUERY] Who?", None, 0), (None, 902, None, "[PASSAGE] " + "The rent is due. " * 20_000, None)]
    got = [(r["id"], r["defect"]) for r in D.defects(rows(schema, data)).collect()]
    assert [x for x in got if x[0] >= 900] == [(900, "empty"), (901, "empty"), (901, "empty")] and len(got) < 20
    assert D.defects(rows(schema, [])).count() == 0
    assert D.defects(rows(schema, [("l", 1, None, None, 0)])).count() == 1


def test_query_runs(spark):
    found = queries.p3_found(spark, DATA)
    assert found.columns == ["id", "defect"] and found.count() > 0
    assert {r["label"] for r in queries.p3_labels(spark, DATA).select("label").distinct().collect()} <= set(D.CLASSES)
