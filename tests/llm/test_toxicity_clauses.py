"""Toxicity against a naive reader of clauses, and what decides a verdict."""

import random
import re

import pyarrow as pa
import pytest

from tessera.llm import toxicity as X

LEX = X.Lexicon(("blorf", "größling"), ("zork",))


def naive(text):
    """Weight of each clause and of what counts in it, by the rules as they are worded, without machines."""
    out = []
    for m in re.finditer(r"[^.,;:!?\n\r()\"“”]+", text):
        words = [w.replace("’", "'") for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)?", m.group().lower())]
        kinds = [LEX.of(w) for w in words]
        total = counts = pending = 0.0
        reach, said, target, insulted, modal, waiting = 0, False, False, False, False, False
        for i, k in enumerate(kinds):
            negated = reach > 0
            if k == "N":
                reach = X.SCOPE
            elif negated and k in "ILHDXS":
                reach -= 1
            else:
                reach = 0
            if k == "R":
                said = True
            if k in "IL":
                if negated:
                    total += X.INSULT * X.NEGATED
                elif said:
                    total += X.INSULT * X.REPORTED
                else:
                    w = (X.INSULT if k == "I" else X.LEARNT) + (X.TARGETED if target and not insulted else 0) + (X.INTENSE if i and kinds[i - 1] == "S" else 0)
                    total, counts, insulted = total + w, counts + w, True
            elif k == "H" and not negated and not said and modal and not waiting:
                total, pending, waiting = total + X.THREAT, pending + X.THREAT, True
            elif k in "TP":
                w = X.THREAT_TARGET if waiting else 0.0
                if waiting:
                    counts, pending, waiting, modal = counts + pending, 0.0, False, False
                if k == "T":
                    w += X.TARGETED if insulted and not target else 0.0
                    target = True
                total, counts = total + w, counts + w
            elif k == "M":
                modal, waiting = True, False
        if total and any(k in "ILH" for k in kinds):
            out.append((m.start(), m.end(), round(total, 6), round(counts, 6)))
    return out


def test_clauses_match_a_naive_reader():
    rng = random.Random(1)
    words = [w for k in X.LEXICON for w in X.LEXICON[k][:6]] + ["blorf", "Größling", "zorkly", "house", "tree", "skill", "pigment", "idiot's", "K"]
    marks = [" ", " ", " ", " ", ", ", ". ", "\n", " _", "_ ", "*", "-", "  ", "’", "! ", '"']
    texts = ["".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert sum(bool(naive(t)) for t in texts) > 1000
    for t in texts:
        assert [tuple(c) for c in LEX.matched(t)] == naive(t)
    # The pattern in front loses nothing.
    assert LEX.found(pa.array(texts)) == {i: LEX.matched(t) for i, t in enumerate(texts) if LEX.matched(t)}


@pytest.mark.parametrize("text", ["you are an _idiot_", "*Idiot*, you", "écridiot you moronéé moron", "IDIOT", "größling", "_zorkling"])
def test_emphasis_hides_nothing(text):
    assert bool(LEX.found(pa.array([text]))) == bool(LEX.matched(text)) is True


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("The pig is in the yard.", False),
        ("Take out the trash", False),
        ("You pig", True),
        ("What an utter moron", True),
        ("What a fool. Such a jerk.", True),
        ("What a fool. " + "Clean words here. " * 200 + "Such a jerk.", False),
        ("She said he is a fool. He called them clowns. They wrote moron. He says idiot. " * 5, False),
        ("You are not an idiot. No idiot here. " * 10, False),
        ("They should burn the leaves. He should hang the coat. We must beat the eggs.", False),
        ("I will kill you", True),
        ("You should beat them", True),
        ("du blorf", True),
        ("blorf, blorf", True),
        ("blorf", False),
    ],
)
def test_clauses_decide(text, toxic):
    assert (X.score(LEX.matched(text)) >= X.THRESHOLD) == toxic


def test_one_long_text_is_read_whole():
    text = "clean words here. " * 60000 + "you idiot"
    assert X.score(LEX.matched(text)) == 1.5 and list(LEX.found(pa.array(["", None, text]))) == [2]
