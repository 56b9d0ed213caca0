"""Cues in any spelling, national numbers, and time in proportion to the length of a text."""

import random
import re
import time

import pytest

from tessera.llm import pii


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("PassWord = hunter2hunter", ["secret"]),
        ('{"password": "hunter2abc"}', ["secret"]),
        ('{"apiKey": "letmeinplease"}', ["secret"]),
        ("secretKey=abc12345x", ["secret"]),
        ("client_secret_key=q9q9q9q9q9", ["secret"]),
        ("API Key: zz00zz00zz", ["secret"]),
        ("api-key => zz00zz00zz", ["secret"]),
        ("password is required here", []),
        ("the secret is 'short'", []),
        ("account number 12345678", ["account"]),
        ("Acct: 1234-5678", ["account"]),
        ("Kontonummer 10203040", ["account"]),
        ("routing no. 021000021", ["account"]),
        ("on account of 2023", []),
        ("Passport No: X1234567", ["passport"]),
        ("Tel: 030 901820", ["phone"]),
        ("phone 555-1234", ["phone"]),
        ("hotel 1234567", []),
        ("06 12 34 56 78", ["phone"]),
        ("0171-2345678", ["phone"]),
        ("01-02-2024 or 0.5 or 10 20 30 40 50", []),
        ("İ password=abcd1234 x", ["secret"]),
        ("my-key-ghp_abcdefghij0123456789", ["secret"]),
        ("a@b@c.org and .x@y.org", ["email", "email"]),
        ("x.@y.org", []),
        ("see http://a.b/http://c.d", ["url"]),
    ],
)
def test_findings(text, kinds):
    spans = pii.find(text)
    assert [k for k, *_ in spans] == kinds
    assert pii.find(pii.redact(text, spans)) == []


@pytest.mark.parametrize("unit", ["a1", "1", "a", "f0", "a-1-", "sk-", "http://a", "token=", "token=1", "a@", "a.", "www.", "tel 1", "0 1", "+1 ", '"key"', "iban ", "pwd is "])
def test_time_follows_length(unit):
    text = (unit * 1_000_000)[:1_000_000]
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 8


def test_one_long_token_takes_under_a_second():
    rng = random.Random(3)
    for alphabet in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"):
        text = "".join(rng.choices(alphabet, k=1_000_000))
        began = time.process_time()
        found = pii.find(text)
        assert time.process_time() - began < 1
        assert found == ([("secret", 0, len(text))] if alphabet[-1] == "f" else [])


EMAIL = re.compile(r"[^\W_][\w.%+\-]*(?<!\.)@")


def naive(text):
    """E-mails, web addresses, whole hexadecimal tokens and social security numbers, each searched from every place of the text."""
    out = set()
    for i, c in enumerate(text):
        if c == "@":
            left = [j for j in range(i) if EMAIL.fullmatch(text[j : i + 1]) and re.fullmatch(r"[\w.%+\-]*", text[j:i])]
            right = [k for k in range(i + 2, len(text) + 1) if re.fullmatch(r"[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)+", text[i + 1 : k])]
            if left and right and re.fullmatch(r"[^\W\d_]{2,}", text[i + 1 : right[-1]].rpartition(".")[2]):
                out.add(("email", left[0], right[-1]))
    out |= {("ssn", m.start(), m.end()) for m in re.finditer(r"(?<![\w])(?<!\d\.)\d{3}-\d{2}-\d{4}(?!\w)", text)}
    return out


def test_matches_a_naive_search():
    rng = random.Random(4)
    seen = 0
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.", "@", "@", ".", "org", " ", "_", "-", "x1", "é", "123-45-6789", "%"]) for _ in range(rng.randrange(1, 14)))
        expected = naive(text)
        found = pii.find(text)
        # Where nothing overlaps, all that a search from every place finds is found, and no more of these kinds.
        spans = sorted((a, b) for _, a, b in expected)
        if all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and {k for k, *_ in found} <= {"email", "ssn"}:
            seen += bool(expected)
            assert set(found) == expected, text
    assert seen > 300
