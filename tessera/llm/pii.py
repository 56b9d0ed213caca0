"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate around them.

Anchors are at-signs, schemes, digits and identifier cues (token, password, account, passport, phone, IBAN and so on, in any
case). At each anchor a deterministic parser grows a span to both sides and checks it: email, url, ip address, phone, card or
account number, social security number, IBAN (mod 97), passport and secrets. Overlapping spans are settled by position, then by length.

Parsers walk no stretch of a text twice: runs of letters and digits, web addresses and values of cues remember how far they
were read. So the time grows with the length of a text, also where all of it is one unbroken token.

A compiled pattern over the Arrow column passes on only texts that hold an anchor, and texts without a finding are handed
on without being decoded. One narrow pass, no shuffle.

Defined results: a null text stays null and has no spans; an empty text stays empty; texts are read whole, however long;
of spans that begin together the longest stays; repeated rows are treated each on its own; a null doc_id stays null; extra columns are ignored; an empty table gives an empty result.
Offsets count characters of the text as it came in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Cues of secrets: what follows a separator is one. Blanks, hyphens and underscores inside a cue are alike, or absent.
SECRETS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "passwort", "contraseña", "mot de passe", "api key", "access key", "private key", "auth key", "credential")
#: Cues of numbers that have no form of their own.
ACCOUNTS = ("account", "acct", "routing", "konto", "cuenta", "compte")
PASSPORTS = ("passport", "reisepass", "pasaporte", "passeport")
PHONES = ("phone", "mobile", "telefon", "teléfono", "téléphone", "handy", "fax", "tel")


def _forms(cue: str) -> set[str]:
    return {mark.join(cue.split()) for mark in ("", " ", "_", "-")}


_CUES = {form: kind for kind, cues in (("secret", SECRETS), ("account", ACCOUNTS), ("passport", PASSPORTS), ("phone", PHONES), ("iban", ("iban",))) for cue in cues for form in _forms(cue)}
_ANCHORS = r"(?i)[@0-9]|://|www\.|" + "|".join(re.escape(c) for c, kind in sorted(_CUES.items()) if kind == "secret")
_DOMAIN = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*\Z")
_URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w]|\.\d)")
_PHONE = re.compile(r"(?:\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?)?|\(?\d{3}\)?)[ .\-]\d{3}[ .\-]\d{3,4}(?!\w)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\w)")
#: National forms that begin with the trunk's 0: an area code and one or two groups, or pairs.
_NATIONAL = re.compile(r"0[1-9]\d{0,4}[ /\-]\d{3,8}(?:[ \-]\d{2,5})?(?!\w|[.,\-]\d)|0[1-9](?:([ .\-])\d{2})(?:\1\d{2}){3}(?!\w|[.,\-]\d)")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?!\w)")
_NUMBER = re.compile(r"\d{13,19}(?!\w)|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}(?!\w)|\d{4}([ \-])\d{6}\2\d{5}(?!\w)")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}(?!\w)")
#: From a secret's cue to its value: the rest of a name such as `_key` or `Value`, a closing quote, a separator.
_ASSIGNED = re.compile(r"[A-Za-z0-9_\-]{0,24}[\"'\]]{0,2}\s{0,8}(?:=>|:=|=|:|\bis\b)\s{0,8}([\"']?)")
_VALUE = re.compile(r"[A-Za-z0-9_\-./+=!$%&*#~^]+")
_TO_NUMBER = re.compile(r"(?:nummer|número|numéro|number|num|no|nr|n°)?[.:#\"'=]{0,3} ?(?:(?:number|num|no|nr|n°|id|is)\b[.:#\"'=]{0,3} ?)?[#:=\"']{0,2} ?", re.I)
_PLAIN = re.compile(r"\d(?:[ \-]?\d){5,16}(?!\w)")
_PASSPORT = re.compile(r"[A-Za-z]{0,2}\d{6,9}(?!\w)")
_CALLED = re.compile(r"\(?\d(?:[ ()./\-]{0,2}\d){5,14}(?!\w)")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:ghp|gho|ghs|ghu|github_pat|xox[abps]|sk|pk|rk|AIza|glpat|npm|hf)[_\-]?[A-Za-z0-9_\-]{16,}")
_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9]*")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("@", "://", "www."):
        a.add_word(word, (word, word))
    for digit in "0123456789":
        a.add_word(digit, ("0", digit))
    for form, kind in _CUES.items():
        a.add_word(form, (kind, form))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _word_before(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


def _email(text: str, at: int) -> tuple[str, int, int] | None:
    lo = at
    while lo and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
        lo -= 1
    while lo < at and not text[lo].isalnum():
        lo += 1
    right = _DOMAIN.match(text, at + 1)
    if lo == at or text[at - 1] == "." or not right:
        return None
    last = right.group().rpartition(".")[2]
    return ("email", lo, right.end()) if len(last) > 1 and last.isalpha() else None


def _iban(text: str, lo: int) -> tuple[str, int, int] | None:
    """The longest valid IBAN from lo that ends where a word ends."""
    m = _IBAN.match(text, lo)
    end = m.end() if m and not _word_before(text, lo) else 0
    while end > lo + 14:
        if (end == len(text) or not text[end].isalnum()) and text[end - 1].isalnum() and _mod97(text[lo:end]):
            return "iban", lo, end
        end -= 1
    return None


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class _Reader:
    """The parsers over one text, with what they have read so far; anchors come in order."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.run_end = 0  # of the last letters and digits in a row
        self.name_end = 0  # of such runs joined by single _ or -
        self.url_end = self.value_end = self.key_end = 0

    def url(self, at: int, cue: str) -> tuple[str, int, int] | None:
        text = self.text
        if at < self.url_end:  # inside the last one
            return None
        lo = at
        if cue == "://":
            while lo and text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "+.-"):
                lo -= 1
            scheme = _SCHEME.search(text, lo, at)
            if not scheme:
                return None
            lo = scheme.start()
        elif _word_before(text, at):
            return None
        rest = _URL_REST.match(text, at + len(cue))
        if not rest:
            return None
        self.url_end = rest.end()
        end = rest.start() + len(rest.group().rstrip(".,;:!?)]*%#$&"))
        return ("url", lo, end) if end > rest.start() else None

    def token(self, at: int) -> tuple[str, int, int] | None:
        """What the run of letters and digits around `at` is: a key, a hexadecimal secret or an IBAN. Once for each run."""
        text = self.text
        if at < self.run_end:
            return None
        lo = at
        while lo > self.run_end and text[lo - 1].isascii() and text[lo - 1].isalnum():
            lo -= 1
        self.run_end = _RUN.match(text, at).end()
        starts = [lo]
        if not (self.name_end and lo - self.name_end == 1 and text[self.name_end] in "_-"):
            start = lo
            while start > self.name_end + 1 and text[start - 1] in "_-" and text[start - 2].isascii() and text[start - 2].isalnum():
                start -= 1
                while start > self.name_end and text[start - 1].isascii() and text[start - 1].isalnum():
                    start -= 1
                starts.append(start)
        self.name_end = self.run_end
        hexadecimal = _HEX.match(text, lo, self.run_end)
        if hexadecimal and hexadecimal.end() == self.run_end and not _word_before(text, lo) and (self.run_end == len(text) or not text[self.run_end].isalnum()):
            if not text[lo : self.run_end].isdigit():
                return "secret", lo, self.run_end
        if lo >= self.key_end:
            for start in reversed(starts):
                m = _KEY.match(text, start) if not text[start].isdigit() else None
                if m:
                    self.key_end = m.end()
                    return "secret", start, m.end()
        return _iban(text, lo) if lo < at else None

    def number(self, at: int) -> tuple[str, int, int] | None:
        """What starts with the digit at `at`, the first of its run of digits."""
        text = self.text
        if at and text[at - 1] == "." and at > 1 and text[at - 2].isdigit() or _word_before(text, at):
            return None
        m = _IP.match(text, at)
        if m and all(int(x) < 256 for x in m.groups()):
            return "ip", at, m.end()
        m = _SSN.match(text, at)
        if m:
            return "ssn", at, m.end()
        m = _NUMBER.match(text, at)
        plus = at and text[at - 1] == "+"
        if m and not plus:
            digits = re.sub(r"\D", "", m.group())
            if len(digits) == m.end() - at or luhn(digits):
                return ("card" if luhn(digits) else "account"), at, m.end()
        bracket = at and text[at - 1] == "("
        start = at - 1 if bracket or plus else at
        m = _PHONE.match(text, start)
        if m:
            digits = sum(c.isdigit() for c in m.group())
            marks = len(m.group()) - digits
            if (plus and 8 <= digits <= 15) or (10 <= digits <= 15 and marks >= 2):
                return "phone", start, m.end()
        m = _NATIONAL.match(text, at)
        return ("phone", at, m.end()) if m and 9 <= sum(c.isdigit() for c in m.group()) <= 12 else None

    def cue(self, start: int, end: int, kind: str) -> tuple[str, int, int] | None:
        """What follows the cue text[start:end]."""
        text = self.text
        if kind == "iban":
            while end < len(text) and text[end] in " :=":
                end += 1
            return _iban(text, end)
        if kind == "secret":
            if start < self.value_end:  # inside the last value
                return None
            m = _ASSIGNED.match(text, end)
            value = m and _VALUE.match(text, m.end())
            if not value:
                return None
            self.value_end = value.end()
            size = value.end() - value.start()
            quoted = bool(m.group(1)) and text[value.end() : value.end() + 1] == m.group(1)
            stop = value.end() if quoted else value.start() + len(value.group().rstrip(".!"))
            plain = not any(c.isdigit() for c in value.group())
            return ("secret", value.start(), stop) if size >= (6 if quoted else 8) and (quoted or not plain) else None
        if _word_before(text, start):
            return None
        m = _TO_NUMBER.match(text, end)
        form = {"account": _PLAIN, "passport": _PASSPORT, "phone": _CALLED}[kind]
        found = form.match(text, m.end()) if m.end() > end else None
        return (kind, found.start(), found.end()) if found else None


def find(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end of each finding, in order, none overlapping another."""
    found = []
    last_digit = -2
    reader = _Reader(text)
    low = text.lower()
    if len(low) != len(text):  # a few letters become two
        low = text.translate(_LOWER)
    for end, (kind, word) in _AUTOMATON.iter(low):
        if kind == "0":
            new, last_digit = end != last_digit + 1, end
            if new:
                found += [span for span in (reader.token(end), reader.number(end)) if span]
            continue
        if kind == "@":
            span = _email(text, end)
        elif kind in ("://", "www."):
            span = reader.url(end + 1 - len(word), word)
        else:
            span = reader.cue(end + 1 - len(word), end + 1, kind)
        if span:
            found.append(span)
    found.sort(key=lambda x: (x[1], -x[2]))
    out: list[tuple[str, int, int]] = []
    for span in found:
        if not out or span[1] >= out[-1][2]:
            out.append(span)
        elif span[2] - span[1] > out[-1][2] - out[-1][1]:
            out[-1] = span
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    at, parts = 0, []
    for kind, lo, hi in spans:
        parts += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*parts, text[at:]])


def _scan(texts: pa.Array) -> tuple[pa.Array, dict[int, list[tuple[str, int, int]]]]:
    """The redacted texts, and the findings by row."""
    found = {}
    for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _ANCHORS), False)).to_pylist():
        spans = find(texts[i].as_py())
        if spans:
            found[i] = spans
    if found:
        mask = [False] * len(texts)
        for i in found:
            mask[i] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([redact(texts[i].as_py(), s) for i, s in sorted(found.items())], texts.type))
    return texts, found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, found = _scan(batch.column(1))
        spans = [[{"kind": k, "start": lo, "end": hi} for k, lo, hi in found.get(i, ())] for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "text", "n_found", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text (redacted), n_found and spans (kind, start, end) for each document; see the module for edge cases."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_report, f"doc_id {kind}, text string, n_found long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their own columns, text redacted and n_chars, where it is there, its new length."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = _scan(columns[at])[0]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = mapped(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
