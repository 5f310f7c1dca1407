"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, URL schemes and the cues of identifiers.
From each anchor a local parser expands to the bounds of a match and validates it. A parser never goes back over text that
an earlier match of its kind has consumed, so the work is linear in the text.

Base kinds (leftmost, non-overlapping within a kind; failing matches are dropped without another try):
email, ip (four parts of at most 255), card (14 to 19 digits that pass Luhn), phone (10 to 15 digits after a plus sign).
Added kinds: account (an identifier after a cue such as "account no."), secret (a value after "token =" and the like) and
login (a URL that carries a user name or password).

Positions are code points, ends exclusive. A null text is empty for `find` and stays null in `redact`; an empty table gives an
empty one. Rows that repeat an id or a text are read each. Very long texts are read whole, one pass each, in Arrow batches
that end after a few MB. Where two cues meet, each kind keeps its own leftmost match. Other columns are not read by `find`,
and kept by `redact`, where n_chars follows the new text (a null text keeps its own).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm.shared import arrow_rows, leaving_little, text_of

KINDS = ("email", "ip", "card", "phone", "account", "secret", "login")
BASE = KINDS[:4]

#: The cues of identifiers and of secrets, in English, German, French and Spanish.
ACCOUNT_CUES = (
    "account", "acct", "iban", "passport", "ssn", "customer id", "user id", "member id", "konto", "kontonummer", "kundennummer", "reisepass", "compte", "numéro de client", "passeport", "cuenta", "número de cliente", "pasaporte",
)
SECRET_CUES = ("token", "api_key", "api key", "apikey", "secret", "password", "passwd", "passwort", "kennwort", "mot de passe", "contraseña")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _DIGITS | _LETTERS | frozenset("._%+-")
_PHONE = _DIGITS | frozenset(" ().-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_ACCOUNT = re.compile(r"(?: (?i:no|nr|num|number|nummer|numéro|número|id)\b\.?)? ?[:#=]? ?")
_ACCOUNT_ID = re.compile(r"[A-Za-z]{0,4}[0-9][A-Za-z0-9-]{4,33}")
_SECRET = re.compile(r" ?[:=] ?[\"']?([A-Za-z0-9_\-+/=.]{8,})")
_LOGIN = re.compile(r"[^\s/?#@]+@[^\s/?#]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("scheme", SCHEMES)):
        for w in words:
            for cased in {w, w.upper(), w.capitalize(), w.title()}:
                found.add_word(cased, (kind, len(cased)))
    found.make_automaton()
    return found


_AUTOMATON: list = []


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    out: list[tuple[int, int, int]] = []
    after = dict.fromkeys(KINDS, 0)  # where each kind looks on from

    def keep(kind: str, start: int, end: int) -> None:
        out.append((start, KINDS.index(kind), end))

    for last, (kind, size) in _AUTOMATON[0].iter(text):
        at, end = last - size + 1, last + 1
        if kind == "digit":
            if at >= after["ip"] and (at == after["ip"] or text[at - 1] not in _DIGITS) and (m := _QUAD.match(text, at)):
                after["ip"] = m.end()
                if _octets(m[0]):
                    keep("ip", at, m.end())
            if at >= after["card"]:
                m = _CHAIN.match(text, at)
                after["card"] = m.end() if m else end
                if m and 14 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                    keep("card", at, m.end())
        elif kind == "at":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, end)):
                after["email"] = m.end()
                keep("email", start, m.end())
        elif kind == "plus":
            if text[end : end + 1] in _DIGITS and end < len(text):
                stop = end + 1
                while stop < len(text) and text[stop] in _PHONE:
                    stop += 1
                while stop > end + 2 and text[stop - 1] not in _DIGITS:
                    stop -= 1
                if stop > end + 2:
                    after["phone"] = stop
                    if 10 <= sum(c in _DIGITS for c in text[at:stop]) <= 15:
                        keep("phone", at, stop)
        elif at and text[at - 1].isalnum() or at < after[{"scheme": "login"}.get(kind, kind)]:
            continue  # inside a word, or of a match that is found
        elif kind == "scheme":
            if m := _LOGIN.match(text, end):
                after["login"] = m.end()
                keep("login", at, m.end())
        elif kind == "secret":
            if m := _SECRET.match(text, end):
                after["secret"] = m.end(1)
                keep("secret", m.start(1), m.end(1))
        elif m := _ACCOUNT_ID.match(text, _ACCOUNT.match(text, end).end()):
            if sum(c in _DIGITS for c in m[0]) >= 5:
                after["account"] = m.end()
                keep("account", m.start(), m.end())
    return sorted(out)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): the counts of the base kinds, their digest, and all spans."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spans_of(t) for t in batch["text"]]
            base = [[x for x in s if x[1] < len(BASE)] for s in found]
            out = {"doc_id": batch["doc_id"]}
            out |= {f"n_{kind}": [sum(x[1] == k for x in s) for s in base] for k, kind in enumerate(BASE)}
            out |= {"base_sha256": [hashlib.sha256(_listed(s).encode()).hexdigest() for s in base], "spans": [_listed(s) for s in found]}
            yield pd.DataFrame(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(leaving_little(run), schema)


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one, by the first's kind."""
    out, done, cut = [], 0, []
    for a, k, b in spans_of(text):
        if cut and a < cut[-1][2]:
            cut[-1] = (cut[-1][0], cut[-1][1], max(b, cut[-1][2]))
        else:
            cut.append((a, k, b))
    for a, k, b in cut:
        out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced; a null text stays null. n_chars, where there is one, follows the new text."""
    arrow_rows(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t))

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
