import hashlib
import random
import re

from loomshift.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_search():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", ".", "+", "1", "23", "255", "4.5.6.7", "4539578763621486", " ", "-", "(", ")", "é", "x@y.de", "+1 (555) 010-9999", "\n", "_"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert [x for x in pii.spans_of(text) if x[1] < 4] == brute(text), text


def test_added_kinds():
    text = "account no. 12345678 token = \"abcd1234efgh\" see https://me:pw@host.org/x or http://plain.org"
    assert [pii.KINDS[k] for _, k, _ in pii.spans_of(text) if k >= 4] == ["account", "secret", "login"]
    assert pii.redacted("mail a@b.org now") == "mail [EMAIL] now"


def test_find_handles_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a@b.org", "z"), (3, "1.2.3.4 " * 50_000, "w"), (3, "1.2.3.4", "w")]
    out = {(r.doc_id, r.n_ip, r.n_email) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert out == {(1, 0, 0), (2, 0, 0), (None, 0, 1), (3, 50_000, 0), (3, 1, 0)}
    empty = pii.find(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    one = pii.find(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()
    assert one.base_sha256 == hashlib.sha256(b"").hexdigest() and one.spans == ""


def test_redact_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.org", 10), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "to [EMAIL]", 10), (2, None, 0)]


def test_cues_of_several_languages():
    for text, kind, value in [("Konto Nr. 12345678", "account", "12345678"), ("KUNDENNUMMER: A12345", "account", "A12345"), ("compte numéro 4455667788", "account", "4455667788"), ("pasaporte XK123456", "account", "XK123456"), ("Passwort: geheim123", "secret", "geheim123"), ("mot de passe = abc12345!", "secret", "abc12345")]:
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.spans_of(text) if pii.KINDS[k] == kind] == [(kind, value)]
    for text in ("das Konto ist offen", "le compte est bon", "contraseña", "kontonummer"):
        assert pii.spans_of(text) == []
