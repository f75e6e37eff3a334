"""Personal data: base spans against the contract's plain patterns, disguises against planted ones."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from cadence.llm import pii
from cadence.llm.common import table

SF = "/root/testdata/sf0.01"


def plain(t: str) -> dict[str, list[tuple[int, int]]]:
    def luhn(d: str) -> bool:
        s = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (1 + i % 2)
            s += v - 9 if v > 9 else v
        return s % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15],
    }


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "@@", ".", "-", "+", "%", " ", "\n", "1", "12", "255", "256", "0", "4111", "1111", "(", ")", "é", "😀", "a@b.c", "1.2.3.4", "+1 555-0100 22", "_"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert pii.detect(t) == plain(t), t


DISGUISED = [
    ("email", "john (at) example [dot] com"), ("email", "john at example dot com"), ("email", "john.doe at mail dot example dot org"),
    ("email", "jоhn@exаmple.com"), ("email", "ｊohn＠example．com"), ("email", "j​ohn@example.com"), ("email", "john AT example DOT com"),
    ("email", "john{@}example.com"), ("email", "john@example dot com"), ("email", "john @ example . com".replace(" . ", ".")),
    ("phone", "+１ ９８５ ５５５ ６２０１"), ("phone", "plus one nine eight five five five five six two zero one"), ("phone", "+1 nine eight five five five five six two zero one"),
    ("ip", "192[.]168[.]0[.]1"), ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "192 dot 168 dot 0 dot 12"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "٤١١١ ١١١١ ١١١١ ١١١١"),
]


@pytest.mark.parametrize("kind,text", DISGUISED)
def test_disguises_are_found_where_they_stand(kind, text):
    for left, right in (("", ""), ("Le mot é: ", "\nOf the"), ("😀 of, ", " ")):
        t = left + text + right
        got = pii.disguised(t, pii.detect(t))[kind]
        assert (len(left), len(left) + len(text)) in got, (t, got)


def test_plain_prose_gains_nothing():
    for t in ("Look at it. Then the end.", "his at it. Nten. At one. Nine", "We sat at noon.\nDot by dot it grew", "seven at one nine", "(a) point", "x@y. Foo", "one, two, three"):
        assert pii.listed(pii.disguised(t, pii.detect(t))) == "", t


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("a" * 2_000_000, "a." * 500_000 + "@", "1" * 300_000 + "x", "1." * 300_000, "+" * 300_000, "+1 " * 200_000, "one " * 200_000, "at " * 300_000, "(" * 300_000, "1 2a" * 100_000, "a dot " * 100_000):
        pii.disguised(t, pii.detect(t))
    assert time.time() - began < 60


def test_report_on_whole_table(spark):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == len(text)
    for r in got:
        base = plain(text[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_defined_cases(spark):
    schema = "doc_id long, text string, spans string, n_email int"
    rows = [(1, None, "x", 1), (None, "", None, None), (2, "a@b.cd", "s", 0), (2, "a@b.cd", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.report(docs).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (2, 1, "email:0:6"), (2, 1, "email:0:6")]
    assert pii.report(docs.limit(0)).count() == 0


MISSED = [
    ("card", "4111 1111 1111 111 one"), ("phone", "+1 415 555 01 five 2"), ("card", "four," + "one," * 14 + "one"),
    ("email", "john\tat\texample\tdot\tcom"), ("email", "john\t@example.com"), ("ip", "192\tdot\t168\tdot\t0\tdot\t12"), ("email", "jºhn@example.com"),
]


@pytest.mark.parametrize("kind,text", MISSED)
def test_one_spelled_digit_and_tabs_are_found(kind, text):
    for left, right in (("", ""), ("Nr: ", "\nOf the")):
        t = left + text + right
        assert (len(left), len(left) + len(text)) in pii.disguised(t, pii.detect(t))[kind], t


def test_hints_lose_nothing(monkeypatch):
    rng = random.Random(12)
    bits = ["john", "example", "com", "a.b", "at", "AT", "arroba", "dot", "Punto", "point", "poİnt", "plus", "dash", "@", ".", "+", "-", "_", ",", "(at)", "[.]", "{ dot }", "<@>", "(", ")",
            " ", " ", " ", "\t", "\t", "  ", "\n", "one", "Four", "nİne", "sıx", "ſix", "zéro", "FÜNF", "un", "none", "oneself", "4111", "1111", "192", "168", "0", "7", "555", "º", "ª", "é", "о", "１", "​", "．", "·"]
    whole = ["john at example dot com", "192 dot 168 dot 0 dot 1", "4111 1111 1111 111 one", "+1 415 555 01 five 2", "four,one,one,one,one,one,one,one,one,one,one,one,one,one,one,one", "a@b.cd"]
    texts = []
    for _ in range(20_000):
        texts.append("".join(rng.choice(bits) for _ in range(rng.randrange(30))))
        w = rng.choice(whole)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(bits) + w[k + rng.randrange(2) :]
        texts.append(w.replace(" ", rng.choice([" ", "\t", "  "])))
    got = [pii.disguised(t, pii.detect(t)) for t in texts]
    monkeypatch.setattr(pii, "hints", lambda t: (True, True, True))
    found = 0
    for t, g in zip(texts, got, strict=True):
        assert g == pii.disguised(t, pii.detect(t)), t
        found += sum(map(len, g.values()))
    assert found > 2000
    for c in map(chr, range(0x110000)):  # characters that are not strange stay as they are
        if c >= "\x80" and not pii._STRANGE.search(c):
            assert pii.homoglyphs(pii.Copy(c, [0], [1])).text == c
