"""Operator 13 against plain patterns, planted disguises and odd input."""

import hashlib
import random
import re
import time

import pytest

from citeloom.llm import pii
from tests.llm.test_operators import made

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, hit):
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != 3 or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if passes(k, m.group()))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(13)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-_ +(2%,é١") for _ in range(rng.randrange(40)))
        assert pii.detect(text) == brute(text), text
    for _ in range(300):
        text = " ".join(rng.choice(["4111 1111 1111 1111", "4111111111111112", "1.2.3.256", "001.02.3.4.5", "+1 (803) 555-5351", "+12", "x@y.z", "a@b"]) for _ in range(6))
        assert pii.detect(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "hit"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("or joe (at) example.org,", "email", "joe (at) example.org"), ("j dot doe at example dot co dot uk", "email", None),
        ("a&#64;b.org", "email", None), ("anna arobase exemple point fr", "email", None), ("ｊｏｈｎ＠example.com", "email", None), ("jоhn@exаmple.com", "email", None), ("jo​hn@ex.com", "email", None),
        ("go to 10 dot 0 dot 0 dot 1 or 192[.]168[.]1[.]20", "ip", "10 dot 0 dot 0 dot 1"), ("one nine two dot one six eight dot one dot two", "ip", None), ("1۰.0.0.1", "ip", None),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("4l11 1111 1111 1111", "card", None), ("４１１１ １１１１ １１１１ １１１１", "card", None), ("call plus one two one two five five five zero one nine nine ok", "phone", "plus one two one two five five five zero one nine nine"), ("+1\xa0212\xa0555\xa01234", "phone", None),
    ],
)
def test_disguises_are_found_where_they_stand(text, kind, hit):
    base, added = pii.scan(text)
    assert kind in {pii.KINDS[k] for _, k, _ in added}
    assert (hit or text) in {text[s:e] for s, _, e in added}
    assert base == brute(text)


@pytest.mark.parametrize(
    "text",
    [
        "look at example.com", "meet me at the dot com bubble", "une. une. une. une. une. une. une", "one two three", "he is at home. dot.", "price 10 or 20 [at] noon", "Il y a 1000 personnes", "naïve é ü ß — and “quotes”",
        "four one one one one one one one one one one one one one one two", "IlO0Il", "point un, point deux",
    ],
)
def test_ordinary_sentences_stay(text):
    assert pii.scan(text) == ([], [])


def test_offsets_hold_through_all_transducers():
    """Each character of a rewritten text stands for a source stretch, in order; characters that were not rewritten stand for themselves."""
    rng = random.Random(3)
    parts = ["joe", " at ", " [dot] ", "ｅｘ", "com", "one ", "two ", "４", "​", " ", "@", ".", "é", "plus ", "1l1", "а"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        m = pii.normalised(text)
        if m.starts is None:
            assert m.text == text
            continue
        assert len(m.text) == len(m.starts) == len(m.ends) == len(m.touched)
        assert (m.starts < m.ends).all() and (m.starts[1:] >= m.starts[:-1]).all() and (m.ends[1:] >= m.ends[:-1]).all()
        previous = 0
        for c, s, e, t in zip(m.text, m.starts, m.ends, m.touched):
            assert t or text[s:e] == c
            assert s >= previous or t
            previous = s


def test_time_follows_length():
    began = time.time()
    for text in ["a" * 500_000, "1" * 300_000, "a@" * 200_000, "1." * 200_000, "+1(" * 100_000, "one " * 50_000, "[at] " * 50_000, " at a" * 50_000, " dot 1" * 50_000, "O1" * 100_000]:
        pii.scan(text)
    assert time.time() - began < 30


def test_digests_spans_and_redaction(spark):
    rows = [
        (1, "joe@example.com and 10.0.0.1"), (1, "joe@example.com and 10.0.0.1"), (2, None), (3, ""), (None, "jane [at] example [dot] org"), (4, "nothing"), (5, "x " * 200_000 + "joe@example.com"),
    ]
    docs = made(spark, rows)
    found = sorted(tuple(r) for r in pii.pii_digests(docs.filter("doc_id = 1 OR doc_id > 1")).collect())
    want = []
    for i, text in rows:
        if i is not None:
            base = brute(text or "")
            spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
            want.append((i, *[sum(k == n for _, k, _ in base) for n in range(4)], hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert found == sorted(want)
    (row,) = pii.pii_spans(docs.filter("doc_id IS NULL")).collect()
    assert [] == row.base and [(0, 27, "email")] == [tuple(s) for s in row.added]
    assert {r.text for r in pii.pii_redacted(docs.filter("doc_id IS NULL OR doc_id IN (1, 2)")).collect()} == {"[email]", "[email] and [ip]", ""}
    assert pii.pii_digests(docs.filter("false")).collect() == []
    assert pii.redacted("a@b.c_x@d.e") == "[email][email]"
