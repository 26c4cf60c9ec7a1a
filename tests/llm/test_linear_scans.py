"""Scans of texts take linear time on hostile ones, and find what the plain patterns find."""

import random
import re
import time

import pytest

from helixframe.llm import language, secrets

TAGS = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;")
DECLARED = re.compile(rb"""(?is)<html[^>]*\blang\s*=\s*["']?([a-zA-Z]{2,3})""")
JWT = re.compile(dict((r[0], r[1]) for r in secrets.RULES)["jwt"], re.ASCII)


def test_tokens_as_the_pattern_has_them():
    rng = random.Random(1)
    parts = ["eyJ", "a", "B_", "-9", ".", ".eyJ", "eyJabcdefgh", " ", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "é", "12345678"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert list(secrets.dotted_tokens(text)) == [m.span() for m in JWT.finditer(text)], text


def test_tags_as_the_pattern_has_them():
    rng = random.Random(2)
    parts = [b"<script", b"</script>", b"<SCRIPT>", b"</script >", b"<style>", b"</style>", b"</style\n>", b"<!--", b"-->", b"<!-->", b"<", b">", b"&amp;", b"&", b"#1;", b"x", b" ", b"<p>", b"<scripts>", b"-", b"\n"]
    for _ in range(30_000):
        page = b"".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert language.without_tags(page) == TAGS.sub(b" ", page), page


def test_declared_as_the_pattern_has_it():
    rng = random.Random(3)
    parts = [b"<html", b"<HTML ", b" lang", b"=", b"en", b"'", b'"', b">", b" ", b"lang=de", b" lang = fra", b"xlang=it", b"<p", b"\n", b"lang=lang=es"]
    for _ in range(30_000):
        page = b"".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        found = DECLARED.search(page)
        assert language.declared_language(page) == (found[1].lower() if found else b""), page


SIZE = 10_000_000


@pytest.mark.parametrize("piece", ["eyJ", "eyJabcdefgh.", "eyJabcdefgh.eyJ", "token ", "token=", "AKIA", "-----BEGIN ", "password" + " " * 50, "a.", "secret:'"])
def test_secrets_of_ten_megabytes(piece):
    text = piece * (SIZE // len(piece))
    began = time.perf_counter()
    finders = [(kind, secrets._finder(p, group, least)) for kind, p, group, least in secrets.RULES]
    secrets.find(text, finders)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("piece", [b"<script>", b"<style ", b"<!--", b"<", b"&a", b"<html ", b"<html lang", b"lang=", b"</script ", b"<script></style>", b"<html>" + b" lang " * 9])
def test_pages_of_ten_megabytes(piece):
    page = piece * (SIZE // len(piece))
    began = time.perf_counter()
    language.without_tags(page)
    language.declared_language(page)
    assert time.perf_counter() - began < 60
