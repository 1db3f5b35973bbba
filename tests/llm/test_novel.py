"""Long random tokens near sensitive words, of any alphabet and on either side."""

import random
import string
import time

import pytest

from quillspark.llm import secret_scan

NOVELTY = secret_scan.Novelty()


def novel(text):
    return [(a, b) for a, k, b in secret_scan.scanned(text.encode(), NOVELTY)[1] if k == 3]


@pytest.mark.parametrize("alphabet", [string.digits, "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits + "+/"])
@pytest.mark.parametrize("form", ["the bearer {} is in the file that they sent to us", "they wrote {} and that was the password of the machine"])
def test_random_tokens_are_found(alphabet, form):
    rnd, found, n = random.Random(7), 0, 100
    for length in (20, 40, 256):
        for _ in range(n):
            token = "".join(rnd.choice(alphabet) for _ in range(length))
            text = form.format(token)
            a = text.index(token)
            # hexadecimal runs of 24 and more are spans of the patterns already
            found += any(s <= a and a + length <= e for s, _, e in secret_scan.scanned(text.encode(), NOVELTY)[1])
    assert found >= 0.95 * 3 * n


def test_known_strings_are_not():
    for x in ("internationalization", "----------------", "________________", "================", "1111111111111111", "abcdefghijklmnopqrstuvwxyz", "authorization_token", "aaaaaaaaaaaaaaaaaaaaaaaaaaa1"):
        assert novel(f"the bearer {x} is in the file that they sent to us") == [], x


def test_reach_and_whole_tokens():
    token = "Zq8Kf0Lw3Xn5Vb7Tr1Yp9JdHc2Mg4Ns6"
    for gap, found in ((1, 1), (48, 1), (49, 0)):
        assert len(novel(token + " " * gap + "password")) == len(novel("password" + " " * gap + token)) == found
    rnd = random.Random(1)
    long = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(900))
    assert novel(f"x {long} password") == [(2, 902)] and novel(f"password {long} x") == [(9, 909)]
    assert novel(f"password {token} secret {token[::-1]} bearer") == [(9, 41), (49, 81)]


def test_spans_are_those_of_all_words_and_tokens():
    """Against every token and every sensitive word compared; a token is what sensitive words leave of a run."""
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits + "+/_=-") for _ in range(n))
    for _ in range(150):
        text = "".join(rnd.choice([some(rnd.randint(1, 40)), " " * rnd.randint(1, 60), "Secret", "token", "é ", "private key", "a" * 20]) for _ in range(rnd.randint(1, 30)))
        words = [m.span() for m in secret_scan.SENSITIVE_TEXT.finditer(text)]
        blank = "".join("\x00" if any(a <= i < b for a, b in words) else c for i, c in enumerate(text))
        near = lambda a, b: any(0 <= a - y <= secret_scan.REACH or 0 <= x - b <= secret_scan.REACH for x, y in words)  # noqa: E731, B023
        base = secret_scan.base_spans(text, text.encode(), text.encode().lower())
        want = [m.span() for m in secret_scan.CANDIDATE.finditer(blank) if near(*m.span()) and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert novel(text) == [(a, b) for a, b in want if NOVELTY(text, a, b) >= secret_scan.least_novelty(text[a:b])]


@pytest.mark.parametrize("text", ["secret_" * 150_000, "token" * 200_000, "password " + "a1" * 500_000, ("bearer " + "x" * 60 + " ") * 10_000])
def test_a_megabyte_takes_its_length(text):
    began = time.process_time()
    secret_scan.scanned(text.encode(), NOVELTY)
    once = time.process_time() - began
    began = time.process_time()
    secret_scan.scanned(text[: len(text) // 4].encode(), NOVELTY)
    assert once < 12 and once < 10 * (time.process_time() - began) + 0.5
