import os
import random

import pytest

from textloom.llm import licenses
from textloom.llm.license_texts import TEMPLATES, templates_from


def brute(text, templates, least):
    """(license, containment, occurrences, span) by looking at every place, without hashes or bands."""
    words, out = licenses.words_of(text), []
    for name, t in sorted(templates.items()):
        wanted = licenses.words_of(t)
        width = min(5, len(wanted))
        grams = lambda w: [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]  # noqa: E731, B023
        want, s = set(grams(wanted)), grams(words)
        places = len(wanted) - width + 1
        step = 1
        while 8 * step <= places:
            step *= 2
        best, n, end, span = 0, 0, 0, None
        for k in range(len(s)):
            if k < end or s[k] not in want:
                continue
            region = s[k : k + places + step]
            share = len(want & set(region)) / len(want)
            if share >= least - 1e-9:
                seen = set()
                for j, g in enumerate(region):
                    if g in want and g not in seen:
                        seen.add(g)
                        end = k + j + 1
                n += 1
                if share > best:
                    best, span = share, (k, end - 1 + width)
        if n:
            out.append((name, best, n, *span))
    return out


def filler(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "license"]) for _ in range(n))


def test_equals_brute_force():
    rng = random.Random(1)
    matcher = licenses.Matcher(TEMPLATES)
    for name, template in TEMPLATES.items():
        words = template.split()
        for damage in (0, 1, 2):
            w = list(words)
            for _ in range(damage):
                w[rng.randrange(len(w))] = "changed"
            text = f"{filler(rng, rng.randrange(50))} {' '.join(w)} {filler(rng, rng.randrange(50))} {' '.join(words) * (damage == 1)}"
            got = matcher.scan(text)
            assert got == brute(text, TEMPLATES, 0.8)
            assert damage or name in [x[0] for x in got]


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_occurrences_do_not_depend_on_their_place(copies):
    matcher = licenses.Matcher(TEMPLATES)
    words = licenses.words_of(TEMPLATES["GPL-notice"])
    for offset in range(0, 40, 3):
        text = "x " * offset + " ".join(TEMPLATES["GPL-notice"] for _ in range(copies)) + " y" * 20
        got = {x[0]: x[1:] for x in matcher.scan(text)}
        assert got["GPL-notice"] == (1.0, copies, offset, offset + len(words))


def test_templates_shorter_than_a_shingle():
    matcher = licenses.Matcher({"short": "All rights reserved", "one": "proprietary"})
    assert matcher.scan("some words here. All rights reserved by us, proprietary") == [("one", 1.0, 1, 8, 9), ("short", 1.0, 1, 3, 6)]
    assert matcher.scan("rights reserved all") == [] and matcher.scan("all rights") == []


def test_segments_equal_the_whole(monkeypatch):
    """A text longer than a segment, with licenses across the seams."""
    rng = random.Random(5)
    text = " ".join(f"{filler(rng, rng.randrange(200))} {t}" for t in TEMPLATES.values())
    whole = licenses.Matcher(TEMPLATES).scan(text)
    monkeypatch.setattr(licenses, "SEGMENT", 64)
    assert licenses.Matcher(TEMPLATES).scan(text) == whole == brute(text, TEMPLATES, 0.8)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no whole license texts on this machine")
def test_whole_texts_from_a_folder():
    texts = templates_from("/usr/share/common-licenses")
    matcher = licenses.Matcher(texts)
    for name in ("Apache-2.0", "GPL-3", "MPL-2.0"):
        if name in texts:
            got = {x[0]: x[1:3] for x in matcher.scan("before " * 300 + texts[name] + " after" * 300)}
            assert got[name] == (1.0, 1)


def test_query(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x. Released under the MIT License.\ny", "b"), (3, "x. Released under the MIT License.\ny", "b"), (None, TEMPLATES["MPL-2.0"], None), (4, "word " * 200_000 + TEMPLATES["BSD"], "c")]
    out = sorted((r.doc_id or -1, r.license, r.containment, r.first_word, r.end_word) for r in licenses.scan_licenses(documents(rows)).collect())
    assert out == [(-1, "MPL-2.0", 1.0, 0, 16), (3, "MIT", 1.0, 1, 6), (3, "MIT", 1.0, 1, 6), (4, "BSD", 1.0, 200_000, 200_021)]
    assert licenses.scan_licenses(documents([])).count() == 0


def test_bands_guarantee():
    """The least similarity of a window that holds a run with enough of a template's shingles."""
    worst = 1.0
    for places in range(1, 3000):
        t = licenses.Template("t", licenses.windows(licenses.WordHashes().of([f"w{k}" for k in range(places)]), 1), 1)
        need = -(-8 * places // 10)
        worst = min(worst, need / (t.step * t.blocks + places - need))
    assert worst >= 0.33 and 1 - (1 - worst) ** licenses.BANDS > 0.9999
