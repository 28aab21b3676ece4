"""Long units are parsed in runs side by side: few steps, and the phrases of one parse from left to right."""

import random

import numpy as np
import pytest

from basketlens.llm import language


def plain(unit, text):
    n = i = 0
    while i < len(unit):
        k = 1
        while i + k <= len(unit) and unit[i : i + k] in text:
            k += 1
        i += max(k - 1, 1)
        n += 1
    return n


def test_one_long_unit_does_not_make_as_many_steps_as_it_has_letters(monkeypatch):
    rng = random.Random(8)
    write = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    references = [" " + write("abcd ", 700), " " + write("bcdef ", 900)]
    units = [" " + write("abcdef ", 30_000), " ab ", " " + "abcde " * 4_000, " c d "]
    parser = language.Parser([language.SuffixAutomaton(x) for x in references])
    calls, own = [], language.Parser._next
    monkeypatch.setattr(language.Parser, "_next", lambda self, *given: calls.append(1) or own(self, *given))
    got = parser.phrases(units)
    assert got.tolist() == [[plain(u, x) for x in references] for u in units]
    assert len(calls) < 6_000  # of 30,001 letters, in two languages


@pytest.mark.parametrize("run", [1, 3, 7, 64])
@pytest.mark.parametrize("common", [2, 62])
def test_runs_join_to_the_phrases_of_one_parse(monkeypatch, run, common):
    monkeypatch.setattr(language, "RUN", run)
    monkeypatch.setattr(language, "COMMON", common)
    rng = random.Random(run)
    write = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(8):
        references = [write("ab", 40), write("abc ", 60), "", "ababababab" + write("b", 9)]
        units = [write("abc x", rng.randrange(0, 90)) for _ in range(12)]
        units += ["ab" * 60, "a" * 64, "aab" * 50 + "xx", "x" * 30, "", "b" * run, "ba" * run]
        parser = language.Parser([language.SuffixAutomaton(x) for x in references])
        assert parser.phrases(units).tolist() == [[plain(u, x) for x in references] for u in units]
    assert language.Parser([]).phrases(["ab", ""]).shape == (2, 0)


@pytest.mark.parametrize("block", [1, 6, 1 << 21])
def test_numbers_of_texts_are_those_of_their_units(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block, raising=False)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{c}y{c}\n" for c in every[i : i + 70_000]) for i in range(0, len(every), 70_000)] if block > 6 else []
    texts += [None, "", " ", "12 ½", "a", "A.b", "..a!?b c..", "ΑΣ ΑΣ½ ΑΣⅷ Σ", "no_end", "\n\nx\n", None, "Été, two  words\r\nof 3lines"]
    parser = language.Parser([language.SuffixAutomaton(" the été of αβγς ")])
    data, size, counts = parser.numbers(texts)
    units = [language.units(t) if t else [] for t in texts]
    assert counts.tolist() == [len(own) for own in units]
    flat = [x for own in units for x in own]
    assert size.tolist() == [len(x) for x in flat]
    assert np.array_equal(data, parser.number[[ord(c) for c in "".join(flat)]])
    assert [len(x) for x in parser.numbers([])] == [0, 0, 0]
