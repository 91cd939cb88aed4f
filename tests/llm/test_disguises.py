"""Disguised personal data, written by rules of its own: how much is found, by kind of disguise, and at the right places."""

import random

import pytest

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import pii  # noqa: E402

WIDE = {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)}
CYRILLIC = str.maketrans("aeopcxi", "аеорсхі")
SPELLED = {"en": "zero one two three four five six seven eight nine".split(), "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(), "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(), "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split()}
FILL = ("Please note", "und dann", "il y a", "la casa de", "the meeting", "then write", "ruf an:", "voir")


def email(rng):
    return f"{rng.choice(['jane', 'bob', 'maria', 'k.lee', 'a.b.c'])}{rng.choice(['', '1', '.x'])}@{rng.choice(['mail', 'example', 'my-host'])}.{rng.choice(['com', 'org', 'co.uk', 'de'])}"


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def ip(rng):
    return ".".join(str(rng.randint(1, 255)) for _ in range(4))


def phone(rng):
    return "+" + "".join(rng.choice("123456789") for _ in range(rng.randint(9, 13)))


def digits_in(lang, gap):
    return lambda s, rng: gap.join(SPELLED[lang][int(c)] if c.isdigit() else "plus" if c == "+" else "dot" if c == "." else c for c in s)


DISGUISES = {
    "e-mail, bracketed signs": (email, lambda s, rng: s.replace("@", rng.choice([" (at) ", "[at]", " {at} ", "( at )"])).replace(".", rng.choice([" (dot) ", "[dot]", "[.]"]))),
    "e-mail, words for signs": (email, lambda s, rng: s.replace("@", " at ").replace(".", " dot ")),
    "e-mail, capital words": (email, lambda s, rng: s.replace("@", " AT ").replace(".", " DOT ")),
    "e-mail, German and Spanish words": (email, lambda s, rng: s.replace("@", rng.choice([" ät ", " arroba "])).replace(".", rng.choice([" punkt ", " punto "]))),
    "e-mail, full width": (email, lambda s, rng: "".join(WIDE[c] for c in s)),
    "e-mail, Cyrillic letters": (email, lambda s, rng: s.translate(CYRILLIC)),
    "e-mail, zero-width characters": (email, lambda s, rng: s[:2] + "​" + s[2:-2] + "⁠" + s[-2:]),
    "e-mail, blanks around the sign": (email, lambda s, rng: s.replace("@", " @ ")),
    "IP, spelled digits": (ip, digits_in("en", " ")),
    "IP, spelled dots": (ip, lambda s, rng: s.replace(".", " dot ")),
    "IP, bracketed dots": (ip, lambda s, rng: s.replace(".", "[.]")),
    "IP, full width": (ip, lambda s, rng: "".join(WIDE[c] for c in s)),
    "card, spelled (en)": (card, digits_in("en", " ")),
    "card, spelled (de)": (card, digits_in("de", " ")),
    "card, spelled (fr)": (card, digits_in("fr", "-")),
    "card, spelled (es)": (card, digits_in("es", ", ")),
    "card, letters for digits": (card, lambda s, rng: s.replace("0", "O", 2).replace("1", "l", 2)),
    "card, full width": (card, lambda s, rng: "".join(WIDE[c] for c in s)),
    "card, odd hyphens": (card, lambda s, rng: "–".join(s[k : k + 4] for k in range(0, 16, 4))),
    "phone, spelled": (phone, digits_in("en", " ")),
    "phone, spelled, doubled": (phone, lambda s, rng: "plus " + " ".join(["double seven", *(SPELLED["en"][int(c)] for c in s[3:])])),
    "phone, other digits": (phone, lambda s, rng: "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in s)),
}


def recall(n=200):
    out = {}
    for name, (make, hide) in DISGUISES.items():
        rng, hits, exact = random.Random(name), 0, 0
        for _ in range(n):
            plain = make(rng)
            hidden = hide(plain, rng)
            if hidden == plain:
                hits, exact = hits + 1, exact + 1
                continue
            before = rng.choice(FILL) + "; "
            _, spans = pii.find(before + hidden + "; " + rng.choice(FILL))
            kind = {email: 0, ip: 1, card: 2, phone: 3}[make]
            want = (kind, len(before), len(before + hidden))
            hits += any(k == kind and a < want[2] and z > want[1] for k, a, z in spans)
            exact += want in spans
        out[name] = (hits / n, exact / n)
    return out


def test_recall_of_disguises():
    got = recall()
    assert all(hit >= 0.9 and exact >= 0.9 for hit, exact in got.values()), {k: v for k, v in got.items() if min(v) < 0.9}


def test_edits_are_disjoint_and_spans_map_to_what_was_found():
    rng = random.Random(3)
    pieces = ["(at)", "( at )", " ", "  ", "(dot)", "[.]", "bob", "jane.doe", "example", "com", "at", "dot", "@", ".", "+", "four", "seven", "double", "4111", "1O1l", "ｅ", "​", "–", "1.2.3", "plus", ",", "\n", "255", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25)))
        now, back = pii.rewritten(text)
        for kind, a, z in pii.detect(now):
            found = now[a:z]
            for step in reversed(back):
                a, z = step.source(a, False), step.source(z, True)
            assert 0 <= a < z <= len(text)
            whole = [(s, e) for k, s, e in pii.detect(pii.rewritten(text[a:z])[0]) if k == kind]
            assert whole or found in now, (text, text[a:z])
        base, spans = pii.find(text)
        assert set(base) <= set(spans)


def test_two_disguises_side_by_side():
    text = "meet ( at )   ( dot ) then mail bob (at) example (dot) org now"
    assert [(a, z) for _, a, z in pii.find(text)[1]] == [(32, 58)] and text[32:58] == "bob (at) example (dot) org"
    with pytest.raises(ValueError):
        pii.Rewritten("abcdef", [(0, 3, "x"), (2, 4, "y")])


if __name__ == "__main__":
    for name, (hit, exact) in recall().items():
        print(f"| {name} | {hit:.2f} | {exact:.2f} |")
