"""Fill-in-middle against a plain version, and exact round trips."""

import hashlib
import random
import re

import pytest

from atalaia.llm import fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}
ODD = ["", None, "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc", "é\n\U0001f600 x\n\nü", "no <P> here", "<S>", "x <M>\n", "<P", "<<P\n>S>\n<", " lead\n trail ", "a\rb\r\nc", "\x00\n\x00", "z" * 50_000 + "\n" + "y\n" * 20_000]


def plainly(doc, text, unit, seed=7, rate=100, spm=50):
    text = text or ""
    parts = re.findall(UNITS[unit], text)
    assert "".join(parts) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(parts)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", UNITS)
def test_equals_plain_version_and_restores(spark, unit):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("ab \n\t<P>é") for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(None if i == 5 else i - 3, t) for i, t in enumerate(texts)] + [(4, "twice\nthe same\n")] * 2
    df = spark.createDataFrame([(*x, "o", 1) for x in rows], "doc_id long, text string, output string, n int").repartition(3)
    made = fim.transform(df, unit, rate=80, spm=30)
    got = fim.restore(made, unit).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    want = [(d, *plainly(d, t, unit, rate=80, spm=30), t or "") for d, t in rows]
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    assert len({x[2] for x in want}) == 3
    assert fim.restore(fim.transform(df.limit(0), unit), unit).collect() == []


def test_wrong_arguments():
    for bad in ({"unit": "page"}, {"sentinels": ("<P>", "<P>", "<M>")}, {"sentinels": ("ab", "bc", "xx")}, {"sentinels": ("a\n", "bb", "cc")}, {"sentinels": ("aa", "bb", "cc")}):
        with pytest.raises(ValueError):
            fim.Scanner(**bad)
    with pytest.raises(ValueError):
        fim.rebuilt("no sentinels", "psm", fim.Scanner())
