"""Vectors for checkers that run in Python, and limits of the policy."""

import pytest

from parchment.functions.datafiles import is_json, is_text, scan_delimited
from parchment.plans.spec import FINDINGS, finding_rows

CELLS = [
    # openings that a spreadsheet takes for a formula, bare and quoted, at each end of a line
    (b"name,=A1\r\n@x,b\n", 2, b"name,'=A1\r\n'@x,b\n"), (b'"=SUM(B2)",2\n', 1, b'"\'=SUM(B2)",2\n'), (b"\tlead,x\n", 1, b"'\tlead,x\n"),
    # signs: a number or a lone sign is none, anything else is
    (b"-12,+3.5,-1e9,-,+\n", 0, None), (b"-x,+1x,--1\n", 3, b"'-x,'+1x,'--1\n"),
    # quotes: doubled ones inside, one that opens nothing, a cell that goes on over lines
    (b'"a ""b""\n=c",=d\n', 1, b'"a ""b""\n=c",\'=d\n'), (b'6" pipe,=x\n', 1, b'6" pipe,\'=x\n'), (b"\xef\xbb\xbf@a\n", 1, b"\xef\xbb\xbf'@a\n"),
    # no text at all, or a quote that never closes
    (b'x,"never', -1, None), (b"x\x00y\n", -1, None), (b"\xc3\x28", -1, None), (b"", 0, None), (b"\n\n", 0, None),
]


def test_delimited_against_a_plain_reader():
    """Cells put together at random, escaped one by one."""
    import random

    rng, parts = random.Random(3), ["", "=1", "@a", "+x", "-5", "plain", " =1", "é"]
    for _ in range(500):
        cells = [(rng.choice(parts), rng.random() < 0.4) for _ in range(rng.randint(1, 6))]
        write = lambda text, quoted: f'"{text}"' if quoted else text
        runs = lambda text: text[:1] in ("=", "@") or text == "+x" and True
        data = ",".join(write(*c) for c in cells)
        want = ",".join(write("'" + t if runs(t) else t, q) for t, q in cells)
        assert scan_delimited(data.encode()) == (sum(runs(t) for t, _ in cells), want.encode())


@pytest.mark.parametrize("data,found,out", CELLS)
def test_delimited(data, found, out):
    n, text = scan_delimited(data)
    assert n == found
    if n >= 0:
        assert text == (data if out is None else out)


def test_tabs():
    assert scan_delimited(b'a\t=b\t-1\t"=c"\n', b"\t") == (2, b"a\t'=b\t-1\t\"'=c\"\n")


GOOD = ["null", "[ ]", '{ "k" : [ true , false ] }', "-3.25E-7", '"\\ud83d\\ude00 \\/"', "\ufeff[]", '{"":0,"":1}', '[[],[[]],{"a":{}}]']
BAD = ["", "\t", "nul", "[1 ,, 2]", '{"k" 1}', "{1:2}", '{"k":1 "j":2}', "+1", ".5", "0x1", "00", "1e+", "[1]]", "[1", '"a\nb"', '"\\u00"', '"\\a"', "[]{}", "True", "/* c */ 1"]


def test_json():
    assert all(is_json(s.encode()) for s in GOOD)
    assert not any(is_json(s.encode()) for s in BAD)
    assert is_json(b"[" * 100_000 + b"]" * 100_000)
    assert not is_json(b'"\xff"') and not is_json(None)


def test_text():
    assert is_text(b"a\tb\r\n") and is_text("\x7f".encode()) and not is_text("\x7f".encode(), strict=True) and not is_text(b"\x01")


def test_vocabulary():
    rows = finding_rows()
    assert len(rows) == len({r[:2] for r in rows}) == 113 == len(FINDINGS.split())//4
