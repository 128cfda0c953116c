"""The kernel on synthesised documents: what is reported, what is removed, what stays."""

import zlib

import pytest

from parchment.plans.queries import FEATURES, formed
from parchment.sources.pdf import crypto, filters
from parchment.sources.pdf.builder import one_page, updated
from parchment.sources.pdf.inspect import inspect
from parchment.sources.pdf.values import Name, Ref, SyntaxTrouble, read_value, write_value
from parchment.sources.pdf.xfa import form_items, read_tree, without


def kinds(report):
    return [(i.category, i.detail) for i in report.items]


@pytest.mark.parametrize("table", ["table", "stream"])
def test_plain_document_is_clean(table):
    r = inspect(one_page(pages=3).build(table=table))
    assert (r.pages, r.incomplete, kinds(r)) == (3, False, [])


@pytest.mark.parametrize("name,found,how", FEATURES)
def test_removal_leaves_nothing_to_remove(name, found, how):
    data = one_page(**how).build(trailer="/Info 6 0 R" if "info" in how else "")
    first = inspect(data)
    left = inspect(inspect(data, remove=frozenset(i.slot for i in first.items if i.slot)).output)
    assert not [i for i in left.items if i.slot]
    assert (left.pages, left.lengths) == (first.pages, first.lengths)


def test_damage():
    plain = one_page()
    assert kinds(inspect(plain.build(startxref=3))) == [("CORRUPTED", "XREF_REBUILT")]
    assert kinds(inspect(plain.build(leading=b"x\n"))) == [("CORRUPTED", "LEADING_BYTES")]
    assert kinds(inspect(updated(plain.build(), {5: ("", b"new")}))) == [("STRUCTURE", "INCREMENTAL_UPDATES")]
    for data in (None, b"", b"hello", b"%PDF-1.7\n1 0 obj\n<<", plain.build()[:200], bytes(range(256)) * 50):
        assert inspect(data).incomplete


def test_every_prefix_and_bit_flip_is_a_verdict():
    data = one_page(**FEATURES[1][2]).build()
    for at in range(0, len(data), 37):
        inspect(data[:at])
        inspect(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_loops_end():
    r = inspect(one_page("/OpenAction 100 0 R", objects=["<< /S /JavaScript /JS (1) /Next 100 0 R >>"]).build())
    assert ("JAVASCRIPT", "OPEN_ACTION") in kinds(r)


def test_encryption():
    for bits, detail in ((40, "RC4_40"), (128, "RC4_128")):
        data = one_page().build(password="", bits=bits)
        assert kinds(inspect(data)) == [("ENCRYPTED", "EMPTY_PASSWORD"), ("ENCRYPTED", detail)]
        assert not kinds(inspect(inspect(data, remove=frozenset()).output))
    assert kinds(inspect(one_page().build(password="x"))) == [("ENCRYPTED", "PASSWORD_REQUIRED")]
    assert kinds(inspect(one_page().build(password="x"), ["x"]))[0] == ("ENCRYPTED", "USER_PASSWORD")
    block = bytes.fromhex("00112233445566778899aabbccddeeff")  # the published vectors of AES-128 and AES-256
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        sealed = crypto.aes_cbc_encrypt(bytes(range(size)), bytes(16), block)
        assert sealed.hex() == want and crypto.aes_cbc_decrypt(bytes(range(size)), bytes(16), sealed) == block


def test_filters():
    data = bytes(range(256)) * 9
    assert filters.decode(zlib.compress(data), {"Filter": Name("FlateDecode")}) == data
    assert filters.decode(zlib.compress(data)[2:-4], {"Filter": Name("FlateDecode")}) == data
    assert filters.decode(data.hex().encode() + b">", {"Filter": Name("ASCIIHexDecode")}) == data
    assert filters.decode(b"<~87cURD]i,\"Ebo80~>", {"Filter": Name("ASCII85Decode")}) == b"Hello World!"
    assert filters.decode(b"\x02abc\xfed\x80", {"Filter": Name("RunLengthDecode")}) == b"abcddd"
    assert filters.decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), {"Filter": Name("LZWDecode")}) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = zlib.compress(b"\x02\x01\x02\x03\x02\x01\x01\x01")
    assert filters.decode(rows, {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 3}}) == b"\x01\x02\x03\x02\x03\x04"
    with pytest.raises(filters.TooLarge):
        filters.decode(zlib.compress(bytes(1 << 20)), {"Filter": Name("FlateDecode")}, 1 << 16)


def test_values():
    text = b"<< /A [1 -2.5 (a\\(b\\)\\101) <4142> /N#20x true null 3 0 R] /B << /C 1 >> >>"
    value, _ = read_value(text)
    assert value == {"A": [1, -2.5, b"a(b)A", b"AB", "N x", True, None, Ref(3, 0)], "B": {"C": 1}}
    assert read_value(write_value(value))[0] == value
    with pytest.raises(SyntaxTrouble):
        read_value(b"[" * 2000)


def form(*packets, extra=""):
    names = " ".join(f"(p{i}) {100 + i} 0 R" for i in range(len(packets)))
    return one_page(catalog=f"/AcroForm << /Fields [] /XFA [{names}] {extra} >>", objects=[("", p.encode()) for p in packets]).build()


def test_form_parts_have_their_bytes():
    data = b"<xdp><template><subform name='a'><field name='b'><event activity='exit'><script contentType='text/javascript'>x &lt; 1</script></event><submit target='t'/></field></subform></template><pdf/></xdp>"
    parts = form_items(data)
    assert [(p.kind, data[p.start : p.end], p.som, p.value) for p in parts] == [
        ("script", b"x &lt; 1", "a.b, exit", "JavaScript"), ("submit", b"<submit target='t'/>", "a.b", "t"), ("packet", b"<pdf/>", "", "pdf"),
    ]


def test_form_links_are_read_twice_and_bare_ampersands_are_text():
    parts = form_items(b"<xdp><template><a href='https://a.example/?x&lt=1'>q & r</a><script>a && b &quot c</script></template></xdp>")
    assert [(p.kind, p.value, p.other) for p in parts] == [("link", "https://a.example/?x&lt=1", "https://a.example/?x<=1"), ("script", "an unreadable form", "")]


@pytest.mark.parametrize("bad", ["<!DOCTYPE x><xdp/>", "<xdp>", "<other/>", "<xdp a='1' a='2'/>", "<xdp>&nope;</xdp>", "<xdp/><xdp/>", "", "\x00"])
def test_unreadable_form_goes_whole(bad):
    data = form(bad)
    first = inspect(data)
    assert ("FORM", "XFA_UNREADABLE") in kinds(first)
    again = inspect(inspect(data, remove=frozenset(i.slot for i in first.items if i.detail == "XFA_UNREADABLE")).output)
    assert ("FORM", "XFA") not in kinds(again)


def test_form_is_cleaned_across_packets():
    data = form("<xdp><template><field><script>a</script><image>AAAA</image></field></temp", "late></xdp>")
    first = inspect(data)
    assert [k for k in kinds(first) if k[1] != "FIELDS"] == [("FORM", "XFA"), ("JAVASCRIPT", "XFA"), ("FORM", "IMAGE")]
    out = inspect(data, remove=frozenset(i.slot for i in first.items if "#" in i.slot and not i.slot.endswith("#whole"))).output
    assert b"<script></script><image></image>" in out
    assert [k for k in kinds(inspect(out)) if k[1] != "FIELDS"] == [("FORM", "XFA")]


def test_cut_over_a_packet_boundary():
    assert without([b"abc", b"def", b"ghi"], [(1, 4), (2, 3), (5, 9)]) == [b"a", b"e", b""]


def test_forms_of_the_query_hold_whole_texts():
    text = "Fish & chips <b>\"5 > 4\"</b> ]]> &amp; é\u3000\U0001f600\r\n\ttail " * 3000
    for key in range(30):
        made = formed(key, text + "\x00\x1b\ufffe")
        at, end = made.index(b"<datasets>"), made.index(b"</datasets>")
        assert read_tree(made[at:end] + b"</datasets>").children[0].said() == text
        assert kinds(inspect(made)) == kinds(inspect(formed(key, "")))
