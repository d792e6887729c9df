"""Secret scan: plain finds against a slow form, layers round trip, cycles, odd rows."""

import base64
import bz2
import gzip
import os
import re
import urllib.parse
import zlib

import pytest
import zstandard
from helpers import documents

from tagtrail.llm import secrets
from tagtrail.llm.queries import QUERIES

KEY = "AKIA" + "Z7" * 8
FOLDER = "/root/testdata/sf0.01"


def spans(text):
    return secrets._joined(secrets.find(text)[1])


def slow_base(text):
    out = []
    p = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in p.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


@pytest.mark.parametrize("text", [
    "password: hunter22", "TOKEN = 'abcdefgh'", "secret=token=abcdefgh", "token: short",
    'api_key":"A1b2C3d4E5"', "apikey=12345678 apiKey = 123", "ſecret=abcdefgh", "xx " + KEY,
    "AKIAAKIA" + "A" * 8, "AKIA short", "0" * 31, "g" + "0123456789abcdef" * 2 + "z",
    "a" * 200, "secret: secret: abcdefgh", "", "é\U0001F600 password=abcdefgh1"])
def test_plain_finds(text):
    assert secrets.find(text)[0] == slow_base(text)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_table_against_slow_form(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    truth = {r["doc_id"]: secrets._joined(slow_base(r["text"])) for r in texts}
    import hashlib
    for r in QUERIES["op4_secrets"](spark, FOLDER).collect():
        assert r["base_sha256"] == hashlib.sha256(truth[r["doc_id"]].encode()).hexdigest()
        assert set(filter(None, truth[r["doc_id"]].split(","))) <= set(r["spans"].split(","))


b64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize("encode", [
    lambda s: "".join(f"%{c:02X}" for c in s.encode()),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: b64(s.encode()), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())),
    lambda s: b64(bz2.compress(s.encode())), lambda s: b64(zstandard.compress(s.encode())),
    lambda s: b64(gzip.compress(zlib.compress(s.encode()))),
    lambda s: urllib.parse.quote(b64(b64(gzip.compress(s.encode())).encode())),
    lambda s: b64("".join(f"\\u{ord(c):04x}" for c in urllib.parse.quote(s)).encode())])
def test_layers_are_unwrapped(encode):
    inner = f"my key is {KEY} ok?"
    coded = encode(inner)
    found = secrets.find("start " + coded + " end")
    assert found[0] == slow_base("start " + coded + " end")
    hits = [s for s in found[1] if s[1] == 1]
    assert hits and all(6 <= a < b <= 6 + len(coded) for a, _, b in hits)


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, zstandard.compress])
@pytest.mark.parametrize("before", [40, 47, 300])
def test_wrapped_base64_is_one_part(width, line_end, pack, before):
    words = " ".join(str(i * 7919) for i in range(200))
    coded = b64(pack((words[:before] + f" {KEY} " + words[before:before + 90]).encode()))
    lines = [coded[i:i + width] for i in range(0, len(coded), width)]
    text = f"start{line_end}{line_end.join(lines)}{line_end}"
    assert any(k == 1 and a == 5 + len(line_end) for a, k, _ in secrets.find(text)[1])


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, zstandard.compress])
def test_all_members_are_read_and_early_ends_counted(pack):
    first, second = pack(b"nothing here. " * 20), pack(f"see {KEY} there".encode())
    coded = b64(first + second)
    assert secrets.find(coded)[1:] == ([(0, 1, len(coded))], 0)
    assert secrets.find(b64(first + second[:-6]))[2] == 1
    assert secrets.find(b64(first))[1:] == ([], 0)


def test_escapes_map_to_their_characters():
    text = "é token%20%3D%20abcdefgh tail"
    assert spans(text) == f"assign:2:{text.index(' tail')}"
    assert spans("x \\u0041KIA" + "B2" * 7) == "access:2:25"


def test_same_part_twice_is_found_twice():
    part = b64(f"see {KEY} there".encode())
    text = f"{part} and {part}"
    assert spans(text).count("access") == 2


def test_cycles_and_bombs_end(monkeypatch):
    deep = f"{KEY} token=abcdefgh12"
    for _ in range(30):
        deep = b64(zlib.compress(deep.encode()))
    assert "access:0:" in spans(deep)
    monkeypatch.setattr(secrets, "MAX_UNPACKED", 1000)
    found = secrets.find(b64(zlib.compress((KEY + " " + "a b " * 10_000).encode())))
    assert found[2] == 1 and any(k == 1 for _, k, _ in found[1])
    assert secrets.find("%25" * 2000)[1] == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdefgh"), (3, "token=abcdefgh"),
            (4, "lorem ipsum " * 30_000 + KEY), (None, KEY), (5, "AAAA" * 20_000)]
    got = secrets.find_secrets(documents(spark, rows, extra="spans")).collect()
    assert sorted((r["doc_id"] or 0, r["secrets"]["spans"]) for r in got) == [
        (0, "access:0:20"), (1, ""), (2, ""), (3, "assign:0:14"), (3, "assign:0:14"),
        (4, "access:360000:360020"), (5, "")]
    assert secrets.find_secrets(documents(spark, [])).count() == 0
