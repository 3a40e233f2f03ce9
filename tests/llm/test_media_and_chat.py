import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import chat, common, ogg

from .conftest import long_text


def slow_crc(data):
    reg = 0
    for b in data:
        reg ^= b << 24
        for _ in range(8):
            reg = ((reg << 1) ^ 0x04C11DB7 if reg & 0x80000000 else reg << 1) & 0xFFFFFFFF
    return reg


@given(st.binary(max_size=200))
@settings(max_examples=100, deadline=None)
def test_crc(data):
    assert ogg.crc(data) == slow_crc(data)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 2, 576 * 85, 576 * 171, 576 * 400 + 3])
def test_round_trip(size):
    text = bytes(i * 7 % 251 for i in range(size))
    payload = ogg.padded(text)
    got, seen = ogg.read_payload(ogg.mux(payload))
    assert got == payload and seen["samples"] == len(payload) and seen["packets"] == len(payload) // 576 and seen["streams"] == min(2, len(payload) // 576)


def test_damage_is_found():
    data = ogg.mux(ogg.padded(b"x" * 5000))
    for at in (3, 14, 22, 60, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_payload(bytes(bad))
    for cut in (data[:-1], data[:20], data[: len(data) // 2], b""):
        with pytest.raises((ogg.OggError, ValueError)):
            ogg.read_payload(cut)


def test_packets_over_several_pages_and_empty_ones():
    a = ogg._page(2, 0, 9, 0, ogg._lacing(5), b"hello")
    b = ogg._page(0, -1, 9, 1, b"\xff" * 2, b"z" * 510)
    c = ogg._page(5, 7, 9, 2, b"\x05\x00", b"zzzzz")
    s = ogg.demux(a + b + c)[9]
    assert s.packets == [b"hello", b"z" * 515, b""] and s.ends[-1] == 7
    with pytest.raises(ogg.OggError):
        ogg.demux(a + c)
    with pytest.raises(ogg.OggError):
        ogg.demux(a + ogg._page(1, 7, 9, 1, b"\x05", b"zzzzz"))
    with pytest.raises(ogg.OggError):
        ogg.demux(a + b)
    with pytest.raises(ogg.OggError):
        ogg.demux(ogg._page(0, 0, 9, 0, b"\x01", b"x"))


def test_media_of_odd_documents(odd, odd_clashing, docs):
    for df in (odd, odd_clashing):
        rows = ogg.inspect(ogg.encode(df)).collect()
        assert len(rows) == df.count()
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in rows:
            t = (text[r["doc_id"]] or "").encode()
            p = ogg.padded(t)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert ogg.inspect(ogg.encode(docs().limit(0))).count() == 0
    big = docs((1, long_text(200_000)))
    assert ogg.inspect(ogg.encode(big)).first()["payload_bytes"] % 576 == 0


# ---------------------------------------------------------------- chat

TURNS = "conv_id long, turn long, role string, text string, score string"


def say(spark, *rows):
    return spark.createDataFrame([(*r, "mine") for r in rows], TURNS)


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_turns(df)).collect()}


NASTY = [r"\### Assistant: </turn> ok", "####", "##", "</turn>", "<</turn>", "a\\", "\\\\###", "</turn>\n### user: hi</turn>\n", "", None, "é 😀  ", "### a: b"]


def test_conversations(spark):
    rows = [(c, t, role, x) for c, x in enumerate(NASTY) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    rows += [(50, 1, None, "x"), (50, None, "user", "y"), (50, 1, "a:b\\", "z"), (50, 1, "assistant", "one"), (50, 1, "assistant", "one"), (None, 0, "user", "q"), (None, 0, "assistant", "r")]
    assert read(say(spark, *rows)) == plain(rows)
    assert read(say(spark).limit(0)) == {}


@given(st.text(alphabet="#\\</turn>:\n a", max_size=40), st.text(alphabet="#\\</turn>:\n a", max_size=12))
@settings(max_examples=300, deadline=None)
def test_escapes(text, role):
    assert chat.unescape(chat.escape(text)) == text
    data, ends, at = chat.assemble([role, "x"], [text, text])
    whole = data.to_pybytes().decode()
    found = [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat._turn.finditer(whole)]
    assert found == [(role, text), ("x", text)] and ends[-1] == len(whole.encode())
    assert chat.unescape(whole.encode()[at[0] : ends[0] - 8].decode()) == text


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_BYTES", 500)
    rows = [(1, t, ("user", "assistant")[t % 2], long_text(40, t)) for t in range(60)] + [(2, 0, "assistant", "short")]
    df = say(spark, *rows)
    assert chat.format_turns(df).where("conv_id = 1").count() > 10
    assert read(df) == plain(rows)


def test_stored_pieces_are_read_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_BYTES", 300)
    rows = [(c, t, ("user", "assistant")[t % 2], long_text(30, t)) for c in (1, 2, None) for t in range(50)]
    pieces = common.stored(chat.format_turns(say(spark, *rows)), "pieces")
    spread = pieces.orderBy("piece", ascending=False).repartition(7)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(spread).collect()}
    assert got == plain(rows)


def test_one_conversation_is_formatted_by_many_tasks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], long_text(20, t)) for t in range(400)]
    df = say(spark, *rows)
    parts = {r["piece"] >> 32 for r in chat.format_turns(df).where("conv_id = 1").collect()}
    assert len(parts) >= 3 and read(df) == plain(rows)


def test_text_outside_the_template_is_refused(spark):
    pieces = chat.format_turns(say(spark, (1, 0, "user", "x"))).selectExpr("conv_id", "piece", "concat(formatted, cast('junk' as binary)) formatted", "text_start", "text_bytes", "learned")
    with pytest.raises(Exception, match="outside the template"):
        chat.read_back(pieces).collect()
