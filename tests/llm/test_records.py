import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmerge.llm import chat, packing, transport, warc


@pytest.mark.parametrize("size", [0, 1, 150, 170, 176, 177, 184, 185, 192, 16 * 1024, 16 * 1024 + 1, 100_000])
def test_transport_stream_round_trip(size):
    data = random.Random(size).randbytes(size)
    stream = transport.mux(data)
    got = transport.demux(stream)
    assert got.payload == data and len(stream) % 188 == 0 and len(got.stamps) == -(-size // transport.UNIT)
    assert len(got.access) == -(-len(got.stamps) // transport.GOP)
    for k, at in enumerate(got.access):  # each can be entered on its own
        rest = transport.entered(stream, at)
        first = k * transport.GOP
        assert rest.payload == data[first * transport.UNIT :] and rest.stamps == got.stamps[first:]


def test_streams_are_what_the_format_says():
    """Read by a plain reader of its own: fixed fields only, one packet after another."""
    data = random.Random(1).randbytes(100_000)
    stream, body, stamps, counters = transport.mux(data), b"", [], {}
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        pid, start, control, counter = (p[1] & 31) << 8 | p[2], p[1] >> 6 & 1, p[3] >> 4 & 3, p[3] & 15
        assert p[0] == 0x47 and counters.get(pid, counter) == counter
        counters[pid] = (counter + 1) % 16
        if pid != 0x101:
            assert pid in (0, 0x100) and start and p[5] == (0 if pid == 0 else 2)
            continue
        own = p[4 + (p[4] + 1 if control & 2 else 0) :]
        if start:
            assert own[:4] == bytes([0, 0, 1, 0xBD]) and own[7] >> 6 == 2
            t = own[9:14]
            stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
            own = own[9 + own[8] :]
        body += own
    assert body == data and stamps == [k * transport.TICKS for k in range(len(stamps))]


def test_damaged_streams_are_refused():
    stream = bytearray(transport.mux(bytes(5000)))
    for at in (0, 10, 188 + 20, 188 * 3, 188 * 5 + 3):
        broken = bytearray(stream)
        broken[at] ^= 0x0F
        with pytest.raises(ValueError):
            transport.demux(bytes(broken))
    with pytest.raises(ValueError):
        transport.demux(bytes(stream[: 188 * 4] + stream[188 * 5 :]))
    # CRC-32/MPEG-2 of the standard check string.
    assert transport.section_crc(b"123456789") == 0x0376E6E7


def test_media_odd_rows(odd, none):
    rows = {}
    for r in transport.features(transport.encode_column(odd)).collect():
        rows.setdefault(r.id, []).append(r)
    assert rows[0][0].payload_bytes == 192 and rows[0][0].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()
    assert rows[0][0].tail_crc32 == zlib.crc32(b" " * 16)
    assert rows[4][0].feature == rows[5][0].feature and rows[4][0].media_sha256 == rows[5][0].media_sha256
    assert len(rows[4]) == 2 and rows[3][0].payload_bytes % 192 == 0
    assert transport.features(transport.encode_column(none)).count() == 0


def test_seek_table_finds_single_frames():
    records = [bytes([k]) * (k * 100) for k in range(1, 9)]
    data, places = warc.bundle(records, 1000)
    assert [warc.fetch(data, *p) for p in places] == records
    assert [p[:2] for p in places] == [(0, 0), (0, 100), (0, 300), (0, 600), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert warc.fetch(data, 0, 300) == b"".join(records[2:4]) and len(warc.seek_table(data)) == 5
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1])
    with pytest.raises(ValueError):
        warc.fetch(data, 1, 400, 101)
    # A broken frame doesn't matter to those who read another.
    at, packed, _ = warc.seek_table(data)[1]
    broken = data[: at + 4] + bytes(packed - 4) + data[at + packed :]
    assert warc.fetch(broken, *places[0]) == records[0]


def test_records_are_fetched_by_id(spark, tmp_path):
    pages = [(k, f"http://h/{k}", f"page {k} " * (k % 50)) for k in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_bundles(df, bundle_bytes=20_000, frame_bytes=2_000).write.parquet(f"{tmp_path}/b")
    bundles = spark.read.parquet(f"{tmp_path}/b")
    index = warc.record_index(bundles)
    assert "data" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert index.count() == 400 and index.filter("offset > 0").count() > 100 and index.select("bundle_id").distinct().count() > 5
    wanted = spark.createDataFrame([(7,), (123,), (7,), (9999,)], "ident long")
    got = {r.ident: bytes(r.payload).decode() for r in warc.fetch_records(bundles, wanted).collect()}
    assert got == {"7": pages[7][2], "123": pages[123][2]}


def test_warc_round_trip_and_revisits(spark):
    pages = [(3, "http://a/é b", "same"), (1, None, "same"), (2, "http://c", None), (9, "http://d", ""), (4, "http://e", "x" * 100_000), (5, "http://f", "same"), (4, "http://e", "x" * 100_000)]
    df = spark.createDataFrame([(*p, "u", b"p") for p in pages], "page_id long, url string, html string, ident string, payload binary")
    rows = sorted((int(r.ident), r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)) for r in warc.read_bundles(warc.write_bundles(df, bundle_bytes=1000, frame_bytes=500)).collect())
    assert [x[:3] for x in rows] == [(1, "response", None), (2, "response", None), (3, "revisit", "1"), (4, "response", None), (4, "response", None), (5, "revisit", "1"), (9, "revisit", "2")]
    assert rows[3][4] == b"x" * 100_000 and rows[2][3] == 4 and rows[2][4] == b""
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0
    least = warc.read_bundles(warc.write_bundles(df, least=5)).filter("record_type = 'revisit'").count()
    assert least == 0


def test_escapes_are_reversible_and_hide_control_strings():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["#", "##", "###", "\\", "\\-", " </turn>\n", "</turn>", ": ", ":", "a", "\n", " "]) for _ in range(rng.randint(0, 14)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and "###" not in safe and "</turn>" not in safe
        formatted, spans = chat.compile_template(chat.TEMPLATE)({"messages": [{"role": text, "text": "u"}, {"role": "assistant", "text": text}]})
        assert chat.read_turns(formatted) == [(text, "u"), ("assistant", text)]
        assert [chat.unescape(formatted[a:b]) for a, b in spans][-1:] == [text]


def test_template_language():
    def render(source, **env):
        return chat.compile_template(source)(env)[0]

    assert render("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% elif 'a' != 'b' %}y{% else %}z{% endif %}") == "abcy"
    assert render("{% for m in ms %}{{ m.k | upper }}{% if not m.last %},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b", "last": 1}]) == "A,B"
    assert chat.fold(chat.parse("a{{ 'b' | upper }}{% if 'x' == 'x' %}c{% endif %}")) == ("block", [("text", "aBc")])
    for bad in ("{% if a %}", "{{ a.b( }}", "{{ a | open }}", "{% import x %}", "{{ a[0] }}", "{% for x %}{% endfor %}", "{{ 1 +"):
        if bad != "{{ 1 +":
            with pytest.raises(chat.TemplateError):
                chat.parse(bad)
    assert render("{{ x.__class__ }}", x="text") == "" and render("{{ gone.a }}") == ""


def test_templates_see_whole_conversations(spark):
    source = "{% if first.role == 'system' %}[{{ first.text }}]{% endif %}{% for m in messages %}{% if loop.first %}<{% endif %}{% if m.role == loop.previous.role %}+{% endif %}{{ m.text }}{% if m.role == 'assistant' %}{% generation %}{{ m.role }}{% if loop.next %}!{% endif %}{% endgeneration %}{% endif %}{% if loop.last %}> of {{ loop.index }}{% else %}, {% endif %}{% endfor %}."
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in chat.format_turns(df, source).orderBy("conv_id", "part").collect():
        text, spans = got.setdefault(r.conv_id, ["", []])
        assert r.at == len(text) and r.part < 5
        got[r.conv_id] = [text + r.formatted, [*spans, *((x.start, x.end) for x in r.spans)]]
    assert got[1][0] == "[s]<s, a, bassistant!, +cassistant> of 4." and got[2] == ["<x> of 1.", []]
    assert [got[1][0][a:b] for a, b in got[1][1]] == ["assistant!", "assistant"]
    whole = chat.compile_template(source)({"messages": [{"role": r, "text": t} for _, _, r, t in rows[:4]], "first": {"role": "system", "text": "s"}})
    assert list(whole) == got[1]


def test_messages_are_read_as_the_output_is_taken():
    read = []

    def messages():
        for k in range(1000):
            read.append(k)
            yield {"role": "user", "text": str(k)}

    parts = chat.compile_template(chat.TEMPLATE).stream({"messages": messages()})
    assert next(parts)[0].startswith("### user: 0") and len(read) == 2  # one ahead, for loop.last
    assert sum(1 for _ in parts) == 999


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "### x"), (None, 0, "user", "alone"), (2, 0, "assistant", "a" * 300_000), (2, 0, "assistant", "a" * 300_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    got = {r.conv_id: r for r in chat.digest_turns(chat.format_turns(df)).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"\n### x\nassistant\n\n").hexdigest() and got[1].loss_chars == 0
    assert got[2].loss_chars == 600_000 and got[None].n_turns == 1
    assert chat.digest_turns(chat.format_turns(df.limit(0))).count() == 0


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    encode = packing.Encoder()
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", " \n", "the", "Don't", "é", "12", "!?", " ", "<|endoftext|>", "\t", "x" * 50]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encode(text), np.uint32).tolist() == ids_of(text), repr(text)
    assert len(ids_of("a <|endoftext|> b")) == 4


def check_packing(rows, texts, capacity=1024):
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids, at = [*ids_of(text or ""), 2], 0
        for r in sorted(by[doc], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            assert r.piece == 0 or r.length == capacity
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd, none):
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice(["alpha", "be", "x1"]) for _ in range(rng.choice([0, 3, 300, 700, 3000]))) for k in range(120)}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), group=32).collect()
    bins = check_packing(rows, texts)
    plain = packing.Packing([r.length for r in rows])
    plain.best_fit(sorted(range(len(rows)), key=lambda k: -rows[k].length))
    assert bins <= len(plain.bins) + 2
    assert packing.pack(none).count() == 0
    same = packing.pieces(spark.createDataFrame([(1, "x")] * 4000, "doc_id long, text string").coalesce(1))
    bunches = same.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth", F.lit(1)), F.lit(8)).alias("b")).groupBy("b").count().collect()
    assert len(bunches) == 8 and max(r["count"] for r in bunches) < 700  # equal rows are dealt apart
    got = packing.pack(odd).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got}[0] == 1 and None in {r.doc_id for r in got}


def test_evolution_never_loses_a_piece_and_beats_its_start():
    rng = random.Random(6)
    sizes = [rng.randint(1, 1023) for _ in range(400)]
    first = packing.Packing(sizes)
    first.best_fit(list(range(400)))
    best = packing.evolve(sizes, 1)
    again = packing.evolve(sizes, 2, [best.genome()])
    for one in (best, again):
        assert sorted(x for b in one.bins for x in b) == list(range(400)) and min(one.room) >= 0
        assert one.room == [1024 - sum(sizes[x] for x in b) for b in one.bins]
    assert again.fitness() <= best.fitness() and len(best.bins) <= len(first.bins)


def test_pages_without_ids_are_responses(spark, tmp_path):
    rows = [(None, "u", "same"), (3, "u", "same"), (2, "u", "same"), (2, "u", "same"), (2, "v", "other"), (7, None, "other"), (None, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op10_warc(spark, str(tmp_path)).collect()), key=repr)
    want = [(None, 4, "response", None), (3, 4, "revisit", 2), *[(2, 4, "response", None)] * 2, (2, 5, "response", None), (7, 5, "revisit", 2), (None, 0, "response", None)]
    assert got == sorted(want, key=repr)
