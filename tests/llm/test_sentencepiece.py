import random
import struct

import pytest
from lacuna.llm.sentencepiece_codec import CharMap, Codec, default_model, encode_documents


@pytest.fixture(scope="module")
def codec():
    return Codec(default_model())


TRICKY = ["", " ", "  ", "a", " a", "  a  b ", "\n", "\n\na", "a\n b \n", "\ta\t", "<s> </s> <unk> <0x0A>", "é́ß漢字🙂", "▁x ▁", "a▁b", "x\0y", "\r\n", " nb　sp", "🙂 🙂\n🙂"]


def test_same_ids_and_text_as_the_library(codec):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice("ab e\n<>0x,é漢🙂 ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert codec.encode(t) == codec.sp.encode(t), t
    got = codec.digests(texts, with_ids=True)
    import hashlib

    for t, r in zip(texts, got.itertuples()):
        ids = codec.sp.encode(t)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest(), t


def test_spans_cover_the_source(codec):
    for t in TRICKY + ["The  quick\nbrown fox. é漢🙂"]:
        spans, data = codec.spans(t), t.encode()
        assert b"".join(data[a:b] for _, a, b in spans) == data
        assert all(a <= b for _, a, b in spans)


def test_character_map_takes_the_longest_prefix():
    # keys "a" -> "x", "ab" -> "yz" in a double array: label in the low byte, leaf bit 8, offset from bit 10
    units = [0] * 1024
    hop = lambda n: n << 10
    units[0] = hop(256)
    units[256 ^ 97] = hop(512) | 256 | 97
    at = 256 ^ 97 ^ 512
    units[at] = 0x80000000 | 0
    units[at ^ 98] = hop(640) | 256 | 98
    units[at ^ 98 ^ 640] = 0x80000000 | 2
    m = CharMap(struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (2, b"yz")
    assert m.longest(b"ac", 0) == (1, b"x")
    assert m.longest(b"b", 0) is None


def test_nulls_ties_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (1, "a b", 6), (None, "", 7)], "doc_id long, text string, n_tokens int")
    rows = encode_documents(df, with_ids=True).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    assert encode_documents(df.limit(0)).count() == 0


def test_rows_carry_the_spans_of_the_reference_path(codec, spark):
    import hashlib

    rng = random.Random(3)
    texts = TRICKY + ["".join(rng.choice("ab e\n<>0x,é漢🙂 ") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    rows = encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t, data = texts[r.doc_id], texts[r.doc_id].encode()
        norm, src = codec.normalise(t)
        ends = [0, *(int(x) for x in codec.sizes[r.ids].cumsum())] if r.ids else [0]
        want = [int(src[x]) for x in ends]
        assert (r.begins, r.ends) == (want[:-1], want[1:]), t
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends)) == data
        assert r.spans_sha256 == hashlib.sha256(struct.pack(f"<{2 * len(r.ids)}q", *r.begins, *r.ends)).hexdigest()


def test_spans_through_a_compiled_map_and_unknown_pieces(tmp_path):
    import io

    import sentencepiece

    out = io.BytesIO()
    lines = [f"the ﬁne cat sat ① on  the mat Ａ{i}" for i in range(300)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_writer=out, vocab_size=60, model_type="bpe", normalization_rule_name="nmt_nfkc", character_coverage=0.98, minloglevel=2)
    (tmp_path / "small.model").write_bytes(out.getvalue())
    own = Codec(str(tmp_path / "small.model"))
    rng = random.Random(4)
    for t in ["", " ", "the ﬁne  Z漢 cat", "① Ａ", *("".join(rng.choice("the cat ﬁ①ＡZ漢é ") for _ in range(30)) for _ in range(100))]:
        ids = own.encode(t)
        begins, ends = own.aligned(t, ids)
        got = own.sp.encode(t, return_type="proto").pieces
        data = t.encode()
        assert [p.id for p in got] == ids and all(a <= b for a, b in zip(begins, ends)), t
        # a word's piece lies within the source that the library gives it, white space apart
        for p, a, b in zip(got, begins, ends):
            assert data[a:b].decode(errors="ignore").strip() in (p.surface.strip(), ""), (t, p, a, b)
