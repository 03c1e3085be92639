import io
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import zstandard
from corpus_cases import odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronozone.llm import frames, packing, tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@lru_cache
def library(name):
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=4096)
def whole(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    enc = tokens.Encoder(public_tokenizers.path(name))
    slow = Tokenizer.from_file(public_tokenizers.path(name))
    slow.encode_special_tokens = True

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from([" ", "  ", "\n", "a", "The", "don't", "é", "É", "é", "́", ".", ",\n", "12", "<|endoftext|>", "İ", "ŉ", "\x00", " ", "\x1c", "日本", "!?", "|", "'s"]), max_size=12).map("".join)))
    def same(text):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_as_the_library_does(name):
    enc, plain = tokens.encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "The", "don't", "é", "日本", "\u0301", ".", "12", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext|>", "İ"]), max_size=12).map("".join))
    def same(text):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    same()
    assert np.frombuffer(enc.encode("end <|endoftext|> of"), "<u4").tolist() == {NAMES[0]: [437, 220, 50256, 286], NAMES[1]: [806, 49407, 539]}[name]


@pytest.mark.parametrize("line", ["日本", "don’t", "д", "’"])
def test_many_lines_without_spaces(line):
    enc = tokens.Encoder(public_tokenizers.path(NAMES[0]))
    for text in ("\n".join([line] * 20_000), "\n".join(f"{line}{k}" for k in range(20_000)) + "\n\nx y\n" + line):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole(NAMES[0], text)


def test_frames_round_trip_and_random_access():
    out, docs = io.BytesIO(), {5: b"", 7: np.arange(9, dtype="<u4").tobytes(), None: b"\x01\x00\x00\x00" * 5000, 9: b"\x02\x00\x00\x00"}
    writer = frames.FrameWriter(out)
    for k, v in docs.items():
        writer.add(k, v)
    writer.close()
    assert writer.size == len(out.getvalue())
    reader = frames.FrameReader(io.BytesIO(out.getvalue()))
    assert {i: reader.read(k) for k, i in enumerate(reader.ids)} == docs
    assert dict(reader.find({7, 9})) == {7: docs[7], 9: docs[9]}
    # the frames are plain zstandard: a reader that skips skippable frames gets all ids
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"".join(docs.values())
    bad = bytearray(out.getvalue())
    bad[int(reader.begin[1]) + 12] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.FrameReader(io.BytesIO(bytes(bad))).read(1)
    with pytest.raises(ValueError):
        frames.FrameReader(io.BytesIO(b"0" * 50))
    empty = io.BytesIO()
    frames.FrameWriter(empty).close()
    assert frames.FrameReader(io.BytesIO(empty.getvalue())).ids == []


def test_op5(spark, sf):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got, at = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in frames.query(spark, sf).collect()}, 0
    for i, text in docs:
        ids = [*whole(NAMES[0], text), 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows_in_files(odd, none, tmp_path):
    for df, name in ((odd, "a"), (none, "b")):
        folder = (tmp_path / name).as_uri()
        manifest = frames.write_tokens(df, folder, public_tokenizers.path(NAMES[0]))
        rows = frames.read_tokens(manifest, folder).collect()
        assert len(rows) == df.count()
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += len(r.ids) // 4
        ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_best_fill_is_best():
    rng = random.Random(7)
    for _ in range(200):
        counts, room = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}, rng.randint(0, 64)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        used = packing.best_fill(dict(counts), room)
        assert all(0 < n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_plans_use_every_remainder_once():
    rng = random.Random(8)
    for _ in range(30):
        width = 64
        counts = {k: rng.randint(1, 30) for k in rng.sample(range(1, width), rng.randint(1, 40))}
        windows = packing.plan(counts, width)
        used = {}
        for times, own in windows:
            assert sum(k * n for k, n in own.items()) <= width
            for k, n in own.items():
                used[k] = used.get(k, 0) + n * times
        assert used == counts
        places, seqs = packing.Places(windows, 5, width), {}
        for k, n in counts.items():
            for r in range(n):
                got = places.find(k, r)
                assert sum(x[1] for x in got) == k
                for _, size, q, o in got:
                    seqs.setdefault(q, []).append((o, size))
        assert sorted(seqs) == list(range(5, places.sequences))
        for own in seqs.values():
            at = 0
            for o, size in sorted(own):
                assert o == at
                at += size
            assert at == width or at & (at - 1) == 0 and at < width


def check_packed(rows, docs, name=NAMES[1]):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = np.array([*whole(name, text), 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for o, size in sorted(own):
            assert o == at
            at += size
        assert 0 < at <= 2048 and at & (at - 1) == 0


def test_op10(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packed(packing.query(spark, sf).collect(), docs)


def test_odd_rows_packed(spark, odd, none, monkeypatch):
    path = public_tokenizers.path(NAMES[1])
    rows = packing.pack(odd, path).collect()
    assert sum(r.length for r in rows) == sum(len(whole(NAMES[1], t[1])) + 1 for t in odd_rows())
    assert packing.pack(none, path).count() == 0
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    docs = [(k, prose(k, 10 + 700 * (k % 5))) for k in range(40)]
    check_packed(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), path, digest=True).collect(), docs)
