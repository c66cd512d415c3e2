import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesync.llm import simple8b
from tablesync.llm.packing import best_cuts, candidates, pack, tail_cuts
from tablesync.llm.token_files import pack_segment, read_token_files, unpack_segment, write_token_files
from tablesync.llm.tokens import ChunkEncoder, vocabulary_path

from .conftest import odd_rows


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(vocabulary_path())


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "Bc", "d.", "1", "'s", "é", "　", "<|endoftext|>", " ", "日本"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, ""]
    for ids, text in zip(encoder.encode(texts), texts):
        assert ids.tolist() == whole(encoder, text), repr(text)


def test_whole_batches_are_cut_into_pieces(encoder, monkeypatch):
    """No text with white space of any kind or with punctuation is encoded alone, and words are learned once, whatever follows them."""
    monkeypatch.setattr(encoder, "_odd", None)
    monkeypatch.setattr(encoder, "_ids", None)
    encoder._forget()
    texts = ["alpha, beta. alpha beta", "", None, "\n\talpha  beta,\n\nalpha beta's alpha ", "it'll 'tis we''ve\u3000\u00e9t\u00e9'", "s end"]
    for ids, text in zip(encoder.encode(texts), texts):
        assert ids.tolist() == whole(encoder, text), repr(text)
    assert not {s for s in encoder.memo if len(encoder.pieces(s)) > 1}
    assert {"alpha", " alpha", " beta", "'s", "'ll", "''", "\u3000", "\u00e9t\u00e9"} < set(encoder.memo)
    encoder._forget()


def test_nothing_is_learned_from_texts_left_to_the_tokenizer(encoder):
    """Their pieces may be none to the tokenizer; other texts of the batch aren't touched by them."""
    encoder._forget()
    texts = ["plain words", "a\x00b \u0378\u0379\u0378", "", "x<|endoftext|>y", None, "plain \u0378 words", "more plain words."]
    for _ in range(2):
        for ids, text in zip(encoder.encode(texts), texts):
            assert ids.tolist() == whole(encoder, text), repr(text)
    assert not {s for s in encoder.memo if encoder.alone(s) and encoder.ids[encoder.stops[encoder.memo[s]] : encoder.stops[encoder.memo[s] + 1]].tolist() != whole(encoder, s)}
    encoder._forget()


def test_slices_of_arrow_arrays(encoder):
    import pyarrow as pa

    texts = ["left out é", None, "kept, words", "", "'s", "s kept\n", "left out"]
    for kind in (pa.string(), pa.large_string()):
        got = encoder.encode(pa.array(texts, kind).slice(1, 5))
        assert [x.tolist() for x in got] == [whole(encoder, t) for t in texts[1:6]]
        assert encoder.encode(pa.array([], kind)) == []
        assert [len(x) for x in encoder.encode(pa.array([None, ""], kind))] == [0, 0]


def test_every_code_point_is_cut_as_the_tokenizer_cuts_it(encoder):
    """Each between a letter and an apostrophe, and between a space and a number; nothing but surrogates is left out."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}'s {c}1\n" for c in points[at : at + 8]) for at in range(0, len(points), 8)]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        for text, mine, whole in zip(part, encoder.encode(part), encoder.tokenizer.encode_batch(part, add_special_tokens=False)):
            assert mine.tolist() == whole.ids, [hex(ord(c)) for c in text]
    encoder._forget()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        ChunkEncoder(vocabulary_path("word_bpe_49k.json"))


def test_memory_is_bounded(encoder, monkeypatch):
    from tablesync.llm import tokens

    monkeypatch.setattr(tokens, "MAX_CHUNKS", 5)
    for n in range(4):
        texts = [f"one two w{n}{i} x{i}" for i in range(9)]
        assert [x.tolist() for x in encoder.encode(texts)] == [whole(encoder, t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**31, 2**59, 2**64 - 1])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=False)
    ids[rng.random(n) < 0.4] %= np.uint64(5)
    if top > 2**60 and n:
        ids[::7] = np.uint64(2**64 - 1)  # raw words that look like escapes
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, n) == ids).all()
    assert offsets[-1] == len(words)


def test_blocks_decode_alone():
    ids = np.arange(5000, dtype=np.uint64)
    words, offsets = simple8b.encode(ids, 512)
    part = simple8b.decode(words[offsets[3] : offsets[4]], np.array([0, offsets[4] - offsets[3]]), 512, 512)
    assert (part == ids[3 * 512 : 4 * 512]).all()


def test_segment_round_trip():
    docs = [np.array([1, 2, 3], dtype=np.uint32), np.zeros(0, dtype=np.uint32), np.array([70000], dtype=np.uint32)]
    ids, starts, tokens, at = unpack_segment(pack_segment([5, None, -1], docs, 17, 1024))
    assert (ids, starts.tolist(), tokens.tolist(), at) == ([5, None, -1], [0, 3, 3, 4], [1, 2, 3, 70000], 17)
    with pytest.raises(ValueError):
        unpack_segment(b"nope" + bytes(60))


def test_files_hold_all_documents_in_order(spark, odd, encoder, tmp_path):
    path = f"file://{tmp_path}/files"
    write_token_files(odd, path, segment_ids=50)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted([r[0] is None for r in odd_rows()], reverse=True)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    at, want = 0, defaultdict(list)
    for r in odd_rows():
        want[r[0]].append([*whole(encoder, r[1]), 2])
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        want[r.doc_id].remove(ids)
        at += len(ids)
    assert not any(want.values())


def test_files_of_clashing_columns(spark, clashing, tmp_path):
    write_token_files(clashing, f"file://{tmp_path}/files", shards=2)
    assert read_token_files(spark, f"file://{tmp_path}/files").count() == len(odd_rows())


def test_files_of_an_empty_table(spark, empty, tmp_path):
    write_token_files(empty, f"file://{tmp_path}/files")
    assert read_token_files(spark, f"file://{tmp_path}/files").count() == 0


def check_pieces(rows, encoder, pieces, max_len=1024):
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*whole(encoder, r[1]), 0])
    total, by_sequence, by_start = 0, defaultdict(list), defaultdict(int)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert p.length == len(ids) > 0
        assert any(len(d) == p.doc_tokens and d[p.start : p.start + p.length] == ids for d in want[p.doc_id])
        by_start[p.doc_id] += p.length
        total += p.length
    assert {k: sum(map(len, v)) for k, v in want.items()} == dict(by_start)
    padding = 0
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= max_len
        padding += 0 if at & (at - 1) == 0 else max_len - at
    return padding / max(1, total)


def test_packing_loses_nothing(odd, encoder):
    assert check_pieces(odd_rows(), encoder, pack(odd).collect()) < 0.02
    check_pieces(odd_rows(), encoder, pack(odd, max_len=16, chunk_ids=100).collect(), 16)


def test_packing_of_odd_tables(empty, clashing, encoder):
    assert pack(empty).count() == 0
    check_pieces(odd_rows(), encoder, pack(clashing).collect())


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(200):
        n, top = rng.randint(1, 9), rng.randint(3, 8)
        cuts = np.cumsum([0] + [rng.randint(1, top) for _ in range(n)])
        pen = np.array([0.0] + [rng.randint(0, 5) for _ in range(n - 1)] + [0.0])
        cost = {0: 0.0}
        for j in range(1, n + 1):
            cost[j] = min(cost[i] + top - (cuts[j] - cuts[i]) + pen[j] for i in range(j) if cuts[j] - cuts[i] <= top)
        got = best_cuts(cuts, pen, top)
        at = [int(np.flatnonzero(cuts == c)[0]) for c in got]
        assert at[0] == 0 and at[-1] == n
        assert sum(top - (cuts[b] - cuts[a]) + pen[b] for a, b in zip(at, at[1:])) == cost[n]


@pytest.mark.parametrize("n", [1, 2, 17, 400])
@pytest.mark.parametrize("step", [1, 3, 16])
def test_candidates_are_document_ends_sentence_ends_and_inner_places(n, step):
    rng = np.random.default_rng(n + step)
    sentence, doc_ends = rng.random(n) < 0.03, np.flatnonzero(rng.random(n) < 0.02) + 1
    want = {0: 0.0, **{int(i) + 1: 2.0 for i in np.flatnonzero(sentence)}, **{int(i): 0.0 for i in doc_ends}, n: 0.0}
    outer = sorted(want)
    for a, b in zip(outer, outer[1:]):
        want.update({i: 8.0 for i in range(a + step, b, step)})
    cuts, penalties = candidates(sentence, doc_ends, 2.0, 8.0, step)
    assert dict(zip(cuts.tolist(), penalties.tolist())) == want and cuts.tolist() == sorted(want)


def test_tail_is_cut_to_powers_of_two():
    assert tail_cuts(10, 10 + 700) == [522, 650, 682, 698, 706, 710]


def test_digests_agree(odd):
    row = pack(odd).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(row.ids)
