"""The token files' coder and writer beyond the round trips of test_text_operators."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kinds", [1, 2, 65536, 65537, 1 << 20])
def test_ids_of_any_size(kinds):
    r = np.random.default_rng(kinds)
    ids = np.concatenate([r.integers(0, kinds, 700), np.minimum(r.zipf(1.2, 700), kinds) - 1, [kinds - 1] * 300])
    assert token_files.decode_block(token_files.code_block(ids), len(ids)).tolist() == ids.tolist()


def test_larger_ids_are_refused():
    with pytest.raises(ValueError):
        token_files.pack([1], [1], np.array([1 << 20]))


def test_several_blocks_and_a_document_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    ids = np.random.default_rng(0).integers(0, 500, 3500)
    ((_, lengths, back),) = token_files.unpack(token_files.pack([1, 2], [3000, 500], ids) + b"\n")
    assert back.tolist() == ids.tolist() and lengths.tolist() == [3000, 500]


def test_blocks_are_reset_and_read_alone():
    ids = np.random.default_rng(1).integers(0, 300, 2000)
    assert token_files.code_block(ids) == token_files.code_block(ids)
    two = [token_files.code_block(x) for x in (ids[:1200], ids[1200:])]
    assert token_files.decode_block(two[1], 800).tolist() == ids[1200:].tolist()


def test_every_damaged_byte_is_found():
    ids = np.random.default_rng(2).integers(0, 90, 600)
    data = token_files.pack([5, None], [600, 0], ids) + b"\n"
    for at in range(0, len(data) - 1, 7):
        with pytest.raises(ValueError):
            found = list(token_files.unpack(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]))
            if found[0][2].tolist() == ids.tolist() and at >= len(data) - 13:
                raise ValueError("the last words of a lane may hold bits that nothing reads")


def test_the_orders_share_one_distribution():
    """The intervals of all ids fill the total without a gap, whatever the candidates are."""
    ids = np.random.default_rng(3).integers(0, 40, 400)
    model = token_files._Mixture(40, 8)
    for step in range(50):
        model.predict(8)
        spans = [model.interval(np.full(8, x)) for x in range(40)]
        starts = np.array([s for s, _ in spans], np.uint64)
        ends = starts + np.array([n for _, n in spans], np.uint64)
        assert (starts[0] == 0).all() and (ends[:-1] == starts[1:]).all() and (ends[-1] == 1 << model.total).all()
        assert all((model.at(starts[x].astype(model.number)) == x).all() and (model.at((ends[x] - np.uint64(1)).astype(model.number)) == x).all() for x in (0, 7, 39))
        model.learn(ids[step * 8 : step * 8 + 8])


def test_context_mixing_beats_frequencies_alone():
    """Ids whose successor is known cost far less than order 0 alone would need."""
    r = np.random.default_rng(4)
    follows, ids = r.permutation(64), [0]
    for jump in r.random(60_000) < 0.1:
        ids.append(int(r.integers(64)) if jump else int(follows[ids[-1]]))
    assert len(token_files.pack([1], [len(ids)], np.array(ids))) * 8 < 0.4 * 6 * len(ids)


def test_rows_of_one_id_and_without_one(spark, tmp_path):
    rows = [(None, f"null {i}") for i in range(30)] + [(7, f"seven {i}") for i in range(30)] + [(3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write(df, str(tmp_path / "ids"), WORDS, partitions=4)
    found = token_files.read(spark, str(tmp_path / "ids")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == sorted((i or -1, len(t.split()[-1]) + 2 if i != 3 else 2) for i, t in rows)
    assert len({r.file for r in found if r.doc_id is None}) > 1
    assert all(len(r.ids) == 4 * r.n_tokens for r in found)
    spread = {r.doc_id: r for r in token_files.round_trip(df.where("doc_id = 3"), WORDS).collect()}
    assert spread[3].ids_crc32 == zlib.crc32(next(r.ids for r in found if r.doc_id == 3))


def test_every_latin_letter_and_every_mark():
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    r = random.Random(5)
    letters, marks = [chr(c) for c in range(0xC0, 0x250)] + list("azAZ"), [chr(c) for c in range(33, 127)]
    texts = [x + m for x in letters for m in r.sample(marks, 3)] + ["".join(r.choices(letters, k=r.randint(1, 9))) + "".join(r.choices(marks, k=r.randint(0, 3))) for _ in range(3000)]
    for t, coded in zip(texts, token_files.encode_texts([t.encode() for t in texts], WORDS, 1), strict=True):
        assert np.frombuffer(coded, "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t
