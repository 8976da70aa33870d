import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flightloom.llm import binary_output as O
from flightloom.llm import packing as P
from flightloom.llm.tokens import encoder

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab ,.'\n\t12Àé×-+<| ", max_size=40)), max_size=6))
def test_ids_are_the_librarys(name, texts):
    ids, sizes = encoder(name).encode(pa.array([*texts, None, ""], pa.string()))
    want = plain(name, [*texts, None, ""])
    assert ids.tolist() == [y for x in want for y in x] and sizes.tolist() == [len(x) for x in want]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_coding_round_trip(ranks):
    control, data = O.encode_ranks(np.array(ranks, np.uint32))
    assert O.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == ranks


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, documents, rows):
    got = O.read_token_files(spark, O.write_token_files(documents, WORDS)).toPandas()
    ids = [[*x, 1] for x in plain(WORDS, [t for _, t in rows])]
    want = sorted((-1 if d is None else d, crc(x), len(x)) for (d, _), x in zip(rows, ids))
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    got = got.sort_values("start")
    assert [tuple(x) for x in got[["doc_id", "ids_crc32", "n_tokens"]].to_numpy().tolist()] == want
    assert got["start"].tolist() == (np.cumsum([n for _, _, n in want]) - [n for _, _, n in want]).tolist()


def test_packing(spark, documents, rows):
    got = P.pack_along_curve(documents, BYTES, 2048).toPandas()
    ids = {}
    for (d, t), x in zip(rows, plain(BYTES, [t for _, t in rows])):
        ids.setdefault(-1 if d is None else d, []).append([*x, 1])
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    covered = 0
    for x in got.itertuples():
        own = ids[x.doc_id][0]  # repeated rows have the same ids
        assert x.doc_tokens == len(own) and crc(own[x.start : x.start + x.length]) == x.ids_crc32
        covered += x.length
    assert covered == sum(len(y) for x in ids.values() for y in x)
    ordered = got.sort_values(["sequence_id", "offset"])
    flat = ordered["sequence_id"] * 2048 + ordered["offset"]
    assert flat.tolist() == (ordered["length"].cumsum() - ordered["length"]).tolist()
    assert (ordered["offset"] + ordered["length"]).max() <= 2048


def test_sequences_can_be_built(spark):
    texts = ["one two three " * n for n in (1, 40, 7, 0, 300)]
    got = P.pack_along_curve(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, 64).toPandas().sort_values(["sequence_id", "offset"])
    sequences = [np.frombuffer(b"".join(map(bytes, x)), "<u4").tolist() for _, x in got.groupby("sequence_id")["ids"]]
    assert [len(x) for x in sequences[:-1]] == [64] * (len(sequences) - 1)
    stream = [y for x in sequences for y in x]
    want = plain(BYTES, texts)
    assert stream == [y for d in got["doc_id"].drop_duplicates() for y in [*want[d], 1]]
    assert got["ids_crc32"].tolist() == [zlib.crc32(bytes(x)) for x in got["ids"]]


def test_empty_tables(spark, nothing):
    assert O.read_token_files(spark, O.write_token_files(nothing, WORDS)).count() == 0
    assert P.pack_along_curve(nothing, BYTES).count() == 0


def test_hilbert_curve_is_one_path():
    points = np.stack(np.meshgrid(*[np.arange(4)] * 3), axis=-1).reshape(-1, 3)
    order = points[np.argsort(P.hilbert_key(points, 2))]
    assert len(set(P.hilbert_key(points, 2).tolist())) == 64
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
