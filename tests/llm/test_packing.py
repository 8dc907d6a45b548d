import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import packing as S
from scriptloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def round_trip(rows, texts, window=S.WINDOW):
    """Pieces give back every document's ids, and sequences are gapless and not too long."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / (total + padded)


def test_round_trip(docs, texts):
    assert round_trip(S.pack(docs, PATH).collect(), texts) < 0.05


def test_odd_rows(odd_docs, no_docs):
    rows = S.pack(odd_docs, PATH).collect()
    once = {r.doc_id: r.text for r in odd_docs.where("doc_id <> 8 and doc_id is not null").collect()}
    round_trip([r for r in rows if r.doc_id in once and False] or _alone(rows, once), once)
    assert sum(r.doc_id == 8 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3, 4)} == {(1, 1)}
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places)
    assert S.pack(no_docs, PATH).count() == 0


def _alone(rows, texts):
    """The documents' pieces, with the places of the others closed up."""
    from types import SimpleNamespace

    out = []
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s and r.doc_id in texts), key=lambda r: r.offset):
            out.append(SimpleNamespace(**r.asDict() | {"offset": at}))
            at += r.length
    return out


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for combo, times in S.plan(histogram, 64):
        assert sum(combo) <= 64 and times > 0
        for v in combo:
            used[v] = used.get(v, 0) + times
    assert used == histogram


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), min_size=1, max_size=12))
@settings(max_examples=40, deadline=None)
def test_lookup_gives_each_piece_its_own_place(histogram):
    places, fill = set(), {}
    for length, first, until, sequence, times, at in S.lookup(S.plan(histogram, 32)):
        for rank in range(first, until):
            n = rank - first
            spot = (sequence + n // times, at + n % times * length)
            assert spot not in places
            places.add(spot)
            fill[spot[0]] = fill.get(spot[0], 0) + length
            assert spot[1] + length <= 32
    assert len(places) == sum(histogram.values()) and max(fill.values()) <= 32


def test_least_squares():
    columns = [(6, 4), (5, 5), (4, 3, 3), (8, 2)]
    target = {6: 10, 4: 15, 5: 8, 3: 10, 8: 3, 2: 3}
    x = S.nnls(columns, target, sweeps=400)
    assert x == pytest.approx([10, 4, 5, 3], abs=0.2)


def test_little_padding_on_many_documents():
    rng = np.random.default_rng(1)
    histogram = {}
    for v in np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 2047).tolist():
        histogram[v] = histogram.get(v, 0) + 1
    plans = S.plan(histogram)
    used = sum(sum(c) * n for c, n in plans)
    assert sum(n for _, n in plans) * 2048 / used < 1.002
