import random

import pyarrow as pa
import pytest

from scriptloom.llm import token_counts as S
from scriptloom.llm import tokens as T
from scriptloom.llm.queries import tokenizer_path

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
ODD = [
    "", None, " ", "  ", " a", "a ", "a  b", "\n", "a\nb", "\n\n a", "a\n b \n", "▁x", "a▁b", " ▁ ", "\t x\t\ty", "<s>hi</s>", "<|endoftext|>x <|startoftext|>",
    "İstanbul ΣΑΣ Café", "café ﬁ", "it's don't", "x\x00y", "a" * 3000, "日本語 テスト", " nb em\x1cfs\x85n", "word...'s", "ab!'s", "#*$<|>", "e̸≠", "٣٤12", "\n'", "İ!",
]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(4)
    letters = "ab \n\t▁.é́İ<|>!'s1\u00a0  "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(1500)]


def test_piece_counts(many):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for at, offsets, wide, total in T.piece_prefixes(pa.array(many), PIECES):
        for i in range(len(offsets) - 1):
            text = many[at + i] or ""
            has = offsets[i + 1] > offsets[i]
            assert (int(total[offsets[i + 1] - 1]) if has else 0) == len(library.encode(text)), repr(text)
            assert (int(wide[offsets[i + 1] - 1]) if has else 0) == len(text)


def test_every_prefix(many):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in many[:250]:
        text = (text or "")[:60]
        table = S.prefix_table(text, PIECES)
        for k in range(len(text) + 1):
            assert S.tokens_of_prefix(text, k, table, PIECES) == len(library.encode(text[:k])), repr(text[:k])


def test_word_ids(many):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for at, ids, offsets in T.word_ids(pa.array(many), WORDS):
        for i in range(len(offsets) - 1):
            want = library.encode(many[at + i] or "", add_special_tokens=False).ids
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, repr(many[at + i])


def test_small_memo_gives_the_same(many, monkeypatch):
    monkeypatch.setattr(T, "MEMO_ENTRIES", 3)
    T.piece_counts.cache_clear()
    T.word_tokens.cache_clear()
    try:
        test_piece_counts(many[:200])
        test_word_ids(many[:200])
    finally:
        T.piece_counts.cache_clear()
        T.word_tokens.cache_clear()


def test_query(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = S.token_counts(docs, PIECES, limit=500).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 500)
        assert len(library.encode(text[: r.fit_chars])) <= 500


def test_odd_rows(odd_docs, no_docs):
    rows = S.token_counts(odd_docs, PIECES).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(0, 0)}
    assert next(r for r in rows if r.doc_id == 5).over_limit
    assert S.token_counts(no_docs, PIECES).count() == 0
    store = {r.doc_id: r for r in S.prefix_store(odd_docs, PIECES).collect()}
    assert store[1].tokens[-1] == next(r.n_tokens for r in rows if r.doc_id == 1) and store[2].tokens == [0]
