import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sanmaru.llm.packing import WordIds, pack_documents, plan_packs, words_of
from sanmaru.llm.queries import tokenizer_path

WIDTH = 64


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@given(st.text(alphabet=st.sampled_from(list("abIKs'.,<|>endoftxé́̌  \n\t*%&0\x1cÉǰ"))), st.text())
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_text(tokenizer, a, b):
    for text in (a, b, a + " " + b, "<|endoftext|>" + a):
        try:
            text.encode()
        except UnicodeEncodeError:
            continue
        known, words = WordIds(tokenizer), words_of(text)
        known.learn(set(words))
        assert known.encode(words).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plan_places_every_length_once(histogram):
    placed = defaultdict(int)
    for count, held in plan_packs(histogram, 50):
        assert sum(n * k for n, k in held) <= 50
        for n, k in held:
            placed[n] += count * k
    assert dict(placed) == histogram


def test_pieces_fill_sequences(spark, tokenizer):
    texts = [None, "", "one", "one", "a b, c's. " * 40, "Über \n x" * 100, "the quick brown fox " * 60] + [f"word{i} again" for i in range(80)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(2, "one", 5)], "doc_id long, text string, length long")
    rows = pack_documents(docs, tokenizer_path(), width=WIDTH).collect()
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(whole) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in whole[i]})
        assert [p[0] for p in pieces] == list(range(0, len(ids), WIDTH))
        for start, length, crc, total in pieces:
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
    assert len(whole[2]) == 2 * len({r.start for r in whole[2]})
    for slots in seqs.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= WIDTH


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, tokenizer_path()).count() == 0
