import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tiller.llm import simple8b
from tiller.llm.op1_token_counts import count_tokens, resync_ids
from tiller.llm.op10_token_files import (
    document_index,
    new_path,
    read_token_files,
    write_token_files,
)
from tiller.llm.tokens import PieceEncoder, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


ODD = ["a<|startoftext|>b", "É́ éx", "́ a", "a\x1cb c d  e", "\x01 x\x01", "İstanbul ΑΣ ΑΣ. 123abc's they're",
       "", "\n\n  \t", "<|endoftext|> x <|ENDOFTEXT|>", "word,word.Word!! don't %%%", "naïve,café."]


def test_pieces_give_the_library_ids():
    encoder = PieceEncoder(PATH, entries=40)  # the cache is emptied again and again
    for _ in range(2):
        got = encoder.encode(ODD)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(x) for x in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcÉéß'.,!<|> \n\t01́Σ中"), max_size=60), max_size=4))
def test_pieces_property(texts):
    encoder = PieceEncoder(PATH)
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [ids(x) for x in texts]


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (300, 16), (2000, 128)])
def test_resync_gives_whole_text_ids(chunk, overlap):
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["the", "don't", "éa", "x" * 70, "1234", "end.\n"]) for _ in range(900))
    for text in [*ODD, long, "y" * 5000, " a" * 300 + "z" * 4000 + " tail" * 200]:
        assert sum(resync_ids(tokenizer(PATH), text, chunk, overlap), []) == ids(text)


def test_counts(spark, corpus):
    got = count_tokens(corpus.frame(spark), PATH, huge_chars=1000, chunk_chars=500, overlap_chars=32)
    want = sorted((str(d), len((t or "").encode()), len(ids(t))) for d, t, *_ in corpus.rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    assert count_tokens(corpus.empty(spark), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 2**64 - 1),
                                   st.sampled_from([0, 1, 2**60 - 1, 2**60])), max_size=600), max_size=5))
def test_simple8b_round_trip(sequences):
    flat = np.array([v for s in sequences for v in s], np.uint64)
    words, blocks = simple8b.encode(flat, np.array([len(s) for s in sequences], np.int64))
    assert blocks.sum() == len(words)
    assert simple8b.decode(words).tolist() == flat.tolist()
    if len(blocks):  # any block decodes alone
        first = simple8b.decode(words[: blocks[0]])
        assert first.tolist() == next(s for s in sequences if s)[: simple8b.BLOCK]


@pytest.mark.parametrize("shards,row_words", [(1, 1 << 17), (5, 64)])
def test_files(spark, corpus, shards, row_words):
    path = new_path(spark)
    write_token_files(corpus.frame(spark), PATH, path, shards=shards, row_words=row_words)
    back = read_token_files(spark, path).orderBy("shard", "nth", "before").collect()
    want = sorted(((d is not None, d or 0), ids(t) + [2]) for d, t, *_ in corpus.rows)
    assert [((r["doc_id"] is not None, r["doc_id"] or 0), np.frombuffer(r["ids"], "<u4").tolist())
            for r in back] == want
    start, expected = 0, []
    for (known, d), seq in want:
        crc = zlib.crc32(np.array(seq, "<u4").tobytes())
        expected.append((d if known else None, start, len(seq), crc))
        start += len(seq)
    index = sorted((tuple(r) for r in document_index(spark, path).collect()), key=lambda r: r[1])
    assert index == expected


def test_empty_files(spark, corpus):
    path = new_path(spark)
    write_token_files(corpus.empty(spark), PATH, path)
    assert document_index(spark, path).count() == 0
