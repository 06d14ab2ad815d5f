import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from strandframe.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_stitching_equals_the_library(library):
    coder, rnd = bpe.codec(RANKS, P.PATTERN), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'ll", "é", "1", "!", "x" * 30, "\t", "　", "\x1c", "中", "\U0001f600", "\x85"]
    for n in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 300))) + (" " * 90 + "q" * 100) * (n % 5 == 0)
        size, overlap = rnd.choice([(16, 8), (32, 16), (5, 4), (64, 3)])
        work = bpe.Stitcher(coder)
        for a in range(0, len(text), size):
            work.add(a, text[a : a + size + overlap], coder.split(text[a : a + size + overlap]))
        ids = list(work.end())
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


@pytest.mark.parametrize("chunk", [32_768, 50])
def test_operator(spark, odd, library, chunk):
    got = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN, chunk_chars=chunk, overlap=8), RANKS, P.PATTERN, keep_ids=True).collect()
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["bytes"])) for r in got) == want
    both = bpe.encode(odd, RANKS, P.PATTERN, chunk_chars=chunk, overlap=8, decoded=True).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["bytes"])) for r in both) == want


def test_empty_table(empty):
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0
