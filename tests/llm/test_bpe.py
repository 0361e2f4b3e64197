import random

import regex
import tiktoken
from spanloom.llm import bpe

TRICKY = ["", " ", "  \n\t x", "a", "it's we'LL don't", "é" * 40, "x" * 3000, "ab" * 900, "日本語 テキスト", "🙂🙃 ok", "\x1c\x1d a\x85b c  d", "123 4567,89%%%", "\r\n\r\n  end  ", "﻿x​Y", "<|endoftext|>"]


def both():
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def test_same_ids_as_the_library_and_round_trip():
    own, other = both()
    rnd = random.Random(5)
    alphabet = "etaoin shrdlu ÄÖéñß 0123 .,!?'\n\t🙂中"
    texts = TRICKY + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 400))) for _ in range(300)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert bpe.np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t), t[:50]
        assert own.decode(ids) == t.encode()


def test_heap_and_matrix_agree():
    own, _ = both()
    rnd = random.Random(7)
    rows = ["".join(rnd.choice("aestrnioé") for _ in range(rnd.randrange(2, 300))).encode() for _ in range(200)]
    assert own._matrix(rows) == [own._heap(r) for r in rows]


def test_white_space_of_the_pattern():
    _, other = both()
    own = regex.compile(bpe.default_vocabulary()[1]).findall
    for c in map(chr, range(0x3100)):
        t = f"a{c}b {c}{c} c"
        assert "".join(own(t)) == t
        assert bpe.np.frombuffer(both_codec.encode([t])[0], "<u4").tolist() == other.encode_ordinary(t), hex(ord(c))


both_codec = both()[0]


def test_query_rows(spark):
    df = spark.createDataFrame([(1, "Hello wörld", 1), (None, None, 2), (3, "", 3), (1, "Hello wörld", 1)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_decode(df, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0, bytes(r.decoded).decode()) for r in rows) == [(0, False, ""), (1, True, "Hello wörld"), (1, True, "Hello wörld"), (3, False, "")]
