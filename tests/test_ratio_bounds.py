"""Bounds that come for whole blocks of texts never lose a pair."""

import difflib
import random

from spanloom.operators import similarity as S

WORDS = "the of and a quick Brown fox, jumps over lazy dog. paper Zebra 7 form x? y; query wide island ß 日本".split()


def texts(n):
    rnd = random.Random(4)
    out = []
    for _ in range(n):
        base = " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([3, 20, 60, 150])))
        words = base.split(" ")
        for share in (0.0, 0.05, 0.3):
            out.append(" ".join(rnd.choice(WORDS) if rnd.random() < share else w for w in words))
        at = rnd.randrange(len(base))
        out.append(base[at:] + base[:at])
    return [*out, "e" * 300, "e" * 280 + "xyz", "日" * 400]


def test_no_block_loses_a_pair():
    own = texts(9)
    a, b = own[::2], own[1::2]
    want = {(i, k): r for i, x in enumerate(a) for k, y in enumerate(b) if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.7}
    block = S.Block(b, 0.7)
    got = {(i, k): r for i, x in enumerate(a) for k, r in block.ratios(x)}
    assert got == want and len(want) > 10


def test_reached_is_a_bound_and_a_close_one():
    own = [t for t in texts(9) if len(t) >= S.LONG]
    spared = 0
    for x in own[::3]:
        held = S._Held(x)
        for y in own:
            found = sum(m.size for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks())
            most = held.reached(y, S._Around(y))
            assert most >= found
            spared += most < S.most_matched(x, y)
    assert spared > 20
