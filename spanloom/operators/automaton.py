"""A dictionary as an automaton over the numbers of case-folded tokens, walked for all places of many texts at once."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ..functions.text import TOKEN, WORD_RUN


def fold(tokens: pa.Array) -> pa.Array:
    """Tokens in one case, for terms and texts alike: every code point becomes its simple lower case, and both small sigmas are one.

    No code point becomes two, so offsets stay. Sharp s and double s stay different, as do letters with and without accents.
    """
    return pc.replace_substring(pc.utf8_lower(tokens), "ς", "σ")


@functools.cache
def _split() -> regex.Pattern:
    return regex.compile(TOKEN)


def cut_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(token, number of its text, its number there, start) of all tokens of some texts."""
    found = list(map(_split().findall, texts))
    tok = pa.array(itertools.chain.from_iterable(found), pa.string())
    n = np.fromiter(map(len, found), np.int64, len(found))
    of = np.repeat(np.arange(len(texts)), n)
    edge = np.cumsum(n) - n
    size = pc.utf8_length(tok).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    start -= np.append(start, 0)[edge[of]]
    return tok, of, np.arange(len(of)) - edge[of], start


def per_distinct(tokens: pa.Array, test) -> np.ndarray:
    """test(token) for each token, called once for each distinct one."""
    coded = tokens.dictionary_encode()
    own = np.fromiter((test(t) for t in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, bool)


def are_words(tokens: pa.Array) -> np.ndarray:
    whole = regex.compile(WORD_RUN).fullmatch
    return per_distinct(tokens, lambda t: whole(t) is not None)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (n[0] numbers), then the same for the next."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def joined(tokens: pa.Array, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The n tokens from each first one as one string."""
    edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), tokens.take(pa.array(spread(first, n)))), "")


@dataclass
class Automaton:
    """Terms as paths of token numbers. Every place of a text is a start, so there are no failure links, and all starts are walked side by side.

    vocabulary: the folded tokens of all terms; keys: node * len(vocabulary) + token, ascending; node k + 1 is reached by keys[k].
    The terms that end in a node are rows at[node]:at[node + 1] of term, label, ord, open and close.
    """

    vocabulary: pa.Array
    keys: np.ndarray
    at: np.ndarray
    label: pa.Array
    ord: pa.Array
    open: np.ndarray
    close: np.ndarray

    @classmethod
    def build(cls, term: pa.Array, label: pa.Array, ord_: pa.Array) -> Automaton:
        """Of terms without a token (null or empty) there is no path. Equal folded terms share a path and stay rows of their own."""
        tok, of, _, _ = cut_tokens([t or "" for t in term.to_pylist()])
        low = fold(tok)
        vocabulary = low.unique()
        ids = pc.index_in(low, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        own, first, n = np.unique(of, return_index=True, return_counts=True)
        node, nodes, level = np.zeros(len(own), np.int64), 0, []
        for k in range(int(n.max()) if len(n) else 0):
            live = np.flatnonzero(n > k)
            step, number = np.unique(node[live] * len(vocabulary) + ids[first[live] + k], return_inverse=True)
            node[live] = nodes + 1 + number
            level.append(step)
            nodes += len(step)
        order = np.argsort(node, kind="stable")
        word = are_words(tok)
        rows = pa.array(own[order])
        return cls(
            vocabulary, np.concatenate([*level, np.zeros(0, np.int64)]), np.searchsorted(node[order], np.arange(nodes + 2)), label.take(rows).cast(pa.string()), ord_.take(rows).cast(pa.int32()),
            ~word[first][order], ~word[first + n - 1][order],
        )

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.vocabulary, self.keys, self.at, self.label, self.ord, self.open, self.close))

    def match(self, tok: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the first token, number of tokens, row of the term) of every place of every term; tok are whole texts' tokens, of their texts.

        A term's end that is no word must not touch a word; ends that are words are whole tokens already.
        """
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(tok):
            return none, none, none
        ids = pc.fill_null(pc.index_in(fold(tok), self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.flatnonzero(ids >= 0)
        node, found, k = np.zeros(len(start), np.int64), [(none, none, none)], 0
        while len(start):
            key = node * len(self.vocabulary) + ids[start + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            start, node, k = start[on], i[on] + 1, k + 1
            n = self.at[node + 1] - self.at[node]
            found.append((np.repeat(start, n), np.full(int(n.sum()), k), spread(self.at[node], n)))
            more = start + k < len(ids)
            more[more] = (of[start[more] + k] == of[start[more]]) & (ids[start[more] + k] >= 0)
            start, node = start[more], node[more]
        first, n, row = (np.concatenate(c) for c in zip(*found, strict=True))
        touching = np.zeros(len(first), bool)
        for side, near in ((self.open, first - 1), (self.close, first + n)):
            at = np.flatnonzero(side[row])
            at = at[(near[at] >= 0) & (near[at] < len(of))]
            at = at[of[near[at]] == of[first[at]]]
            touching[at] |= are_words(tok.take(pa.array(near[at])))
        free = ~touching
        return first[free], n[free], row[free]
