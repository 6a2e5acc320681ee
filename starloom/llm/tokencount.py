"""Token counts that follow edits: a segment tree over pre-tokens for each document.

Leaves are blocks of pre-tokens; every node sums characters and tokens below it.  An
edit (start, stop, replacement) finds its block by the character sums, takes back the
pre-tokens it touches and those before it whose match looked at changed characters,
and pre-tokenises from there until a boundary falls on an old one again.  Only those
pre-tokens are encoded, and only sums on the way up change.

Defined results: null text is empty, and so are null edits; edits are given in the
text's own positions, those outside it are cut to it, and of overlapping ones the first
holds; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import encoder, slices
from .common import like, small_batches, text_column

#: Pre-tokens of a leaf when the tree is made; characters after its end that a match may have looked at.
LEAF, LOOKAHEAD = 32, 2


class CountTree:
    """The tree of one document; ``count`` gives the tokens of a pre-token, ``tokens`` are the pre-tokens if known.

    ``reach``: characters after an edit that are looked at first; more than an added token's string has.
    """

    def __init__(self, text: str, split, count, tokens: list[str] | None = None, reach: int = 32):
        self.split, self.count, self.encoded, self.reach = split, count, 0, reach
        tokens = split(text) if tokens is None else tokens
        self.leaves = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, leaf)), sum(map(count, leaf))
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the leaf's first character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _put(self, leaf: int, tokens: list[str], gone: list[str], fresh: list[str]) -> None:
        """Replace a leaf, of whose old pre-tokens ``gone`` went and ``fresh`` came."""
        self.leaves[leaf] = tokens
        chars = sum(map(len, fresh)) - sum(map(len, gone))
        n = sum(map(self.count, fresh)) - sum(map(self.count, gone))
        i = leaf + self.size
        while i:
            self.chars[i] += chars
            self.tokens[i] += n
            i //= 2

    def replace(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start to stop."""
        first, at = self.find(max(0, start - LOOKAHEAD))
        # pre-tokens from the first on whose end is LOOKAHEAD - 1 characters before the edit or later
        head = self.leaves[first]
        sums = list(accumulate(map(len, head), initial=at))
        k = bisect.bisect_left(sums, start - (LOOKAHEAD - 1), 1) - 1
        begin, end, old, ends, leaf = sums[k], sums[-1], head[k:], sums[k + 1 :], first
        met, near = None, bisect.bisect_left(sums, stop + self.reach)
        if near < len(head):  # most edits are met at once, long before the leaf's end
            text = "".join(head[k:near])
            met = self._meets(text[: start - begin] + new + text[stop - begin :], begin, stop, len(new) - (stop - start), ends[: near - k], False)
        # take old pre-tokens, a leaf at a time, until the new ones fall in with them
        while met is None:
            done = leaf + 1 >= len(self.leaves)
            if end >= stop or done:
                text = "".join(old)
                changed = text[: start - begin] + new + text[stop - begin :]
                met = self._meets(changed, begin, stop, len(new) - (stop - start), ends, done)
                if met is not None:
                    break
            leaf += 1
            sums = list(accumulate(map(len, self.leaves[leaf]), initial=end))
            end = sums[-1]
            old += self.leaves[leaf]
            ends += sums[1:]
        fresh, taken = met
        # the edited stretch goes to the first leaf; leaves after it lose what was taken from them
        gone = old[:taken]
        self.encoded += len(fresh)
        left = taken
        in_head = min(left, len(head) - k)
        self._put(first, head[:k] + fresh + head[k + in_head :], gone[:in_head], fresh)
        used = in_head
        for i in range(first + 1, leaf + 1):
            m = min(taken - used, len(self.leaves[i]))
            if m:
                self._put(i, self.leaves[i][m:], gone[used : used + m], [])
            used += m
        if len(self.leaves[first]) > 64 * LEAF:
            self._spread()

    def _spread(self) -> None:
        """Deal the pre-tokens out to leaves anew.  Nothing is split or encoded: only sums of known counts are made.

        A leaf gets here after 63 * LEAF insertions, so that each insertion's share of this is small.
        """
        encoded, tokens = self.encoded, [t for leaf in self.leaves for t in leaf]
        self.__init__("", self.split, self.count, tokens, self.reach)
        self.encoded = encoded

    def _meets(self, changed: str, begin: int, stop: int, shift: int, ends: list[int], done: bool):
        """New pre-tokens up to the first new boundary that is an old one behind the edit, and how many old ones they replace."""
        fresh, at = [], begin
        last = begin + len(changed)
        for t in self.split(changed):
            at += len(t)
            # without the text that follows, the last pre-tokens may not be final
            if not done and at + LOOKAHEAD > last:
                return None
            fresh.append(t)
            old = at - shift
            if old >= stop:
                i = bisect.bisect_left(ends, old)
                if i < len(ends) and ends[i] == old:
                    return fresh, i + 1
        return (fresh, len(ends)) if done else None


def rule_edits(text: str, rules: Iterable[tuple[regex.Pattern, str]]) -> list[tuple[int, int, str]]:
    """Edits of all rules' matches, from left to right; of overlapping ones the first."""
    return apart((m.start(), m.end(), new) for p, new in rules for m in p.finditer(text) if m.end() > m.start())


def apart(edits: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits from left to right, without those that overlap one before them (insertions at one place all stay)."""
    out, at = [], 0
    for s, e, new in sorted(edits):
        if s >= at:
            out.append((s, e, new))
            at = e
    return out


def given_edits(text: str, edits) -> list[tuple[int, int, str]]:
    """Edits that come with a row, cut to the text."""
    inside = lambda x: min(max(x or 0, 0), len(text))
    return apart((inside(e["start"]), max(inside(e["start"]), inside(e["stop"])), e["replacement"] or "") for e in edits or [] if e)


def edited_counts(docs: DataFrame, tokenizer: str, rules: list[tuple[str, str]] | None = None, edits: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_reencoded, edited_sha256.

    Edits are the matches of ``rules`` (pattern, replacement), or come with the rows in
    the column ``edits`` (array of struct(start, stop, replacement)).
    """
    small_batches(docs.sparkSession)
    rules = rules or []

    def run(batches):
        enc = encoder(tokenizer)
        compiled = [(regex.compile(p), new) for p, new in rules]
        reach = max(32, *(len(s) + LOOKAHEAD for s in enc.v.added), 0)
        for batch in batches:
            col = text_column(batch)
            for i, texts in slices(col, 1 << 20):
                part = batch.slice(i, len(texts))
                given = like(part, edits).to_pylist() if edits else [None] * len(texts)
                rows = []
                split = list(map(enc.pieces, texts))
                enc.sizes.learn(set().union(*split))
                for text, own, tokens in zip(texts, given, split, strict=True):
                    tree = CountTree(text, enc.pieces, enc.sizes.__getitem__, tokens, reach)
                    n, pre = tree.total, sum(map(len, tree.leaves))
                    todo = given_edits(text, own) if edits else rule_edits(text, compiled)
                    for start, stop, new in sorted(todo, reverse=True):
                        tree.replace(start, stop, new)
                    rows.append((n, len(todo), tree.total, pre, tree.encoded, hashlib.sha256(tree.text().encode()).hexdigest()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([like(part, key), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5])], schema.names)

    longs = ("n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("edited_sha256", T.StringType())])
    return docs.select(key, "text", *([edits] if edits else [])).mapInArrow(run, schema)
