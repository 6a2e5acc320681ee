"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words (pre-tokens) of a batch go into a byte trie.  A depth-first
walk gives every node one state: the last token of the encoding of the path to
it.  The encoding of a prefix ends in the only token t for which the encoding of
the prefix without t ends in a token that t may follow, so a node's state comes
from its ancestors' states alone and shared prefixes are worked out once.

Defined results: null text encodes as empty text; the added token's own string
inside a text gets the added token's id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept_in_worker, like, small_batches, text_column

#: The public pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words in a worker's store; beyond it a new one is begun, and words used again move over (results don't change).
KEPT_WORDS = 150_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: a byte that prints stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Suffixes:
    """Which tokens a byte string ends in: an automaton over the tokens' prefixes.

    A state is the longest suffix of the bytes so far that begins some token;
    ``ends[state]`` are the tokens (length, id) that are suffixes of it, longest first.
    """

    def __init__(self, ids: dict[bytes, int]):
        self.children: dict[int, int] = {}
        self.fallback, self.ends, self.moves = [0], [()], {}
        own: dict[int, tuple[int, int]] = {}
        levels: list[list[tuple[int, int, int]]] = []  # by depth: state, its parent and last byte
        for token, i in ids.items():
            state = 0
            for depth, byte in enumerate(token):
                to = self.children.get(state << 8 | byte)
                if to is None:
                    to = self.children[state << 8 | byte] = len(self.fallback)
                    self.fallback.append(0)
                    self.ends.append(())
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((to, state, byte))
                state = to
            own[state] = len(token), i
        for depth, level in enumerate(levels):
            for state, parent, byte in level:
                shorter = self.fallback[state] = self._next(self.fallback[parent], byte) if depth else 0
                self.ends[state] = (own[state], *self.ends[shorter]) if state in own else self.ends[shorter]

    def _next(self, state: int, byte: int) -> int:
        to = self.children.get(state << 8 | byte)
        while to is None and state:
            state = self.fallback[state]
            to = self.children.get(state << 8 | byte)
        return to or 0

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; ``moves`` keeps what was asked for."""
        if len(self.moves) > 300_000:
            self.moves.clear()
        to = self.moves[state << 8 | byte] = self._next(state, byte)
        return to


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_alphabet()
        to_bytes = lambda s: bytes(as_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.suffixes = Suffixes(self.ids)
        # order[i]: when token i is made (0 for single bytes); halves[i]: what it is made of
        self.order: dict[int, int] = dict.fromkeys(self.ids.values(), 0)
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(spec["model"]["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = n
            if made not in self.halves:
                self.halves[made], self.order[made] = (left, right), n
        self.follows: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Does the text of a and then b encode as these two tokens?

        Take both apart from their last merge back.  Each step shows the two
        pieces that met at the border at that time; had they a merge that comes
        before the next merge of either side, it would have been made.
        """
        known = self.follows.get((a, b))
        if known is not None:
            return known
        x, y, done = a, b, 1 << 60
        good = True
        while True:
            n = self.rank.get((x, y))
            if n is not None and n < done:
                good = False
                break
            ox, oy = self.order[x], self.order[y]
            if not ox and not oy:
                break
            # the later made of both is undone; at the border its inner half remains.
            # Merges of one rank are made from left to right: at the border before the right side's.
            if oy >= ox:
                done, y = oy + 0.5, self.halves[y][0]
            else:
                done, x = ox, self.halves[x][1]
        if len(self.follows) > 300_000:
            self.follows.clear()
        self.follows[a, b] = good
        return good


class Sizes(dict):
    """Tokens of each pre-token, worked out when it is learnt or asked for; keeps KEPT_WORDS or so, as the encoder does."""

    def __init__(self, encoder: TrieEncoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Have all of these pre-tokens at hand."""
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        older, added, new = self.older, self.encoder.v.added, []
        for piece in pieces:
            if piece not in self:
                if piece in older:
                    self[piece] = older[piece]
                elif piece in added:
                    self[piece] = 1
                else:
                    new.append(piece)
        for word, at, _, begins in self.encoder.walked(new):
            n = 0
            while at:
                n += 1
                at = begins[at]
            self[word] = n

    def __missing__(self, piece: str) -> int:
        self.learn((piece,))
        return self[piece]


class TrieEncoder:
    """Encodes words; keeps what it has found up to KEPT_WORDS words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.sizes = Sizes(self)
        self.split = regex.compile(PRETOKEN).findall
        self.added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.v.added, key=len, reverse=True)) + ")") if self.v.added else None

    def learn(self, words: set[str]) -> None:
        """Keep each word's ids (packed as uint32)."""
        for word, at, last, begins in self.walked(words):
            out = []
            while at:
                out.append(last[at])
                at = begins[at]
            out.reverse()
            self.known[word] = struct.pack(f"<{len(out)}I", *out)

    def walked(self, words: Iterable[str]) -> Iterator[tuple[str, int, list[int], list[int]]]:
        """Walk the trie of the words depth-first: each word, its length in bytes, and the last token and its place for all places.

        The two lists are the walk's own and change when it goes on.  The trie is held as the sorted list of its words: in that order a word
        leaves the path of the word before it where their common prefix ends, so
        ``last`` always has the states on the path from the root.
        """
        v, follow, follows = self.v, self.v.may_follow, self.v.follows
        moves, ends = v.suffixes.moves, v.suffixes.ends
        # of the path's first d bytes: last token of their encoding, where it begins, and what suffix they end in
        last, begins, states, before = [-1], [0], [0], b""
        for path, word in sorted((w.encode("utf-8"), w) for w in words):
            size, shared = len(path), min(len(before), len(path))
            if shared > 32 and before[:shared] != path[:shared]:  # halving: long words without a common beginning
                least = 0
                while shared - least > 1:
                    middle = (least + shared) // 2
                    if before[:middle] == path[:middle]:
                        least = middle
                    else:
                        shared = middle
                shared = least
            while before[:shared] != path[:shared]:
                shared -= 1
            del last[shared + 1 :], begins[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for here in range(shared + 1, size + 1):
                to = moves.get(state << 8 | path[here - 1])
                state = v.suffixes.step(state, path[here - 1]) if to is None else to
                states.append(state)
                for length, token in ends[state]:
                    start = here - length
                    if start:
                        good = follows.get((last[start], token))
                        if good is None:
                            good = follow(last[start], token)
                        if not good:
                            continue
                    last.append(token)
                    begins.append(start)
                    break
                else:
                    raise ValueError(f"the vocabulary has no encoding for {path[:here]!r}")
            yield word, size, last, begins
            before = path

    def store(self, words: set[str]) -> None:
        """Encode the words that aren't known; changes the set."""
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        known = self.known
        words.difference_update(known)
        for word in words.intersection(self.older):
            known[word] = self.older[word]
        words.difference_update(known)
        if words:
            self.learn(words)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, packed as little-endian uint32."""
        parts = []
        for text in texts:
            pieces = self.added.split(text) if self.added is not None and any(s in text for s in self.v.added) else [text]
            parts.append([(self.v.added[p] if i % 2 else self.split(p)) for i, p in enumerate(pieces)])
        self.store({w for pieces in parts for p in pieces if not isinstance(p, int) for w in p})
        known = self.known
        for pieces in parts:
            yield b"".join(np.uint32(p).astype("<u4").tobytes() if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in pieces)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of the text, the added tokens' strings among them."""
        if self.added is None or not any(s in text for s in self.v.added):
            return self.split(text)
        return [t for i, p in enumerate(self.added.split(text)) for t in ([p] if i % 2 else self.split(p))]

    def size(self, piece: str) -> int:
        """The number of tokens of a pre-token."""
        ids = self.known.get(piece)
        if ids is None:
            if piece in self.v.added:
                return 1
            if len(self.known) > KEPT_WORDS:
                self.older, self.known = self.known, {}
            ids = self.older.get(piece)
            if ids is None:
                self.learn({piece})
                return len(self.known[piece]) // 4
            self.known[piece] = ids
        return len(ids) // 4

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> TrieEncoder:
    """The process's encoder of that vocabulary, kept until another operator runs there."""
    encoders = kept_in_worker("encoders", dict)
    if path not in encoders:
        encoders[path] = TrieEncoder(Vocabulary(path))
    return encoders[path]


def slices(col: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about ``limit`` bytes of text."""
    from .common import utf8_bytes

    off, i = utf8_bytes(col)[1], 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, col.slice(i, j - i).to_pylist()
        i = j


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Each row's ``key`` (and ``keep`` columns) with ids (binary, uint32 little-endian), n_tokens and decoded text.

    ``tokenizer`` is a path that every executor can open.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (keep or []) if c != key]
    fields = docs.select(key, *keep).schema

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            col = text_column(batch)
            for i, texts in slices(col):
                packed = list(enc.encode(texts))
                part = batch.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(like(part, f.name) for f in fields), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(enc.decode, packed), pa.string())],
                    [*fields.names, "bpe_ids", "n_tokens", "decoded"],
                )

    from pyspark.sql import types as T

    schema = T.StructType([*fields.fields, T.StructField("bpe_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return docs.select(key, *keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
