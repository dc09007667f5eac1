"""Byte-level BPE: a streaming encoder with bounded look-ahead, and an incremental decoder.

Sufficient look-ahead. Let x be a prefix of the input and d the leftmost place where the merges made in x
alone and in x followed by more text differ. d starts at the end of x and moves left only when a merge (u, v)
happens in one of the two with u ending at d, and then by the length of u. The next such merge has a later
rank, and its v begins with the u of the one before. So the longest chain, found in one pass over the merge
list, bounds how far from the end of a prefix tokens can still change: whatever ends before that is
emitted, and the buffer never holds more than two blocks and that bound, also in a run without a break.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array

import regex

#: Fixed values of the public vocabulary: its pre-tokenizer and its one added token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ADDED = "<|endoftext|>"

#: The same language for texts in these ranges, where the standard library's classes agree with it.
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_FAST = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧]")
_SLOW = regex.compile(PATTERN)
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
_KINDS = [regex.compile(k) for k in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
_SPACES = regex.compile(r"\s+")
_ODD_SPACE = re.compile(r" (?=\s|$)")

BLOCK_CHARS = 1 << 15
BLOCK_BYTES = 1 << 12


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens and merges of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda t: bytes(alphabet[c] for c in t)
        self.added = {a["content"]: a["id"] for a in whole["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in whole["model"]["vocab"].items() if t not in self.added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        self.merges = [(self.ids[to_bytes(a)], self.ids[to_bytes(b)], self.ids[to_bytes(a + b)]) for a, b in merges]
        self.rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(self.merges)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        left: dict[int, int] = {}  # the token whose merge made it: its left part
        best: dict[int, int] = {}  # the furthest move of d so far by a merge whose left part is this token
        furthest = 0
        for a, b, c in self.merges:
            reach, t = 0, b
            while t is not None:
                reach = max(reach, best.get(t, 0))
                t = left.get(t)
            reach += len(self.bytes_of[a])
            best[a] = max(best.get(a, 0), reach)
            furthest = max(furthest, reach)
            left.setdefault(c, a)
        return furthest

    def merge(self, piece: bytes) -> list[int]:
        """All merges in rank order, the leftmost first among equals."""
        tokens = [self.single[b] for b in piece]
        rank = self.rank
        if len(tokens) > 48:
            return self._merge_long(tokens)
        while len(tokens) > 1:
            least, at, made = 1 << 60, -1, -1
            for k in range(len(tokens) - 1):
                found = rank.get((tokens[k], tokens[k + 1]))
                if found is not None and found[0] < least:
                    least, at, made = found[0], k, found[1]
            if at < 0:
                break
            tokens[at : at + 2] = [made]
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        import heapq

        n = len(tokens)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.rank
        heap = [(f[0], k, tokens[k], tokens[k + 1], f[1]) for k in range(n - 1) if (f := rank.get((tokens[k], tokens[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k] if tokens[k] == a else -1
            if j < 0 or tokens[j] != b:
                continue
            tokens[k], tokens[j] = made, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] >= 0 and (f := rank.get((tokens[i], tokens[after[i]]))):
                    heapq.heappush(heap, (f[0], i, tokens[i], tokens[after[i]], f[1]))
        return [t for t in tokens if t >= 0]


def pre_tokens(text: str) -> list[str]:
    return (_FAST if text.isascii() or not _NOT_FAST.search(text) else _SLOW).findall(text)


def pieces_of(text: str, start: int, end: int, last: bool) -> tuple[list[str], int, bool]:
    """Runs of whole pre-tokens of ``text[start:end]`` that more text cannot change, where they end, and whether a run goes on.

    Unless the text ends here, the last two pieces wait: the rest may lengthen the last one, and a
    contraction or a run of spaces depends on at most what the next piece begins with.
    """
    window = text[start:end]
    if _ODD_SPACE.search(window):
        found = pre_tokens(window)
    else:  # every space is followed by a letter or sign, so a pre-token ends before each of them
        found = window.replace(" ", "\0 ").removeprefix("\0").split("\0") if "\0" not in window else pre_tokens(window)
    if last:
        return found, end, False
    if len(found) <= 2:
        return [], start, True
    waiting = found[-2:]
    return found[:-2], end - sum(map(len, waiting)), False


def run_end(text: str, start: int) -> int:
    """Where the pre-token that starts at ``start`` ends, found block by block."""
    if contraction := _CONTRACTION.match(text, start):
        return contraction.end()
    at = start + (text[start] == " " and start + 1 < len(text) and not _SPACES.match(text, start + 1))
    kind = next((k for k in _KINDS if k.match(text, at)), _SPACES)
    n = len(text)
    while at < n and (m := kind.match(text, at, min(n, at + BLOCK_CHARS))):
        at = m.end()
    # the last of several white-space characters belongs to what follows them
    return at - 1 if kind is _SPACES and at < n and at - start > 1 else at


class StreamingEncoder:
    """Ids of a text, block by block, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, merge=None, memo_limit: int = 250_000):
        self.vocabulary = vocabulary
        merge = merge or vocabulary.merge
        block = BLOCK_BYTES + vocabulary.lookahead

        class Memo(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = b""
                for raw in (p.encode("utf-8") for p in pre_tokens(piece)):
                    ids += b"".join(stream_merge([raw], vocabulary, merge, block)) if len(raw) > block else packed(merge(raw))
                if len(self) < memo_limit and len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.memo, self.merge, self.block = Memo(), merge, block

    def segments(self, text: str):
        """Parts between the added tokens' strings, and those tokens."""
        if not any(a in text for a in self.vocabulary.added):
            yield text, None
            return
        rest = 0
        for m in re.finditer("|".join(map(re.escape, self.vocabulary.added)), text):
            yield text[rest : m.start()], None
            yield None, self.vocabulary.added[m[0]]
            rest = m.end()
        yield text[rest:], None

    def encode(self, text: str):
        """Chunks of packed ids, each as soon as it is stable; a run without a break is read and merged in blocks too."""
        memo = self.memo
        for part, token in self.segments(text):
            if part is None:
                yield packed([token])
                continue
            start, n = 0, len(part)
            while start < n:
                end = min(n, start + BLOCK_CHARS)
                pieces, after, longer = pieces_of(part, start, end, end == n)
                if longer:
                    after = run_end(part, start)
                    yield from self._run(part, start, after)
                else:
                    yield b"".join(map(memo.__getitem__, pieces))
                start = after

    def _run(self, text: str, start: int, end: int):
        """The ids of one pre-token, ``text[start:end]``."""
        blocks = (text[at : min(end, at + BLOCK_CHARS)].encode("utf-8") for at in range(start, end, BLOCK_CHARS))
        yield from stream_merge(blocks, self.vocabulary, self.merge, self.block)


def packed(ids) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def stream_merge(blocks, vocabulary: Vocabulary, merge, block: int):
    """Merge a very long piece that comes in blocks of bytes: tokens further from a window's end than the look-ahead are emitted."""
    held = bytearray()
    for more in blocks:
        held += more
        at = 0
        while len(held) - at > block:
            stable, used = [], 0
            for i in merge(bytes(held[at : at + block])):
                size = len(vocabulary.bytes_of[i])
                if used + size > block - vocabulary.lookahead:
                    break
                used += size
                stable.append(i)
            yield packed(stable)
            at += used
        del held[:at]
    yield packed(merge(bytes(held)))


class StreamingDecoder:
    """Text of ids as they come; bytes that are not UTF-8 become U+FFFD, an unfinished character waits."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


def fast_merge(vocabulary: Vocabulary):
    """A compiled merge of one window where the vocabulary's ids follow the order of its merges; else its own."""
    made = [c for _, _, c in vocabulary.merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        return vocabulary.merge
    import tiktoken

    encoding = tiktoken.Encoding("windows", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
    return encoding._encode_single_piece
