"""A unigram reading of a SentencePiece vocabulary, with exact arithmetic.

Scores are fixed-point integers, so sums do not depend on the order in which parts are added and max-plus products are
associative exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np

SPACE = "▁"
ONE = 1 << 20
#: Minus infinity of the max-plus semiring; sums of two stay far from overflow.
NEVER = -(1 << 61)
UNKNOWN_PENALTY = 10.0
WORD_CACHE = 300_000
#: Words longer than this are not remembered.
LONG_WORD = 64
#: Words whose trie is built at a time.
TOGETHER = 16_384


class Unigram:
    """Pieces and scores. No piece reaches over the edge of a word (split_words), so words are encoded on their own."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        n = len(sp)
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = sorted((i for i in range(n) if not special[i] and i not in self.value), key=lambda i: (-sp.get_score(i), i))
        # Zipf-Mandelbrot: probability in proportion to 1 / (rank + 2.7); the file has ranks of merges, not probabilities.
        norm = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
        self.score = {i: round(-(math.log(r + 2.7) + norm) * ONE) for r, i in enumerate(plain)}
        self.id = {self.piece[i]: i for i in plain}
        self.by_text = {p: self.score[i] for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.unknown = min(self.score.values()) - round(UNKNOWN_PENALTY * ONE)
        if not all(map(is_word, self.id)):
            raise ValueError("a piece reaches over the edge of a word: words are not independent")
        #: ids of ASCII characters as bytes; -2 for all others.
        self.ascii = np.array([*(self.byte[b] for b in range(0x80)), -2])
        self.is_byte = np.array([i in self.value for i in range(n)])
        self.words: dict[str, tuple[int, bytes]] = {}

    @cached_property
    def trie(self) -> dict:
        """Nested by character; (score, id) of a piece stands under the empty string."""
        root: dict = {}
        for p, i in self.id.items():
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (self.score[i], i)
        return root

    @cached_property
    def tables(self) -> list[PieceTable]:
        texts = sorted(self.id)
        return [PieceTable(texts, [self.score[self.id[t]] for t in texts], [self.id[t] for t in texts], seed) for seed in (0, 1)]

    def paths(self, text: str, starts: dict[int, int], last: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Best scores of reaching each position up to last, and (start, id) of the last piece (-1: none, -2: unknown character).

        Pieces begin before last and may end past it where text goes on; of equal scores the longest last piece stays.
        """
        end = min(len(text), last + self.longest - 1)
        best, back = [NEVER] * (end + 1), [(-1, -1)] * (end + 1)
        for at, value in starts.items():
            best[at] = value
        trie, unknown = self.trie, self.unknown
        for i in range(last):
            here = best[i]
            if here <= NEVER:
                continue
            node, single = trie, False
            for j in range(i, end):
                node = node.get(text[j])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    single |= j == i
                    total = here + found[0]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1] = total, (i, found[1])
            if not single and i < end and here + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + unknown, (i, -2)
        return best, back

    def ids_back(self, text: str, back: list[tuple[int, int]], start: int, end: int) -> list[int]:
        out: list[int] = []
        while end > start:
            i, piece = back[end]
            if piece == -2:
                out += [self.byte[b] for b in reversed(text[i].encode("utf-8", "replace"))]
            else:
                out.append(piece)
            end = i
        return out[::-1]

    def learn(self, words: set[str]) -> None:
        """Scores and ids of words that are not known yet, the shorter ones together over the trie of their prefixes."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > WORD_CACHE:
            self.words.clear()
            new = list(words)
        short = sorted(w for w in new if len(w) <= LONG_WORD)
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            forward = PrefixTrie(self, part)
            raw, edges = forward.ids()
            for w, score, a, b, odd in zip(part, forward.scores().tolist(), edges[:-1], edges[1:], forward.odd().tolist(), strict=True):
                self.words[w] = self.alone(w) if odd else (score, raw[4 * a : 4 * b])
        for w in new:
            if len(w) > LONG_WORD:
                self.words[w] = self.alone(w)

    def alone(self, w: str) -> tuple[int, bytes]:
        best, back = self.paths(w, {0: 0}, len(w))
        return best[len(w)], np.array(self.ids_back(w, back, 0, len(w)), "<u4").tobytes()

    def count(self, w: str) -> int:
        """Number of ids of a word of any length: of scores and numbers only those of the last places are kept."""
        longest, score, unknown = self.longest, self.by_text.get, self.unknown
        # Places are kept in a ring; of equal scores the longest last piece stays.
        best, number = [NEVER] * longest, [0] * longest
        best[0] = 0
        for end in range(1, len(w) + 1):
            top, n = NEVER, 0
            for k in range(min(longest, end), 0, -1):
                piece = score(w[end - k : end])
                if piece is not None and best[(end - k) % longest] + piece > top:
                    top, n = best[(end - k) % longest] + piece, number[(end - k) % longest] + 1
            if w[end - 1] not in self.by_text and best[(end - 1) % longest] + unknown > top:
                top, n = best[(end - 1) % longest] + unknown, number[(end - 1) % longest] + len(w[end - 1].encode("utf-8", "replace"))
            best[end % longest], number[end % longest] = top, n
        return number[len(w) % longest]

    def encode(self, text: str) -> tuple[int, bytes]:
        """Score and ids (little-endian unsigned 32-bit) of a text in which spaces are space marks already."""
        words = split_words(text)
        self.learn(set(words))
        return self.joined(words)

    def joined(self, words: list[str]) -> tuple[int, bytes]:
        """Of learned words."""
        found = [self.words[w] for w in words]
        return sum([s for s, _ in found]), b"".join([i for _, i in found])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [split_words(t) for t in texts]
        self.learn(set().union(*split))
        known = self.words
        return [b"".join([known[w][1] for w in words]) for words in split]

    def decode(self, ids: np.ndarray, first: bool) -> str:
        """Text of ids; the mark that encoding put before the text goes if first."""
        if not self.is_byte[ids].any():
            text = "".join(map(self.piece.__getitem__, ids.tolist()))
        else:
            out, raw = [], bytearray()
            for i in ids.tolist():
                if i in self.value:
                    raw.append(self.value[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.piece[i])
            text = "".join(out) + raw.decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if first and text.startswith(" ") else text


class PieceTable:
    """Finds pieces by a 64-bit polynomial hash; two tables with different multipliers confirm each other."""

    def __init__(self, texts: list[str], scores: list[int], ids: list[int], seed: int):
        draw = np.random.default_rng(100 + seed)
        self.base, self.mix = (draw.integers(0, 2**63, 2, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(LONG_WORD, self.base)], dtype=np.uint64)
        h = np.array([self.hash(t) for t in texts], np.uint64)
        order = np.argsort(h)
        self.hashes, self.scores, self.ids = h[order], np.array(scores, np.int64)[order], np.array(ids, np.int64)[order]
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        self.bits = np.zeros(1 << 21, bool)
        self.bits[(self.hashes * self.mix) >> np.uint64(43)] = True

    def hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.base) + ord(c) + 1) & (2**64 - 1)
        return h

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Where a piece with this hash may be."""
        return np.flatnonzero(self.bits[(h * self.mix) >> np.uint64(43)])

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


class PrefixTrie:
    """Forward scores over the trie of sorted distinct words, level by level: each shared prefix is computed once.

    A node's best score follows from the nodes above it, and so does its number of pieces; of equal scores the longest
    last piece stays.
    """

    def __init__(self, model: Unigram, words: list[str]):
        self.size = np.array([len(w) for w in words])
        depth, n = int(self.size.max(initial=0)), len(words)
        chars = np.zeros((n, depth), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
        chars[np.arange(depth)[None, :] < self.size[:, None]] = flat
        one, two = model.tables
        hash1, hash2 = np.zeros((depth + 1, n), np.uint64), np.zeros((depth + 1, n), np.uint64)
        same = np.ones(n, bool)
        same[:1] = False
        #: By depth: the node of each word (of those above its end), counted over all depths.
        self.node = np.zeros((depth + 1, n), np.int64)
        best, count, length, piece, made = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)], 1
        for d in range(1, depth + 1):
            c = chars[:, d - 1]
            hash1[d] = hash1[d - 1] * one.base + c
            hash2[d] = hash2[d - 1] * two.base + c
            same[1:] &= c[1:] == c[:-1]
            rows = np.flatnonzero((self.size >= d) & ~same)
            self.node[d] = made - 1 + np.cumsum((self.size >= d) & ~same)
            top, pieces = np.full(len(rows), NEVER, np.int64), np.zeros(len(rows), np.int64)
            last, which = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
            flat_best, flat_count = np.concatenate(best), np.concatenate(count)
            for k in range(min(d, model.longest), 0, -1):
                h = hash1[d, rows] - hash1[d - k, rows] * one.power[k]
                maybe = one.maybe(h)
                at, hit = one.place(h[maybe])
                maybe, at = maybe[hit], at[hit]
                r = rows[maybe]
                sure = two.place(hash2[d, r] - hash2[d - k, r] * two.power[k])[1]
                maybe, at, r = maybe[sure], at[sure], r[sure]
                above = self.node[d - k, r]
                total = flat_best[above] + one.scores[at]
                better = total > top[maybe]
                maybe, at, above = maybe[better], at[better], above[better]
                top[maybe], pieces[maybe], last[maybe], which[maybe] = total[better], flat_count[above] + 1, k, one.ids[at]
                if k == 1:
                    lone = np.ones(len(rows), bool)
                    lone[one.maybe(h)[hit][sure]] = False
                    lone = np.flatnonzero(lone)
                    above = self.node[d - 1, rows[lone]]
                    total = flat_best[above] + model.unknown
                    better = total > top[lone]
                    lone, above = lone[better], above[better]
                    code = c[rows[lone]].astype(np.int64) - 1
                    # An unknown character stands for the bytes of its UTF-8 form.
                    top[lone], pieces[lone], last[lone], which[lone] = total[better], flat_count[above] + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1, model.ascii[np.minimum(code, 0x80)]
            best.append(top)
            count.append(pieces)
            length.append(last)
            piece.append(which)
            made += len(rows)
        self.best, self.count, self.length, self.piece = (np.concatenate(x) for x in (best, count, length, piece))
        self.ends = self.node[self.size, np.arange(n)] if n else np.zeros(0, np.int64)

    def scores(self) -> np.ndarray:
        return self.best[self.ends]

    def counts(self) -> np.ndarray:
        return self.count[self.ends]

    def steps(self):
        """(words, piece ids) from the last pieces to the first."""
        at, word = self.size.copy(), np.arange(len(self.size))
        while len(word):
            node = self.node[at[word], word]
            yield word, self.piece[node]
            at[word] -= self.length[node]
            word = word[at[word] > 0]

    def odd(self) -> np.ndarray:
        """Words with an unknown character of several bytes on their best path."""
        out = np.zeros(len(self.size), bool)
        for word, piece in self.steps():
            out[word[piece == -2]] = True
        return out

    def ids(self) -> tuple[bytes, list[int]]:
        """ids of all words together, and where each word's begin and end; what odd() names is not to be used."""
        found = list(self.steps())
        if not found:
            return b"", [0]
        word, piece = np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])
        order = np.lexsort((-np.arange(len(word)), word))
        return np.maximum(piece[order], 0).astype("<u4").tobytes(), np.r_[0, np.cumsum(np.bincount(word, minlength=len(self.size)))].tolist()


#: A word: leading space marks, then letters and digits, or other characters (in the vocabulary a superscript two goes with those).
_WORD = re.compile(rf"{SPACE}*(?:[^\W_²]+|(?:[^\w{SPACE}]|[_²])+)|{SPACE}+")


def iter_words(text: str) -> Iterator[str]:
    """split_words(), one after the other."""
    return (m[0] for m in _WORD.finditer(text))


def split_words(text: str) -> list[str]:
    """Cut before space marks that follow another character, and between letters or digits and other characters: no piece
    crosses such a place."""
    return _WORD.findall(text)


def is_word(piece: str) -> bool:
    return _WORD.fullmatch(piece) is not None
