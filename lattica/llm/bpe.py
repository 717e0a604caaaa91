"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, with_columns_last

#: Fixed value: the pre-tokenizer's pattern, with its white space as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Characters that count as letters or numbers for the regular-expression library in use here, but
#: not (yet) for the pre-tokenizer whose results are to match.
YOUNG = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3"
    r"\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191"
    r"\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    r"\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    r"\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)

#: Pieces, and different ones, of texts that are encoded together; of these a block steps at once. Pairs that a worker knows the
#: compatibility of, and places of the table of those of short pieces; the bytes of a piece that is encoded together with others instead of
#: by the automaton (62 at most: a bit for each place).
GROUP_PIECES = 1 << 21
GROUP_DISTINCT = 50_000
BLOCK = 1 << 14
CACHE_PAIRS = 200_000
PAIR_SLOTS = 1 << 19
SHORT = 32

NEVER = 1 << 60


def printable() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable Latin-1 stands for itself, the rest follows at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Exact byte-pair merges of a vocabulary file, in time linear in the text.

    A sequence of tokens is what merging gives if and only if each adjacent pair is compatible: no merge
    across the pair's border could come before the merges that formed its two sides. So the encoder
    takes the longest token at a position (found for all positions in one pass of an Aho-Corasick automaton
    over the reversed text; for short pieces by a walk down the tree of tokens where it is needed), falls back to shorter ones while the pair with the token before is not
    compatible, and steps back where none is left; a position it stepped back from never ends a token again.
    Each different piece of a group of texts is encoded once; short ones take these steps side by side, as arrays.
    """

    def __init__(self, spec: dict):
        byte = printable()
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        content |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = [content.get(i, b"") for i in range(max(content) + 1)]
        self.offsets = np.zeros(len(self.pieces) + 1, np.int64)
        np.cumsum([len(p) for p in self.pieces], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.pieces), np.uint8)

        rank, parts, born = self.merges = {}, {}, {}
        for k, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            rank[a, b] = k
            parts.setdefault(c, (a, b))
            born.setdefault(c, k)
        self.table: dict[tuple[int, int], bool] = {}
        sound: set[int] = {i for i in vocab.values() if i not in parts}
        for c, (a, b) in parts.items():
            if a in sound and b in sound and not self._crossed(a, b, born[c]):
                sound.add(c)
        by_bytes = {self.pieces[i]: i for i in sound}
        self.whole = by_bytes
        self.shorter = {i: next((by_bytes[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in by_bytes), None) for p, i in by_bytes.items()}
        self._arrays(by_bytes)
        ordered = all(born.get(t, -1) < k for pair, k in rank.items() for t in pair)
        self.short = SHORT if ordered and all(bytes([b]) in by_bytes for b in range(256)) else 0
        del self.merges  # made again if a long piece comes
        self.pattern = regex.compile(PATTERN)
        self.young = regex.compile(f"[{YOUNG}]")
        old = {kind: rf"[\p{{{kind}}}--[{YOUNG}]]" for kind in "LN"}
        self.strict = regex.compile(
            PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", "[^" + r"\p{White_Space}" + old["L"] + old["N"] + "]").replace(r" ?\p{L}+", f" ?{old['L']}+").replace(r" ?\p{N}+", f" ?{old['N']}+"),
            regex.V1,
        )
        self.plain = plane_pattern()
        self.fence = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def merges(self) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]], dict[int, int]]:
        """The merges by their pairs, the parts of each token and the merge that makes it: only long pieces need them so."""
        made = np.flatnonzero(self.birth >= 0)
        rank = dict(zip(zip((self.pairs >> 32).tolist(), (self.pairs & 0xFFFFFFFF).tolist(), strict=True), self.ranks.tolist(), strict=True))
        parts = zip(self.left[made].tolist(), self.right[made].tolist(), strict=True)
        return rank, dict(zip(made.tolist(), parts, strict=True)), dict(zip(made.tolist(), self.birth[made].tolist(), strict=True))

    @cached_property
    def automaton(self):
        """Finds the tokens in reversed texts: for long pieces."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for p, i in self.whole.items():
            out.add_word(p[::-1].decode("latin-1"), i)
        out.make_automaton()
        return out

    def _arrays(self, by_bytes: dict[bytes, int]) -> None:
        """What short pieces need: the tree of tokens, tokens' sizes, next shorter ones and parts, and the merges by their pairs."""
        hops: dict[int, int] = {}
        best = [-1]
        for p in sorted((p for p in by_bytes if 0 < len(p) <= SHORT), key=len):
            node = 0
            for b in p:
                if (down := hops.get(node << 9 | b)) is None:
                    down = hops[node << 9 | b] = len(best)
                    best.append(best[node])
                node = down
            best[node] = by_bytes[p]
        self.best = np.array(best, np.int32)
        self.hops = np.array(sorted(hops), np.int32)
        self.down = np.array([hops[k] for k in self.hops.tolist()], np.int32)
        self.two = np.zeros((257, 257), np.int32)
        self.on = np.zeros((257, 257), bool)
        for b in range(256):
            self.two[b] = first = hops.get(b, 0)
            for c in range(256):
                if first and (node := hops.get(first << 9 | c)) is not None:
                    self.two[b, c], self.on[b, c] = node, True
        self.two, self.on = self.two.ravel(), self.on.ravel()

        n = len(self.pieces)
        self.size = np.array([len(p) for p in self.pieces], np.int32)
        self.less, self.birth, self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for token, less in self.shorter.items():
            self.less[token] = -1 if less is None else less
        rank, parts, born = self.merges
        for token, (a, b) in parts.items():
            self.left[token], self.right[token], self.birth[token] = a, b, born[token]
        pairs = sorted((a << 32 | b, k) for (a, b), k in rank.items())
        self.pairs, self.ranks = np.array([p for p, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_slot(self.pairs >> 32, self.pairs & 0xFFFFFFFF)] = True
        self.known = np.full(PAIR_SLOTS, -1, np.int64)

    def _edge(self, token: int, side: int, last: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge of ``token`` while it forms, each with the merge that ends it."""
        _, parts, born = self.merges
        out = [(token, last)]
        while token in parts:
            out.append((parts[token][side], born[token]))
            token = out[-1][0]
        return out

    def _crossed(self, a: int, b: int, last: int = NEVER) -> bool:
        """Whether a merge across the border of a and b comes before ``last`` and the merges that form them.

        Of equal merges the left one is first, so one inside ``a`` wins a tie and one inside ``b`` loses it.
        """
        rank, right = self.merges[0], self._edge(b, 0, last)
        for x, x_ends in self._edge(a, 1, last):
            for y, y_ends in right:
                k = rank.get((x, y))
                if k is not None and k < x_ends and k <= y_ends and k < last:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        known = self.table.get((a, b))
        if known is None:
            if len(self.table) >= CACHE_PAIRS:
                self.table.clear()
            known = self.table[a, b] = not self._crossed(a, b)
        return known

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if (one := self.whole.get(piece)) is not None:
            return [one]
        n = len(piece)
        if n <= self.short:
            return self._together([piece])[0].tolist()
        longest = [0] * n
        width = [0] * n
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if (size := len(self.pieces[token])) > width[at]:
                width[at], longest[at] = size, token
        out, at, dead, token = [], 0, set(), longest[0]
        while at < n:
            while token is not None:
                end = at + len(self.pieces[token])
                if end not in dead and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead.add(at)
                last = out.pop()
                at -= len(self.pieces[last])
                token = self.shorter[last]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
        return out

    def _longest(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest token at each position of a text whose pieces end with 256."""
        both = text[at] * 257 + text[at + 1]
        node, live, step = self.two[both], np.flatnonzero(self.on[both]), 2
        while len(live):
            key = node[live] << 9 | text[at[live] + step]
            k = np.minimum(np.searchsorted(self.hops, key), len(self.hops) - 1)
            found = self.hops[k] == key
            live = live[found]
            node[live] = self.down[k[found]]
            step += 1
        return self.best[node]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for each pair of two arrays, known from a table in which a pair takes the place of another."""
        pair, slot = a.astype(np.int64) << 31 | b, _slot(a, b) & (PAIR_SLOTS - 1)
        held = self.known[slot]
        out, new = held & 1 == 1, np.flatnonzero(held >> 1 != pair)
        if len(new):
            out[new] = self._uncrossed(a[new], b[new])
            self.known[slot[new]] = pair[new] << 1 | out[new]
        return out

    def _uncrossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for pairs not known: their merges are undone from the last one back, and at each time the pair then at the border is looked up."""
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), NEVER)
        while len(live):
            some = np.flatnonzero(self.maybe[_slot(a, b)])
            key = a[some].astype(np.int64) << 32 | b[some]
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            crossed = some[(self.pairs[k] == key) & (self.ranks[k] < limit[some])]
            out[live[crossed]] = False
            x, y = self.birth[a], self.birth[b]
            on = np.maximum(x, y) >= 0
            on[crossed] = False
            undo = x > y
            limit = np.where(undo, x, y.astype(np.int64) + 1)[on]
            a, b, live = np.where(undo, self.right[a], a)[on], np.where(undo, b, self.left[b])[on], live[on]
        return out

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of short pieces, end to end, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int32)
        ends = np.cumsum(sizes + 1, dtype=np.int32) - 1
        starts = ends - sizes
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int32)
        text[ends] = 256
        out = np.zeros((len(pieces), sizes.max(initial=1)), np.int32)
        count, at, dead = np.zeros(len(pieces), np.int32), starts.copy(), np.zeros(len(pieces), np.int64)
        live, token = np.arange(len(pieces)), self._longest(text, starts)
        while len(live):
            now = token[live]
            some = now >= 0
            end = at[live] + self.size[now]
            fits = some & (dead[live] >> (end - starts[live]) & 1 == 0)
            later = np.flatnonzero(fits & (count[live] > 0))
            fits[later] = self._compatible(out[live[later], count[live[later]] - 1], now[later])
            taken, refused, back = live[fits], live[some & ~fits], live[~some]
            out[taken, count[taken]] = now[fits]
            count[taken] += 1
            at[taken] = end[fits]
            taken = taken[at[taken] < ends[taken]]
            token[taken] = self._longest(text, at[taken])
            token[refused] = self.less[token[refused]]
            dead[back] |= np.int64(1) << (at[back] - starts[back])
            count[back] -= 1
            last = out[back, count[back]]
            at[back] -= self.size[last]
            token[back] = self.less[last]
            live = np.concatenate([taken, refused, back])
        return out[np.arange(out.shape[1]) < count[:, None]], count

    def _table(self, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of numbered pieces, where each piece's begin, and how many it has."""
        raw = list(map(str.encode, number))
        own = {number[t]: [i] for t, i in self.special.items() if t in number}
        short = np.fromiter(map(len, raw), np.int64, len(raw)) <= self.short
        short[list(own)] = False
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        n, counts, found = int(short.sum()), np.zeros(len(raw), np.int64), [np.zeros(0, np.int32)]
        for k in range(0, n, BLOCK):
            some = order[k : min(k + BLOCK, n)]
            ids, counts[some] = self._together([raw[i] for i in some.tolist()])
            found.append(ids)
        for k in order[n:].tolist():
            found.append(np.array(own[k] if k in own else self.merged(raw[k]), np.int32))
            counts[k] = len(found[-1])
        starts = np.zeros(len(raw), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found), starts, counts

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a whole text, special tokens included, a bounded number at once."""
        if np.frombuffer(text.encode(), np.uint8).max(initial=0) < 0xF0:  # no character of four bytes
            pattern = self.plain
        else:
            pattern = self.strict if self.young.search(text) else self.pattern
        for i, part in enumerate(self.fence.split(text) if any(t in text for t in self.special) else [text]):
            if i % 2:
                yield [part]
            elif len(part) <= 1 << 18:
                yield pattern.findall(part)
            else:
                found = (m.group() for m in pattern.finditer(part))
                while some := list(islice(found, 1 << 16)):
                    yield some

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of whole texts, one after another, as little-endian unsigned 32-bit integers."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        held, parts, n = [], [], 0

        def settled():
            ids, starts, counts = self._table(number)
            for some in held:
                if some is None:
                    yield b"".join(parts)
                    parts.clear()
                else:
                    parts.append(ids[_laid(starts[some], counts[some])].astype("<u4").tobytes())
            held.clear()
            number.clear()

        for text in texts:
            for some in self._pieces(text):
                held.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
                n += len(some)
                if n >= GROUP_PIECES or len(number) >= GROUP_DISTINCT:
                    yield from settled()
                    n = 0
            held.append(None)
        yield from settled()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a sequence of ids: each id's stretch of the table, laid end to end."""
        parts = []
        each = np.frombuffer(ids, "<u4").astype(np.int64)
        for k in range(0, len(each), 1 << 20):
            some = each[k : k + (1 << 20)]
            parts.append(self.blob[_laid(self.offsets[some], self.offsets[some + 1] - self.offsets[some])].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=1)
def plane_pattern() -> re.Pattern:
    """PATTERN for texts of the basic plane, its classes written out (YOUNG left out of them), for the faster standard library."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        found = [(m.start(), m.end() - 1) for m in regex.compile(kind, regex.V1).finditer(plane)]
        return "".join(rf"\u{ord(plane[a]):04x}-\u{ord(plane[b]):04x}" for a, b in found)

    letters, numbers, blanks = (ranges(rf"[{kind}--[{YOUNG}]]+") for kind in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


def _laid(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches laid end to end."""
    moved = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return moved + np.arange(len(moved))


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A place of 2^20 for each pair of tokens."""
    return (a * 40503 + b * 9973) & 0xFFFFF


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(json.loads(spec))


def encoded(docs: DataFrame, tokenizer_json: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` without their text, and n_tokens, token_ids (binary, little-endian 32-bit), ids_sha256 and
    decoded_sha256 (of what the ids decode to, in UTF-8).

    A null text counts as an empty one: no tokens. Repeated rows and null ids are rows like any other; a text of any length is encoded whole, in
    linear time; columns of the results' names are replaced, all others pass; an empty table gives an empty table. Special tokens in a text are recognised as such. The file's
    content (a few MB, fixed) is broadcast, so executors need no access to ``tokenizer_json``.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    names = ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"] if keep_ids else ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = with_columns_last(docs.drop(text), names)
    columns = [f"c{i}" for i in range(len(kept.columns))]
    source = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept.columns, columns, strict=True)], F.col(text).alias("_text"))
    types = {"n_tokens": "long", "token_ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = kept.toDF(*columns).schema
    for n in names:
        schema = schema.add(n, types[n])

    def run(batches):
        enc = encoder(spec.value)
        for batch in batches:
            rows, held, start = [], 0, 0
            for i, ids in enumerate(enc.encode_all(t.as_py() or "" for t in batch.column("_text"))):
                again = enc.decode(ids).decode("utf-8", "replace").encode()
                rows.append((len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(again).hexdigest()))
                held += len(ids) if keep_ids else 0
                if held > 2 << 20 or i == batch.num_rows - 1:
                    cols = list(zip(*rows, strict=True))
                    new = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())]
                    part = batch.slice(start, i + 1 - start)
                    old = [part.column(c) for c in columns]
                    yield pa.RecordBatch.from_arrays(old + (new if keep_ids else [new[0], *new[2:]]), names=[*columns, *names])
                    rows, held, start = [], 0, i + 1

    return mapped(source, run, schema).toDF(*kept.columns, *names)
