"""Byte-pair encoding and decoding over a contiguous rank array.

A word is held as a list of part ids and, beside it, one array with the merge
rank of each adjacent pair.  The leftmost minimum of that array names the next
merge; the merge deletes a boundary and refreshes the two neighbouring ranks.
Scanning is quadratic, so words of more than LONG parts take the same merges
from a heap instead.

Text is prepared as the vocabulary file states: special tokens are cut out
first, then NFC, white space runs to one space, lower case character by
character, the file's pattern, and bytes mapped to printable characters.  What
is a letter and what its lower case is depends on the version of Unicode; for
code points that our tables and the tokenizers library's may disagree on, the
library is asked once, when the file is loaded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

from pyspark.sql import DataFrame

from .common import arrow_map

#: Parts of a word up to which the rank array is scanned.
LONG = 128
#: Words whose ids a task remembers.
CACHE = 300_000
NONE = 1 << 30
#: Decoded ids joined at once, so that very long texts need no second copy.
CHUNK = 1 << 16


def load(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs; it has the size of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
    others, lower = newer(path)
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"] or "",
        "pattern": split["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "others": others,
        "lower": lower,
    }


def newer(path: str) -> tuple[list[int], dict[int, str]]:
    """Of the letters and numbers that are younger than unicodedata: those that are neither to the library, and what it lowers."""
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    word = regex.compile(r"[\p{L}\p{N}]")
    pieces = lambda text: len(library.pre_tokenizer.pre_tokenize_str(text))
    others, lower = [], {}
    for c in map(chr, range(0x110000)):
        if unicodedata.category(c) != "Cn" or not word.match(c):
            continue
        if (low := library.normalizer.normalize_str(c)) != c.lower():
            lower[ord(c)] = low
        # a letter goes on with a letter, a number stands alone, and other characters go on with each other only
        if pieces(f"a{low}") == 2 and pieces(low * 2) == 1:
            others.append(ord(c))
    return others, lower


def ranges(codes: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def byte_letters() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """encode(text) -> ids and decode(ids) -> text for one vocabulary."""

    def __init__(self, spec: dict):
        import regex

        vocab, self.suffix = spec["vocab"], spec["suffix"]
        letters = byte_letters()
        self.inner = [vocab.get(c, -1) for c in letters]
        self.final = [vocab.get(c + self.suffix, -1) for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.merged = {pair: made for pair, (_, made) in self.pairs.items()}
        self.special = spec["special"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.number = {i: str(i) for i in self.token}
        self.words = regex.compile(spec["pattern"])
        # texts with characters that are younger than a table are rare, and take a slower way
        self.lower, self.young = spec["lower"], frozenset(map(chr, [*spec["others"], *spec["lower"]]))
        self.late = regex.compile(f"[{min(self.young)}-\U0010ffff]") if self.young else None
        less = lambda kind: f"[\\p{{{kind}}}--[{ranges(spec['others'])}]]"
        self.young_words = regex.compile(spec["pattern"].replace(r"\p{L}", less("L")).replace(r"\p{N}", less("N")), regex.V1) if spec["others"] else self.words
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, list[int]] = {}

    def prepared(self, text: str) -> list[str]:
        """The words of a text; white space needs no folding, since it only separates them."""
        if text.isascii():
            return self.words.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if self.late is None or not self.late.search(text) or self.young.isdisjoint(text):
            return self.words.findall(text.lower())
        return self.young_words.findall(text.translate(self.lower).lower())

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.final[raw[-1]])
        if -1 in parts:
            parts = [p for p in parts if p >= 0]
        if len(parts) > LONG:
            return self.long_word(parts)
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[parts[i] << 32 | parts[i + 1]]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges, from a heap of (rank, place) over a linked list."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i] = self.merged[a << 32 | b]
            parts[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := get(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def plain(self, text: str, ids: list[int]) -> None:
        known = self.known
        for word in self.prepared(text):
            found = known.get(word)
            if found is None:
                if len(known) >= CACHE:
                    known.clear()
                found = self.word(word)
                if len(word) <= LONG:
                    known[word] = found
            ids += found

    def encode(self, text: str | None) -> list[int]:
        """Null encodes as the empty text: no ids."""
        ids: list[int] = []
        if not text:
            return ids
        at = 0
        if self.cut is not None and "<|" in text:
            for m in self.cut.finditer(text):
                self.plain(text[at : m.start()], ids)
                ids.append(self.special[m.group()])
                at = m.end()
        self.plain(text[at:] if at else text, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as for a vocabulary without a decoder; unknown ids are left out."""
        return " ".join(map(self.token.__getitem__, ids)) if all(map(self.token.__contains__, ids)) else " ".join(self.token[i] for i in ids if i in self.token)


def digest(table: dict[int, str], ids: list[int]) -> str:
    """SHA-256 of the entries of ``table`` joined by one space, a chunk at a time."""
    h, get = hashlib.sha256(), table.__getitem__
    for at in range(0, len(ids), CHUNK):
        h.update((" " if at else "").encode())
        h.update(" ".join(map(get, ids[at : at + CHUNK])).encode("utf-8"))
    return h.hexdigest()


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ids array<int>, one row for each row of docs.

    Null and empty texts get an empty list; repeated rows are kept; other
    columns are ignored, and a column named ids is replaced.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(vocabulary.value)
        return lambda c: [[codec.encode(t) for t in c[text]]]

    return arrow_map(docs.select(*dict.fromkeys((*keep, text))), make, "ids array<int>", keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and decoded string; null ids decode as the empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(vocabulary.value)
        return lambda c: [[codec.decode(x or []) for x in c[ids]]]

    return arrow_map(encoded.select(*dict.fromkeys((*keep, ids))), make, "decoded string", keep)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of each whole text, without carrying the ids along.

    Null and empty texts have no tokens and the digests of the empty text.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        codec = Codec(vocabulary.value)

        def step(c):
            counts, numbers, decoded = [], [], []
            for t in c[text]:
                ids = codec.encode(t)
                counts.append(len(ids))
                numbers.append(digest(codec.number, ids))
                decoded.append(digest(codec.token, ids))
            return [counts, numbers, decoded]

        return step

    return arrow_map(docs.select(*dict.fromkeys((*keep, text))), make, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)
