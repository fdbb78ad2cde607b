"""Byte-level BPE encoding and decoding, by a pair occurrence index.

The distinct pre-tokens of a partition's block are laid out as one linked sequence of symbols. An index maps each
mergeable pair to all positions of its left symbol; pairs are applied in ascending order of rank, each at all its
positions, and the lists of the pairs that appear beside a merged symbol are updated. A pair that holds a new symbol
always has a later rank than the merge that made it, so one ascending sweep gives what merging each pre-token on
its own gives. The vocabulary is read from a tokenizer file (its path is a parameter); nothing is trained.
"""

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import pandas as pd
import regex
from pyspark.sql import functions as F

from . import common

#: Unicode's white space, as the pattern's \s means it (Python's str.isspace also has four control characters).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
# Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# Fixed value: the same pattern as the libraries write it.
LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers (and the most characters of one that it does), and characters of text at once.
REMEMBERED, MOST_CHARS, BLOCK = 600_000, 64, 500_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 characters for themselves, then from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def _check(file: dict) -> None:
    """Raise where a tokenizer file asks for what this module does not do."""
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    bare = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    marks = any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    decodes = (file.get("decoder") or {}).get("type") == "ByteLevel"
    if not (plain and bare and decodes and model.get("type") == "BPE") or file.get("normalizer") or marks:
        raise ValueError("not a byte-level BPE file of the plain kind: its normalizer, pre-tokens, model, decoder or added tokens differ")


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        _check(file)
        letters, ids = byte_letters(), file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.merges: dict[int, tuple[int, int]] = {}
        self.pairs: list[int] = []
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = ids[left] << 32 | ids[right]
            self.merges[key] = (rank, ids[left + right])
            self.pairs.append(key)
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(_PATTERN)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens into :attr:`known`, as little-endian unsigned 32-bit ids."""
        of_byte, merges, pairs = self.of_byte, self.merges, self.pairs
        symbols: list[int] = []
        ends: list[int] = []
        for w in words:
            symbols += [of_byte[b] for b in w.encode("utf-8", "replace")]
            symbols.append(-1)  # a wall between words: it is in no pair
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            left, right = symbols[i], symbols[i + 1]
            if left >= 0 and right >= 0 and (key := left << 32 | right) in merges:
                index.setdefault(key, []).append(i)
        active = [merges[key][0] for key in index]
        heapq.heapify(active)
        while active:
            key = pairs[heapq.heappop(active)]
            new, left, right = merges[key][1], key >> 32, key & 0xFFFFFFFF
            at = index.pop(key)
            at.sort()
            for i in at:
                j = after[i]
                if symbols[i] != left or symbols[j] != right:  # an earlier merge took one of them
                    continue
                symbols[i], symbols[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                if (x := symbols[k]) >= 0 and (pair := new << 32 | x) in merges:
                    if (there := index.get(pair)) is None:
                        index[pair] = [i]
                        heapq.heappush(active, merges[pair][0])
                    else:
                        there.append(i)
                h = before[i]
                if h >= 0 and (x := symbols[h]) >= 0 and (pair := x << 32 | new) in merges:
                    if (there := index.get(pair)) is None:
                        index[pair] = [h]
                        heapq.heappush(active, merges[pair][0])
                    else:
                        there.append(h)
        start = 0
        for w, end in zip(words, ends, strict=True):
            self.known[w] = array("I", [s for s in symbols[start : end - 1] if s >= 0]).tobytes()
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Strings of special tokens become these."""
        out: list[bytes] = []
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (size < BLOCK or high == low):
                size += len(texts[high])
                high += 1
            out += self._block(texts[low:high])
            low = high
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        find, special = self.pattern.findall, self.special
        cut = [self.split_special.split(t) if special and any(s in t for s in special) else [t] for t in texts]
        words = [[find(part) if not k % 2 else part for k, part in enumerate(parts)] for parts in cut]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(part for parts in words for part in parts[::2])))
        self.learn(list(new))
        find = self.known.__getitem__
        out = [b"".join([b"".join(map(find, part)) if not k % 2 else special[part].to_bytes(4, "little") for k, part in enumerate(parts)]) for parts in words]
        for word in new:  # what is remembered is bounded in bytes, as long pre-tokens are not
            if len(word) > MOST_CHARS:
                del self.known[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_column(path: str, sums_only: bool = False, decoded: bool = False):
    """A function of a text column: n_tokens, ids (binary; or their SHA-256 and the decoded text's). With ``decoded``
    the SHA-256 of the text that the ids decode to stands beside the ids.

    A null text counts as empty. Texts are encoded whole, block by block, so memory follows the block and the
    longest text. Each row is encoded on its own: repeated rows get equal results, an empty table an empty one, and as
    this is a function of one column, no column of the caller's can clash with it.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if sums_only else "n_tokens long, ids binary" + ", decoded_sha256 string" * decoded

    @F.pandas_udf(kind)
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.claim(__name__, vocabulary.cache_clear)
        v = vocabulary(path)
        for part in parts:
            ids = v.encode([t or "" for t in part.tolist()])
            n = [len(x) // 4 for x in ids]
            if sums_only:
                sums = [(hashlib.sha256(x).hexdigest(), hashlib.sha256(v.decode(x).encode("utf-8")).hexdigest()) for x in ids]
                yield pd.DataFrame({"n_tokens": n, "ids_sha256": [s[0] for s in sums], "decoded_sha256": [s[1] for s in sums]})
            else:
                sums = {"decoded_sha256": [hashlib.sha256(v.decode(x).encode("utf-8")).hexdigest() for x in ids]} if decoded else {}
                yield pd.DataFrame({"n_tokens": n, "ids": ids, **sums})
        common.release()

    return udf


def decode_column(path: str):
    """A function of an ids column (binary): the decoded text. Null ids give the empty text."""
    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for part in parts:
            yield pd.Series([v.decode(x or b"") for x in part.tolist()], dtype=object)

    return udf
