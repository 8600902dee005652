"""Byte-level BPE encoding and decoding with a given vocabulary file, by tree concatenation.

A text longer than two leaves is halved down to leaves, wherever that falls; all leaves of a
batch are encoded in one parallel call. Neighbours are then joined: a window around the join
is encoded anew, grown until both sides agree exactly, and its ids replace what both sides
have there.

Windows begin and end at borders: places where a pre-token of the byte-level pattern ends
whatever stands elsewhere in the text, as none holds a blank or line feed after a letter,
digit or mark, or a mark after a letter or digit, and none looks further. So a side's ids
can be cut at a border, what lies between two borders is encoded on its own, and the sides
agree once the window has a border on each. Where a leaf has no border within (text that the tokenizer does
not split), the stretch between the borders around it is cut in pre-tokens; a long pre-token is a
tree of its own, whose leaves are joined by the merges alone: a window of tokens around the
join grows until its first and last token agree with what both sides have there. Two tokens that
stand next to each other in some exact encoding are compatible, and a sequence all of whose
neighbours are compatible is the exact encoding.

One pass over the scan each way, no shuffle; memory is bounded by a slice of about 1 MB
of text or one single text. Null and empty texts have no ids and decode to ''; repeated
rows and ids give repeated rows, and equal texts of a slice are encoded once.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkernel as K

#: The byte-level pattern of pre-tokens (a fixed value, as published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A border: a blank or line feed after a letter, digit or mark, or a mark after a letter or digit.
_BORDER = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ.,;:!?])(?=[ \n])|(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ\u3041-\u3096\u4E00-\u9FA5])(?=[.,;:!?。、，])")


@dataclass(frozen=True)
class Params:
    """leaf: characters of a leaf of a text's tree (bytes, in a long pre-token's); reach: characters on each side of a join at first; window: tokens, in a long pre-token."""

    leaf: int = 1_024
    reach: int = 32
    window: int = 8


@dataclass
class Node:
    """Characters begin to end of a text, with their own exact ids."""

    begin: int
    end: int
    ids: list[int]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """The library's tokenizer, and the same merges alone for pre-tokens that are given in the byte alphabet."""

    def __init__(self, path: str, p: Params):
        self.p = p
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.text = text
        spec = json.loads(text)
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.lengths = np.zeros(max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1, np.int64)
        for token, i in spec["model"]["vocab"].items():
            self.lengths[i] = len(token)
        self.bytes_of = self.lengths.tolist()
        self.ranks = self.by_rank(spec)
        self.joins = 0

    @functools.cached_property
    def whole(self) -> Tokenizer:
        """The library's tokenizer, made when it is needed: workers that meet no long pre-token do not hold it."""
        made = Tokenizer.from_str(self.text)
        made.no_truncation()
        made.no_padding()
        return made

    @functools.cached_property
    def merges(self) -> Tokenizer:
        """Its merges alone."""
        return Tokenizer.from_str(json.dumps(json.loads(self.text) | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))

    @staticmethod
    def by_rank(spec: dict) -> tiktoken.Encoding | None:
        """A faster encoder of the same vocabulary, or None unless ids follow the order of the merges."""
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        in_order = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs)) and len(plain) == 256 + len(pairs)
        if not in_order or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"] or spec["normalizer"] or spec["post_processor"]:
            return None
        if any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in plain.items()}, special_tokens=added)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of texts, each by itself."""
        if self.ranks is None:
            return [x.ids for x in self.whole.encode_batch_fast(parts, add_special_tokens=False)]
        return [self.ranks.encode(x, allowed_special="all") for x in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        place: dict[str, int] = {}
        for text in texts:
            place.setdefault(text, len(place))
        found = self.concatenated(list(place))
        return [found[place[text]] for text in texts]

    def concatenated(self, texts: list[str]) -> list[np.ndarray]:
        sections, owner = [], []  # special tokens stand by themselves, as in the library
        for n, text in enumerate(texts):
            long = len(text) > 2 * self.p.leaf
            for section in self.special.split(text) if long and self.special else [text]:
                if section or not long:
                    sections.append(section)
                    owner.append(n)
        leaves: list[str] = []
        cuts = []
        for section in sections:
            n = 1 << (len(section) // self.p.leaf).bit_length() - 1 if len(section) > 2 * self.p.leaf else 1
            at = [len(section) * i // n for i in range(n + 1)]
            leaves += [section[a:b] for a, b in zip(at, at[1:])]
            cuts.append(at)
        encoded = self.encode_parts(leaves)
        out: list[list[int]] = [[] for _ in texts]
        first = 0
        for section, at, n in zip(sections, cuts, owner):
            count = len(at) - 1
            out[n] += self.tree(section, at, encoded[first : first + count]) if count > 1 else encoded[first]
            first += count
        return [np.array(x, np.uint32) for x in out]

    def tree(self, text: str, at: list[int], encoded: list[list[int]]) -> list[int]:
        """The ids of text from those of its leaves, which are cut at at."""
        level = [Node(a, b, ids) for a, b, ids in zip(at, at[1:], encoded)]
        while len(level) > 1:
            level = [self.concatenate(text, x, y) for x, y in zip(level[::2], level[1::2])]
        return level[0].ids

    def concatenate(self, text: str, x: Node, y: Node) -> Node:
        """Neighbours as one: the window around their join grows until it has a border on each side, or takes a whole side."""
        self.joins += 1
        reach, at = self.p.reach, x.end
        while True:
            low, high = max(x.begin, at - reach), min(y.end, at + reach)
            first, last = _BORDER.search(text, low + 1, at), _BORDER.search(text, at + 1, high)
            begin = first.start() if first else x.begin if low == x.begin else None
            end = last.start() if last else y.end if high == y.end else None
            if begin is not None and end is not None:
                break
            reach *= 2
        left, size = len(x.ids), len(text[begin:at].encode())
        while size > 0:
            left -= 1
            size -= self.bytes_of[x.ids[left]]
        right, size = 0, len(text[at:end].encode())
        while size > 0:
            size -= self.bytes_of[y.ids[right]]
            right += 1
        return Node(x.begin, y.end, x.ids[:left] + self.between(text[begin:end]) + y.ids[right:])

    def between(self, part: str) -> list[int]:
        """Ids of what stands between two borders."""
        if len(part) <= 2 * self.p.leaf:
            return self.encode_parts([part])[0]
        tokens = [(mapped, part[a:b]) for mapped, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(part)]
        long = [mapped for mapped, _ in tokens if len(mapped) > 2 * self.p.leaf]
        trees = iter(self.trees(long))
        short = iter(self.encode_parts([x for mapped, x in tokens if len(mapped) <= 2 * self.p.leaf]))
        return [i for mapped, _ in tokens for i in (next(trees) if len(mapped) > 2 * self.p.leaf else next(short))]

    def trees(self, tokens: list[str]) -> list[list[int]]:
        """Ids of long pre-tokens, given in the byte alphabet."""
        leaves, counts = [], []
        for token in tokens:
            n = 1 << max(0, (len(token) // self.p.leaf).bit_length() - 1)
            cuts = [len(token) * i // n for i in range(n + 1)]
            leaves += [token[a:b] for a, b in zip(cuts, cuts[1:])]
            counts.append(n)
        encoded = [] if not leaves else [x.ids for x in self.merges.encode_batch_fast(leaves, add_special_tokens=False)]
        out, at = [], 0
        for token, n in zip(tokens, counts):
            level, at = encoded[at : at + n], at + n
            ends = [len(token) * (i + 1) // n for i in range(n)]
            while len(level) > 1:
                level = [self.join(token, ends[i], level[i], level[i + 1]) for i in range(0, len(level), 2)]
                ends = ends[1::2]
            out.append(level[0])
        return out

    def join(self, token: str, at: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbours that meet at character at of token."""
        self.joins += 1
        w = self.p.window
        while True:
            a, b = left[-w:], right[:w]
            begin, end = at - int(self.lengths[a].sum()), at + int(self.lengths[b].sum())
            ids = self.merges.encode(token[begin:end], add_special_tokens=False).ids
            if (w >= len(left) or ids[0] == a[0]) and (w >= len(right) or ids[-1] == b[-1]):
                return left[: max(0, len(left) - w)] + ids + right[w:]
            w *= 2

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
        if self.ranks is None:
            return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [self.ranks.decode_bytes(x.tolist()).decode("utf-8", "replace") for x in ids]


@functools.lru_cache(maxsize=2)
def codec(path: str, p: Params) -> Codec:
    """Loaded once in each Python worker."""
    return Codec(path, p)


def encode(docs: DataFrame, path: str, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers)."""
    p = params or Params()

    def run(batch: pa.RecordBatch) -> dict:
        ids = codec(path, p).encode([t or "" for t in batch["text"].to_pylist()])
        return {"doc_id": batch["id"].cast(pa.int64()), "n_tokens": [len(x) for x in ids], "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}

    return K.map_texts(docs, run, "doc_id long, n_tokens long, ids binary", id_col, text_col)


def decode(encoded: DataFrame, path: str, params: Params | None = None) -> DataFrame:
    """encode()'s rows with one column more, text; null ids decode to ''."""
    p = params or Params()

    def run(batches):
        for batch in batches:
            for piece in K.pieces(iter([batch]), "ids", 2 * K.BUFFER_BYTES):
                texts = codec(path, p).decode([np.frombuffer(x or b"", "<u4") for x in piece["ids"].to_pylist()])
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["n_tokens"], piece["ids"], pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])
        K.release()

    return K.bound_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and hexadecimal SHA-256 of ids and of the decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))
