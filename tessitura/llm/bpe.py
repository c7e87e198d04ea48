"""Byte-level BPE by a traversal of the trie of distinct words.

For a byte-level BPE vocabulary the encoding of a string is decided by the last token of each of its
prefixes: the encoding of a prefix of length i ends in the one token t that ends there, whose rest
is the encoding of prefix i - len(t), and that stands next to that encoding's last token without a merge
between the two. So a trie of distinct words, walked depth first, needs one last-token state for each
node, and words that share a prefix share its states. The walk here goes over the sorted words: the common
prefix with the word before is the path that stays on the stack. A state is a number: the last token tells where the
one before it ends, so the encoding of a word is read backwards from its end, and a word of n bytes takes n states.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, worker_state
from .words import text_column

#: Fixed pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII letters only, where Python's own expressions do; their \s would take U+001C to U+001F too.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Bytes of word encodings that a worker keeps; beyond that only those of the words at hand stay.
KEEP_BYTES = 24 << 20
#: Bytes of a word that is kept at all, and pairs of tokens whose test is kept.
KEEP_WORD, KEEP_PAIRS = 1 << 10, 100_000
#: Letters of texts that share one walk; words of a longer text that do.
GROUP, WORDS = 1 << 20, 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """tokens: bytes by id. pairs: left << 32 | right -> merged id. rank, left, right: of a merged id, its priority and its two parts."""

    ids: dict[bytes, int]
    tokens: list[bytes]
    pairs: dict[int, int]
    rank: array
    left: array
    right: array
    added: dict[str, int]
    _fits: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        self._whole: list[bool | None] = [None] * len(self.tokens)
        self.names = [str(i) for i in range(len(self.tokens))]
        #: four bytes -> longest token that ends in them
        self.reach: dict[bytes, int] = {}
        for word in self.ids:
            if len(word) > 3:
                self.reach[word[-4:]] = max(self.reach.get(word[-4:], 0), len(word))

    @classmethod
    def load(cls, spec: str) -> Vocabulary:
        """From the text of a tokenizer's JSON file."""
        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        if model["type"] != "BPE" or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or an added blank")
        raw = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        tokens = [b""] * (max([*raw.values(), *added.values()]) + 1)
        for word, i in raw.items():
            tokens[i] = word
        for word, i in added.items():
            tokens[i] = word.encode()
        pairs, (rank, first, second) = {}, (array("i", [-1]) * len(tokens) for _ in range(3))
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = (raw[bytes(letters[c] for c in w)] for w in (a, b))
            whole = raw[tokens[left] + tokens[right]]
            pairs[left << 32 | right] = whole
            if rank[whole] < 0:
                rank[whole], first[whole], second[whole] = n, left, right
        return cls(raw, tokens, pairs, rank, first, second, added)

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens, each the encoding of its own bytes, stay two when their bytes are encoded together.

        Their merges are undone from the last one on; between two of them, the parts that then meet at the seam must not have
        merged before one of them went into a token of its own side. Of merges of one rank the left one comes first.
        """
        two = left << 32 | right
        known = self._fits.get(two)
        if known is None:
            if len(self._fits) > KEEP_PAIRS:
                self._fits.clear()
            known = self._fits[two] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        rank, pairs, until = self.rank, self.pairs, len(self.rank)
        while True:
            whole = pairs.get(left << 32 | right)
            if whole is not None and rank[whole] < until:
                return False
            if rank[left] > rank[right]:
                until, left = rank[left], self.right[left]
            elif rank[right] < 0:
                return True
            else:
                until, right = rank[right] + 1, self.left[right]

    def merged(self, word: bytes) -> list[int]:
        """Encoding by repeated merges of the pair of best rank, leftmost first; the definition."""
        parts = [self.ids[word[k : k + 1]] for k in range(len(word))]
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                whole = self.pairs.get(parts[k] << 32 | parts[k + 1])
                if whole is not None and (best is None or self.rank[whole] < best):
                    best, at = self.rank[whole], k
            if best is None:
                break
            parts[at : at + 2] = [self.pairs[parts[at] << 32 | parts[at + 1]]]
        return parts

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words."""
        return {word: [int(i) for i in codes.split(",")] for word, (codes, _) in self.coded_words(words).items()}

    def _walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Each distinct word, sorted, with the last tokens of its prefixes (by length) and where these begin; the lists change afterwards."""
        # of each prefix on the current path: its last token, and where that begins
        last, begins = [-1], [0]
        find, reach, fits, whole = self.ids.get, self.reach.get, self._fits.get, self._whole
        path = b""
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(path), size)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, size + 1):
                begin = max(0, end - reach(word[end - 4 : end], 3)) if end > 3 else 0
                while True:
                    token = find(word[begin:end])
                    if token is not None and (whole[token] or whole[token] is None and self.whole(token)):
                        if not begin:
                            break
                        fit = fits(last[begin] << 32 | token)
                        if self.fits(last[begin], token) if fit is None else fit:
                            break
                    begin += 1
                    if begin == end:
                        raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")
                last.append(token)
                begins.append(begin)
            path = word
            yield word, last, begins

    def counted_words(self, words: list[bytes]) -> dict[bytes, int]:
        """Numbers of tokens of distinct words."""
        out: dict[bytes, int] = {}
        for word, _, begins in self._walk(words):
            at, n = len(word), 0
            while at:
                at = begins[at]
                n += 1
            out[word] = n
        return out

    def coded_words(self, words: list[bytes]) -> dict[bytes, tuple[str, bytes]]:
        """Encodings of distinct words as ids joined by commas, and what these ids decode to."""
        out: dict[bytes, tuple[str, bytes]] = {}
        names, tokens = self.names, self.tokens
        for word, last, begins in self._walk(words):
            at = len(word)
            if at and not begins[at]:
                out[word] = names[last[at]], tokens[last[at]]
                continue
            ids = []
            while at:
                ids.append(last[at])
                at = begins[at]
            ids.reverse()
            out[word] = ",".join([names[i] for i in ids]), b"".join([tokens[i] for i in ids])
        return out

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if self._whole[token] is None:
            self._whole[token] = self.merged(self.tokens[token]) == [token]
        return self._whole[token]


class Encoder:
    """Encodes whole texts; keeps the encodings of words between batches, or only their numbers of tokens if `counts`."""

    def __init__(self, vocabulary: Vocabulary, counts: bool = False):
        self.vocabulary, self.counts = vocabulary, counts
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        #: word -> ids joined by commas (or how many), and the bytes that these ids stand for
        self.known: dict[str, str | int] = {}
        self.spelled: dict[str, bytes] = {}
        self.used = 0
        self.marks = {t: str(i) for t, i in vocabulary.added.items()}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; special tokens are words of their own."""
        if self.special is None or not any(t in text for t in self.marks):
            return (self.split_ascii if text.isascii() else self.split).findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split.findall(text, at, m.start())
            out.append(m.group())
            at = m.end()
        return out + self.split.findall(text, at)

    def runs(self, text: str) -> Iterator[list[str]]:
        """The words of a text, those of one longer than GROUP in runs of at most WORDS."""
        if len(text) <= GROUP:
            yield self.words(text)
            return
        ends = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        at = 0
        for begin, end in [*ends, (len(text), len(text))]:
            found = (m.group() for m in self.split.finditer(text, at, begin))
            while run := list(islice(found, WORDS)):
                yield run
            if end > begin:
                yield [text[begin:end]]
            at = end

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet, all in one walk of their trie."""
        fresh = list(words - self.known.keys())
        if not fresh:
            return
        if self.used > KEEP_BYTES:
            self.known = {w: self.known[w] for w in words if w in self.known and len(w) <= KEEP_WORD}
            self.spelled = {w: self.spelled[w] for w in self.known} if not self.counts else {}
            fresh = list(words - self.known.keys())
            self.used = _cost(self.known)
        if self.counts:
            plain = self.vocabulary.counted_words([w.encode() for w in fresh])
            self.known.update((w, plain[w.encode()]) for w in fresh)
        else:
            codes = self.vocabulary.coded_words([w.encode() for w in fresh])
            for w in fresh:
                self.known[w], self.spelled[w] = codes[w.encode()]
        self.used += _cost(fresh)
        for mark, own in self.vocabulary.added.items():
            if self.counts:
                self.known[mark] = 1
            else:
                self.known[mark], self.spelled[mark] = self.marks[mark], self.vocabulary.tokens[own]

    def codes(self, word: str) -> str:
        """The ids of one word, joined by commas."""
        return self.marks.get(word) or self.vocabulary.coded_words([word.encode()])[word.encode()][0]

    def entries(self, words: list[str]) -> list[str] | list[int]:
        self.learn(set(words))
        return list(map(self.known.__getitem__, words))

    def decoded(self, words: list[str]) -> bytes:
        """Known words as their ids decode, in UTF-8; ids that spell no UTF-8 give replacement characters."""
        raw = b"".join(map(self.spelled.__getitem__, words))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    def ids(self, text: str) -> list[int]:
        return [int(i) for run in self.runs(text) for e in self.entries(run) for i in e.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.vocabulary.tokens[i] for i in ids]).decode("utf-8", "replace")


def _cost(words: Iterable[str]) -> int:
    """Bytes, about, that words and their entries take."""
    sizes = list(map(len, words))
    return 280 * len(sizes) + 6 * sum(sizes)


def encoder(spec: str, counts: bool = False) -> Encoder:
    """One encoder for each vocabulary and worker process, and one that only counts; it goes when the worker serves another operator."""
    key = hashlib.sha256(spec.encode()).hexdigest(), counts
    kept = worker_state("bpe")
    if key not in kept:
        kept[key] = Encoder(Vocabulary.load(spec), counts)
    return kept[key]


def vocabulary_text(spark: SparkSession, path: str) -> str:
    """The vocabulary file: a path on the driver, or one that Spark reads (with a scheme)."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(os.fspath(path), encoding="utf-8") as f:
        return f.read()


def encoded_texts(own: Encoder, texts: pa.Array) -> Iterator[Iterator[tuple[list[str], list[str]]]]:
    """For each text, in order, its words in runs and their encodings. Texts of about GROUP letters together are learnt in one walk,
    a longer one run by run, so a worker holds the words of no more than that."""
    at = 0
    while at < len(texts):
        group, letters = [], 0
        while at < len(texts) and letters < GROUP:
            text = texts[at].as_py()
            if len(text) > GROUP:
                break
            group.append(own.words(text))
            letters += len(text)
            at += 1
        if group:
            own.learn(set().union(*group))
            for words in group:
                yield iter([(words, list(map(own.known.__getitem__, words)))])
        else:
            yield ((run, own.entries(run)) for run in own.runs(texts[at].as_py()))
            at += 1


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids: token_ids.

    vocabulary: path of a byte-level BPE tokenizer file. Special tokens in a text become their ids; none
    is added. Null counts as empty; an empty text has no tokens and the digests of the empty string.
    Texts of any length are encoded whole. Rows with null or repeated ids get a row each. Other
    columns are ignored; an empty table gives an empty result.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(docs.sparkSession, vocabulary))

    def run(batches):
        own = encoder(spec.value)
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for runs in encoded_texts(own, batch.column(1)):
                size, codes, text, ids = 0, hashlib.sha256(), hashlib.sha256(), []
                for words, found in runs:
                    joined = ",".join(found)
                    codes.update(b"," * bool(size and found) + joined.encode())
                    size += joined.count(",") + bool(found)
                    text.update(own.decoded(words))
                    if with_ids and joined:
                        ids += map(int, joined.split(","))
                for column, value in zip(columns, (size, codes.hexdigest(), text.hexdigest(), ids), strict=True):
                    column.append(value)
            out = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())), strict=True))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
            yield pa.RecordBatch.from_arrays(out if with_ids else out[:-1], names=names if with_ids else names[:-1])
            del batch, out
            pa.default_memory_pool().release_unused()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    extra = ", token_ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, text: the texts that lists of ids stand for, special tokens included. Null lists give empty texts."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary_text(encoded.sparkSession, vocabulary))

    def run(batches):
        own = encoder(spec.value)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
