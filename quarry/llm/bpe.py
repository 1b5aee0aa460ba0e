"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is the BPE result exactly when each of its
tokens encodes to itself and each adjacent pair encodes to that pair: merges within a region happen in the
order of BPE on the region alone until one crosses a boundary, and the first to cross would also cross in
the pair. Pairs are tested as one array per batch, and only words with a failing pair are merged exactly.

Defined results: a null text counts as empty and has no tokens; repeated rows get equal results; texts of
any length are encoded whole; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import holding

#: Words and pairs that a task remembers; beyond that it starts anew.
CACHE_WORDS, CACHE_PAIRS, LONG_WORD = 120_000, 200_000, 64
#: Symbols up to which merging looks through all pairs instead of keeping a heap.
SHORT = 48
#: Rows and characters that are tokenised at once.
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000
END, STOP = "</w>", "\n"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [x for _, x in sorted([(b, chr(b)) for b in shown] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


class WordBpe:
    """A word-level BPE vocabulary with word ends, from a tokenizers JSON file."""

    #: Characters on which the plain path and the library's normaliser agree: no composition, no odd blanks.
    plain = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
    letters = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
    numbers = "0-9\xb2\xb3\xb9\xbc-\xbe"
    words = re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{letters}{numbers}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END)}
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [token for _, token in self.merges.values()]
        self.longest = None
        self.bytes = byte_symbols()
        self.library = Tokenizer.from_file(path)
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.seen: dict[str | int, tuple[str, str]] = {}

    def symbols(self, word: str, end: bool = True) -> list[int]:
        ids = [self.inner[c] for c in word]
        if end:
            ids[-1] = self.final[word[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """BPE itself: the pair of lowest rank first, the leftmost of equals, in n log n steps."""
        n, ids = len(ids), list(ids)
        if n <= SHORT:
            return self.merge_short(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if 0 <= left and right < n and (m := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def merge_short(self, ids: list[int]) -> list[int]:
        none, rank = len(self.made), self.ranks.get
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def parts(self, token: int) -> list[int]:
        text = self.tokens[token]
        return self.symbols(text[: -len(END)]) if text.endswith(END) else self.symbols(text, end=False)

    def self_made(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.parts(token)) == [token]
        return known

    def matcher(self):
        """Finds leftmost longest tokens in C; STOP after a word's symbols stands for the word's end."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for ending, table in (("", self.inner), (STOP, self.final)):
            for text, token in table.items():
                if self.self_made(token):
                    found.add_word(text + ending, (token, len(text + ending)))
        found.make_automaton()
        return found

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over tokens that encode to themselves: tokens, their words, and the words
        whose end no token takes."""
        if self.longest is None:
            self.longest = self.matcher()
        bounds = np.cumsum([len(w) + 1 for w in words])
        ends, values = zip(*self.longest.iter_long(STOP.join(words) + STOP), strict=True)
        tokens, lengths = np.array(values, np.int64).T
        stops = np.array(ends, np.int64) + 1
        owner = np.searchsorted(bounds, stops)
        covered = np.bincount(owner, lengths, len(words))
        return tokens, owner, np.flatnonzero(covered != np.diff(bounds, prepend=0))

    def fits(self, pair: int) -> bool:
        if (known := self.pairs.get(pair)) is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = pair >> 20, pair & 0xFFFFF
            known = self.pairs[pair] = self.merge(self.parts(a) + self.parts(b)) == [a, b]
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """words: in byte symbols, not empty."""
        if not words:
            return []
        flat, owner, open_ended = self.propose(words)
        within = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, place = np.unique(flat[within] << 20 | flat[within + 1], return_inverse=True)
        good = np.fromiter(map(self.fits, pairs.tolist()), bool, len(pairs))
        failed = np.union1d(owner[within[~good[place]]], open_ended)
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        tokens = flat.tolist()
        found = [tokens[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        for i in failed.tolist():
            found[i] = self.merge(self.symbols(words[i]))
        return found

    def pre_tokens(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens, which are matched in the raw text."""
        pieces = self.split.split(text) if self.split and "<|" in text else [text]
        out: list[str | int] = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
            elif self.plain.fullmatch(piece):
                out += self.words.findall(piece.lower())
            else:
                normal = self.library.normalizer.normalize_str(piece)
                out += [self.words_of(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, new: list[str | int]) -> None:
        words = [w for w in new if not isinstance(w, int)]
        for w, ids in zip(words, self.encode_words([self.as_symbols(w) for w in words]), strict=True):
            self.seen[w] = (" ".join(map(str, ids)), self.decode(ids))
        self.seen |= {t: (str(t), self.tokens[t]) for t in new if isinstance(t, int)}

    def words_of(self, symbols: str) -> str:
        """The text of byte symbols, kept as bytes where it isn't one."""
        return bytes(map(self.byte_of.__getitem__, symbols)).decode("utf-8", "surrogateescape")

    @property
    def byte_of(self) -> dict[str, int]:
        if not hasattr(self, "_byte_of"):
            self._byte_of = {s: b for b, s in enumerate(self.bytes)}
        return self._byte_of

    def as_symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode("utf-8", "surrogateescape")))

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, ids joined by a blank, decoded text."""
        docs = [self.pre_tokens(t) for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen = self.seen
        new = list(set(chain.from_iterable(filterfalse(seen.__contains__, words) for words in docs)))
        self.learn(new)
        for words in docs:
            if not words:
                yield 0, "", ""
                continue
            ids, decoded = map(" ".join, zip(*map(seen.__getitem__, words)))  # noqa: B905
            yield ids.count(" ") + 1, ids, decoded
        for w in new:
            if isinstance(w, str) and len(w) > LONG_WORD:
                del seen[w]

    def encode(self, text: str | None) -> list[int]:
        _, ids, _ = next(self.digest([text or ""]))
        return list(map(int, ids.split()))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a blank: the file names no decoder. Special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One vocabulary for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
        gc.freeze()  # the vocabulary needs no looking at in each collection
    return _loaded[path]


def slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if len(part) >= SLICE_ROWS or chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (string), ids_sha256, decoded_sha256 of each row.

    with_ids=False leaves ids and decoded out, where only the digests are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("bpe", _loaded.clear)
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogateescape")).hexdigest()
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                rows = [(n, ids if with_ids else None, out if with_ids else None, sha(ids), sha(out)) for part in slices([t or "" for t in texts[at : at + SLICE_ROWS].to_pylist()]) for n, ids, out in bpe.digest(part)]
                n, ids, out, ids_sha, out_sha = zip(*rows, strict=True)
                columns = [batch.column(0)[at : at + SLICE_ROWS], pa.array(n, pa.int64())]
                names = ["doc_id", "n_tokens"]
                if with_ids:
                    columns += [pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())), pa.array(out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha), pa.array(out_sha)], names + ["ids_sha256", "decoded_sha256"])
                at += SLICE_ROWS

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>, decoded string" * with_ids + ", ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
