"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

Per word, an Aho-Corasick automaton finds the longest vocabulary token at each place. The encoder takes it, checks it
against its left neighbour in a table of compatible pairs, goes on to the token's next shorter prefixes, and steps back when
nothing fits; no place is visited again after it failed, so the time is linear in the word. Different words of a task
are encoded once; texts are gathered from them by index. Two neighbours are
compatible if replaying the merges never joins pieces across their border before those pieces were used up.
The result is what merging the lowest rank first gives.

The vocabulary is a JSON file of the tokenizers library with: NFC, lower case, words by a pattern, byte-level
symbols, an end-of-word suffix and no decoder, in which case decoding joins token strings with one space. Its path
is a parameter; workers read it once each. Special tokens written out in a text are special tokens.

Edge cases: a null text is an empty one and has no tokens; unknown ids decode to nothing; repeated rows and null ids
are rows like others.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmweave.llm.common import give_back, prepare

END = "\n"  # stands for the end-of-word suffix; no byte-level symbol is a line break
CACHED_WORDS, CACHED_PAIRS, LONG = 150_000, 200_000, 64  # words a task keeps, pairs a worker keeps
# Fixed value: white space of the pattern language that the vocabulary's file uses.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.symbols = byte_symbols()
        vocab = model["vocab"]
        most = max(vocab.values()) + 1
        self.rank: list[float] = [-1] * most
        self.left, self.right = [-1] * most, [-1] * most
        self.joined: dict[int, int] = {}  # rank of the merge of a pair, by left * 2^32 + right
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], rank
            self.joined[vocab[a] << 32 | vocab[b]] = rank
        self.pairs: dict[int, bool] = {}
        self.size, self.shorter = [0] * most, [-1] * most
        self.automaton = ahocorasick.Automaton()
        reachable = {i: self.rank[i] < 0 for i in vocab.values()}
        for made in sorted((i for i in vocab.values() if self.rank[i] >= 0), key=self.rank.__getitem__):
            a, b = self.left[made], self.right[made]
            reachable[made] = reachable[a] and reachable[b] and self._replay(a, b, self.rank[made])
        own: dict[str, int] = {}
        for text, i in vocab.items():
            if reachable[i]:
                own[text.removesuffix(suffix) + END if text.endswith(suffix) and text != suffix else text] = i
        for text, i in own.items():
            self.size[i] = len(text)
            self.shorter[i] = next((own[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in own), -1)
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()

    def _replay(self, a: int, b: int, limit: float) -> bool:
        """Do the merges ranked below ``limit`` leave the border between two tokens alone?"""
        ranks, joined = self.rank, self.joined
        while True:
            rank = joined.get(a << 32 | b)
            if rank is not None and rank < limit:
                return False
            of_a, of_b = ranks[a], ranks[b]
            if of_a > of_b:
                limit, a = min(limit, of_a), self.right[a]
            elif of_b >= 0:  # at equal rank, the pair further left goes first
                limit, b = min(limit, of_b + 1), self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self._replay(a, b, float("inf"))
        return found

    def encode_symbols(self, text: str) -> tuple[int, ...]:
        """Tokens of one word in byte-level symbols with its end mark."""
        size, shorter, known = self.size, self.shorter, self.pairs
        out: list[int] = []
        failed: set[int] = set()
        pos, walk = 0, self.automaton.iter_long(text)  # the longest token at a place, and at its end the next
        token = next(walk, (0, -1))[1]
        while True:
            longest, last = token, out[-1] if out else -1
            while token >= 0:
                if pos + size[token] not in failed:
                    if last < 0:
                        break
                    fits = known.get(last << 32 | token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]  # the next longest token at this place
            if token >= 0:
                out.append(token)
                pos += size[token]
                if pos == len(text):
                    return tuple(out)
                if token != longest or walk is None:
                    walk = self.automaton.iter_long(text, pos)
                end, token = next(walk, (0, -1))
                if token >= 0 and end + 1 - size[token] != pos:
                    token = -1
            else:
                failed.add(pos)
                if not out:
                    raise ValueError("the vocabulary has no token for some symbol")
                token = out.pop()
                pos -= size[token]
                token, walk = shorter[token], None

    def split(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of special tokens written out in it."""
        out: list[str | int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # Lower case is taken character by character, so a sigma never takes its final form.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.pattern.findall(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in self.ids_of(word)]

    def ids_of(self, word: str | int) -> tuple[int, ...]:
        return (word,) if isinstance(word, int) else self.encode_symbols("".join(map(self.symbols.__getitem__, word.encode())) + END)


class Words:
    """Different words of a task with their ids, each encoded once; texts are places in it, gathered by index."""

    def __init__(self, own: Encoder) -> None:
        self.own = own
        self.clear()

    def clear(self) -> None:
        self.place: dict[str | int, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def add(self, word: str | int) -> int:
        self.ids.extend(self.own.ids_of(word))
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    def places(self, text: str) -> list[int]:
        words = self.own.split(text)
        out = list(map(self.place.get, words))
        if None in out:
            for i, word in enumerate(words):
                if out[i] is None:
                    out[i] = self.place[word] if word in self.place else self.add(word)
                    if isinstance(word, int) or len(word) <= LONG:
                        self.place[word] = out[i]
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        places, counts = array("q"), array("q")
        for t in texts:
            found = self.places(t.as_py() or "")
            places.extend(found)
            counts.append(len(found))
        at = np.frombuffer(places, dtype=np.int64) if places else np.zeros(0, dtype=np.int64)
        ends = np.array(self.ends, dtype=np.int64)
        size = ends[at + 1] - ends[at]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        take = np.arange(total) + np.repeat(ends[at] - (last - size), size)
        flat = np.array(self.ids, dtype=np.int32)[take]
        bounds = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])]
        if len(self.place) > CACHED_WORDS or len(self.ids) > 8 * CACHED_WORDS:
            self.clear()
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


_ENCODERS: dict[str, Encoder] = {}
_TABLES: dict[str, pa.Array] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_table(path: str) -> pa.Array:
    """Token strings by id: one buffer of characters and the offsets in it. All that decoding needs."""
    if path not in _TABLES:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        _TABLES[path] = pa.array([named.get(i) for i in range(max(named) + 1)], pa.large_string())
    return _TABLES[path]


def _fields(schema) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)


def _decoded(table: pa.Array, ids: pa.Array) -> pa.Array:
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < len(table))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(known)])[ends]
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), table.take(pa.array(flat[known], pa.int64())))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: the carried columns and ``ids``; with ``decoded`` also what they decode to."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *carry)
    kept = rows.drop("_text").schema

    def work(batches):
        own, table = encoder(path), token_table(path) if decoded else None
        words = Words(own)
        for batch in batches:
            ids = words.encode(batch.column(0))
            found = {"ids": ids} | ({"decoded": _decoded(table, ids)} if decoded else {})
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found.values()], names=[*kept.names, *found])
        words.clear()
        give_back()

    return rows.mapInArrow(work, f"{_fields(kept)}ids array<int>{', decoded string' if decoded else ''}")


def decode(encoded: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """One row per input row: the carried columns, the ids and the ``decoded`` text."""
    prepare(encoded.sparkSession)
    rows = encoded.select(F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"), *carry)
    kept = rows.drop("ids").schema

    def work(batches):
        table = token_table(path)
        for batch in batches:
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids, _decoded(table, ids)], names=[*kept.names, "ids", "decoded"])

    return rows.mapInArrow(work, f"{_fields(kept)}ids array<int>, decoded string")
