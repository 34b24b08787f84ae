"""Byte-level BPE by speculation and verification.

Each text is cut into words by the usual byte-level pattern. For a word, a greedy longest match over the vocabulary
proposes tokens. A proposal is the true encoding if no merge crosses the border between any two neighbouring
tokens, which is a property of the pair alone; all pairs of a batch are tested together with numpy. Only words
with a failing pair are merged step by step.

Why a pair can be tested alone: while (a, b) are built from their bytes, the piece at the right edge of a runs through
a chain (a, its right part, that one's right part, ...) and the piece at the left edge of b through the mirrored
chain. A piece lasts until the merge that builds its parent in the chain. A merge of two edge pieces comes into
play exactly if its rank is lower than that of the left piece's parent and not higher than that of the right
piece's parent (equal ranks go leftmost first).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from bisect import bisect_right
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import per_batch

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a generation of the cache. When the younger one is full, it becomes the older, and words of that which were not met since are forgotten.
CACHE_WORDS = 150_000
#: Words longer than this many characters are not remembered.
CACHE_CHARS = 64
_NEVER = np.iinfo(np.int64).max
_COUNT, _DECIMAL, _RAW = map(itemgetter, range(3))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: printable bytes stand for themselves, the rest are numbered from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def latin_pattern() -> re.Pattern:
    """PATTERN for texts of characters below U+0250 without U+001C to U+001F, in the faster standard module."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += c
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\u024f]")


class Memory:
    """What is known of words, in two generations: words that are met often stay, others are forgotten."""

    def __init__(self, learn):
        self.learn, self.young, self.old = learn, {}, {}

    def of(self, words: set[str]) -> dict:
        """What is known of each word, or is now learnt."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        young.update((w, old[w]) for w in words & old.keys())
        new = self.learn(words - young.keys())
        if len(max(new, key=len, default="")) <= CACHE_CHARS:
            young.update(new)
            return young
        young.update((w, x) for w, x in new.items() if len(w) <= CACHE_CHARS)
        return {w: new[w] if w in new else young[w] for w in words}


class Vocabulary:
    """The tables of one tokenizer file, its pair test and its two directions."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model, letters = spec["model"], byte_alphabet()
        size = 1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.decimal = [str(i) for i in range(size)]
        self.numbers = [*range(size)]  # one object for each id, which the cache shares
        self.single = [0] * 256
        for i in model["vocab"].values():
            if len(self.bytes[i]) == 1:
                self.single[self.bytes[i][0]] = i
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.born = np.full(size, -1)  # rank of the merge that makes a token; -1 for bytes
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merge[x, y] = rank, z
            if self.left[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.made[[r for r, _ in self.merge.values()]] = [z for _, z in self.merge.values()]
        self.pattern, self.latin = regex.compile(PATTERN), latin_pattern()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known_pairs, self.known_fine = np.zeros(0, np.int64), np.zeros(0, bool)
        self.words = Memory(self.learned)
        self.forms = Memory(lambda words: {w: self.form(ids) for w, ids in self.learned(words).items()})
        self.greedy = self._reachable()
        #: The lengths that tokens with the same first four bytes have, longest first, and the short lengths that any may have.
        of: dict[bytes, set[int]] = {}
        for token in self.greedy:
            if len(token) > 3:
                of.setdefault(token[:4], {3, 2, 1}).add(len(token))
        self.lengths = {head: tuple(sorted(some, reverse=True)) for head, some in of.items()}

    def _reachable(self) -> dict[bytes, int]:
        """Tokens that their own bytes encode to; only those can be proposed."""
        made = np.flatnonzero(self.left >= 0)
        fine = self.compatible(self.left[made], self.right[made], self.born[made])
        bad = set(made[~fine].tolist())
        for i in made[np.argsort(self.born[made])].tolist():
            if int(self.left[i]) in bad or int(self.right[i]) in bad:
                bad.add(i)
        return {self.bytes[i]: self.numbers[i] for i in [*self.single, *made.tolist()] if i not in bad}

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether no merge crosses their border before rank `until` (default: ever)."""
        until = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        fine = np.ones(len(a), bool)
        x, x_ends, on = a.astype(np.int64), until, np.arange(len(a))
        while len(on):
            y, y_ends, at = b[on].astype(np.int64), until[on], np.arange(len(on))
            while len(at):
                rank = self.ranks(x[at], y)
                # The pair's own merge has rank `until` and is no crossing.
                fine[on[at[(rank < x_ends[at]) & (rank <= y_ends) & (rank < until[on[at]])]]] = False
                go = self.left[y] >= 0
                at, y, y_ends = at[go], self.left[y[go]], self.born[y[go]]
            go = self.right[x] >= 0
            on, x, x_ends = on[go], self.right[x[go]], self.born[x[go]]
        return fine

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of tokens; _NEVER for pairs without one."""
        key = x << 32 | y
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == key, self.pair_ranks[found], _NEVER)

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The exact encodings of words: in each word the lowest-ranked merge first, leftmost first among equals; all words take their next merge together."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = bisect_right(order, 100, key=lambda i: len(words[i]))
        for i in order[short:]:
            out[i] = self._merged_long([self.single[b] for b in words[i]])
        for at in range(0, short, 4096):
            self._merge_together(words, order[at : min(at + 4096, short)], out)
        return out

    def _merge_together(self, words: list[bytes], short: list[int], out: list[list[int]]) -> None:
        """Fill in out for the words at the places `short`, of about the same length."""
        width = np.array([len(words[i]) for i in short], np.int64)
        grid = np.full((len(short), int(width.max(initial=0)) + 1), -1, np.int64)
        grid[np.arange(grid.shape[1])[None, :] < width[:, None]] = np.array(self.single)[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        row, cols = np.array(short, np.int64), np.arange(grid.shape[1])
        rank = np.full(grid.shape, _NEVER)
        rank[:, :-1] = np.where(grid[:, 1:] >= 0, self.ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(grid), -1), _NEVER)
        while len(row):
            at = rank.argmin(axis=1)
            done = rank[np.arange(len(row)), at] == _NEVER
            for i, ids in zip(row[done].tolist(), grid[done].tolist()):
                out[i] = [t for t in ids if t >= 0]
            row, grid, rank, at = row[~done], grid[~done], rank[~done], at[~done]
            if not len(row):
                break
            n = np.arange(len(row))
            grid[n, at] = self.made[rank[n, at]]
            # Close the gap: what stands right of the merged pair moves one place to the left.
            source = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), len(cols) - 1)
            grid, rank = np.take_along_axis(grid, source, 1), np.take_along_axis(rank, source, 1)
            grid[:, -1], rank[:, -1] = -1, _NEVER
            for side in (at - 1, at):
                x, y = grid[n, np.maximum(side, 0)], grid[n, np.minimum(side + 1, len(cols) - 1)]
                new = np.where(y >= 0, self.ranks(x, np.maximum(y, 0)), _NEVER)
                rank[n[side >= 0], side[side >= 0]] = new[side >= 0]

    def _merged_long(self, ids: list[int]) -> list[int]:
        """As merged, for one word, with a heap and a linked list, so that very long words take n log n steps."""
        n = len(ids)
        before, after, alive = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        heap = [(self.merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = self.merge[x, y][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], k, *p))
        return [x for x, a in zip(ids, alive) if a]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.greedy.get(word)
        if whole is not None:
            return [whole]
        out, at, n, known, lengths = [], 0, len(word), self.greedy, self.lengths
        while at < n:
            # What reaches beyond the word is the rest of it, which is a shorter length's business.
            for size in lengths.get(word[at : at + 4], (3, 2, 1)):
                if (i := known.get(word[at : at + size])) is not None and at + size <= n:
                    out.append(i)
                    at += size
                    break
        return out

    def learned(self, words: set[str]) -> dict[str, list[int]]:
        """The encodings of words that are not remembered."""
        words = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [*map(self.proposed, raw)]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, where = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fine = self.judged(pairs)
        failed = np.unique(owner[inner[~fine[where]]]).tolist() if len(inner) else []
        for i, ids in zip(failed, self.merged([raw[i] for i in failed])):
            guess[i] = [*map(self.numbers.__getitem__, ids)]
        return dict(zip(words, guess))

    def judged(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours (one number, in order) is compatible; what was found before is remembered, for as many pairs as the cache has words."""
        at = np.minimum(np.searchsorted(self.known_pairs, pairs), max(len(self.known_pairs) - 1, 0))
        old = self.known_pairs[at] == pairs if len(self.known_pairs) else np.zeros(len(pairs), bool)
        fine = np.zeros(len(pairs), bool)
        fine[old] = self.known_fine[at[old]]
        new = pairs[~old]
        fine[~old] = self.compatible(new >> 32, new & 0xFFFFFFFF)
        if len(self.known_pairs) > CACHE_WORDS:
            self.known_pairs, self.known_fine = pairs, fine
        elif len(new):
            both, first = np.unique(np.concatenate([self.known_pairs, new]), return_index=True)
            self.known_pairs, self.known_fine = both, np.concatenate([self.known_fine, fine[~old]])[first]
        return fine

    def form(self, ids: list[int]) -> tuple[int, str, bytes]:
        """What digests need of token ids: their number, their decimal form, and the bytes they decode to."""
        return len(ids), ",".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def cut_up(self, texts: list[str | None]) -> tuple[list[list[tuple[int, list[str]]]], set[str]]:
        """For each text its parts: a special token's id, or -1 and the words of a stretch between; and the set of all words. A null text is empty."""
        parts: list[list[tuple[int, list[str]]]] = []
        for text in texts:
            pieces = self.cut.split(text) if text and self.cut else [text or ""]
            parts.append([(self.special[p], []) if i % 2 else (-1, (self.pattern if _NOT_LATIN.search(p) else self.latin).findall(p)) for i, p in enumerate(pieces)])
        return parts, set(chain.from_iterable(w for doc in parts for _, w in doc))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text. Special tokens' own strings become their ids; a null or empty text has none."""
        parts, words = self.cut_up(texts)
        known = self.words.of(words).__getitem__
        return [[*chain.from_iterable([one] if one >= 0 else chain.from_iterable(map(known, ws)) for one, ws in doc)] for doc in parts]

    def digest_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of its tokens and the SHA-256 of their comma-joined ids and of the text they decode to, word by word: no list of ids is made."""
        parts, words = self.cut_up(texts)
        known = self.forms.of(words).__getitem__
        out = []
        for doc in parts:
            forms = [*chain.from_iterable([self.form([one])] if one >= 0 else map(known, ws) for one, ws in doc)]
            decoded = b"".join(map(_RAW, forms)).decode("utf-8", "replace").encode()
            out.append((sum(map(_COUNT, forms)), hashlib.sha256(",".join(map(_DECIMAL, forms)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@contextmanager
def _uncollected():
    """Without Python's search for cycles: there are none here, and it would look through all that is remembered again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def _vocabulary(definition: bytes) -> Vocabulary:
    return Vocabulary(definition)


#: Characters that are encoded together at most, so that memory stays bounded whatever the batch holds.
GROUP_CHARS = 4_000_000


def _groups(texts: list[str | None]):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(df: DataFrame, definition: bytes, text_col: str = "text", out_col: str = "ids", with_count: str | None = None) -> DataFrame:
    """df with its token ids (array of int) appended as out_col, and their number as with_count if that is given; definition is a byte-level BPE tokenizer file's content.

    A null or empty text gets an empty array. An existing column out_col is replaced.
    """
    kept = df.drop(out_col, *([with_count] if with_count else []))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocabulary(definition)
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        with _uncollected():
            ids = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(pa.array(v.encode_batch(g), pa.list_(pa.int32())) for g in _groups(texts))])
        new = {out_col: ids} | ({with_count: ids.value_lengths().cast(pa.int64())} if with_count else {})
        return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    schema = StructType([*kept.schema.fields, StructField(out_col, ArrayType(IntegerType()))])
    if with_count:
        schema = StructType([*schema.fields, StructField(with_count, LongType())])
    return per_batch(kept, work, schema, text_col)


def decode(df: DataFrame, definition: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of its token ids appended as out_col. Null ids give a null text."""
    kept = df.drop(out_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocabulary(definition)
        texts = [None if x is None else v.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    schema = StructType([*kept.schema.fields, StructField(out_col, StringType())])
    return per_batch(kept, work, schema)


def digests(df: DataFrame, definition: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and the SHA-256 of the comma-joined ids and of the decoded text, made in one pass.

    Repeated rows stay; a null text counts as empty; other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocabulary(definition)
        with _uncollected():
            found = [x for group in _groups(batch.column(1).to_pylist()) for x in v.digest_batch(group)]
        counts, of_ids, of_text = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(slim, work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "text")
