"""Byte-pair encoding in batched numpy merge rounds, and decoding.

``MergeRounds`` keeps the symbols of many words end to end in one array. In each round every
word merges all places of its lowest-rank pair. The rank of a pair is found by binary search
over the sorted pair keys, and only pairs beside a merge are looked up again. A merged symbol is
younger than the merge that made it, so merging all places of the lowest pair at once gives what
one merge at a time gives.

``encode_documents`` is the operator: it encodes whole texts, every word once a block, and joins the
ids. Ids and decoded texts equal those of the tokenizers library. A tokenizer file whose word rules are
none of ``FORMS`` is refused. A null or empty text has no tokens and decodes to the empty text; a null id is
kept; repeated rows are encoded each; an empty table gives no row; other columns of the frame are not looked
at. Memory: a slice of texts (4 MB, or one longer text) and a table of words of fixed size in each worker.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallyframe.llm._common import id_and_text, mixed, slices, strings

#: Classes of bytes in plain texts; every byte from 128 is part of a Latin-1 letter there.
BLANK, LETTER, DIGIT, OTHER, END = range(5)
#: The word rules that ``TextEncoder`` knows, as (normalizer, pre-tokenizer) of a tokenizer file.
FORMS = {
    "folded": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
    "bytes": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
}
#: What keeps a text from being plain: NUL, separators, and Latin-1 signs that aren't letters.
_ODD = re.compile(rb"[\x00\x1c-\x1f\x80-\xbf\xd7\xf7]")
#: Keep the first n of eight bytes.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs = {b: chr(b) for b in kept}
    spare = (chr(256 + i) for i in range(256))
    return [signs[b] if b in signs else next(spare) for b in range(256)]


class MergeRounds:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        signs = byte_alphabet()
        self.first = np.array([vocab.get(s, -1) for s in signs], dtype=np.int64)
        self.last = np.array([vocab.get(s + suffix, -1) for s in signs], dtype=np.int64)
        if (self.first < 0).any() or (self.last < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), at.astype(np.int32)

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each, from the words' bytes end to end."""
        symbols = self.first[data]
        ends = np.cumsum(lengths)
        symbols[ends[lengths > 0] - 1] = self.last[data[ends[lengths > 0] - 1]]
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
        at = np.zeros(len(symbols), dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.empty(0, dtype=np.int64)
        if len(inner):
            rank[inner], at[inner] = self._rank(symbols[inner], symbols[inner + 1])
        done_ids, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(word)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NO_RANK
            if over.any():
                out = np.repeat(over, counts)
                done_ids.append(symbols[out])
                done_words.append(word[out])
                symbols, word, rank, at = symbols[~out], word[~out], rank[~out], at[~out]
                lowest, counts = lowest[~over], counts[~over]
                if not len(symbols):
                    break
            merge = np.flatnonzero(rank == np.repeat(lowest, counts))
            # In a run of overlapping places (aaaa) every other one merges, from the left.
            fresh = np.r_[True, merge[1:] != merge[:-1] + 1]
            run = np.flatnonzero(fresh)
            merge = merge[((np.arange(len(merge)) - run[np.cumsum(fresh) - 1]) & 1) == 0]
            symbols[merge] = self.made[at[merge]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[merge + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            merge = moved[merge]
            beside = np.zeros(len(symbols), dtype=bool)
            beside[merge] = True
            beside[merge[merge > 0] - 1] = True
            near = np.flatnonzero(beside)
            near_inner = near[near < len(word) - 1]
            near_inner = near_inner[word[near_inner] == word[near_inner + 1]]
            rank[near] = NO_RANK
            if len(near_inner):
                rank[near_inner], at[near_inner] = self._rank(symbols[near_inner], symbols[near_inner + 1])
        ids = np.concatenate(done_ids) if done_ids else np.empty(0, dtype=np.int64)
        of = np.concatenate(done_words) if done_words else np.empty(0, dtype=np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(of, minlength=len(lengths)).astype(np.int64)


class TextEncoder:
    """Whole-text ids, many texts at once.

    Texts are cut into words, looked up and joined in numpy: a word of up to 24 bytes is three 64-bit
    numbers, compared in full with a table of words seen before; the others and the longer ones go
    through ``MergeRounds`` once a block. Texts of ASCII and the Latin-1 letters are cut byte by byte, all
    others by code points, whose classes are asked of the library's rules when a worker first meets them.
    Only texts with NULs or special tokens, which aren't words, are encoded by the library alone.
    """

    SLOTS, POOL, BLOCK = 1 << 20, 4 << 20, 1 << 19

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        added = spec.get("added_tokens", [])
        rules = (spec.get("normalizer"), spec.get("pre_tokenizer"))
        form = next((name for name, known in FORMS.items() if known == rules), None)
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for x in added for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
        if form is None or model["type"] != "BPE" or odd or spec.get("post_processor"):
            raise ValueError(f"this encoder doesn't know the tokenizer file's rules: {odd or rules}")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"] for x in added]
        self.folds = form == "folded"
        self.rounds = MergeRounds(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
        self.has_decoder = spec.get("decoder") is not None
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        kind = np.full(256, OTHER, dtype=np.uint8)
        kind[0] = END
        kind[[*range(9, 14), 32]] = BLANK
        kind[[*range(48, 58)]] = DIGIT
        kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
        self.kind = kind
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        #: Classes of code points; 255 is one not met yet.
        self.wide = np.full(0x110000, 255, dtype=np.uint8)
        self.wide[:128] = kind[:128]
        self.wide[28:32] = 255
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((3, self.SLOTS), dtype=np.uint64)
        self.at = np.full(self.SLOTS, -1, dtype=np.int32)
        self.count = np.zeros(self.SLOTS, dtype=np.int32)
        self.pool = np.empty(self.POOL, dtype=np.uint32)
        self.used = 0

    def _is_plain(self, text: str) -> bool:
        try:
            raw = text if text.isascii() else text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(x in text for x in self.special) and not _ODD.search(raw if isinstance(raw, bytes) else raw.encode())

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """The classes of code points, as the library's word rules have them."""
        found = self.wide[points]
        for point in np.unique(points[found == 255]).tolist():
            words = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            sign = chr(point)
            if words("a" + sign) == 1 and words(sign + "a") == 1:
                is_ = LETTER
            elif words("#" + sign) == 1 and words(sign + "#") == 1:
                is_ = OTHER
            elif words("1" + sign + "1") == (3 if self.folds else 1):
                is_ = DIGIT
            else:
                is_ = BLANK
            self.wide[point] = is_
        return self.wide[points]

    def _words(self, flat: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts that each end with a NUL, from their characters and the classes of those."""
        start = np.r_[True, kind[1:] != kind[:-1]] | (kind == END)
        if self.folds:
            start |= kind == DIGIT
        quote = np.flatnonzero(flat[:-2] == 39)
        quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
        if not self.folds:
            quote = quote[(quote == 0) | (flat[quote - 1] != 32)]
        one, two = flat[quote + 1], flat[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[at + 1] = False
            start[at + size] = True
        if not self.folds:
            last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK))
            last = last[kind[last + 1] != END]
            start[last] = True
            start[last[flat[last] == 32] + 1] = False
        first = np.flatnonzero(start)
        ends = np.r_[first[1:], len(flat)]
        keep = kind[first] != END
        if self.folds:
            keep &= kind[first] != BLANK
        return first[keep], ends[keep]

    def _merge(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words lie in the pool, and how many they are."""
        before = np.cumsum(length) - length
        data = flat[np.repeat(first - before, length) + np.arange(int(length.sum()))]
        ids, counts = self.rounds.encode(data, length)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool[: self.used], np.empty(len(ids) + self.POOL // 4, dtype=np.uint32)]
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return at, counts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts end to end, and the number of ids of each."""
        raw = ("\x00".join(texts) + "\x00").encode()
        flat = np.frombuffer(raw + bytes(32), dtype=np.uint8)
        if self.folds:
            flat = self.lower[flat]
            accent = np.flatnonzero(flat == 0xC3) + 1
            accent = accent[flat[accent] <= 0x9E]
            flat[accent] += 32
        part = flat[: len(raw)]
        return self._looked_up(flat, len(raw), *self._words(part, self.kind[part]))

    def _other(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of any characters end to end, and the number of ids of each."""
        if self.folds:
            texts = list(map(self.tokenizer.normalizer.normalize_str, texts))
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        place = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]
        first, ends = self._words(points, self._classes(points))
        raw = joined.encode()
        return self._looked_up(np.frombuffer(raw + bytes(32), dtype=np.uint8), len(raw), place[first], place[ends])

    def _looked_up(self, flat: np.ndarray, size: int, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words from ``first`` to ``ends`` in the bytes of texts that each end with a NUL."""
        if self.used > self.POOL - (self.POOL >> 3):
            self._forget()
        length = ends - first
        eight = np.ndarray(shape=(len(flat) - 7,), dtype="<u8", buffer=flat.data, strides=(1,))
        key = [eight[first + 8 * i] & MASKS[np.clip(length - 8 * i, 0, 8)] if i else eight[first] & MASKS[np.minimum(length, 8)] for i in range(3)]
        with np.errstate(over="ignore"):
            mix = mixed(key[0] + key[1] * np.uint64(0x9E3779B97F4A7C15) + key[2] * np.uint64(0xC2B2AE3D27D4EB4F))
        at = np.full(len(first), -1, dtype=np.int64)
        count = np.zeros(len(first), dtype=np.int64)
        short = length <= 24
        for shift in (0, 32):
            todo = np.flatnonzero((at < 0) & short)
            slot = (mix[todo] >> np.uint64(shift)) & np.uint64(self.SLOTS - 1)
            slot = slot.astype(np.int64)
            same = self.at[slot] >= 0
            for k, seen in zip(key, self.keys):
                same &= seen[slot] == k[todo]
            at[todo[same]], count[todo[same]] = self.at[slot[same]], self.count[slot[same]]
        todo = np.flatnonzero((at < 0) & short)
        if len(todo):
            order = todo[np.lexsort((key[2][todo], key[1][todo], key[0][todo]))]
            fresh = np.r_[True, np.any([k[order[1:]] != k[order[:-1]] for k in key], axis=0)]
            new = order[fresh]
            where, counts = self._merge(flat, first[new], length[new])
            at[order], count[order] = (x[np.cumsum(fresh) - 1] for x in (where, counts))
            for shift in (0, 32):
                slot = ((mix[new] >> np.uint64(shift)) & np.uint64(self.SLOTS - 1)).astype(np.int64)
                free = np.flatnonzero(self.at[slot] < 0)
                free = free[np.unique(slot[free], return_index=True)[1]]
                for k, seen in zip(key, self.keys):
                    seen[slot[free]] = k[new[free]]
                self.at[slot[free]], self.count[slot[free]] = at[new[free]], count[new[free]]
                rest = np.ones(len(new), dtype=bool)
                rest[free] = False
                new = new[rest]
        long = np.flatnonzero(~short)
        if len(long):
            at[long], count[long] = self._merge(flat, first[long], length[long])
        total = np.cumsum(count)
        ids = self.pool[np.repeat(at - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
        stop = np.searchsorted(first, np.flatnonzero(flat[:size] == 0))
        per_text = np.diff(np.r_[0, np.r_[0, total][stop]])
        return ids, per_text

    def _way(self, text: str) -> int:
        """0: plain; 1: by code points; 2: by the library."""
        if self._is_plain(text):
            return 0
        return 2 if "\x00" in text or any(x in text for x in self.special) else 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and the number of ids of each (int64)."""
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        ways = list(map(self._way, texts))
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and ways[stop] == ways[start] and (stop == start or size + len(texts[stop]) <= self.BLOCK):
                size += len(texts[stop])
                stop += 1
            if ways[start] == 2:
                found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts[start:stop]]
                ids, counts[start:stop] = np.concatenate(found), list(map(len, found))
            else:
                ids, counts[start:stop] = (self._other if ways[start] else self._plain)(texts[start:stop])
            out.append(ids)
            start = stop
        return (np.concatenate(out) if out else np.empty(0, dtype=np.uint32)), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8. A tokenizer without a decoder joins its tokens by blanks."""
        if self.has_decoder:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


_encoders: dict[int, TextEncoder] = {}


def encoder(tokenizer_json: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file's content."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(tokenizer_json)
    return _encoders[key]


def load(path: str) -> str:
    """The content of a tokenizer file, which the driver sends to the tasks (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Per row: ``doc_id``, ``ids`` array<int>, ``n_tokens`` long and, with ``decode``, ``decoded`` string."""
    content = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches):
        tool = encoder(content.value)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = tool.encode(strings(part, "text"))
                ends = np.cumsum(counts)
                columns = [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32))),
                    pa.array(counts),
                ]
                if decode:
                    texts = [tool.decode(flat[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
                    columns.append(pa.array(texts, type=pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>, n_tokens long" + ", decoded string" * decode
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)
