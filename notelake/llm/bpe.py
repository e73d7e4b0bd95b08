"""Ids of a word-level BPE tokenizer file, for many texts at once.

Texts are folded and cut into words as the file's pre-tokenizer does it. Most words are met again,
so a worker remembers their ids, up to a bound. The merges run over all unseen words together as
array operations, one merge of each word in a step: lowest rank first, leftmost on ties, as the
tokenizer does it. Whatever lies outside the plain case (letters beyond the Latin blocks, special
tokens, very long words, other kinds of tokenizer file) goes to the tokenizer itself, by
blank-separated stretches, since it never joins across blanks.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Words of which a worker remembers the ids.
MEMORY = 300_000
WIDTHS = (8, 16, 32)
NONE = np.int32(2**31 - 1)
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters up to U+017F are folded alike by Python and the tokenizer, but for the dotted capital I.
_STRANGE = re.compile("[\u0130\u0180-\U0010ffff]")
_ODD_BLANK = re.compile("[\x1c-\x1f]")


class WordBpe:
    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._understood(spec)
        if self.fast:
            self.split = self._pattern()
            self._tables(spec["model"])

    @staticmethod
    def _understood(spec: dict) -> bool:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        return (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
            and parts == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0].get("pattern") == {"Regex": PLAIN_SPLIT}
            and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and spec.get("post_processor") is None
        )

    @staticmethod
    def _pattern() -> re.Pattern:
        """PLAIN_SPLIT over the plain characters, as sets; the branches differ in their first character, so their order is free."""
        kinds: dict[str, str] = {"L": "", "N": "", "": ""}
        for c in map(chr, range(0x180)):
            if not c.isspace():
                k = unicodedata.category(c)[0]
                kinds[k if k in "LN" else ""] += re.escape(c)
        return re.compile(f"[{kinds['L']}]+|'(?:s|t|re|ve|m|ll|d)|[{kinds['']}]+|[{kinds['N']}]")

    def _tables(self, model: dict) -> None:
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[chars[b] + "</w>"] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        order = np.lexsort((rank, keys))
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        order = order[first]
        self.made = made
        # open addressing with a fixed number of probes: pair -> rank
        self.bits = max(18, int(len(order) * 6).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size + 64, -1, dtype=np.int64)
        self.slot_rank = np.full(size + 64, NONE, dtype=np.int32)
        self.probes = 0
        for k, r in zip(keys[order].tolist(), rank[order].tolist()):
            at, n = self._home(k), 1
            while self.slot_key[at] != -1:
                at, n = at + 1, n + 1
            self.slot_key[at], self.slot_rank[at] = k, r
            self.probes = max(self.probes, n)

    def _home(self, key):
        if isinstance(key, int):
            return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = self._home(key)
        got = self.slot_key[at]
        out = np.where(got == key, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((got != key) & (got != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            k, a = key[open_], at[open_] + step
            got = self.slot_key[a]
            hit = got == k
            out[open_[hit]] = self.slot_rank[a[hit]]
            open_ = open_[~hit & (got != -1)]
        return out

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        """All words have 1 to ``width`` bytes."""
        sizes = np.array([len(w) for w in words])
        text = np.zeros((len(words), width), dtype=np.uint8)
        mask = np.arange(width) < sizes[:, None]
        text[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[text]
        row = np.arange(len(words))
        sym[row, sizes - 1] = self.final[text[row, sizes - 1]]
        rank = np.full((len(words), width), NONE, dtype=np.int32)
        ok = np.arange(width - 1) < sizes[:, None] - 1
        rank[:, :-1][ok] = self._ranks(sym[:, :-1][ok], sym[:, 1:][ok])
        who, n = row.copy(), sizes.copy()
        out_sym, out_n = np.zeros_like(sym), sizes.copy()
        col = np.arange(width)
        while len(who):
            at = rank.argmin(1)
            row = np.arange(len(who))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                out_sym[who[done]], out_n[who[done]] = sym[done], n[done]
                keep = ~done
                who, n, sym, rank, at, best = who[keep], n[keep], sym[keep], rank[keep], at[keep], best[keep]
                row = np.arange(len(who))
                if not len(who):
                    break
            beyond = np.minimum(col + (col > at[:, None]), width - 1)
            sym[row, at] = self.made[best]
            sym = np.take_along_axis(sym, beyond, 1)
            rank = np.take_along_axis(rank, np.minimum(col + (col >= at[:, None]), width - 1), 1)
            n -= 1
            rank[row, n - 1] = NONE
            for where, good in ((at - 1, at > 0), (at, at < n - 1)):
                r, w = row[good], where[good]
                rank[r, w] = self._ranks(sym[r, w], sym[r, w + 1])
        flat = out_sym[np.arange(width) < out_n[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(out_n)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _fold(self, text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()

    def _learn(self, new: list[str]) -> None:
        """Folded words that are not known yet."""
        data = [w.encode() for w in new]
        sizes = np.array([len(w) for w in data])
        lo = 1
        for width in WIDTHS:
            some = np.flatnonzero((sizes >= lo) & (sizes <= width)).tolist()
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                self.words.update(zip([new[k] for k in part], self._merge([data[k] for k in part], width)))
            lo = width + 1
        for k in np.flatnonzero(sizes >= lo).tolist():
            self.words[new[k]] = self._plain(new[k])

    def _parts(self, text: str) -> list[str]:
        """Words of a text; in a text with strange characters, some are whole stretches, marked by a blank."""
        if not _STRANGE.search(text) and "<|" not in text:
            return self.split.findall(self._fold(text))
        parts: list[str] = []
        for s in text.split():
            if "<|" in s or _STRANGE.search(s):
                parts.append(" " + s)
                if parts[-1] not in self.words:
                    self.words[parts[-1]] = self._plain(s)
            else:
                parts += self.split.findall(self._fold(s))
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        if len(self.words) > self.memory:
            self.words.clear()
        known = self.words
        rows: list = []
        new: set[str] = set()
        for t in texts:
            # odd blanks are blanks to Python and none to the tokenizer: left to it
            if not self.fast or _ODD_BLANK.search(t):
                rows.append((self._plain(t), None, None))
                continue
            words = self._parts(t)
            ids = list(map(known.get, words))
            if None in ids:
                gaps = [i for i, v in enumerate(ids) if v is None]
                new.update([words[i] for i in gaps])
                rows.append((ids, gaps, [words[i] for i in gaps]))
            else:
                rows.append((b"".join(ids), None, None))
        self._learn(list(new))
        out = []
        for ids, gaps, words in rows:
            if gaps is not None:
                for i, w in zip(gaps, words):
                    ids[i] = known[w]
                ids = b"".join(ids)
            out.append(ids)
        return out


_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One for each worker process; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]
