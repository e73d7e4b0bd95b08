"""Alignment of two tokenizers over a corpus: which ids of one go with which of the other.

A byte-level BPE file (A) and a sentencepiece model (B) cut the same bytes. Offsets at which both end a token cut a text
into groups; each A and B token of one group are linked, and an id pair counts once for each document that holds it linked.

1. Texts are encoded where they are read, many at a time. Their distinct (pair, document) entries, with the number of links of each,
   leave the task as one row for each stripe of A ids (id modulo ``STRIPES``, so frequent ids, which are small, lie apart) in
   an inverted form: distinct pairs, the number of documents of each, gaps between documents, links. All is written once.
2. Pairs are dealt by stripe. A stripe is a dense matrix of counts, its A ids by all B ids; ``np.add.at`` adds the rows into it, and the maximum of a
   row is the count of an A id's best partners. Hot stripes are dealt by stripe and salt first; their matrices, as sparse rows, are added again.
3. A stripe's counts are dealt with its salts, so each task holds one stripe's counts and scores the links of its rows. The sums by batch of documents go
   back to their documents.

Task memory: one dense matrix (ids of A / STRIPES by ids of B longs, 101 MB for 50,257 by 32,000) and one batch of
texts (``BATCH_CHARS``, one text at least). Groups with many tokens are reduced to distinct ids before their product is taken. Nothing reaches the driver.

A's ids come from the ranks of the file, by tiktoken, for texts in Latin letters, and from the tokenizer of the file itself for others and
wherever its merges aren't in the order of its ids; the tests compare the two.

Defined results: a text that is null, empty, or that one of the tokenizers does not give back byte by byte has no tokens: zeros and an
empty string, unhashed; null ids and repeated rows are documents of their own; of ids with several best partners, all are best; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.session import materialize, partitions, ship

STRIPES = 128
BATCH_CHARS = 4_000_000
BATCH_ROWS = 60_000
#: Links of a group beyond which its ids are made distinct first; links made at a time.
WIDE = 4096
AT_A_TIME = 4_000_000
#: Texts without letters beyond the Latin blocks go by ranks.
_STRANGE = re.compile("[^\0-ɏ‐-…]")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Tokenizers:
    """Ids of both sides and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        known = {i: bytes(map(chars.__getitem__, token)) for token, i in spec["model"]["vocab"].items() if i not in added}
        self.bytes_a = [known.get(i, added.get(i, b"")) for i in range(max([*known, *added]) + 1)]
        self.path_a, self._whole = path_a, None
        self.ranks = self._ranked(spec, known)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(self.sp.id_to_piece(i)[3:-1], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self.sp.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))

    @staticmethod
    def _ranked(spec: dict, known: dict[int, bytes]):
        """The encoding by ranks, where the order of ids is that of the merges."""
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        made = [vocab.get(a + b, -1) for a, b in merges]
        if not (plain and split and spec.get("normalizer") is None and made == sorted(made) and len(set(made)) == len(made) and len(known) == len(made) + 256 and min(made, default=256) >= 256):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level splitter's own
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in known.items()}, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        """A's ids by the tokenizer of the file."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path_a)
            self._whole.encode_special_tokens = True
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def ids_a(self, text: str) -> np.ndarray:
        if self.ranks is None or _STRANGE.search(text):
            return self.whole(text)
        return np.array(self.ranks.encode_ordinary(text), dtype=np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space+text by A and of text by B; None if the text has no tokens."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.ids_a(" " + text), np.array(self.sp.encode(text, num_threads=1), dtype=np.int64)
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                return None
        return a, b


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each worker process; it outlives the task."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


# ---------------------------------------------------------------- arrays as bytes


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in as few bytes as its largest needs, compressed."""
    codec, out = pa.Codec("zstd", 1), []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        data = codec.compress(x.astype(f"<u{width}").tobytes(), asbytes=True) if len(x) else b""
        out += [np.array([width, len(x), len(data)], dtype="<u8").tobytes(), data]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd", 1), [], 0
    while at < len(data):
        width, n, size = np.frombuffer(data, dtype="<u8", count=3, offset=at).tolist()
        at += 24
        out.append(np.frombuffer(codec.decompress(data[at : at + size], decompressed_size=n * width, asbytes=True), dtype=f"<u{width}").astype(np.int64) if n else np.zeros(0, dtype=np.int64))
        at += size
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


# ---------------------------------------------------------------- groups and links of a batch


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def _summed(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often they occur or the sums of their weights."""
    if weights is None:
        codes = np.sort(codes)
        first = _starts(codes)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = _starts(codes)
    return codes[first], (np.add.reduceat(weights[order], first) if len(first) else weights[:0])


class Groups:
    """The groups of many texts: their tokens on both sides, in order, as one array a side."""

    def __init__(self, both: list[tuple[np.ndarray, np.ndarray]], size_a: np.ndarray, size_b: np.ndarray):
        empty = np.zeros(0, dtype=np.int64)
        self.a, self.b = (np.concatenate([empty, *(x[side] for x in both)]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        cut = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=bool)
        cut[ends_a] = True
        common = ends_b[cut[ends_b]]
        self.n = len(common)
        self.of_a, self.of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.n_a, self.n_b = np.bincount(self.of_a, minlength=self.n), np.bincount(self.of_b, minlength=self.n)
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        sizes = np.array([len(x[0]) for x in both], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(both)), sizes)[self.first_a] if self.n else empty  # of each group
        self.docs = len(both)

    def per_document(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        links = np.zeros(self.docs, dtype=np.int64)
        np.add.at(links, self.doc, self.n_a * self.n_b)
        return np.bincount(self.doc, minlength=self.docs), links

    def digests(self, both: list[tuple[np.ndarray, np.ndarray]], marks: list[bytes]) -> list[str]:
        """SHA-256 of the ids by group of each text. ``marks``: see :func:`_marks`."""
        third = len(marks) // 6
        at_a = np.arange(len(self.a)) + self.first_b[self.of_a]
        at_b = np.arange(len(self.b)) + (self.first_a + self.n_a)[self.of_b]
        head_a, head_b = np.zeros(len(self.a), dtype=bool), np.zeros(len(self.b), dtype=bool)
        head_a[self.first_a], head_b[self.first_b] = True, True
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        codes[at_a] = self.a + np.where(head_a, third, 0)
        codes[at_b] = self.b + np.where(head_b, 2 * third, 0) + 3 * third
        out, at = [], 0
        for a, b in both:
            end = at + len(a) + len(b)
            out.append(hashlib.sha256(b"".join(map(marks.__getitem__, codes[at:end].tolist()))[1:]).hexdigest())
            at = end
        return out

    def _small(self, code) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Links of groups with few of them, at most about AT_A_TIME at a time."""
        width = np.where((self.n_a * self.n_b <= WIDE)[self.of_a], self.n_b[self.of_a], 0) if self.n else self.a
        total = np.cumsum(width)
        at = 0
        while at < len(width):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_A_TIME, side="right")))
            w = width[at:end]
            i = np.repeat(np.arange(at, end), w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + self.first_b[self.of_a[i]]
            yield code(self.a[i], self.b[j], self.doc[self.of_a[i]]), None
            at = end

    def _wide(self, code) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        for g in np.flatnonzero(self.n_a * self.n_b > WIDE).tolist():
            a, times_a = _summed(self.a[self.first_a[g] : self.first_a[g] + self.n_a[g]])
            b, times_b = _summed(self.b[self.first_b[g] : self.first_b[g] + self.n_b[g]])
            step = max(1, AT_A_TIME // len(b))
            for lo in range(0, len(a), step):
                some = a[lo : lo + step]
                yield code(np.repeat(some, len(b)), np.tile(b, len(some)), np.full(len(some) * len(b), self.doc[g])), np.outer(times_a[lo : lo + step], times_b).ravel()

    def links(self, code) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes of (A id, B id, text) of all links, in order, and the links of each."""
        found = [_summed(*x) for part in (self._small(code), self._wide(code)) for x in part]
        if len(found) == 1:
            return found[0]
        empty = np.zeros(0, dtype=np.int64)
        return _summed(np.concatenate([empty, *(x[0] for x in found)]), np.concatenate([empty, *(x[1] for x in found)]))


def _marks(n: int) -> list[bytes]:
    """Ids with the sign before them: A inside a group, A at its head, unused, then B inside, unused, B at the head."""
    ids = [str(i).encode() for i in range(n)]
    signed = lambda s: [s + i for i in ids]
    return [*signed(b","), *signed(b";"), *ids, *signed(b","), *ids, *signed(b"|")]


FACTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
ENCODED = pa.schema([("batch", pa.int64()), ("idx", pa.int32()), *((c, pa.int64()) for c in FACTS), ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("pairs", pa.binary()), ("posts", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class Stripes:
    """Where an id pair lies: A ids are dealt over the stripes, a stripe is its A ids by all B ids."""

    def __init__(self, n: int, ids_a: int, ids_b: int):
        self.n, self.rows, self.ids_b = n, -(-ids_a // n), ids_b

    @property
    def cells(self) -> int:
        return self.rows * self.ids_b

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a % self.n) * self.rows + a // self.n) * self.ids_b + b


def _encode(path_a: str, path_b: str, stripes: int):
    """doc_id and text in, rows of ENCODED out: one for each text, and one for each stripe of a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(path_a, path_b)
        marks = _marks(max(len(tok.bytes_a), len(tok.bytes_b)))
        grid = Stripes(stripes, len(tok.bytes_a), len(tok.bytes_b))
        number = TaskContext.get().partitionId() << 32

        def made(ids: list, both: list) -> Iterator[pa.RecordBatch]:
            have = [k for k, x in enumerate(both) if x is not None]
            some = [both[k] for k in have]
            groups = Groups(some, tok.size_a, tok.size_b)
            facts = np.zeros((4, len(ids)), dtype=np.int64)
            facts[0, have], facts[1, have] = [len(a) for a, _ in some], [len(b) for _, b in some]
            facts[2, have], facts[3, have] = groups.per_document()
            digests = [""] * len(ids)
            for k, d in zip(have, groups.digests(some, marks)):
                digests[k] = d
            yield _rows(ENCODED, batch=np.full(len(ids), number), idx=np.arange(len(ids), dtype=np.int32), doc_id=ids, groups_sha256=digests, **dict(zip(FACTS[1:], facts)))
            docs, at = len(ids), np.array(have, dtype=np.int64)
            codes, times = groups.links(lambda a, b, doc: grid.place(a, b) * docs + at[doc])
            pair, doc = codes // docs, codes % docs
            bounds = np.searchsorted(pair, np.arange(stripes + 1) * grid.cells)
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = int(bounds[s]), int(bounds[s + 1])
                p, d = pair[lo:hi] - s * grid.cells, doc[lo:hi]
                first = _starts(p)
                gap = _gaps(d)
                gap[first] = d[first]
                row = {"pairs": packed(_gaps(p[first]), np.diff(np.append(first, len(p)))), "posts": packed(gap, times[lo:hi])}
                yield _rows(ENCODED, batch=[number], stripe=[s], **{k: [v] for k, v in row.items()})

        ids, both, chars = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc)
                both.append(tok.encode(text))
                chars += len(text)
                if chars >= BATCH_CHARS or len(ids) >= BATCH_ROWS:
                    yield from made(ids, both)
                    ids, both, chars, number = [], [], 0, number + 1
        if ids:
            yield from made(ids, both)

    return run


# ---------------------------------------------------------------- counts

COUNTED = pa.schema([("stripe", pa.int32()), ("counts", pa.binary())])


def _count(path_a: str, path_b: str, stripes: int, last: bool):
    """stripe and pairs in, by stripe; for each stripe its nonzero counts out, with a mark at the largest of each A id on the ``last`` pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(path_a, path_b)
        grid = Stripes(stripes, len(tok.bytes_a), len(tok.bytes_b))
        block = np.zeros(grid.cells, dtype=np.int64)
        current = None

        def made() -> pa.RecordBatch:
            held = np.flatnonzero(block)
            counts = block[held]
            arrays = [_gaps(held), counts]
            if last:
                arrays.append((counts == block.reshape(grid.rows, grid.ids_b).max(axis=1)[held // grid.ids_b]).astype(np.int64))
            block[held] = 0
            return _rows(COUNTED, stripe=[current], counts=[packed(*arrays)])

        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if current is not None and s != current:
                    yield made()
                current = s
                pairs, n = unpacked(data.as_py())
                np.add.at(block, np.cumsum(pairs), n)
        if current is not None:
            yield made()

    return run


# ---------------------------------------------------------------- scores

SCORED = pa.schema([("batch", pa.int64()), ("sums", pa.binary())])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stripe, role, batch, pairs, posts: a stripe's counts (role 0), then its links. Sums by text of each batch out."""
    held = counts = best = None
    for batch in batches:
        out_batch, out_sums = [], []
        for role, number, pairs, posts in zip(*(batch.column(k) for k in (1, 2, 3, 4))):
            if role.as_py() == 0:
                gaps, counts, best = unpacked(pairs.as_py())
                held = np.cumsum(gaps)
                continue
            gaps, n = unpacked(pairs.as_py())
            step, times = unpacked(posts.as_py())
            at = np.repeat(np.searchsorted(held, np.cumsum(gaps)), n)
            first = np.cumsum(n) - n
            total = np.cumsum(step)
            doc = total - np.repeat(total[first] - step[first], n)
            sums = np.zeros((2, int(doc.max()) + 1), dtype=np.int64)
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * counts[at])
            some = np.flatnonzero(sums[1])
            out_batch.append(number.as_py())
            out_sums.append(packed(_gaps(some), sums[0][some], sums[1][some]))
        if out_batch:
            yield _rows(SCORED, batch=out_batch, sums=out_sums)


RESULT = pa.schema([*((c, pa.int64()) for c in [*FACTS, "n_best", "count_sum"]), ("groups_sha256", pa.string())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, role, sums, idx, FACTS, groups_sha256: the sums of a batch (role 0), then its texts. RESULT out."""
    current, best, total = None, np.zeros(BATCH_ROWS, dtype=np.int64), np.zeros(BATCH_ROWS, dtype=np.int64)
    for batch in batches:
        numbers, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if numbers[lo] != current:
                current = numbers[lo]
                best[:], total[:] = 0, 0
            part = batch.slice(lo, hi - lo)
            if roles[lo] == 0:
                for data in part.column(2):
                    gaps, b, t = unpacked(data.as_py())
                    at = np.cumsum(gaps)
                    best[at] += b
                    total[at] += t
            else:
                at = part.column(3).to_numpy()
                columns = [*part.columns[4 : 4 + len(FACTS)], pa.array(best[at]), pa.array(total[at]), part.column(4 + len(FACTS))]
                yield pa.RecordBatch.from_arrays(columns, schema=RESULT)


def align(documents: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, stripes: int = STRIPES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = documents.sparkSession
    ship(spark)
    path_a, path_b = (x or y for x, y in zip((tokenizer_a, tokenizer_b), default_tokenizers()))
    encoded = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(path_a, path_b, stripes), _ddl(ENCODED))
    encoded = materialize(encoded, "aligned")
    texts, links = encoded.where("stripe is null"), encoded.where("stripe is not null")
    n = partitions(encoded)
    salts = -(-n // stripes)  # parts of a stripe, by batch
    links = links.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    pairs = links.select("stripe", "salt", "pairs")
    if salts > 1:
        parts = pairs.repartition(n, "stripe", "salt").sortWithinPartitions("stripe").select("stripe", "pairs")
        pairs = parts.mapInArrow(_count(path_a, path_b, stripes, False), _ddl(COUNTED)).withColumnRenamed("counts", "pairs")
    counted = pairs.repartition(min(n, stripes), "stripe").sortWithinPartitions("stripe").select("stripe", "pairs").mapInArrow(_count(path_a, path_b, stripes, True), _ddl(COUNTED))
    counted = materialize(counted, "aligned-counts")
    dealt = counted.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("batch"), F.col("counts").alias("pairs"), F.lit(None).cast("binary").alias("posts"))
    dealt = dealt.union(links.select("stripe", "salt", F.lit(1).alias("role"), "batch", "pairs", "posts"))
    dealt = dealt.repartition(n, "stripe", "salt").sortWithinPartitions("stripe", "salt", "role").select("stripe", "role", "batch", "pairs", "posts")
    sums = dealt.mapInArrow(_score, _ddl(SCORED)).select("batch", F.lit(0).alias("role"), "sums")
    back = sums.unionByName(texts.select("batch", F.lit(1).alias("role"), "idx", *FACTS, "groups_sha256"), allowMissingColumns=True)
    back = back.select("batch", "role", "sums", "idx", *FACTS, "groups_sha256").repartition(n, "batch").sortWithinPartitions("batch", "role")
    return back.mapInArrow(_gather, _ddl(RESULT))
