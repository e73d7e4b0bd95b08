"""Line deduplication: range partitions of line hashes, sorted by document and place.

Lines of every text are reduced to 128-bit hashes of their keys (stripped at both ends, A-Z lowered)
with the document and the line number. They are range-partitioned on (hash, document, line) and
sorted, the largest document first, so that in a run of one hash the first document met is the one
that keeps its lines. A partition is streamed in batches; a run that begins and reaches the least
number of documents inside one partition is decided there. The range bounds may cut a run of a very
common line: such runs are handed on as *open* rows, with at most two boundary hashes for each
partition, and are decided from counts over these rows alone. No group of equal lines is gathered.

What comes back for each document is a compressed bitmap of the lines to keep, not text; the texts
are filtered by it in a last pass.

Defined results: a null or empty text has one empty line; a null document id is smaller than any
other and counts as a document; rows repeated with the same id count as one document and each gives
an output row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.sieve import sieve, sifted
from notelake.session import materialize, partitions, ship

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs, keys, places = [], [], [], []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tkeys = batch.column(1).to_numpy(zero_copy_only=False)
            for doc, tkey, text in zip(ids, tkeys, batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                for place, line in enumerate(data.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(SPACE)
                    if len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
                        continue
                    hashes.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    keys.append(tkey)
                    places.append(place)
            two = np.frombuffer(b"".join(hashes), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pa.array(np.array(docs, dtype=np.int64)), pa.array(np.array(keys, dtype=np.int64)), pa.array(np.array(places, dtype=np.int32))],
                names=["h1", "h2", "doc", "tkey", "place"],
            )

    return run


DROP, OPEN, FACT = 0, 1, 2


def _stream(min_docs: int):
    """Sorted rows in, marks out: DROP, or OPEN and FACT for a run that crosses a range bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "tkey", "place"]
        run_key = None  # of the run that the last batch left open
        first_run = True
        keeper = last_doc = None
        n_docs = 0
        held: list[np.ndarray] = []  # its rows, while fewer than min_docs documents are known

        def out(rows: np.ndarray, state: int) -> pa.RecordBatch:
            cols = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(rows[:, 4].astype(np.int32)), pa.array(np.full(len(rows), state, dtype=np.int32))], names=[*names, "state"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            new = np.empty(len(rows), dtype=bool)
            new[0] = run_key is None or tuple(rows[0, :2]) != run_key
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new)
            head = starts[0] if len(starts) else len(rows)
            segments = []
            if head:  # goes on with the run that is open
                segments.append((0, head, False))
            if len(starts) > 1:
                # runs that lie inside this batch: those of one document in all are of no interest
                stops = starts[1:]
                newdoc = new.copy()
                newdoc[1:] |= rows[1:, 2] != rows[:-1, 2]
                docs_before = np.concatenate([[0], np.cumsum(newdoc)])
                inside = docs_before[stops] - docs_before[starts[:-1]]
                wanted = inside >= min_docs
                wanted[0] |= run_key is None  # the partition's first run is handed on as it is
                segments += [(starts[k], stops[k], True) for k in np.flatnonzero(wanted)]
            if len(starts):
                segments.append((starts[-1], len(rows), True))
            for lo, hi, begins in segments:
                part = rows[lo:hi]
                if begins:
                    if run_key is not None:
                        first_run = False
                    run_key, keeper, last_doc, n_docs, held = tuple(part[0, :2]), part[0, 2], None, 0, []
                changed = np.flatnonzero(np.diff(part[:, 2])).size
                n_docs += changed + (last_doc is None or part[0, 2] != last_doc)
                last_doc = part[-1, 2]
                if first_run:
                    yield out(part, OPEN)
                elif n_docs < min_docs:
                    held.append(part)
                else:
                    rest = np.concatenate([*held, part]) if held else part
                    held = []
                    rest = rest[rest[:, 2] != keeper]
                    if len(rest):
                        yield out(rest, DROP)
        if run_key is not None and not first_run:
            if n_docs < min_docs:
                yield out(np.concatenate(held), OPEN)
            else:
                yield out(np.array([[*run_key, keeper, 0, 0]], dtype=np.int64), FACT)

    return run


def _bitmap(places: list[int]) -> bytes:
    drop = np.asarray(places, dtype=np.int64)
    bits = np.ones(-(-(int(drop.max()) + 1) // 8) * 8, dtype=np.uint8)  # whole bytes
    bits[drop] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def kept_lines(lines: list[bytes], bitmap: bytes | None) -> list[bytes]:
    """Lines beyond the bitmap's end stay."""
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    tail = len(lines) - len(bits)
    keep = np.concatenate([bits, np.ones(tail, dtype=np.uint8)]) if tail > 0 else bits
    return [line for line, k in zip(lines, keep) if k]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, tkey, bitmap) of the documents that lose a line. docs: doc, tkey, text."""
    spark = docs.sparkSession
    ship(spark)
    # written first: the ranges are found by sampling, which would hash all lines again
    lines = materialize(docs.mapInArrow(_lines(min_chars), "h1 long, h2 long, doc long, tkey long, place int"), "hashes")
    n = partitions(lines)
    by = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tkey"), F.col("place")]
    marks = materialize(
        lines.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_stream(min_docs), "h1 long, h2 long, doc long, tkey long, place int, state int"), "lines"
    )
    # one or two boundary hashes for each partition. A document counts once for a hash: these are told apart first, dealt by hash and
    # document, so what is left for a hot hash is one partial count a task
    each = marks.where(f"state <> {DROP}").groupBy("h1", "h2", "doc").agg(F.max(F.when(F.col("state") == OPEN, 1).otherwise(0)).alias("open"), F.max("state").alias("known"))
    crossing = each.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.sum("open").alias("docs"), F.max("known").alias("known")).where((F.col("docs") >= min_docs) | (F.col("known") == FACT))
    decided = marks.where(f"state = {OPEN}").join(crossing, ["h1", "h2"]).where("doc <> keeper").select("doc", "tkey", "place")
    drops = marks.where(f"state = {DROP}").select("doc", "tkey", "place").unionByName(decided)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_bitmap(x.as_py()) for x in batch.column(2)], type=pa.binary())], names=["doc", "tkey", "bitmap"])

    return drops.groupBy("doc", "tkey").agg(F.collect_set("place").alias("places")).mapInArrow(pack, "doc long, tkey long, bitmap binary")


def _with_bitmaps(documents: DataFrame, doc_id: str, text: str, carry: list[str], min_chars: int, min_docs: int) -> DataFrame:
    keyed = documents.select(
        F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry if c != text)).alias("row")
    )
    bitmaps = materialize(keep_bitmaps(keyed.select("doc", "tkey", "text"), min_chars, min_docs), "bitmaps")
    # texts that lose no line stay where they are read
    rows = sifted(keyed, sieve(bitmaps, "tkey"), "tkey")
    whole = rows.where("not maybe").select("row", "text", F.lit(None).cast("binary").alias("bitmap"))
    return whole.unionByName(rows.where("maybe").join(bitmaps, ["doc", "tkey"], "left").select("row", "text", "bitmap"))


def dedup_digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, digests = [], [], []
            for text_, bitmap in zip(batch.column(1), batch.column(2)):
                data = (text_.as_py() or "").encode("utf-8", "surrogatepass")
                if not bitmap.is_valid:
                    total.append(data.count(b"\n") + 1)
                    dropped.append(0)
                else:
                    lines = data.split(b"\n")
                    kept = kept_lines(lines, bitmap.as_py())
                    total.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                    data = b"\n".join(kept)
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_bitmaps(documents, doc_id, text, [doc_id], min_chars, min_docs)
    return rows.select(F.col(f"row.{doc_id}").alias("doc_id"), "text", "bitmap").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``documents`` with the repeated lines gone from the text (n_chars follows, if named).

    A null text stays null.
    """
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def cut(texts, bitmaps):
        return texts.combine(bitmaps, lambda t, b: t if t is None or b is None else b"\n".join(kept_lines(t.encode("utf-8", "surrogatepass").split(b"\n"), b)).decode("utf-8", "surrogatepass"))

    rows = _with_bitmaps(documents, doc_id, text, documents.columns, min_chars, min_docs)
    rows = rows.withColumn("new", F.when(F.col("bitmap").isNotNull(), cut("text", "bitmap")).otherwise(F.col("text")))
    changed = {text: F.col("new")} | ({n_chars: F.when(F.col("bitmap").isNotNull(), F.length("new").cast("long")).otherwise(F.col(f"row.`{n_chars}`"))} if n_chars else {})
    return rows.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


ORACLE_SQL = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, unnest(range(len(l))) as i, unnest(l) as line from d),
k as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
f as (select key, max(doc_id) as keeper from k where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}),
g as (select k.doc_id, k.i, k.line, f.key is not null and k.doc_id <> f.keeper as gone from k left join f on f.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from g group by doc_id"""
