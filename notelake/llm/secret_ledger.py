"""Secret scans over an incremental ledger of content-addressed blobs (DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its text. The ledger holds one row for
each (blob, rule, rule version) that has ever been scanned, findings or none. A scan takes from the
incoming versions one representative path for each blob, keeps the blobs for which some current
(rule, version) pair is absent from the ledger, runs only those rules there, appends what it found,
and joins the findings back to all paths of the blob. A text is scanned where it is read if its blob is
new and has one path; others are moved once, to their representative. What is grouped and joined by blob is digests, so copies that make up a third of all rows are
combined on the map side and split by the adaptive skew join.

Defined results: a null text is an empty text; null paths and repeated rows are paths like any
other and give one output row each; an empty table gives no rows; further columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.sieve import sieve, sifted
from notelake.session import materialize, scratch


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if ``group`` has ``least`` characters.

    Raise ``version`` whenever the pattern changes: known blobs are then scanned again for this
    rule alone. ``hint`` is a plain necessary condition, tried before the pattern.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")

#: Base rules first, in the order in which ties at one start are listed.
BASE_RULES = (
    Rule("assign", 1, rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"[0-9a-f]+", 32),
)
#: Added spans: key files and keys with a vendor's prefix.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    Rule("prefixed", 1, r"(sk|pk|rk|ghp|gho|ghs|xoxb|xoxp|glpat)[-_][A-Za-z0-9_-]+", 20),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


#: Matches that are walked in one go; a list is copied for each element that is put to it.
WALK = 256
SPANS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of one rule, in code points, end exclusive.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches, so
    running lengths give the places; a match that is too short stays in the running length. Very many
    matches are walked in pieces, each from the sum of the lengths before it.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(
        F.transform(whole, F.length).alias("n"),
        F.transform(tested, F.length).alias("t"),
        F.transform(F.slice(gaps, 1, F.size(whole)), F.length).alias("gap"),
    )

    def walked(piece: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))
        span = lambda acc, m: F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["n"]).alias("end"))
        step = lambda acc, m: F.struct((acc["at"] + m["gap"] + m["n"]).alias("at"), F.when(m["t"] >= rule.least, F.array_append(acc["spans"], span(acc, m))).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(piece, none, step)["spans"]

    def cut(all_rows: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / WALK).cast("int")), lambda k: F.slice(all_rows, k * WALK + 1, F.lit(WALK)))
        length = lambda piece: F.aggregate(piece, F.lit(0), lambda a, m: a + m["gap"] + m["n"])
        placed = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")),
            lambda acc, piece: F.struct((acc["at"] + length(piece)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")),
        )["starts"]
        return F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), placed.alias("start")), lambda x: walked(x["piece"], x["start"])))

    # bound once: named inside the lambdas the matches would be found anew for each of them
    found = F.transform(F.array(rows), lambda r: F.when(F.size(r) <= WALK, walked(r, F.lit(0))).otherwise(cut(r)))
    likely = rule.pattern if rule.group else rule.pattern.removesuffix("+") + f"{{{max(1, rule.least - 4)}}}" if rule.pattern == "[0-9a-f]+" else rule.pattern
    return F.when(text.rlike(likely), F.get(found, F.lit(0))).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _seen(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except Exception as e:  # a ledger that was never written is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def addresses(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """at (struct of the path), blob of every row, written: no text is hashed for them again."""
    return materialize(versions.select(F.struct(F.col(path).alias("p")).alias("at"), blob_of(F.col(text)).alias("blob")), "addresses")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text", known_as: DataFrame | None = None) -> DataFrame:
    """Scan the unseen (blob, rule version) pairs of ``versions``, append them to ``ledger``.

    Returns the appended rows' ledger, i.e. the whole ledger read again. known_as: ``addresses`` of the versions, if there.
    """
    spark = versions.sparkSession
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    named = addresses(versions, path, text) if known_as is None else known_as
    one = named.groupBy("blob").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    seen = _seen(spark, ledger).groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    known = F.coalesce("done", F.expr("cast(array() as array<struct<rule:string,version:int>>)"))
    state = materialize(one.join(seen, "blob", "left").select("at", "blob", "n", F.array_except(wanted, known).alias("todo")), "blobs")
    # a blob of one path that no rule has seen is scanned where it is read; texts of others are moved to their representative
    shared = named.join(state.where((F.col("n") > 1) | (F.size("todo") < len(rules))).select("blob"), "blob", "left_semi")
    keyed = versions.select(F.struct(F.col(path).alias("p")).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("pkey", F.xxhash64("at"))
    rows = sifted(keyed, sieve(shared.select(F.xxhash64("at").alias("pkey")), "pkey"), "pkey").withColumn("blob", blob_of(F.col("body")))
    moved = rows.where("maybe").join(state.where(F.size("todo") > 0).select("at", "blob", "todo"), ["at", "blob"]).select("blob", "body", "todo")
    found = rows.where("not maybe").select("blob", "body", wanted.alias("todo")).unionByName(moved).select(
        "blob",
        "todo",
        F.array(
            *(
                F.struct(
                    F.lit(r.kind).alias("rule"),
                    F.lit(r.version).alias("version"),
                    F.when(F.array_contains(F.col("todo"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))), spans_of(F.col("body"), r)).alias("spans"),
                )
                for r in rules
            )
        ).alias("each"),
    )
    told = found.select("blob", F.explode(F.filter("each", lambda x: x["spans"].isNotNull())).alias("x")).select("blob", "x.rule", "x.version", "x.spans")
    told.write.mode("append").parquet(ledger)
    return _seen(spark, ledger)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text", known_as: DataFrame | None = None) -> DataFrame:
    """(path, spans): for every row of ``versions`` the spans of the current rule versions.

    spans is array<struct<start, rank, end, kind>> in order; rank is the rule's place in ``rules``. known_as: ``addresses`` of the versions, if there.
    """
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind} {r.version}"), F.lit(i))))
    flat = (
        ledger.where(F.size("spans") > 0)
        .withColumn("rank", F.try_element_at(order, F.concat_ws(" ", "rule", "version")))
        .where("rank is not null")
        .dropDuplicates(["blob", "rule", "version"])  # a repeated row may have been scanned twice
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind"))).alias("spans"))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    paths = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob")) if known_as is None else known_as.select("at.p", "blob").withColumnRenamed("p", "path")
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    return paths.join(flat, "blob", "left").select("path", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """The digest columns of every row of ``documents`` (doc_id, text); a new ledger unless one is named."""
    ledger = ledger or scratch(documents.sparkSession, "secrets")
    named = addresses(documents, "doc_id")
    found = findings(documents, scan(documents, ledger, path="doc_id", known_as=named), path="doc_id", known_as=named)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    def rows(rule: Rule, rank: int) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
        select doc_id, '{rule.kind}' as kind, {rank} as rank, t, n, gap,
            sum(gap + n) over (partition by rid order by i) - n as start
        from (select rid, doc_id, unnest(range(len(m))) as i, unnest(list_transform(m, lambda x: length(x))) as n,
                unnest(list_transform(g, lambda x: length(x))) as t, unnest(list_transform(p[1:len(m)], lambda x: length(x))) as gap
              from (select rid, doc_id, regexp_extract_all(text, '{pattern}') as m,
                      regexp_extract_all(text, '{pattern}', {rule.group}) as g, string_split_regex(text, '{pattern}') as p from d))"""

    parts = " union all ".join(f"select doc_id, kind, rank, start, start + n as stop from ({rows(r, i)}) where t >= {r.least}" for i, r in enumerate(RULES))
    span = "kind || ':' || start || ':' || stop"
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents), s as ({parts}), a as (
        select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
            count(*) filter (kind = 'hex') as n_hex,
            sha256(coalesce(string_agg({span}, ',' order by start, rank) filter (rank < {len(BASE_RULES)}), '')) as base_sha256,
            string_agg({span}, ',' order by start, rank) as spans from s group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans
    from d left join a on a.doc_id = d.doc_id"""


ORACLE_SQL = _oracle()
