"""Validation of note contracts, quality gates, link status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.dates import recall_stale
from notelake.functions.text import SLUG, fenced_blocks, first_banned

# The note contract, in the order of its keys. type, required, and the bounds of each kind.
TYPES = ["concept", "howto", "pattern", "pitfall", "decision", "api", "incident"]
CONFIDENCES = ["high", "medium", "low"]
ORIGINS = ["ask", "session-capture", "garden", "import"]
SOURCE_KINDS = ["official", "spec", "blog", "paper", "video", "forum", "code", "session"]
STAGES = ["intake", "recall", "plan", "research", "synthesize", "verify", "write", "link", "index"]
LOCKED_STAGES = ["recall", "write", "index"]
CONTRACT = {
    "title": {"type": "string", "required": True, "length": (3, 120)},
    "slug": {"type": "string", "required": True, "pattern": SLUG, "length": (None, 80)},
    "type": {"type": "enum", "required": True, "values": TYPES},
    "stack": {"type": "list", "required": True, "items": (1, 6), "closed": True},
    "tags": {"type": "list", "required": True, "items": (1, 8), "item": SLUG},
    "depth": {"type": "int", "required": True, "range": (1, 5)},
    "confidence": {"type": "enum", "required": True, "values": CONFIDENCES},
    "created": {"type": "date", "required": True},
    "updated": {"type": "date", "required": True},
    "verified": {"type": "date", "required": True},
    "freshness_days": {"type": "int", "required": True, "range": (1, 3650)},
    "sources": {"type": "objects", "required": True, "items": (0, None)},
    "related": {"type": "list", "required": True, "items": (0, None), "item": r"^\[\[[^\]]+\]\]$"},
    "supersedes": {"type": "list", "required": True, "items": (0, None), "item": SLUG},
    "code_refs": {"type": "list", "required": False, "items": (0, None), "item": r"^[A-Za-z0-9._-]+:[^:#]+(:\d+)?(#[A-Za-z_][A-Za-z0-9_.]*)?$"},
    "forge_version": {"type": "string", "required": True, "pattern": r"^\d+\.\d+\.\d+$"},
    "origin": {"type": "enum", "required": True, "values": ORIGINS},
    "engine_trail": {"type": "list", "required": False, "item": f"^({'|'.join(STAGES)})=(none|host|api|advisor)$"},
}
SOURCE_FLOOR = {"concept": 1, "howto": 1, "pattern": 1, "pitfall": 1, "api": 1, "decision": 0, "incident": 0}
FRESHNESS_BY_TYPE = {"concept": 365, "pattern": 365, "pitfall": 365, "decision": 730, "howto": 180, "api": 180, "incident": 730}
DATE = r"^\d{4}-\d{2}-\d{2}$"
#: What a failing gate recommends, and which of it does not keep a draft out.
REMEDIES = {"schema": "retry_once", "citation": "mark_unverified", "code": "drop_confidence", "freshness": "drop_confidence", "antislop": "rewrite_pass", "link": "delegate_to_librarian", "duplicate": "switch_to_update"}
SOFT_REMEDIES = ["none", "delegate_to_librarian", "switch_to_update"]
VERDICTS = ["pass", "skipped", "fail"]


def by_type(table: dict[str, int], kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), kind)


def issue_list(stacks: list[str], aliases: dict[str, dict[str, str]], contract: dict[str, dict] | None = None) -> Column:
    """array<struct<key, code>>: every broken rule of a note, told from its row alone; list items give an issue each.

    The row: error (why the frontmatter could not be read: 'no-frontmatter', 'bad-yaml', or null), keys
    array<string> as written, and of each key of the contract a column: text of scalars, array<string> of
    lists, array<struct<url, accessed, kind>> of sources; null is a missing key. A note with an error has that one issue.
    """
    rules: list[Column] = []
    contract = contract or CONTRACT
    day = lambda x: x.rlike(DATE) & F.try_to_date(x, "yyyy-MM-dd").isNotNull()
    none = F.expr("cast(array() as array<struct<key:string,code:string>>)")

    def one(key: Column | str, code: str, where: Column) -> None:
        found = F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), F.lit(code).alias("code"))
        rules.append(F.when(where, F.array(found)).otherwise(none))

    def scalar(rule: dict, x: Column) -> list[tuple[str, Column]]:
        told = []
        if "values" in rule:
            told.append(("not-in-enum", ~x.isin(rule["values"])))
        if rule["type"] == "date":
            told.append(("bad-date", ~F.coalesce(day(F.btrim(x, F.lit("\"' "))), F.lit(False))))
        if "pattern" in rule:
            told.append(("bad-format", ~x.rlike(rule["pattern"])))
        if rule["type"] == "int":
            number = x.rlike(r"^[+-]?\d{1,18}$")
            low, high = rule["range"]
            told += [("not-an-int", ~number), ("out-of-range", number & ~x.try_cast("long").between(low, high))]
        if "length" in rule:
            low, high = rule["length"]
            told += [("too-short", F.octet_length(x) < low)] if low else []
            told += [("too-long", F.octet_length(x) > high)] if high else []
        return [("empty", x == ""), *((code, (x != "") & bad) for code, bad in told)]

    def listed(key: str, rule: dict, x: Column) -> None:
        low, high = rule.get("items", (None, None))
        if low:
            one(key, "too-few", F.size(x) < low)
        if high:
            one(key, "too-many", (F.size(x) > high) & (F.size(x) >= (low or 0)))
        if rule["type"] == "objects":
            odd = F.transform(F.filter(x, lambda i: i.isNull()), lambda i: F.struct(F.lit(key).alias("key"), F.lit("bad-item").alias("code")))
            rules.append(F.coalesce(odd, none))
            return
        names = list(aliases.get(key, {}))
        # of the rules of an item the first that is broken counts
        code = lambda i: F.when(i.isin(names) if names else F.lit(False), "alias").when(i != F.lower(i), "not-lowercase").when(~i.isin(stacks) if rule.get("closed") else F.lit(False), "not-in-vocabulary").when(~i.rlike(rule["item"]) if "item" in rule else F.lit(False), "bad-item")
        found = F.filter(F.transform(x, lambda i: F.struct(F.lit(key).alias("key"), code(i).alias("code"))), lambda i: i["code"].isNotNull())
        rules.append(F.when(x.isNotNull(), found).otherwise(none))

    for key, rule in contract.items():
        x = F.col(key)
        if rule["required"]:
            one(key, "missing", x.isNull())
        if rule["type"] in ("list", "objects"):
            listed(key, rule, x)
        else:
            for code, bad in scalar(rule, x):
                one(key, code, x.isNotNull() & bad)
    known = F.array(*map(F.lit, contract))
    rules.append(F.transform(F.array_except("keys", known), lambda k: F.struct(k.alias("key"), F.lit("unknown-key").alias("code"))))
    # the first key that stands after a later one
    ranks = F.filter(F.transform("keys", lambda k: F.struct(F.array_position(known, k).alias("rank"), k.alias("key"))), lambda k: k["rank"] > 0)
    late = F.filter(F.transform(ranks, lambda k, i: F.when((i > 0) & (F.get(ranks, i - 1)["rank"] > k["rank"]), k["key"])), lambda k: k.isNotNull())
    one(F.get(late, F.lit(0)), "key-order", F.size(late) > 0)
    sound = lambda k: F.coalesce(day(F.btrim(F.col(k), F.lit("\"' "))), F.lit(False))
    for key in ("updated", "verified"):
        one(key, "date-order", sound(key) & sound("created") & (F.btrim(F.col(key), F.lit("\"' ")) < F.btrim(F.col("created"), F.lit("\"' "))))
    one("sources", "uncited", F.coalesce(F.size("sources"), F.lit(0)) < by_type(SOURCE_FLOOR, F.col("type")))
    for name, rule in (("url", {"type": "string"}), ("accessed", {"type": "date"}), ("kind", {"type": "enum", "values": SOURCE_KINDS})):
        at = lambda i, name=name: F.concat(F.lit("sources["), i.cast("string"), F.lit(f"].{name}"))
        for code, bad in [("missing", None), *scalar(rule, F.lit(""))]:
            pick = (lambda v, code=code, rule=rule: dict(scalar(rule, v))[code]) if bad is not None else None
            broken = lambda s, pick=pick, name=name: (s.isNotNull() & s[name].isNull()) if pick is None else s[name].isNotNull() & pick(s[name])
            found = F.filter(F.transform("sources", lambda s, i: F.when(broken(s), F.struct(at(i).alias("key"), F.lit(code).alias("code")))), lambda s: s.isNotNull())
            rules.append(F.coalesce(found, none))
    trail = F.filter(F.coalesce("engine_trail", F.expr("cast(array() as array<string>)")), lambda e: ~trail_sound(e))
    rules.append(F.transform(trail, lambda e: F.struct(F.lit("engine_trail").alias("key"), F.lit("engine-invariant").alias("code"))))
    return F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("").alias("key"), F.col("error").alias("code")))).otherwise(F.flatten(F.array(*(F.coalesce(r, none) for r in rules))))


def issues(notes: DataFrame, stacks: list[str], aliases: dict[str, dict[str, str]], contract: dict[str, dict] | None = None) -> DataFrame:
    """rel, key, code for every broken rule of every note, in one pass over the notes. notes: rel, and the columns of :func:`issue_list`."""
    return notes.select("rel", F.explode(issue_list(stacks, aliases, contract)).alias("i")).select("rel", "i.key", "i.code")


def trail_sound(entry: Column) -> Column:
    """A locked stage may only have been served by no engine; what is not ``stage=engine`` is not judged."""
    return ~entry.rlike(rf"\A({'|'.join(LOCKED_STAGES)})=(?!none\z)")


def merged_trail(trail: Column, stage: Column, engine: Column) -> Column:
    """The trail with one entry for the stage, its latest, sorted."""
    entry = F.concat(stage, F.lit("="), engine)
    return F.array_sort(F.array_append(F.filter(F.coalesce(trail, F.expr("cast(array() as array<string>)")), lambda e: ~F.startswith(e, F.concat(stage, F.lit("=")))), entry))


def contract_summary(notes: DataFrame, found: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: notes, valid, invalid, orphans. notes, orphans: rel; found: issues."""
    invalid = found.select("rel").distinct().withColumn("bad", F.lit(True))
    alone = orphans.select("rel").distinct().withColumn("alone", F.lit(True))
    rows = notes.select("rel").join(invalid, "rel", "left").join(alone, "rel", "left")
    return rows.agg(F.count("*").alias("notes"), F.count_if(F.col("bad").isNull()).alias("valid"), F.count_if(F.col("bad")).alias("invalid"), F.count_if(F.col("alone")).alias("orphans"))


def canonical(values: Column, aliases: dict[str, str]) -> Column:
    """Lower case, aliases replaced, the first of each kept."""
    table = F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))))
    return F.array_distinct(F.transform(values, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.lower(x))))


def worst(verdicts: DataFrame, by: str) -> DataFrame:
    """``by``, verdict, detail: of several verdicts the worst (fail before skipped before pass), of equal ones the first.

    verdicts: ``by``, pos, verdict, detail.
    """
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return verdicts.groupBy(by).agg(F.max_by(F.struct("verdict", "detail"), F.struct(rank, -F.col("pos"))).alias("w")).select(by, "w.verdict", F.when(F.col("w.verdict") == "pass", "").otherwise(F.col("w.detail")).alias("detail"))


def outcomes(drafts: DataFrame, invalid: DataFrame, compiled: DataFrame, dangling: DataFrame, similar: DataFrame, now_s: int, cite: bool = True, run_code: str = "never", floors: dict[str, int] | None = None) -> DataFrame:
    """draft, gate, verdict, remedy, detail of the seven gates; a gate that cannot judge a draft says skipped.

    drafts: draft, mode (create, update), readable (has frontmatter), type, body, n_sources, n_links, updated, verified
    (text), freshness_days (null: that of the type). invalid: draft, n (issues); compiled: draft, verdict, detail
    (the worst of its code blocks); dangling, similar: draft, n. Drafts without a row there have none.
    """
    c, body = F.col, F.coalesce("body", F.lit(""))
    # what bodies tell is told where they are read, so they do not move
    rows = drafts.withColumn("phrase", first_banned(body)).withColumn("blocks", F.size(fenced_blocks(body))).drop("body")
    for name, facts in (("n_issues", invalid), ("n_dangling", dangling), ("n_similar", similar)):
        rows = rows.join(facts.select("draft", F.col("n").alias(name)), "draft", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    rows = rows.join(compiled.select("draft", F.col("verdict").alias("built"), F.col("detail").alias("built_detail")), "draft", "left")
    floor = F.coalesce(by_type(floors or SOURCE_FLOOR, c("type")), F.lit(0))
    days = F.when(c("freshness_days") > 0, c("freshness_days")).otherwise(F.coalesce(by_type(FRESHNESS_BY_TYPE, c("type")), F.lit(0)))
    undated = (c("mode") == "create") & (F.coalesce("updated", F.lit("")) == "") & (F.coalesce("verified", F.lit("")) == "")
    unshown = c("readable") & c("type").isin("howto", "api") & (c("blocks") == 0)

    def gate(name: str, judge: Column, detail: Column) -> Column:
        verdict = F.coalesce(judge, F.lit("pass"))
        return F.struct(F.lit(name).alias("gate"), verdict.alias("verdict"), F.when(verdict == "fail", REMEDIES[name]).otherwise("none").alias("remedy"), F.coalesce(detail, F.lit("")).alias("detail"))

    counted = lambda n, word: F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(word)))
    told = F.array(
        gate("schema", F.when(c("n_issues") > 0, "fail"), counted("n_issues", " issues")),
        gate("citation", F.when(F.lit(not cite) | ~c("readable") | (floor == 0), "skipped").when(c("n_sources") < floor, "fail"), F.when(F.lit(not cite), "citations are not asked for").when(~c("readable"), "no frontmatter").when(floor == 0, "no source is asked of the type").when(c("n_sources") < floor, F.concat(c("n_sources").cast("string"), F.lit(" of "), floor.cast("string"), F.lit(" sources")))),
        gate("code", F.when(F.lit(run_code != "auto") | (c("blocks") == 0), "skipped").otherwise(F.coalesce("built", F.lit("skipped"))), F.when(F.lit(run_code != "auto"), "code is not run").when(c("blocks") == 0, "no code blocks").otherwise(c("built_detail"))),
        gate(
            "freshness",
            F.when(~c("readable") | undated | (days <= 0), "skipped").when(recall_stale(c("verified"), c("updated"), days, F.lit(now_s)), "fail"),
            F.when(~c("readable"), "no frontmatter").when(undated, "a new draft without dates").when(days <= 0, "never stale").when(recall_stale(c("verified"), c("updated"), days, F.lit(now_s)), "past its freshness window"),
        ),
        gate("antislop", F.when(c("phrase").isNotNull() | unshown, "fail"), F.coalesce("phrase", F.when(unshown, "no fenced code block"))),
        gate("link", F.when(c("n_links") == 0, "skipped").when(c("n_dangling") > 0, "fail"), F.when(c("n_links") == 0, "no links").otherwise(counted("n_dangling", " dangling"))),
        gate("duplicate", F.when(c("n_similar") > 0, "fail"), counted("n_similar", " similar")),
    )
    return rows.select("draft", F.explode(told).alias("o")).select("draft", "o.*")


def quarantined(judged: DataFrame) -> DataFrame:
    """draft, quarantine: some gate fails whose remedy keeps the draft out."""
    return judged.groupBy("draft").agg(F.bool_or((F.col("verdict") == "fail") & ~F.col("remedy").isin(SOFT_REMEDIES)).alias("quarantine"))


def link_status(code: Column) -> Column:
    """2xx and 3xx are alive, other answers dead, no answer unreachable."""
    return F.when(code.isNull(), "unreachable").when((code >= 200) & (code < 400), "alive").otherwise("dead")


def cached_or_fresh(urls: DataFrame, cache: DataFrame, probed: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """url, verdict: the cached verdict within its time unless unreachable, else what the probe says."""
    usable = cache.where((F.col("verdict") != "unreachable") & (F.lit(now_s) - F.col("checked_s") <= ttl_s)).select("url", F.col("verdict").alias("cached"))
    return urls.join(usable, "url", "left").join(probed.select("url", "code"), "url", "left").select("url", F.coalesce("cached", link_status(F.col("code"))).alias("verdict"))
