"""Queries of validation and gates: contracts are made of the texts of ``documents``, and the SQL applies the rules to their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import gates as G
from notelake.plans import inputs as I
from notelake.plans.registry import query
from notelake.session import table

STACKS = ["english", "de", "fr", *(f"src{k}" for k in range(1, 20))]
ALIASES = {"stack": {"en": "english", "src0": "src1"}, "tags": {"the": "article"}}
KINDS = [*G.TYPES, "essay"]
TRAILS = ["recall=none", "write=api", "verify=host", "index=none=x", "plan", "recall=host"]
NOW_S = 1_709_251_200  # 2024-03-01


def _sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def contracts(spark, sf) -> DataFrame:
    """A note contract for every document, its fields taken from the text, so that every rule is broken somewhere."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")
    d = table(spark, sf, "documents").withColumn("w", words).withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    n, m = F.col("n"), F.size("w")
    day = lambda k: F.concat(F.lit("2024-02-"), F.lpad(k.cast("string"), 2, "0"))
    source = lambda k: F.struct(F.when((n + k) % 5 == 0, "").when((n + k) % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://x/"), F.col("source"))).alias("url"), day((n + k) % 32).alias("accessed"), pick(["official", "blog", "rumour"], n + k).alias("kind"))
    keys = F.array(*map(F.lit, ["title", "slug", "type", "stack", "tags", "depth"]))
    return d.select(
        F.concat(F.lit("n"), "doc_id").alias("rel"),
        F.when(m == 0, "no-frontmatter").when(m == 1, "bad-yaml").alias("error"),
        F.when(n % 6 == 0, F.concat(F.lit(["slug", "title"]), F.slice(keys, 3, 4))).when(n % 6 == 1, F.concat(keys, F.lit(["mood"]))).otherwise(keys).alias("keys"),
        F.when(n % 17 != 0, F.array_join(F.slice("w", 1, 8), " ")).alias("title"),
        F.when(n % 13 != 0, F.array_join(F.slice("w", 1, 3), "-")).alias("slug"),
        pick(KINDS, n).alias("type"),
        F.when(m % 11 == 0, F.array().cast("array<string>")).when(m % 11 == 1, F.array_repeat(F.col("lang"), 7)).when(m % 11 > 2, F.array("lang", "source")).alias("stack"),
        F.when(m % 9 != 0, F.slice("w", 1, 2)).alias("tags"),
        F.when(n % 8 == 7, F.get("w", F.lit(0))).otherwise((n % 8).cast("string")).alias("depth"),
        pick(["high", "medium", "low", "sure", ""], m).alias("confidence"),
        day(n % 31).alias("created"), day(m % 29 + 1).alias("updated"), F.lit("2024-02-15").alias("verified"),
        (n % 4000).cast("string").alias("freshness_days"),
        F.when(n % 10 != 9, F.filter(F.array(F.when(m % 3 > 0, source(F.lit(0))), F.when(m % 3 > 1, source(F.lit(1)))), lambda x: x.isNotNull())).alias("sources"),
        F.array(F.concat(F.lit("[["), F.get("w", F.lit(0)), F.lit("]]"))).alias("related"), F.array("lang").alias("supersedes"), F.lit(None).cast("array<string>").alias("code_refs"),
        F.when(n % 2 == 0, "2.0.0").otherwise("2.0").alias("forge_version"), pick([*G.ORIGINS, "robot"], m).alias("origin"),
        F.array(pick(TRAILS, n), pick(TRAILS, m)).alias("engine_trail"),
        F.coalesce("text", F.lit("")).alias("body"),
    )


def _pick(values: list[str], k: str) -> str:
    return f"{_sql(values)}[{k} % {len(values)} + 1]"


_SOURCE = "{{'url': case when (n + {0}) % 5 = 0 then '' when (n + {0}) % 7 = 0 then null else 'https://x/' || source end, 'accessed': '2024-02-' || lpad(((n + {0}) % 32)::varchar, 2, '0'), 'kind': " + _pick(["official", "blog", "rumour"], "(n + {0})") + "}}"
I.VIEWS["note_contracts"] = f"""select 'n' || doc_id as rel, case when m = 0 then 'no-frontmatter' when m = 1 then 'bad-yaml' end as error,
    case when n % 6 = 0 then ['slug', 'title', 'type', 'stack', 'tags', 'depth'] when n % 6 = 1 then ['title', 'slug', 'type', 'stack', 'tags', 'depth', 'mood'] else ['title', 'slug', 'type', 'stack', 'tags', 'depth'] end as keys,
    case when n % 17 <> 0 then array_to_string(w[1:8], ' ') end as title, case when n % 13 <> 0 then array_to_string(w[1:3], '-') end as slug, {_pick(KINDS, 'n')} as type,
    case when m % 11 = 0 then [] when m % 11 = 1 then [lang, lang, lang, lang, lang, lang, lang] when m % 11 > 2 then [lang, source] end as stack, case when m % 9 <> 0 then w[1:2] end as tags,
    case when n % 8 = 7 then w[1] else (n % 8)::varchar end as depth, {_pick(['high', 'medium', 'low', 'sure', ''], 'm')} as confidence, '2024-02-' || lpad((n % 31)::varchar, 2, '0') as created,
    '2024-02-' || lpad((m % 29 + 1)::varchar, 2, '0') as updated, '2024-02-15' as verified, (n % 4000)::varchar as freshness_days,
    case when n % 10 <> 9 then case m % 3 when 0 then [] when 1 then [{_SOURCE.format(0)}] else [{_SOURCE.format(0)}, {_SOURCE.format(1)}] end end as sources,
    ['[[' || w[1] || ']]'] as related, [lang] as supersedes, case when n % 2 = 0 then '2.0.0' else '2.0' end as forge_version, {_pick([*G.ORIGINS, 'robot'], 'm')} as origin, [{_pick(TRAILS, 'n')}, {_pick(TRAILS, 'm')}] as engine_trail, body
    from (select *, len(w) as m, length(body) as n from (select *, coalesce(text, '') as body, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') as w from documents))"""

_SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
_DAY = "(regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_strptime({0}, '%Y-%m-%d') is not null)"


def _rules() -> str:
    told = []

    def one(key: str, code: str, where: str) -> None:
        told.append(f"case when {where} then [{{'key': '{key}', 'code': '{code}'}}] else [] end")

    for k in ("title", "slug", "stack", "tags", "sources"):
        one(k, "missing", f"{k} is null")
    for k in ("title", "slug", "type", "depth", "confidence", "created", "updated", "freshness_days", "forge_version", "origin"):
        one(k, "empty", f"{k} = ''")
    for k, values in (("type", G.TYPES), ("confidence", ["high", "medium", "low"]), ("origin", ["ask", "session-capture", "garden", "import"])):
        one(k, "not-in-enum", f"{k} <> '' and {k} not in ({', '.join(repr(v) for v in values)})")
    one("title", "too-short", "title <> '' and strlen(title) < 3")
    one("title", "too-long", "strlen(title) > 120")
    one("slug", "too-long", "strlen(slug) > 80")
    one("slug", "bad-format", f"slug <> '' and not regexp_matches(slug, '{_SLUG}')")
    one("forge_version", "bad-format", "forge_version = '2.0'")
    for k, lo, hi in (("depth", 1, 5), ("freshness_days", 1, 3650)):
        one(k, "not-an-int", f"{k} <> '' and not regexp_matches({k}, '^[+-]?[0-9]{{1,18}}$')")
        one(k, "out-of-range", f"regexp_matches({k}, '^[+-]?[0-9]{{1,18}}$') and try_cast({k} as bigint) not between {lo} and {hi}")
    for k in ("created", "updated"):
        one(k, "bad-date", f"{k} <> '' and not {_DAY.format(k)}")
    for k in ("updated", "verified"):
        one(k, "date-order", f"{_DAY.format(k)} and {_DAY.format('created')} and {k} < created")
    one("stack", "too-few", "len(stack) < 1")
    one("stack", "too-many", "len(stack) > 6")
    one("tags", "too-few", "len(tags) < 1")
    item = lambda k, cases: told.append(f"coalesce(list_filter(list_transform({k}, lambda x: {{'key': '{k}', 'code': case {cases} end}}), lambda x: x.code is not null), [])")
    item("stack", f"when x in ('en', 'src0') then 'alias' when x <> lower(x) then 'not-lowercase' when not list_contains({_sql(STACKS)}, x) then 'not-in-vocabulary'")
    item("tags", f"when x = 'the' then 'alias' when x <> lower(x) then 'not-lowercase' when not regexp_matches(x, '{_SLUG}') then 'bad-item'")
    item("related", "when x <> lower(x) then 'not-lowercase' when not regexp_matches(x, '^\\[\\[[^\\]]+\\]\\]$') then 'bad-item'")
    item("engine_trail", "when x in ('plan', 'index=none=x') then 'bad-item'")
    item("engine_trail", "when x in ('write=api', 'recall=host', 'index=none=x') then 'engine-invariant'")
    item("sources", "when false then ''")
    told.append("case when list_contains(keys, 'mood') then [{'key': 'mood', 'code': 'unknown-key'}] else [] end")
    told.append("case when keys[1] = 'slug' then [{'key': 'title', 'code': 'key-order'}] else [] end")
    one("sources", "uncited", "type in ('concept', 'howto', 'pattern', 'pitfall', 'api') and coalesce(len(sources), 0) < 1")
    for i in (1, 2):
        at, s = f"sources[{i - 1}]", f"sources[{i}]"
        one(f"{at}.url", "missing", f"len(sources) >= {i} and {s}.url is null")
        one(f"{at}.url", "empty", f"{s}.url = ''")
        one(f"{at}.accessed", "bad-date", f"len(sources) >= {i} and not {_DAY.format(s + '.accessed')}")
        one(f"{at}.kind", "not-in-enum", f"{s}.kind = 'rumour'")
    return " || ".join(told)


_ISSUES = f"with i as (select rel, unnest(case when error is not null then [{{'key': '', 'code': error}}] else {_rules()} end) as x from note_contracts)"


@query("validate_issues", _ISSUES + " select rel, x.key as key, x.code as code from i")
def validate_issues(spark, sf):
    return G.issues(contracts(spark, sf), STACKS, ALIASES)


@query("issue_counts", _ISSUES + " select x.key as key, x.code as code, count(*) as n from i group by 1, 2")
def issue_counts(spark, sf):
    return validate_issues(spark, sf).groupBy("key", "code").agg(F.count("*").alias("n"))


@query("contract_summary", _ISSUES + ", b as (select distinct rel from i), o as (select rel from note_contracts where lower(body) not like '%the %') select count(*) as notes, count(*) filter (rel not in (select rel from b)) as valid, count(*) filter (rel in (select rel from b)) as invalid, count(*) filter (rel in (select rel from o)) as orphans from note_contracts")
def contract_summary(spark, sf):
    notes = contracts(spark, sf)
    return G.contract_summary(notes, validate_issues(spark, sf), notes.where(~F.lower("body").contains("the ")))


@query("engine_trails", "select rel, array_to_string(list_sort(list_concat(list_filter(engine_trail, lambda e: not starts_with(e, 'verify=')), ['verify=' || case when length(body) % 2 = 0 then 'api' else 'none' end])), ',') as trail, len(list_filter(engine_trail, lambda e: e in ('write=api', 'recall=host', 'index=none=x'))) = 0 as sound from note_contracts")
def engine_trails(spark, sf):
    engine = F.when(F.length("body") % 2 == 0, "api").otherwise("none")
    return contracts(spark, sf).select("rel", F.array_join(G.merged_trail(F.col("engine_trail"), F.lit("verify"), engine), ",").alias("trail"), F.forall("engine_trail", G.trail_sound).alias("sound"))


# ------------------------------------------------------------------ gates

_BANNED = " when ".join(f"contains(lower(prose), '{p.replace(chr(39), chr(39) * 2)}') then '{p.replace(chr(39), chr(39) * 2)}'" for p in T.BANNED_PHRASES)
_GATES = f"""with s as ({_ISSUES} select rel as draft, count(*) as n from i group by rel),
    d as (select rel as draft, error is null as readable, case when length(body) % 2 = 0 then 'create' else 'update' end as mode, type, body, regexp_replace(body, '(?s)```.*?```|`[^`\\n]*`', ' ', 'g') as prose, coalesce(len(sources), 0) as sources,
        case when length(body) % 3 = 0 then updated end as updated, case when length(body) % 5 = 0 then verified end as verified, length(body) % 400 as days, len(regexp_extract_all(body, '(?s)```.*?```')) as blocks,
        len(regexp_extract_all(body, 'https?://')) as links, len(regexp_extract_all(body, 'http://')) as dangling from note_contracts),
    j as (select d.*, coalesce(s.n, 0) as issues, case when days > 0 then days when type in ('concept', 'pattern', 'pitfall') then 365 when type in ('decision', 'incident') then 730 when type in ('howto', 'api') then 180 else 0 end as budget,
        case when type in ('concept', 'howto', 'pattern', 'pitfall', 'api') then 1 else 0 end as floor, coalesce(try_strptime(verified, '%Y-%m-%d'), try_strptime(updated, '%Y-%m-%d')) as dated, length(body) in (select length(body) from d group by 1 having count(*) > 1) as twin,
        case when {_BANNED} end as phrase from d left join s using (draft)),
    g as (select draft, unnest([
    {{'gate': 'schema', 'verdict': case when issues > 0 then 'fail' else 'pass' end, 'remedy': 'retry_once', 'detail': case when issues > 0 then issues || ' issues' else '' end}},
    {{'gate': 'citation', 'verdict': case when not readable or floor = 0 then 'skipped' when sources < floor then 'fail' else 'pass' end, 'remedy': 'mark_unverified', 'detail': case when not readable then 'no frontmatter' when floor = 0 then 'no source is asked of the type' when sources < floor then sources || ' of ' || floor || ' sources' else '' end}},
    {{'gate': 'code', 'verdict': case when blocks = 0 then 'skipped' when length(body) % 3 = 0 then 'fail' when length(body) % 3 = 1 then 'skipped' else 'pass' end, 'remedy': 'drop_confidence', 'detail': case when blocks = 0 then 'no code blocks' when length(body) % 3 = 0 then 'b' when length(body) % 3 = 1 then 'a' else '' end}},
    {{'gate': 'freshness', 'verdict': case when not readable or (mode = 'create' and verified is null and updated is null) or budget <= 0 then 'skipped' when dated is null or {NOW_S} - epoch(dated) > budget * 86400 then 'fail' else 'pass' end, 'remedy': 'drop_confidence',
        'detail': case when not readable then 'no frontmatter' when mode = 'create' and verified is null and updated is null then 'a new draft without dates' when budget <= 0 then 'never stale' when dated is null or {NOW_S} - epoch(dated) > budget * 86400 then 'past its freshness window' else '' end}},
    {{'gate': 'antislop', 'verdict': case when phrase is not null or (readable and type in ('howto', 'api') and blocks = 0) then 'fail' else 'pass' end, 'remedy': 'rewrite_pass', 'detail': coalesce(phrase, case when readable and type in ('howto', 'api') and blocks = 0 then 'no fenced code block' end, '')}},
    {{'gate': 'link', 'verdict': case when links = 0 then 'skipped' when dangling > 0 then 'fail' else 'pass' end, 'remedy': 'delegate_to_librarian', 'detail': case when links = 0 then 'no links' when dangling > 0 then dangling || ' dangling' else '' end}},
    {{'gate': 'duplicate', 'verdict': case when twin then 'fail' else 'pass' end, 'remedy': 'switch_to_update', 'detail': case when twin then '1 similar' else '' end}}]) as o from j)"""


def _outcomes(spark, sf) -> DataFrame:
    c = contracts(spark, sf)
    n = F.length("body")
    drafts = c.select(
        F.col("rel").alias("draft"), F.when(n % 2 == 0, "create").otherwise("update").alias("mode"), F.col("error").isNull().alias("readable"), "type", "body", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"),
        F.regexp_count("body", F.lit("https?://")).alias("n_links"), F.when(n % 3 == 0, F.col("updated")).alias("updated"), F.when(n % 5 == 0, F.col("verified")).alias("verified"), (n % 400).alias("freshness_days"),
    )
    counted = lambda rows: rows.groupBy("draft").agg(F.count("*").alias("n"))
    dangling = drafts.select("draft", F.regexp_count("body", F.lit("http://")).alias("n")).where("n > 0")
    twins = drafts.groupBy(F.length("body").alias("size")).agg(F.count("*").alias("k")).where("k > 1")
    similar = drafts.withColumn("size", F.length("body")).join(twins, "size", "left_semi").select("draft", F.lit(1).alias("n"))
    # two code blocks a draft, of which the worse counts
    blocks = drafts.select("draft", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.when(F.length("body") % 3 == 1, "skipped").otherwise("pass").alias("verdict"), F.lit("a").alias("detail")), F.struct(F.lit(1).alias("pos"), F.when(F.length("body") % 3 == 0, "fail").otherwise("pass").alias("verdict"), F.lit("b").alias("detail")))).alias("x")).select("draft", "x.*")
    invalid = counted(validate_issues(spark, sf).withColumnRenamed("rel", "draft"))
    return G.outcomes(drafts, invalid, G.worst(blocks, "draft"), dangling, similar, NOW_S, run_code="auto")


@query("gate_outcomes", _GATES + " select draft, o.gate as gate, o.verdict as verdict, case when o.verdict = 'fail' then o.remedy else 'none' end as remedy, o.detail as detail from g")
def gate_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query("quarantine", _GATES + " select draft, bool_or(o.verdict = 'fail' and o.gate in ('schema', 'citation', 'code', 'freshness', 'antislop')) as quarantine from g group by draft")
def quarantine(spark, sf):
    return G.quarantined(_outcomes(spark, sf))
