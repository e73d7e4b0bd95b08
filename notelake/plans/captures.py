"""Queries of capture, sessions, migration and link reports over ``events``, ``conversations``, ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import capture as C
from notelake.operators import gates as G
from notelake.operators import migrate as M
from notelake.operators import reports as P
from notelake.operators.dataset import check_format, csv, dpo
from notelake.plans import contracts as K
from notelake.plans import inputs as I
from notelake.plans.registry import query
from notelake.session import table

_S = "cast(floor(epoch(ts)) as bigint)"


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("s", I.seconds("ts"))


@query("capture_routing", f"select 'd1-routing' as kind, substr(sha256(props), 1, 12) as q_hash, event_type as topic, case when value > 50 then 'CREATE' else 'UPDATE(extend)' end as decision, 's' || (user_id % 7) as stack, value as recall_top_score, user_id as candidates, {_S} as captured_s from events where {_S} >= 1704672000")
def capture_routing(spark, sf):
    e = _events(spark, sf).select(F.col("props").alias("question"), F.col("event_type").alias("topic"), F.when(F.col("value") > 50, "CREATE").otherwise("UPDATE(extend)").alias("decision"), F.array(F.concat(F.lit("s"), F.col("user_id") % 7)).alias("stack"), F.col("value").alias("top_score"), F.col("user_id").alias("candidates"), F.col("s").alias("at_s"))
    return C.since(C.routing(e), "d1", 1_704_672_000).withColumn("stack", F.array_join("stack", ","))


@query("capture_critiques", "select 'd2-advisor-critique' as kind, 'verify' as stage, a.text as draft, b.text as critique, a.conv_id as captured_s from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def capture_critiques(spark, sf):
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("critique"))
    return C.critiques(c.join(after, ["conv_id", "turn"], "left").select(F.lit("verify").alias("stage"), F.col("text").alias("draft"), "critique", F.col("conv_id").alias("at_s")))


# a user is a note: a signup adds it, a purchase edits it, an error is a commit of the engine's own
_EDITS = f"""added as (select 'notes/' || user_id || '.md' as rel, min({_S}) as added_s, min_by('c' || event_id, ({_S}, event_id)) as gen_sha from events where event_type = 'signup' group by 1),
    edits as (select 'c' || event_id as sha, case when value < 5 then 'raw/' else 'notes/' end || user_id || '.md' as rel, case when value > 90 then 'D' else 'M' end as status, {_S} as edited_s, event_type = 'click' as own, props from events where event_type in ('purchase', 'click'))"""


@query(
    "capture_corrections",
    f"""with {_EDITS} select 'd3-human-edit' as kind, e.rel as note, 'u' as topic, substr(sha256('v1 ' || e.rel), 1, 24) as content_hash, case when length(e.rel) % 2 = 0 then 'ask' else 'garden' end as origin, added_s as generated_s, edited_s, gen_sha as gen_commit, sha as edit_commit,
        'v1 ' || e.rel as generated, case when edited_s % 3 = 0 then 'v1 ' else 'v2 ' end || e.rel as preferred
    from edits e join added a on a.rel = e.rel where not own and status = 'M' and edited_s between added_s and added_s + 604800 and edited_s % 3 <> 0 and length(e.rel) <> 13""",
)
def capture_corrections(spark, sf):
    e = _events(spark, sf)
    sha, rel = F.concat(F.lit("c"), "event_id").alias("sha"), F.concat(F.lit("notes/"), "user_id", F.lit(".md"))
    edits = e.where("event_type in ('purchase', 'click')").select(sha, F.when(F.col("value") < 5, F.concat(F.lit("raw/"), "user_id", F.lit(".md"))).otherwise(rel).alias("rel"), F.when(F.col("value") > 90, "D").otherwise("M").alias("status"), F.col("s").alias("edited_s"))
    added = e.where("event_type = 'signup'").groupBy(rel.alias("rel")).agg(F.min(F.struct("s", "event_id")).alias("x")).select("rel", F.concat(F.lit("c"), "x.event_id").alias("gen_sha"), F.col("rel").alias("gen_path"), F.col("x.s").alias("added_s"))
    made = added.select(F.col("gen_sha").alias("sha"), F.col("gen_path").alias("path"))
    blobs = made.withColumn("text", F.concat(F.lit("v1 "), "path")).unionByName(edits.select("sha", F.col("rel").alias("path"), F.concat(F.when(F.col("edited_s") % 3 == 0, "v1 ").otherwise("v2 "), "rel").alias("text")))
    origin = F.when(F.length("path") == 13, "import").when(F.length("path") % 2 == 0, "ask").otherwise("garden")
    return C.corrections(edits, e.where("event_type = 'click'").select(sha), added, blobs, made.select("sha", "path", origin.alias("origin"), F.lit("u").alias("topic")))


@query(
    "capture_repairs",
    """with p as (select conv_id, min_by(text, (turn, text)) as body, min(turn) as at from conversations where turn > 0 group by conv_id)
    select 'd4-repair' as kind, 'drafts/' || c.conv_id as path, c.text as failing_draft, c.role as gate_error, p.body as fixed_draft, p.at as captured_s from conversations c join p using (conv_id) where c.turn = 0 and c.conv_id not in (select page_id * 3 from pages)""",
)
def capture_repairs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("path", F.concat(F.lit("drafts/"), "conv_id"))
    consumed = table(spark, sf, "pages").select(F.concat(F.lit("drafts/"), F.col("page_id") * 3).alias("path"))
    return C.repairs(c.where("turn = 0").select("path", F.col("text").alias("draft"), F.col("role").alias("error")), c.where("turn > 0").select(F.col("path").alias("previous"), F.col("text").alias("body"), F.col("turn").alias("at_s")), consumed)


@query("capture_accepted", "select 'd5-style' as kind, slug as topic, rel, body as note, 'infra=' || (length(body) % 3) || case when stack[1] is null then '' else ',primary_language=' || stack[1] end as profile, array_to_string(stack, ',') as stack, 1 as captured_s from note_contracts")
def capture_accepted(spark, sf):
    c = K.contracts(spark, sf)
    profile = F.map_from_arrays(F.array(*map(F.lit, ["primary_language", "avoid", "infra"])), F.array(F.coalesce(F.get("stack", F.lit(0)), F.lit("")), F.lit("secret words"), (F.length("body") % 3).cast("string")))
    rows = C.accepted(c.select("slug", "rel", "body", "stack", F.array().cast("array<string>").alias("sources"), F.lit(1).alias("at_s")), profile)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("profile")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return rows.select("kind", "topic", "rel", "note", told.alias("profile"), F.array_join("stack", ",").alias("stack"), "captured_s")


@query("export_dpo", """select conv_id as id, '{"prompt":' || cast(to_json(role) as varchar) || ',"chosen":"kept","rejected":' || cast(to_json(role || '!') as varchar) || '}' as line, 0::bigint as redactions from conversations""")
def export_dpo(spark, sf):
    check_format("d3", "dpo")
    return dpo(table(spark, sf, "conversations").withColumn("id", F.col("conv_id")), F.col("role"), F.lit("kept"), F.concat("role", F.lit("!")))


_SAID = [
    "We decided that the cache stays. Then we agreed that tests come first\nand we concluded that",
    "we established that one. We decided that two. We agreed that three. we decided that four.",
    "nothing here, we hope that it stays",
]
_TEXTS = "select conv_id as session, turn as pos, text from conversations union all select s, p, t from (values " + ", ".join(f"({i // 2}, {1000 + i}, '{t}')" for i, t in enumerate(_SAID * 2)) + ") v(s, p, t)"


@query(
    "session_stubs",
    rf"""with t as ({_TEXTS}), x as (select session, pos, unnest(regexp_extract_all(text, '(?i)\bwe (established|decided|concluded|agreed) that\b[^.\n]*[.\n]?')) as c, generate_subscripts(regexp_extract_all(text, '(?i)\bwe (established|decided|concluded|agreed) that\b[^.\n]*[.\n]?'), 1) as k from t),
    y as (select session, trim(c, ' ' || chr(10)) as text, min((pos, k)) as spot from x group by 1, 2), z as (select *, row_number() over (partition by session order by spot) as rank from y where text <> 'We agreed that three.')
    select session, substr(sha256(text), 1, 16) as hash, text, cast(rank as integer) as rank from z where rank <= 3""",
)
def session_stubs(spark, sf):
    said = spark.createDataFrame([(i // 2, 1000 + i, t) for i, t in enumerate(_SAID * 2)], "session long, pos long, text string")
    texts = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("pos"), "text").unionByName(said)
    seen = texts.select("session").distinct().select("session", T.short_hash(F.lit("We agreed that three."), 16).alias("hash"))
    return C.first_unseen(texts, seen)


# ------------------------------------------------------------------ inbox, scrubbing, sources


@query("inbox_drafts", """select '_inbox/d' || doc_id || '.md' as path, 'low' as confidence, case when length(coalesce(text, '')) % 3 = 0 then coalesce(text, '') else coalesce(text, '') || case when coalesce(text, '') = '' or suffix(text, chr(10)) then '' else chr(10) end || chr(10) || '## Open questions' || chr(10) || chr(10) || '- why ' || coalesce(source, '') || '?' || chr(10) end as body from documents""")
def inbox_drafts(spark, sf):
    body = F.coalesce("text", F.lit(""))
    asked = F.when(F.length(body) % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("why "), F.coalesce("source", F.lit("")), F.lit("?"))))
    return C.to_inbox(table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("slug"), body.alias("body"), asked.alias("questions")))


@query("scrub_vault")
def scrub_vault(spark, sf):
    return C.scrubbed_alone(K.contracts(spark, sf), G.issue_list(K.STACKS, K.ALIASES)).select("rel", "title", "redactions", F.sha2("body", 256).alias("body_sha256"), "error")


@query("cached_sources", "select substr(sha256(url), 1, 16) || '.md' as file, '---' || chr(10) || 'url: ' || url || chr(10) || 'fetched: 2024-03-01' || chr(10) || 'ttl_days: 30' || chr(10) || '---' || chr(10) || coalesce(html, '') as text from pages where url is not null")
def cached_sources(spark, sf):
    return C.cached_source(table(spark, sf, "pages").where("url is not null").select("url", F.coalesce("html", F.lit("")).alias("body")), 30, "2024-03-01")


@query("hook_payloads", "select event_id, event_type as first from events")
def hook_payloads(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("session_id"), "value")).alias("payload"))
    return e.select("event_id", C.hook_fields(F.col("payload"), ["session_id", "cwd"])["session_id"].alias("first"))


# ------------------------------------------------------------------ links


_CITED = "u as (select page_id, url, case when length(html) % 4 = 0 then 'dead' when length(html) % 4 = 1 then 'unreachable' else 'alive' end as verdict from pages), c as (select distinct 'n' || (page_id // 3) as note, url from pages)"


@query("dead_urls_of_notes", f"with {_CITED} select note, count(distinct url) as dead from c join (select url from u group by url having min(verdict) = 'dead') d using (url) group by note")
def dead_urls_of_notes(spark, sf):
    return P.dead_per_note(*_cited(spark, sf))


@query("url_citations", f"with {_CITED} select url, verdict, string_agg(note, ',' order by note) as notes from c join (select url, min(verdict) as verdict from u group by url) v using (url) where verdict <> 'alive' group by all")
def url_citations(spark, sf):
    return P.citing_notes(*_cited(spark, sf)).select("url", "verdict", F.array_join("notes", ",").alias("notes"))


def _cited(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "pages")
    n = F.length("html") % 4
    status = p.groupBy("url").agg(F.min(F.when(n == 0, "dead").when(n == 1, "unreachable").otherwise("alive")).alias("verdict"))
    return p.select(F.concat(F.lit("n"), F.floor(F.col("page_id") / 3)).alias("note"), "url").distinct(), status


# ------------------------------------------------------------------ migration

_OLD = "select ['decisions', 'concepts', 'issues', 'TIL', 'syntheses', 'misc'][length(coalesce(text, '')) % 6 + 1] || '/' || doc_id || '.md' as rel, coalesce(text, '') as body, lang, source from documents"


def _old(spark, sf) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    folder = F.element_at(F.array(*map(F.lit, ["decisions", "concepts", "issues", "TIL", "syntheses", "misc"])), F.length(body) % 6 + 1)
    return table(spark, sf, "documents").select(F.concat(folder, F.lit("/"), "doc_id", F.lit(".md")).alias("rel"), body.alias("body"), "lang", "source")


@query(
    "migrated_types",
    rf"""with o as ({_OLD}) select rel, case split_part(rel, '/', 1) when 'decisions' then 'decision' when 'issues' then case when regexp_matches(body, '(?i)\b(outage|incident|down|postmortem|post-mortem)\b') then 'incident' else 'pitfall' end
        when 'TIL' then case when regexp_matches(body, '(?m)^(?:\d+\.\s|```|\$ |- \[ \])') then 'howto' else 'concept' end else 'concept' end as type, case when rel like 'decisions/%' then 'high' else 'low' end as confidence, case when rel like 'syntheses/%' then '4' else '' end as depth,
        array_to_string(list_filter(list_distinct([case lang when 'en' then 'english' else lang end]), lambda x: x in ('english', 'de')), ',') as stack,
        array_to_string(list_filter([case lang when 'en' then 'english' else lang end, source], lambda x: x not in ('english', 'de')), ',') as tags from o""",
)
def migrated_types(spark, sf):
    t = M.inferred(F.col("rel"), F.col("body"))
    axes = M.axes(F.lit(None).cast("array<string>"), F.filter(F.array("lang", "source"), lambda x: x.isNotNull()), ["english", "de"], {"en": "english"})
    return _old(spark, sf).select("rel", t.alias("t"), axes.alias("a")).select("rel", "t.type", "t.confidence", "t.depth", F.array_join("a.stack", ",").alias("stack"), F.array_join("a.tags", ",").alias("tags"))


@query(
    "migrated_links",
    """with l as (select 'n' || page_id as rel, 'see [[old/p' || (page_id + 1) || '.md#top]] and [[p' || (page_id + 2) || '|that]] or [[q]] ' || url as body, page_id as k from pages), m as (select max(page_id) as top from pages)
    select rel, 'see [[' || case when k + 1 <= top then 'new/' || (k + 1) || '-page' else 'old/p' || (k + 1) || '.md' end || '#top]] and [[' || case when k + 2 <= top then (k + 2) || '-page' else 'p' || (k + 2) end || '|that]] or [[q]] ' || split_part(body, '[[q]] ', 2) as body,
        cast((k + 1 <= top)::int + (k + 2 <= top)::int as integer) as n from l, m""",
)
def migrated_links(spark, sf):
    k = F.col("page_id")
    p = table(spark, sf, "pages")
    notes = p.select(F.concat(F.lit("n"), k).alias("rel"), F.concat(F.lit("see [[old/p"), k + 1, F.lit(".md#top]] and [[p"), k + 2, F.lit("|that]] or [[q]] "), "url").alias("body"))
    moves = p.select(F.concat(F.lit("old/p"), k, F.lit(".md")).alias("src"), F.concat(F.lit("new/"), k, F.lit("-page.md")).alias("dst"))
    return M.relinked(notes, moves, moves.select(F.col("src").alias("rel")))


@query("migration_collisions", "with m as (select 'notes/' || coalesce(source, '') || '-' || length(coalesce(text, '')) || '.md' as dst from documents), c as (select dst, count(*) as n from m group by 1) select dst, n from c where n > 1 or dst in (select 'notes/' || coalesce(source, '') || '-1.md' from documents)")
def migration_collisions(spark, sf):
    d = table(spark, sf, "documents")
    stem = F.concat(F.lit("notes/"), F.coalesce("source", F.lit("")), F.lit("-"))
    moves = d.select(F.col("doc_id").alias("src"), F.concat(stem, F.length(F.coalesce("text", F.lit(""))), F.lit(".md")).alias("dst"))
    return M.collisions(moves, d.select(F.concat(stem, F.lit("1.md")).alias("rel")))


# ------------------------------------------------------------------ reports of the index, the statistics, the datasheet


@query("recent_notes", "select rel, verified from order_notes order by verified desc, rel limit 15")
def recent_notes(spark, sf):
    return P.recent(I.order_notes(spark, sf), "verified").select("rel", "verified")


@query("stalest_notes", f"select rel, verified from order_notes where freshness_days > 0 and ({I.NOW_S} - verified_s) / 86400.0 > freshness_days order by verified, rel limit 15")
def stalest_notes(spark, sf):
    return P.stalest(I.order_notes(spark, sf), I.NOW_S).select("rel", "verified")


@query("most_asked", "select topic, count(*) as asked from asks group by topic order by asked desc, topic limit 15")
def most_asked(spark, sf):
    return P.most_asked(I.asks(spark, sf))


@query("queued_notes", "select rel from note_contracts where lower(confidence) = 'sure'")
def queued_notes(spark, sf):
    return P.queued(K.contracts(spark, sf).select("rel", F.when(F.col("confidence") == "sure", "TRUE").otherwise("no").alias("pending")), "pending")


@query("index_by_type", "select k as type, count(n.rel) as notes from (select unnest(['concept', 'howto', 'pattern', 'pitfall', 'decision', 'api', 'incident']) as k) left join note_contracts n on n.type = k group by k")
def index_by_type(spark, sf):
    return P.by_type(K.contracts(spark, sf))


@query(
    "act_now",
    "with c as (select event_type as kind, count(*) as n, min(event_id) as first from events group by 1) select cast(row_number() over (order by case kind when 'error' then 0 when 'purchase' then 1 else 2 end, kind) as integer) as line, kind, first as target from c",
)
def act_now(spark, sf):
    top = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.min("event_id").alias("target"))
    return P.act_now(top, ["error", "purchase"])
