"""Queries of the link graph and of drift, over all rows of ``lineitem``: lines are edges, citations and declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators import asks as A
from notelake.operators import drift as D
from notelake.operators import graph as L
from notelake.operators import history as H
from notelake.operators import renames
from notelake.operators.components import connected_components
from notelake.plans import inputs as I
from notelake.plans.registry import query
from notelake.session import materialize, table

# ------------------------------------------------------------------ graph: parts are notes, and a line links its part to that of its supplier's number

_EDGES = """nodes as (select case when p_size > 45 then '' else 'dir/' end || 'f' || p_partkey || '.md' as rel, p_partkey as id from part),
    g as (select a.rel as src, b.rel as dst from lineitem join nodes a on a.id = l_partkey join nodes b on b.id = l_suppkey where l_partkey <> l_suppkey)"""


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "part").select(F.concat(F.when(F.col("p_size") > 45, "").otherwise("dir/"), F.lit("f"), "p_partkey", F.lit(".md")).alias("rel"), F.col("p_partkey").alias("id"))
    e = table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    a, b = nodes.select(F.col("rel").alias("a"), F.col("id").alias("src")), nodes.select(F.col("rel").alias("b"), F.col("id").alias("dst"))
    return nodes.select("rel"), e.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


_DEGREES = f"""{_EDGES}, d as (select n.rel, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree from nodes n left join (select src, count(*) as n from g group by 1) o on o.src = n.rel
    left join (select dst, count(*) as n from g group by 1) i on i.dst = n.rel),
    c as (select *, starts_with(rel, 'moc/') or not contains(rel, '/') or out_degree >= (select greatest(floor(count(*) * 0.10), 5) from nodes) as is_root from d)"""


@query("degrees", f"with {_DEGREES} select rel, out_degree, in_degree, is_root, in_degree = 0 and not is_root as is_orphan from c")
def degrees(spark, sf):
    return L.degrees(*_graph(spark, sf))


@query("orphans", f"with {_DEGREES} select rel from c where in_degree = 0 and not is_root")
def orphans(spark, sf):
    return L.degrees(*_graph(spark, sf)).where("is_orphan").select("rel")


# an order and the part of a line belong together; labels spread until none changes
_LABELS = """e as (select distinct 2 * l_orderkey as a, 2 * l_partkey + 1 as b from lineitem),
    u as (select a, b from e union select b, a from e),
    label(x, c) using key (x) as (select distinct a, a from u union (select u.a, min(l.c) from label l join u on u.b = l.x join recurring.label o on o.x = u.a group by u.a having min(l.c) < min(o.c)))"""


def _together(spark, sf) -> DataFrame:
    return connected_components(table(spark, sf, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")))


@query("components", f"with recursive {_LABELS} select x as node, c as component from label")
def components(spark, sf):
    return _together(spark, sf)


@query("component_sizes", f"with recursive {_LABELS}, t as (select count(*) as n from label) select c as component, count(*) as size, count(*) / max(t.n) as share, not bool_or(x % 2 = 0 and x % 10 = 0) as rootless from label, t group by c")
def component_sizes(spark, sf):
    members = components(spark, sf).select(F.col("node").alias("rel"), "component")
    return L.component_sizes(members, members.select("rel", (F.col("rel") % 10 == 0).alias("is_root"))).select("component", "size", "share", "rootless")


# ------------------------------------------------------------------ drift: lines shipped before a day are the verified tree, the others the tree at HEAD

DAY = "1995-06-17"
I.VIEWS["declarations"] = f"""select l_shipdate >= timestamp '{DAY}' as head, 'r' || l_linenumber as repo, 'f' || l_partkey as path, 'P' || l_partkey || '.m' || cast(round(l_discount * 100) as integer) as name, min(l_suppkey) as start,
    md5(cast(max(cast(l_quantity as integer)) as varchar)) as body_hash from lineitem group by 1, 2, 3, 4"""
I.VIEWS["citations"] = """select 'n' || l_suppkey as note, l_orderkey * 10 + l_linenumber as pos, 'r' || l_linenumber as repo, 'f' || l_partkey as path,
    case when l_tax < 0.03 then '' when l_tax < 0.055 then 'P' || l_partkey || '.m' || cast(round(l_discount * 100) as integer) else 'm' || cast(round(l_discount * 100) as integer) end as symbol, l_suppkey as line, case when l_linestatus = 'F' then 'v1' end as rev from lineitem"""


def _number() -> F.Column:
    return F.round(F.col("l_discount") * 100).cast("int")


def declarations(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_shipdate") >= F.lit(DAY).cast("timestamp_ntz")).alias("head"), F.concat(F.lit("r"), "l_linenumber").alias("repo"), F.concat(F.lit("f"), "l_partkey").alias("path"), F.concat(F.lit("P"), "l_partkey", F.lit(".m"), _number()).alias("name"), "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    return rows.groupBy("head", "repo", "path", "name").agg(F.min("l_suppkey").alias("start"), F.md5(F.max("q").cast("string")).alias("body_hash"))


def citations(spark, sf) -> DataFrame:
    full, short = F.concat(F.lit("P"), "l_partkey", F.lit(".m"), _number()), F.concat(F.lit("m"), _number())
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("n"), "l_suppkey").alias("note"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("r"), "l_linenumber").alias("repo"), F.concat(F.lit("f"), "l_partkey").alias("path"),
        F.when(F.col("l_tax") < 0.03, "").when(F.col("l_tax") < 0.055, full).otherwise(short).alias("symbol"), F.col("l_suppkey").alias("line"), F.when(F.col("l_linestatus") == "F", "v1").alias("rev"),
    )


# the history of the tree: a line is what the commit of its day left of a declaration; returned lines took it away
I.VIEWS["commits_of"] = """select 'r' || (l_linenumber // 4) as repo, 'f' || l_partkey as path, 'P' || l_partkey || '.m' || (cast(round(l_discount * 100) as integer) % 4) as name, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as at_day,
    bool_and(l_returnflag = 'R') as gone, min(l_suppkey) as start, md5(cast(max(cast(l_quantity as integer)) as varchar)) as body_hash from lineitem group by 1, 2, 3, 4"""
# a note is an order's, with a day of verification of its own; every fifth has none
I.VIEWS["dated_citations"] = """select 'n' || l_orderkey as note, l_orderkey * 10 + l_linenumber as pos, 'r' || (l_linenumber // 4) as repo, 'f' || l_partkey as path,
    case when l_tax < 0.03 then '' when l_tax < 0.055 then 'P' || l_partkey || '.m' || (cast(round(l_discount * 100) as integer) % 4) else 'm' || (cast(round(l_discount * 100) as integer) % 4) end as symbol,
    case when l_linenumber = 1 then 0 else l_suppkey end as line, case when l_orderkey % 5 > 0 then 8000 + (l_orderkey * 37) % 2600 end as verified from lineitem"""


def commits_of(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("P"), "l_partkey", F.lit(".m"), _number() % 4)
    rows = li.select(F.concat(F.lit("r"), F.floor(F.col("l_linenumber") / 4)).alias("repo"), F.concat(F.lit("f"), "l_partkey").alias("path"), name.alias("name"), F.unix_date(F.col("l_shipdate").cast("date")).alias("at"), "l_returnflag", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    return rows.groupBy("repo", "path", "name", "at").agg(F.bool_and(F.col("l_returnflag") == "R").alias("gone"), F.min("l_suppkey").alias("start"), F.md5(F.max("q").cast("string")).alias("body_hash"))


def dated_citations(spark, sf) -> DataFrame:
    full, short = F.concat(F.lit("P"), "l_partkey", F.lit(".m"), _number() % 4), F.concat(F.lit("m"), _number() % 4)
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("n"), "l_orderkey").alias("note"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("r"), F.floor(F.col("l_linenumber") / 4)).alias("repo"), F.concat(F.lit("f"), "l_partkey").alias("path"),
        F.when(F.col("l_tax") < 0.03, "").when(F.col("l_tax") < 0.055, full).otherwise(short).alias("symbol"), F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_suppkey")).alias("line"),
        F.when(F.col("l_orderkey") % 5 > 0, 8000 + (F.col("l_orderkey") * 37) % 2600).cast("int").alias("verified"),
    )


_PICK = "case when k.symbol = '' then sha256(string_agg(k.name || ':' || body_hash, ';' order by start, k.name, body_hash)) else arg_min(body_hash, (rank, start, k.name)) end"
_DRIFT = f"""ev as materialized (select * from commits_of), nm as (select distinct repo, path, name, string_split(name, '.')[2] as short from ev),
    q as (select distinct repo, path, symbol, verified from dated_citations),
    k as (select q.*, n.name, case when n.name = q.symbol or q.symbol = '' then 0 else 1 end as rank from q join nm n on n.repo = q.repo and n.path = q.path and (q.symbol in ('', n.name, n.short))),
    t as (select k.repo, k.path, k.symbol, k.verified, {_PICK} as hash_then from k asof join ev e on k.repo = e.repo and k.path = e.path and k.name = e.name and k.verified >= e.at_day where not e.gone group by k.repo, k.path, k.symbol, k.verified),
    last as (select * from ev qualify row_number() over (partition by repo, path, name order by at_day desc) = 1),
    f as (select distinct repo, path from last where not gone),
    n as (select k.repo, k.path, k.symbol, case when k.symbol <> '' then arg_min(start, (rank, start, k.name)) end as start, {_PICK} as body_hash from (select distinct repo, path, symbol, name, rank from k) k join last using (repo, path, name) where not gone group by k.repo, k.path, k.symbol),
    v as (select r.note, r.pos, r.repo, r.path, r.symbol, r.line, n.start as line_now, case when f.path is null then 'broken' when r.symbol <> '' and n.body_hash is null then 'broken' when t.hash_then <> n.body_hash then 'suspect'
        when r.symbol <> '' and r.line <> 0 and r.line <> n.start then 'repaired' else 'ok' end as verdict
        from dated_citations r left join f using (repo, path) left join n using (repo, path, symbol) left join t using (repo, path, symbol, verified))"""


def _drift(spark, sf) -> DataFrame:
    return D.drift(dated_citations(spark, sf), materialize(D.held(commits_of(spark, sf)), "held"))


@query("drift_ladder", f"with {_DRIFT} select note, pos, repo, path, symbol, line, line_now, verdict from v")
def drift_ladder(spark, sf):
    return _drift(spark, sf)


@query("drift_counts", f"with {_DRIFT} select verdict, count(*) as findings, count(distinct note) as notes from v group by verdict")
def drift_counts(spark, sf):
    return _drift(spark, sf).groupBy("verdict").agg(F.count("*").alias("findings"), F.count_distinct("note").alias("notes"))


@query("first_broken", f"with {_DRIFT} select note, min(pos) as pos, arg_min(path, (pos, path)) as path from v where verdict = 'broken' group by note")
def first_broken(spark, sf):
    return _drift(spark, sf).where("verdict = 'broken'").groupBy("note").agg(F.min("pos").alias("pos"), F.min_by("path", F.struct("pos", "path")).alias("path"))


_CONF = """c as (select 'n' || o_orderkey as slug, case when o_totalprice < 40000 then '' when o_totalprice < 90000 then 'low' when o_totalprice < 150000 then 'medium' else 'high' end as confidence from orders),
    m as (select 'n' || o_orderkey as slug, 'high' as prior from orders where o_custkey % 4 = 0)"""


@query(
    "confidence_transitions",
    f"""with {_DRIFT}, {_CONF}, b as (select note as slug, bool_or(verdict = 'broken') as broken from v group by 1),
    a as (select slug, confidence, prior, case when broken and confidence not in ('', 'low') and prior is null then 'demoted' when not broken and prior is not null then 'restored' else 'stamped' end as action from c join b using (slug) left join m using (slug))
    select slug, action, case action when 'demoted' then 'low' when 'restored' then prior else confidence end as confidence, case action when 'demoted' then confidence when 'restored' then null else prior end as remembered from a""",
)
def confidence_transitions(spark, sf):
    o = table(spark, sf, "orders")
    slug, price = F.concat(F.lit("n"), "o_orderkey").alias("slug"), F.col("o_totalprice")
    notes = o.select(slug, F.when(price < 40000, "").when(price < 90000, "low").when(price < 150000, "medium").otherwise("high").alias("confidence"))
    findings = _drift(spark, sf).select(F.col("note").alias("slug"), "pos", "verdict")
    return H.confidence(notes, findings, o.where("o_custkey % 4 = 0").select(slug, F.lit("high").alias("prior")))


_FIRST = "arg_min({0}, (rank, repo, path, start, name))"
_LOOKUP = "(select *, name as wanted, 0 as rank from declarations union all select *, string_split(name, '.')[2], 1 from declarations)"


@query(
    "drift_symbol_only",
    f"""with x as (select head, wanted as symbol, {_FIRST.format('repo')} as repo, {_FIRST.format('path')} as path, {_FIRST.format('start')} as start, {_FIRST.format('body_hash')} as h from {_LOOKUP} group by 1, 2),
    b as (select repo, path, wanted as symbol, arg_min(body_hash, (rank, start, name)) as h from {_LOOKUP} where not head group by 1, 2, 3),
    j as (select c.note, c.pos, c.symbol, c.line, c.rev, n.repo, n.path, n.start, n.h, b.h as was, t.repo as t_repo, t.path as t_path from (select * from citations where symbol <> '') c
        left join x n on n.head and n.symbol = c.symbol left join b on c.rev = 'v1' and b.repo = n.repo and b.path = n.path and b.symbol = c.symbol left join x t on not t.head and c.rev = 'v1' and t.symbol = c.symbol),
    v as (select *, case when h is not null and was <> h then 'suspect' when h is not null and line <> 0 and line <> start then 'repaired' when h is not null then 'ok' when t_repo is not null then 'broken' else 'skipped' end as verdict from j)
    select note, pos, symbol, case when verdict = 'broken' then t_repo else repo end as repo, case when verdict = 'broken' then t_path else path end as path, line, start as line_now, verdict from v""",
)
def drift_symbol_only(spark, sf):
    d = declarations(spark, sf)
    then = d.where("not head").select(F.lit("v1").alias("rev"), "repo", "path", "name", "start", "body_hash")
    refs = citations(spark, sf).where("symbol <> ''").select("note", "pos", "symbol", "line", "rev")
    return D.symbol_only(refs, d.where("head"), then, deep=True)


_FILES = f"select distinct l_shipdate >= timestamp '{DAY}' as head, 'r' || l_linenumber as repo, 'src/d' || l_suppkey || '/F' || l_partkey || '.java' as path, 'd' || l_suppkey as d, 'F' || l_partkey || '.java' as b from lineitem"
_SHAPED = """select 'n' || l_suppkey as note, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as pos, min(case when l_tax < 0.04 then '' else 'd' || l_suppkey end) as d, min('F' || l_partkey || '.java') as b, min(case when l_quantity > 25 then 'r' || l_linenumber else '' end) as repo,
    min(case when l_linestatus = 'F' then 'v1' end) as rev from lineitem group by 1, 2"""
_UNRESOLVED = f"""fs as ({_FILES}), rs as ({_SHAPED}), hits as (select note, pos, head, count(*) as n, min(fs.repo || ':' || fs.path) as spot from rs join fs on fs.b = rs.b and (rs.d = '' or rs.d = fs.d) and (rs.repo = '' or rs.repo = fs.repo) group by 1, 2, 3),
    u as (select rs.*, case when rs.d = '' then rs.b else rs.d || '/' || rs.b end as path, coalesce(h.n, 0) as n, t.n as tn, t.spot from rs left join hits h on h.head and h.note = rs.note and h.pos = rs.pos left join hits t on not t.head and t.note = rs.note and t.pos = rs.pos and rs.rev is not null where coalesce(h.n, 0) <> 1)"""


def _shaped(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Citations, and files as often as a line names them. Texts that a citation's numbers tell are made once these are grouped."""
    li = table(spark, sf, "lineitem")
    base, folder, repo = F.concat(F.lit("F"), "l_partkey", F.lit(".java")), F.concat(F.lit("d"), "l_suppkey"), F.concat(F.lit("r"), "l_linenumber")
    files = li.select((F.col("l_shipdate") >= F.lit(DAY).cast("timestamp_ntz")).alias("head"), repo.alias("repo"), F.concat_ws("/", F.lit("src"), folder, base).alias("path"))
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    lines = li.select(
        "l_suppkey", pos.alias("pos"), F.coalesce(F.col("l_tax") < 0.04, F.lit(False)).alias("bare"), F.col("l_partkey").cast("string").alias("part"), F.when(F.col("l_quantity") > 25, F.col("l_linenumber").cast("string")).otherwise("").alias("line"), (F.col("l_linestatus") == "F").alias("then")
    )
    shaped = lines.repartition("l_suppkey", "pos").groupBy("l_suppkey", "pos").agg(F.bool_or("bare").alias("bare"), F.min("part").alias("part"), F.min("line").alias("line"), F.bool_or("then").alias("then"))
    name = F.concat(F.lit("F"), "part", F.lit(".java"))
    refs = shaped.select(
        F.concat(F.lit("n"), "l_suppkey").alias("note"), "pos", F.when(F.col("bare"), name).otherwise(F.concat(folder, F.lit("/"), name)).alias("path"), F.when(F.col("line") == "", "").otherwise(F.concat(F.lit("r"), "line")).alias("repo"), F.when(F.col("then"), "v1").alias("rev")
    )
    return refs, files


@query("drift_unresolved", f"with {_UNRESOLVED} select note, pos, path, case when n = 0 and tn = 1 then spot end as repo_path, case when n = 0 and tn = 1 then 'broken' else 'skipped' end as verdict from u")
def drift_unresolved(spark, sf):
    refs, files = _shaped(spark, sf)
    return D.unresolved(refs, files.where("head"), None, files.where("not head").withColumn("rev", F.lit("v1")), deep=True)


@query(
    "drift_deleted",
    f"""with {_UNRESOLVED}, gone as (select lower(b) as b, min((path, repo)) as x from fs where not head and (repo, path) not in (select (repo, path) from fs where head) group by 1)
    select note, pos, u.path, case when n = 0 then x[2] || ':' || x[1] end as repo_path, case when n = 0 then 'broken' else 'skipped' end as verdict from u left join gone on gone.b = lower(u.b) where n > 1 or x is not null""",
)
def drift_deleted(spark, sf):
    refs, files = _shaped(spark, sf)
    deleted = files.groupBy("repo", "path").agg(F.bool_or("head").alias("here")).where("not here").drop("here")
    return D.unresolved(refs, files.where("head").drop("head"), deleted, files.where("not head").withColumn("rev", F.lit("v1")), deep=False)


@query(
    "symbol_markers",
    f"""with x as (select wanted as symbol, {_FIRST.format('repo')} as repo, {_FIRST.format('path')} as path, {_FIRST.format('name')} as name, {_FIRST.format('start')} as start from {_LOOKUP} where head group by 1),
    m as (select path, name, start, note, min(pos) as pos from citations join x using (symbol) where x.repo = 'r1' group by all)
    select path, name, start, string_agg(note, ',' order by pos, note) as slugs from m group by all""".replace("select path, name, start, note", "select x.path, x.name, x.start, note"),
)
def symbol_markers(spark, sf):
    refs = citations(spark, sf).select(F.col("note").alias("slug"), "pos", "symbol")
    return D.markers(refs, declarations(spark, sf).where("head"), "r1").select("path", "name", "start", F.array_join("slugs", ",").alias("slugs"))


@query("touched_findings", f"with {_DRIFT} select note, pos, path, verdict from v where path in (select 'f' || p_partkey from part where p_size > 25)")
def touched_findings(spark, sf):
    touched = table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("f"), "p_partkey").alias("path"))
    return D.gated(_drift(spark, sf), touched).select("note", "pos", "path", "verdict")


@query("absolute_paths", "select page_id, 'r' || length(string_split(url, '/')[3]) as repo, array_to_string(string_split(url, '/')[4:], '/') as rel from pages where len(string_split(url, '/')) > 3")
def absolute_paths(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    hosts = p.select(F.get(F.split("url", "/"), F.lit(2)).alias("h")).distinct()
    # every host is a root, and the scheme alone a shorter one that never wins
    roots = hosts.select(F.concat(F.lit("r"), F.length("h")).alias("repo"), F.concat(F.lit("https://"), "h", F.lit("/")).alias("root")).unionByName(hosts.select(F.concat(F.lit("r"), F.length("h")).alias("repo"), F.concat(F.lit("http://"), "h").alias("root")))
    return p.join(D.in_roots(p.select(F.col("url").alias("path")).distinct(), roots).withColumnRenamed("path", "url"), "url").select("page_id", "repo", "rel")


# ------------------------------------------------------------------ renames: a line adds the file of its part, or renames that of its supplier's number to it

_EVENTS = "ev as materialized (select 'r' as repo, l_orderkey * 10 + l_linenumber as pos, min('f' || l_partkey) as path, min(case when l_returnflag <> 'N' then 'f' || l_suppkey end) as old_path from lineitem group by 2)"


@query(
    "rename_origins",
    f"""with recursive {_EVENTS}, p as materialized (select r.pos, r.path, e.pos as to_pos, e.path as to_path from (select * from ev where old_path is not null) r asof join ev e on r.old_path = e.path and r.pos > e.pos),
    walk as (select pos as start, path as from_path, pos, path from ev union all select w.start, w.from_path, p.to_pos, p.to_path from walk w join p on p.pos = w.pos)
    select start as pos, from_path as path, min(pos) as origin_pos, arg_min(path, pos) as origin_path from walk group by 1, 2""",
)
def rename_origins(spark, sf):
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy(pos.alias("pos")).agg(F.min(F.concat(F.lit("f"), "l_partkey")).alias("path"), F.min(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("f"), "l_suppkey"))).alias("old_path"))
    changes = rows.select(F.lit("r").alias("repo"), "path", "pos", F.when(F.col("old_path").isNull(), "A").otherwise("R").alias("status"), "old_path")
    return renames.origins(changes).select("pos", "path", "origin_pos", "origin_path")


# ------------------------------------------------------------------ citations in order, and the measures of a week


@query(
    "cited_refs",
    """with f as (select 'n' || l_orderkey as note, case when l_returnflag = 'R' then 0 else 1 end as part, l_linenumber * 10000000 + l_partkey as pos, 'f' || l_partkey as raw from lineitem group by all)
    select note, cast(row_number() over (partition by note order by part, pos) - 1 as integer) as pos, raw from f""",
)
def cited_refs(spark, sf):
    """Returned lines are the frontmatter of an order's note, the others its body."""
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("n"), "l_orderkey").alias("note"), (F.col("l_returnflag") == "R").alias("front"), (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("f"), "l_partkey").alias("raw")).distinct()
    return D.cited_refs(rows.where("front"), rows.where("not front"))


@query(
    "week_row",
    f"""with {_DEGREES}, {_DRIFT}, asked as (select topic, count(*) as asked, topic in (select slug from slugs) as written from asks group by topic)
    select (select count(*) from nodes) as notes, (select case when sum(asked) > 0 then 100.0 * sum(asked) filter (written) / sum(asked) else 0 end from asked) as hit_rate,
        (select count(*) from c where in_degree = 0 and not is_root) as orphans, (select count(distinct note) from v where verdict in ('broken', 'suspect')) as drift""",
)
def week_row(spark, sf):
    asked = A.topics(I.asks(spark, sf), I.slugs(spark, sf))
    nodes, edges = _graph(spark, sf)
    return A.week_row(nodes, asked, L.degrees(nodes, edges).select("rel", "is_orphan"), _drift(spark, sf).select("note", "verdict"))
