"""Registered queries over stored indexes, overlays, graphs, archives, responses and contracts, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.patterns import Pattern
from ..operators import catalog, diffs, extract, graph, paging, search, states
from ..sources import archive, corpus, scip
from ..streaming import events as ev
from . import response
from .api import Engine
from .queries import FILES, LINKS, OCC, PAGES, SITES, SNAP, TAGS, _found, _occurrences, shared_dir, stored_index
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- overlay, scope, changes -------------------------------------------------------------------------------------------------------------------------------------------------------

EDITED = """indexed as (select doc_id, text from documents where doc_id % 11 <> 0),
live as (select concat_ws('/', source, lang, doc_id::varchar || '.txt') as path, lang as language, case when doc_id % 5 = 0 then text || ' llech' else text end as content,
  case when doc_id % 11 = 0 or doc_id % 5 = 0 then 'live_overlay' else 'index' end as source_reason from documents where doc_id % 7 <> 0)"""


def _edited(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(indexed files, live files): every eleventh is new, every fifth edited, every seventh gone."""
    d = corpus.table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path")
    row = lambda c: (path, F.col("lang").alias("language"), F.octet_length(c).cast("long").alias("size"), c.alias("content"))
    new = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" llech"))).otherwise(F.col("text"))
    return d.where("doc_id % 11 <> 0").select(*row(F.col("text"))), d.where("doc_id % 7 <> 0").select(*row(new))


@query(f"""with {EDITED}, lines as (select path, source_reason, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1))::bigint as line from live)
select path, line, source_reason, ((length(text) - length(replace(lower(text), 'llech', ''))) // 5)::bigint as hits from lines where contains(lower(text), 'llech')""")
def overlay_find(spark, sf):
    """A search behind an index that the files have moved on from: fresh files by their trigrams, edited and new ones as they are."""
    indexed, live = _edited(spark, sf)
    engine = Engine(live, grams=catalog.gram_index(indexed), indexed=catalog.proofs(indexed).select("path", "hash"))
    return engine.find("llech", limit=0).results.groupBy("path", "line", "source_reason").agg(F.count("*").alias("hits"))


@query(f"with {SNAP} select b.path, b.size from b left join a using (path) where a.path is null")
def added_paths(spark, sf):
    """Files that no indexed path names."""
    a, b = corpus.snapshots(spark, sf)
    return catalog.added(a, b).select("path", "size")


@query(f"""with {FILES}, changed as (select distinct concat_ws('/', d.source, d.lang, d.doc_id::varchar || '.txt') as path from documents d join events e on e.event_id = d.doc_id where e.event_type in ('view', 'click'))
select path, size from files join changed using (path) where contains(path, '1')""")
def changed_files(spark, sf):
    """Path search among changed files only."""
    d, e = corpus.table(spark, sf, "documents"), corpus.table(spark, sf, "events")
    changed = d.join(e.where("event_type in ('view', 'click')"), d["doc_id"] == e["event_id"]).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return Engine(corpus.corpus_files(spark, sf), changed_paths=changed).files_matching("1", scope=search.Scope(changed=True), limit=0).results.select("path", "size")


IGNORE = "*2.txt\n!src1/de/*\n/src2/\nfr/\n# comment\nsrc3/**/*9.txt\n"


@query(f"""with {FILES}, j as (select path, size,
  case when regexp_matches(path, '^src3/(.*/)?[^/]*9\\.txt$') then true when regexp_matches(path, '(^|/)fr/') then true when starts_with(path, 'src2/') then true when regexp_matches(path, '^src1/de/[^/]*$') then false
    when regexp_matches(path, '2\\.txt$') then true else false end as ignored from files)
select path, size from j where not ignored""")
def ignored_files(spark, sf):
    """The catalog without what an ignore file at the top names; later lines win."""
    files = corpus.corpus_files(spark, sf).select("path", "language", "size", F.lit("x").alias("content"))
    rules = spark.createDataFrame([(".gitignore", "text", 0, IGNORE)], "path string, language string, size long, content string")
    return catalog.included(catalog.scan(catalog.with_ignored(files.unionByName(rules)))).where("path <> '.gitignore'").select("path", "size")


@query(f"with {PAGES} select path, 'file' as kind from pages_ order by path limit 20")
def list_limited(spark, sf):
    """The first twenty files of a recursive listing, by path."""
    return Engine(corpus.page_files(spark, sf)).list("", recursive=True).where("kind = 'file'").orderBy("path").limit(20).select("path", "kind")


@query(f"""with {PAGES}, parts as (select string_split(path, '/') as p from pages_), each as (select unnest(range(1, len(p) + 1)) as k, p from parts), every as (
select distinct array_to_string(p[1:k], '/') as path, case when k = len(p) then 'file' else 'dir' end as kind, k::bigint as depth from each where k <= 2) select * from every order by path, kind limit 30""")
def tree_limited(spark, sf):
    return Engine(corpus.page_files(spark, sf)).tree("", 1, limit=30)


@query(f"with {FILES} select 'table' as snapshot, count(*)::bigint as files, sum(size)::bigint as bytes, (select count(distinct doc_id % 9) from documents)::bigint as changed from files")
def workspace_status(spark, sf):
    """Snapshot, files, bytes and changed paths in one row."""
    files = corpus.corpus_files(spark, sf)
    changed = corpus.table(spark, sf, "documents").select((F.col("doc_id") % 9).cast("string").alias("path"))
    return Engine(files, snapshot="table", changed_paths=changed).status()


# --- stored index ------------------------------------------------------------------------------------------------------------------------------------------------------------------


@query("select 'missing' as step, null::boolean as fresh, 0::bigint as stale, 0::bigint as gone, 0::bigint as added union all select 'built', true, 0, 0, 0 union all select 'edited', false, count(*) filter (doc_id % 11 <> 0 and doc_id % 5 = 0 and doc_id % 7 <> 0)::bigint, count(*) filter (doc_id % 11 <> 0 and doc_id % 7 = 0)::bigint, count(*) filter (doc_id % 11 = 0 and doc_id % 7 <> 0)::bigint from documents union all select 'updated', true, 0, 0, 0")
def index_lifecycle(spark, sf):
    """What the index says of itself before it is built, once built, after files have changed, and after an update."""
    indexed, live = _edited(spark, sf)
    folder, rows = _folder(spark, "index"), []
    one, two = Engine(indexed, snapshot="s"), Engine(live, snapshot="s")
    note = lambda step, s: rows.append((step, s["fresh"] if s["exists"] else None, s.get("staleFiles", 0), s.get("missingFiles", 0), s.get("addedFiles", 0)))
    note("missing", one.index_status(folder))
    one.update(folder)
    note("built", one.index_status(folder))
    note("edited", two.index_status(folder))
    two.update(folder)
    note("updated", two.index_status(folder))
    one.clean(folder)
    return spark.createDataFrame(rows, "step string, fresh boolean, stale long, gone long, added long")


@query(f"with {FILES} select path, size, sha256(content) as hash, 'remote_unverified' as source from files")
def packed_catalog(spark, sf):
    """A snapshot packed, unpacked elsewhere with its checksums compared, and read where there is no local one."""
    files, folder, snapshot = stored_index(spark, sf)
    there, here = _folder(spark, "pack"), _folder(spark, "unpacked")
    archive.pack(spark, folder, snapshot, there)
    archive.unpack(spark, there, here)
    proofs = archive.fallback(spark, here, "none", "proofs").select("path", "hash", "source")
    return archive.fallback(spark, here, "none", "catalog").select("path", "size").join(proofs, "path")


# --- precise store and graph -------------------------------------------------------------------------------------------------------------------------------------------------------


def _facts(spark, sf) -> DataFrame:
    """Pages' headings and links as a provider's facts, 0-based, on one line."""
    pages = corpus.table(spark, sf, "pages")
    path = F.format_string("p/%d", "page_id").alias("path")
    row = lambda df, name, role, symbol: df.select(path, F.lit("html").alias("language"), F.lit(0).cast("long").alias("start_line"), F.col("pos").alias("start_column"), F.lit(0).cast("long").alias("end_line"), (F.col("pos") + F.col("width")).alias("end_column"), symbol.alias("symbol"), F.col(name).alias("display_name"), F.lit("class").alias("kind"), F.lit(role).alias("role"))
    heads = row(corpus.page_headings(pages), "name", "definition", F.concat(F.lit("h "), F.lower("name"), F.lit("#")))
    links = row(corpus.page_links(pages), "target", "reference", F.concat(F.lit("h "), F.lower(F.regexp_replace("target", "^/", "")), F.lit("#")))
    return heads.unionByName(links).withColumn("reliability", F.when(F.col("start_column") % 13 == 0, "parser_fallback").otherwise("provider_confirmed"))


@query(f"""with {TAGS}, {LINKS}, facts as (select path, 'definition' as role, 'h ' || lower(name) || '#' as symbol, pos, width from hs union all select path, 'reference', 'h ' || lower(regexp_replace(target, '^/', '')) || '#', pos, width from ls)
select distinct path, role, symbol, 1::bigint as line, pos + 1 as "column", pos + width + 1 as end_column, 'html' as language from facts where pos % 13 <> 0""")
def scip_round_trip(spark, sf):
    """Provider-confirmed facts written as protobuf indexes and read back."""
    folder = _folder(spark, "scip")
    scip.write_scip(_facts(spark, sf), folder)
    return scip.read_scip(spark, folder).select("path", "role", "symbol", "line", "column", "end_column", "language")


@query(f"""with {OCC}, syms as (select symbol_key, min(name) as name from occ group by 1) select o.path, o.role, s.name, o.pos from occ o join syms s using (symbol_key)""")
def occurrence_store(spark, sf):
    """Occurrences written to a store with their files' hashes and read back while every hash still holds."""
    pages = corpus.table(spark, sf, "pages")
    files = pages.select(F.format_string("p/%d", "page_id").alias("path"), F.col("html").alias("content"))
    occ = _occurrences(spark, sf).withColumns({"symbol": F.col("symbol_key"), "language": F.lit("html"), "kind": F.lit("symbol")})
    folder = _folder(spark, "occurrences")
    scip.build_store(occ, files, folder, "s")
    current = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    return scip.read_store(spark, folder, "s", current).select("path", "role", "name", "pos")


@query("select 'same' as files, true as usable union all select 'edited', count(*) filter (page_id % 10 = 0) = 0 from pages union all select 'none', false")
def occurrences_fresh(spark, sf):
    """A store is usable only while every one of its files has its hash, and if it has any."""
    files = corpus.table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("hash"))
    edited = files.withColumn("hash", F.when(F.col("page_id") % 10 == 0, "x").otherwise(F.col("hash")))
    say = lambda name, a, b: graph.occurrences_fresh(a, b).select(F.lit(name).alias("files"), "usable")
    return say("same", files, files).unionByName(say("edited", files, edited)).unionByName(say("none", files.limit(0), files))


@query(f"with {OCC} select path, name, pos from occ where role = 'definition' and path like 'p/%3%' and path not like '%5%'")
def precise_in_scope(spark, sf):
    """Precise definitions joined with the files that a scope lets through."""
    files = corpus.table(spark, sf, "pages").select(F.format_string("p/%d", "page_id").alias("path"))
    scoped = search.Scope(include=("3",), exclude=("5",)).apply(files)
    return graph.in_scope(_occurrences(spark, sf).where("role = 'definition'"), scoped).select("path", "name", "pos")


@query(f"""with {OCC}, defs as (select distinct path, symbol_key, pos from occ where role = 'definition'), refs as (select distinct path, symbol_key as callee, pos from occ where role = 'reference'),
around as (select r.path, r.callee, r.pos, arg_max(d.symbol_key, (d.pos, d.symbol_key)) as caller from refs r join defs d on d.path = r.path and d.pos <= r.pos group by 1, 2, 3)
select distinct caller, callee, path, pos + 1 as "column" from around where callee in (select symbol_key from defs)""")
def graph_from_occurrences(spark, sf):
    """Edges from the heading before each link to the heading that the link names."""
    occ = _occurrences(spark, sf).select("path", "role", "symbol_key", "name", F.lit("heading").alias("kind"), F.lit(1).cast("long").alias("line"), (F.col("pos") + 1).alias("column"), F.lit(1).cast("long").alias("end_line"), (F.col("pos") + 1).alias("end_column"))
    return graph.from_occurrences(occ)[1].select("caller", "callee", "path", "column")


@query(f"with {SITES}, e as (select caller, callee, path, line from sites group by all) select * from e where caller not like '%3' and callee not like '%7'")
def graph_resolved(spark, sf):
    """Edges written and read again with their nodes: those with an end that is no node are left out."""
    edges = graph.edges_of(corpus.call_sites(spark, sf))
    ids = graph.degrees(edges).select("id", F.col("id").alias("display_name"), F.lit("function").alias("kind"), F.lit("x").alias("path"), F.lit("parser").alias("source"))
    known = graph.nodes(ids.where("not (id like 'supplier%' and id like '%3') and not (id like 'part%' and id like '%7')"))
    folder = _folder(spark, "graph")
    catalog.write_snapshot({"nodes": known, "edges": edges}, folder, "s")
    return graph.resolved(catalog.read_snapshot(spark, folder, "nodes", "s"), catalog.read_snapshot(spark, folder, "edges", "s")).select("caller", "callee", "path", "line")


@query("""with n as (select 'n' || (event_id % 200)::varchar as id, event_type as kind, 'u/' || user_id::varchar as path, case when event_type = 'error' then 'precise' else 'parser' end as source from events)
select id, kind, path, source from (select *, row_number() over (partition by id order by (source <> 'precise'), path, kind) as k from n) where k = 1""")
def graph_nodes(spark, sf):
    """One row for each node id, precise ones first."""
    e = corpus.table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("n"), (F.col("event_id") % 200).cast("string")).alias("id"), F.lit("").alias("display_name"), F.col("event_type").alias("kind"), F.format_string("u/%d", "user_id").alias("path"), F.when(F.col("event_type") == "error", "precise").otherwise("parser").alias("source"))
    return graph.nodes(rows).select("id", "kind", "path", "source")


# --- responses ---------------------------------------------------------------------------------------------------------------------------------------------------------------------


@query(f"with {_found('(?i)llech')} select path || ':' || line::varchar as read_target, count(*)::bigint as n from found group by 1")
def read_targets(spark, sf):
    """What read() takes to show each hit, and how many hits it shows."""
    hits = search.find(corpus.corpus_files(spark, sf), Pattern("llech"))
    return response.with_read_target(hits).groupBy("read_target").agg(F.count("*").alias("n"))


@query(f"with {PAGES} select path, case when not contains(path, 'blog') then path end as read_target from pages_")
def read_targets_of_paths(spark, sf):
    """Paths without a place; binary ones aren't shown."""
    rows = corpus.page_files(spark, sf).select("path", F.when(F.col("path").contains("blog"), "binary").otherwise("file").alias("kind"))
    return response.with_read_target(rows).select("path", "read_target")


@query("select '{\"name\":\"' || p_name || '\"' || case when p_size % 3 = 0 then '' else ',\"size\":' || p_size::varchar end || '}' as result from part")
def public_results(spark, sf):
    """Rows as JSON, without the engine's own columns and without nulls."""
    p = corpus.table(spark, sf, "part")
    size = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    return response.public(p.select(F.col("p_name").alias("name"), size.alias("size"), F.lit("x").alias("producer"), F.lit(True).alias("index_fresh")))


@query("select count(*)::bigint as result_count, count(*) filter (length(text) > 900)::bigint as truncated_count, (select count(*) filter (event_type in ('view', 'click')) + 3 from events)::bigint as skipped_count from documents")
def response_summary(spark, sf):
    """Results, cut ones, and files that were skipped."""
    rows = corpus.table(spark, sf, "documents").select((F.length("text") > 900).alias("truncated"))
    e = corpus.table(spark, sf, "events")
    code = F.when(F.col("event_type") == "view", "binary_file_not_displayed").when(F.col("event_type") == "click", "unreadable_file_skipped").otherwise("other")
    return response.summary(rows, e.select(code.alias("code")), 3)


@query("""with w as (select event_id as seq, event_type as code, 'seen by ' || user_id::varchar as message from events union all select event_id + 1000000, 'parser_fact', 'late' from events)
select code, arg_min(message, (seq, message)) as message, case when code = 'parser_fact' then 'info' else 'warning' end as severity, case when code = 'parser_fact' then 'capability' else 'risk' end as category from w group by 1""")
def distinct_caveats(spark, sf):
    """Each code once, with its first message."""
    e = corpus.table(spark, sf, "events")
    one = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("code"), F.format_string("seen by %d", "user_id").alias("message"))
    two = e.select((F.col("event_id") + 1_000_000).alias("seq"), F.lit("parser_fact").alias("code"), F.lit("late").alias("message"))
    return response.distinct_caveats(one.unionByName(two))


@query("""with m as (select p_partkey as id, case p_partkey % 4 when 0 then 'failed to read ' || p_name when 1 then p_name || ': ' || p_brand when 2 then 'no_match: ' || p_name else p_brand || ' ' || p_name end as message from part)
select id, case id % 4 when 0 then 'read_failed' when 2 then 'no_match' else regexp_replace(regexp_replace(lower(string_split(message, ':')[1]), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') end as code from m""")
def stable_codes(spark, sf):
    p = corpus.table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    message = F.when(k == 0, F.concat(F.lit("failed to read "), "p_name")).when(k == 1, F.concat_ws(": ", "p_name", "p_brand")).when(k == 2, F.concat(F.lit("no_match: "), "p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    return p.select(F.col("p_partkey").alias("id"), response.stable_code_col(message).alias("code"))


# --- contracts over facts and changes ----------------------------------------------------------------------------------------------------------------------------------------------


@query("select layer, count(*)::bigint as n from (select case event_type when 'signup' then 'precise_provider' when 'view' then 'parser' when 'click' then 'config' when 'purchase' then 'source' end as layer from events) where layer is not null group by 1")
def fact_layers(spark, sf):
    """Facts by the layer of their reliability."""
    e = corpus.table(spark, sf, "events")
    level = F.try_element_at(F.create_map(*(F.lit(x) for x in ("signup", "provider_confirmed", "view", "parser_fallback", "click", "config_fact", "purchase", "source_fact"))), F.col("event_type"))
    layers = diffs.split_layers(e.select("event_id", level.alias("reliability")))
    out = None
    for df in layers.values():
        out = df if out is None else out.unionByName(df)
    return out.groupBy("layer").agg(F.count("*").alias("n"))


@query("""with b as (select doc_id, unnest(string_split(text, chr(10))) as body, doc_id % 5 = 0 as edited from documents), old as (select distinct doc_id, sha256(body) as h from b), new as (select distinct doc_id, sha256(case when edited then body || '!' else body end) as h from b)
select 'd/' || doc_id::varchar as path, doc_id % 5 <> 0 as file_unchanged, count(new.h)::bigint as reusable from old left join new using (doc_id, h) group by 1, 2""")
def reusable_bodies(spark, sf):
    """Bodies, here lines, that need no new parse: those that both states of a file have."""
    d = corpus.table(spark, sf, "documents")
    each = d.select("doc_id", F.format_string("d/%d", "doc_id").alias("path"), F.col("text").alias("t"), F.explode(F.split("text", "\n", -1)).alias("body"))
    edited = F.col("doc_id") % 5 == 0
    old = each.select("path", F.sha2("t", 256).alias("file_hash"), F.sha2("body", 256).alias("body_hash"))
    new = each.select("path", F.sha2(F.when(edited, F.concat("t", F.lit("!"))).otherwise(F.col("t")), 256).alias("file_hash"), F.sha2(F.when(edited, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256).alias("body_hash"))
    return diffs.reusable_bodies(old, new)


@query(f"with {SNAP}, d as (select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'dirty' end as change from a full join b using (path) where a.hash is distinct from b.hash) select path, change from d order by path limit 10 offset 5")
def diff_page(spark, sf):
    """Changed files 5 to 14 by path."""
    rows, about = diffs.diff_page(catalog.reconcile(*corpus.snapshots(spark, sf)), 5, 10)
    assert about["offset"] <= 5 and about["limit"] == 10
    return rows


@query(f"with {SNAP} select a.path, (select count(distinct user_id) from events where event_type = 'view')::bigint as blocked_roots from a left join b using (path) where b.path is null")
def diff_alignment(spark, sf):
    """Deleted files while manifests block: semantic facts of them may be out of date."""
    e = corpus.table(spark, sf, "events")
    manifests = e.select(F.col("user_id").alias("root_id"), F.when(F.col("event_type") == "view", "stale").otherwise("fresh").alias("state"))
    return diffs.diff_alignment(catalog.reconcile(*corpus.snapshots(spark, sf)).where("change = 'deleted'"), manifests)


PROVIDERS = "providers as (select * from (values ('view', 'a-ls'), ('view', 'b-ls'), ('click', 'c-ls'), ('signup', 'd-ls')) v(language, provider))"


def _providers(spark):
    return spark.createDataFrame([("view", "a-ls"), ("view", "b-ls"), ("click", "c-ls"), ("signup", "d-ls")], "language string, provider string")


@query(f"""with {PROVIDERS}, own as (select event_id as probe_id, event_type as language, case event_id % 3 when 0 then 'b-ls' when 1 then 'c-ls' end as preferred from events),
first as (select language, min(provider) as f from providers group by 1)
select probe_id, o.language, case when p.provider is not null then p.provider else f.f end as provider from own o left join providers p on p.language = o.language and p.provider = o.preferred left join first f on f.language = o.language""")
def provider_assignment(spark, sf):
    """Each probe's preferred provider if it serves the language, else the language's first, else none."""
    e = corpus.table(spark, sf, "events")
    k = F.col("event_id") % 3
    probes = e.select(F.col("event_id").alias("probe_id"), F.col("event_type").alias("language"), F.when(k == 0, "b-ls").when(k == 1, "c-ls").alias("preferred"))
    return states.provider_for(probes, _providers(spark)).select("probe_id", "language", "provider")


@query(f"with {PROVIDERS}, roots as (select distinct user_id as root_id, event_type as language from events) select root_id, language, provider, 'missing' as state from roots join providers using (language)")
def manifests_of_roots(spark, sf):
    """A manifest, missing at first, for each root and provider of its language."""
    roots = corpus.table(spark, sf, "events").select(F.col("user_id").alias("root_id"), F.col("event_type").alias("language")).distinct()
    return states.manifests_for(roots, _providers(spark)).select("root_id", "language", "provider", "state")


@query(f"""with {PROVIDERS}, m as (select e.event_type as language, p.provider, case when e.user_id = 1 then 'stale' else 'fresh' end as state from (select distinct user_id, event_type from events) e join providers p on p.language = e.event_type),
per as (select language, bool_or(state = 'stale') as blocked, min(provider) as provider from m group by 1)
select e.language, case when per.blocked is null then 'missing' when per.blocked then 'partial' else 'ready' end as state, per.provider from (select distinct event_type as language from events) e left join per using (language)""")
def capabilities(spark, sf):
    """What each language's manifests allow."""
    roots = corpus.table(spark, sf, "events").select(F.col("user_id").alias("root_id"), F.col("event_type").alias("language")).distinct()
    manifests = states.manifests_for(roots, _providers(spark)).withColumn("state", F.when(F.col("root_id") == 1, "stale").otherwise("fresh"))
    return states.capability(manifests, roots)


LEGAL = "'missing>starting', 'starting>importing', 'importing>ready', 'ready>resolving', 'resolving>ready', 'ready>stale', 'stale>resolving', 'starting>partial', 'importing>partial', 'resolving>partial', 'partial>retrying', 'retrying>ready', 'retrying>partial'"


@query(f"""with s as (select user_id, event_id, (['missing', 'starting', 'importing', 'ready', 'resolving', 'stale', 'partial', 'retrying'])[(event_id * 7 % 8 + 1)::int] as state from events),
m as (select *, lead(state) over (partition by user_id order by event_id) as next from s)
select state, next, (state || '>' || next) in ({LEGAL}) as legal, count(*)::bigint as n from m where next is not null group by 1, 2, 3""")
def provider_transitions(spark, sf):
    """Which moves between a provider's states are legal."""
    e = corpus.table(spark, sf, "events")
    names_ = F.array(*(F.lit(x) for x in ("missing", "starting", "importing", "ready", "resolving", "stale", "partial", "retrying")))
    s = e.select("user_id", "event_id", F.element_at(names_, (F.col("event_id") * 7 % 8 + 1).cast("int")).alias("state"))
    m = s.withColumn("next", F.lead("state").over(Window.partitionBy("user_id").orderBy("event_id"))).where("next is not null")
    return m.select("state", "next", states.can_move(F.col("state"), F.col("next")).alias("legal")).groupBy("state", "next", "legal").agg(F.count("*").alias("n"))


@query("with s as (select user_id as session, max(event_id)::bigint as seen_at from events group by 1) select session, seen_at from s where (select max(event_id) from events) - seen_at >= 20")
def idle_sessions(spark, sf):
    """Sessions that have been idle for a budget of twenty events."""
    e = corpus.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seen_at"))
    return ev.idle_sessions(e, e.agg(F.max("seen_at")).first()[0], 20)


@query("select 'u/' || user_id::varchar as path, count(*)::bigint as n from events where user_id % 4 <> 0 and event_type <> 'purchase' group by 1")
def events_worth_looking_at(spark, sf):
    """Change events outside generated directories; every fourth user's lie in one."""
    e = corpus.change_events(corpus.table(spark, sf, "events").where("event_type <> 'purchase'"))
    user = F.split_part("path", F.lit("/"), F.lit(2)).cast("long")
    hidden = e.withColumn("path", F.when(user % 4 == 0, F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path")))
    return ev.without_generated(hidden).groupBy("path").agg(F.count("*").alias("n"))


@query(f"with {SNAP}, r as (select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'dirty' end as change from a full join b using (path) where a.hash is distinct from b.hash) select change, count(*)::bigint as n from r group by 1")
def watch_once(spark, sf):
    """What watching once reports: the stored state against the files."""
    a, b = corpus.snapshots(spark, sf)
    folder = _folder(spark, "watched")
    catalog.write_snapshot({"proofs": a.select("path", "hash")}, folder, "s")
    found = catalog.reconcile(catalog.read_snapshot(spark, folder, "proofs", "s"), b)
    return found.groupBy("change").agg(F.count("*").alias("n"))


@query("with d as (select doc_id, unnest(string_split(text, chr(10))[1:1]) as line from documents) select doc_id, length(line[1:3])::bigint as chars, case when length(line) >= 3 then length(line[1:3])::bigint end as from_bytes, case when length(line) >= 3 then length(line[1:3])::bigint end as from_units from d")
def position_conversions(spark, sf):
    """The place after three characters, from its offsets in bytes and in UTF-16 units."""
    d = corpus.table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1)[0].alias("line"))
    head = F.substring("line", 1, 3)
    enough = F.length("line") >= 3
    return d.select("doc_id", F.length(head).cast("long").alias("chars"), F.when(enough, text.bytes_to_chars(F.col("line"), F.octet_length(head))).cast("long").alias("from_bytes"), F.when(enough, text.utf16_to_chars(F.col("line"), text.utf16_units(head))).cast("long").alias("from_units"))


@query("select count(*)::bigint as files, sum(strlen(text))::bigint as bytes, count(*) filter (contains(lower(text), 'tion'))::bigint as matched, case when count(*) > 200 or sum(strlen(text)) > 5242880 or count(*) filter (contains(lower(text), 'tion')) > 100 then 96 when count(*) > 20 or sum(strlen(text)) > 524288 or count(*) filter (contains(lower(text), 'tion')) > 50 then 160 else 240 end::bigint as preview_chars from documents")
def output_budget(spark, sf):
    """Files, bytes and matched files of the corpus, and how long previews may be."""
    f = corpus.corpus_files(spark, sf)
    n = f.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(Pattern("tion").matches(F.col("content"))).alias("matched"))
    return n.withColumn("preview_chars", paging.preview_chars_col(F.col("files"), F.col("bytes"), F.col("matched")))


@query("select 'p' || (p_partkey % 50)::varchar as path, 'f_' || p_partkey::varchar as caller, 'g' as callee from part")
def extracted_calls(spark, sf):
    """The calls in the same files, with the function around each."""
    p = corpus.table(spark, sf, "part")
    line = F.format_string("def f_%d(x):\n    return g(x)\n", "p_partkey")
    files = p.groupBy(F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("path")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("content")).withColumn("language", F.lit("python"))
    return extract.call_edges(extract.candidates(files, most=None)).select("path", "caller", "callee")
