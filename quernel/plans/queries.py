"""The registered queries over whole tables, and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from ..functions.patterns import Pattern, broad_reason
from ..operators import catalog, config, extract, graph, paging, project, search, states
from ..sources import corpus, workspace
from ..streaming import events as ev
from .api import Engine, browse, read_lines
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

STYLE = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
FILES = "files as (select concat_ws('/', source, lang, doc_id::varchar || '.txt') as path, lang as language, strlen(text)::bigint as size, text as content from documents)"
LINES = f"{FILES}, lines as (select path, language, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1))::bigint as line from files)"


def _found(regex: str, where: str = "true") -> str:
    """Matches by line with positions, from the pieces between matches."""
    return f"""{LINES}, cut as (
  select path, language, line, text, regexp_extract_all(text, '{regex}') as hits, string_split_regex(text, '{regex}') as parts from lines where regexp_matches(text, '{regex}') and {where}),
each as (select *, unnest(range(1, len(hits) + 1)) as k from cut),
found as (
  select path, language, line,
    (1 + list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::bigint as "column",
    hits[k] as match_text, text from each)"""


_PLACE = 'select path, line, "column", match_text from found'


def _places(hits: DataFrame) -> DataFrame:
    return hits.select("path", "line", "column", "match_text")


@query(f"with {_found('(?i)tion')} {_PLACE}")
def find_literal_ci(spark, sf):
    return _places(search.find(corpus.corpus_files(spark, sf), Pattern("tion")))


@query(f"with {_found('Tion')} {_PLACE}")
def find_literal_cs(spark, sf):
    return _places(search.find(corpus.corpus_files(spark, sf), Pattern("Tion", case_sensitive=True)))


@query(f"with {_found('(?i)th[aeo]n+d')} {_PLACE}")
def find_regex(spark, sf):
    return _places(search.find(corpus.corpus_files(spark, sf), Pattern("th[aeo]n+d", "regex")))


@query(f"with {_found('(?i)er[^\\n]st[^\\n]*tion')} {_PLACE}")
def find_wildcard(spark, sf):
    return _places(search.find(corpus.corpus_files(spark, sf), Pattern("er?st*tion", "wildcard")))


@query(f"""with {LINES}, toks as (select path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as tok from lines)
select path, line, count(*)::bigint as n from toks where lower(tok) = 'the' group by 1, 2""")
def find_identifier_boundary(spark, sf):
    """Whole-word hits per line."""
    hits = search.find(corpus.corpus_files(spark, sf), Pattern("the"), boundary=True)
    return hits.groupBy("path", "line").agg(F.count("*").alias("n"))


@query(f"""with {_found('(?i)licen')}, whole as (select path, string_split(content, chr(10)) as ls from files)
select f.path, line, "column", case when length(rtrim(text)) > 96 then rtrim(text)[1:96] || '...' else rtrim(text) end as preview,
  array_to_string(list_transform(ls[greatest(line - 2, 1):line - 1], lambda x: case when length(rtrim(x)) > 96 then rtrim(x)[1:96] || '...' else rtrim(x) end), '|') as before,
  array_to_string(list_transform(ls[line + 1:line + 2], lambda x: case when length(rtrim(x)) > 96 then rtrim(x)[1:96] || '...' else rtrim(x) end), '|') as after
from found f join whole w on f.path = w.path""")
def find_preview_context(spark, sf):
    hits = search.with_context(search.find(corpus.corpus_files(spark, sf), Pattern("licen"), preview=96), corpus.corpus_files(spark, sf), 2, 96)
    return hits.select("path", "line", "column", "preview", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"with {_found('(?i)ing', "(starts_with(path, 'src1/') or starts_with(path, 'src2/')) and lower(language) = 'en' and not contains(path, '7') and contains(path, 'en/')")} {_PLACE}")
def find_scoped(spark, sf):
    scope = search.Scope(dirs=("src1", "src2"), languages=("EN",), include=("en/",), exclude=("7",))
    return _places(search.find(scope.apply(corpus.corpus_files(spark, sf)), Pattern("ing")))


@query(f"with {_found('(?i)function')} select path, line, \"column\", match_text from found order by path, line, \"column\" limit 5")
def find_guarded_none(spark, sf):
    """A guarded literal with few hits or none shows what there is."""
    page = Engine(corpus.corpus_files(spark, sf)).find("function")
    return _places(page.results)


@query(f"with {_found('(?i)a')} select path, line, \"column\", match_text from found order by path, line, \"column\" limit 5")
def find_guarded_sample(spark, sf):
    """A broad query, here one character, shows five rows in order."""
    page = Engine(corpus.corpus_files(spark, sf)).find("a")
    assert page.guard == broad_reason("find", "a") and page.next_cursor is None
    return _places(page.results)


@query(f"with {_found('(?i)tion')} {_PLACE} order by path, line, \"column\" limit 100 offset 100")
def find_page_2(spark, sf):
    return paging.page(_places(search.find(corpus.corpus_files(spark, sf), Pattern("tion"))), 100, 100)


@query(f"""with {LINES} select path, line, regexp_extract(text, '^[A-Z]+[!]+', 0) as hit from lines where regexp_matches(text, '^[A-Z]+[!]+')""")
def find_line_anchored(spark, sf):
    """An anchored regex, searched in whole contents."""
    hits = search.find(corpus.corpus_files(spark, sf), Pattern("(?m)^[A-Z]+[!]+", "regex", True))
    return hits.select("path", "line", F.col("match_text").alias("hit"))


@query(f"""with {_found('(?i)tion')}, dims as (
  select 'topDir' as dim, string_split(path, '/')[1] as value from found union all select 'fileType', 'txt' from found union all select 'language', language from found)
select dim, value, count(*)::bigint as n from dims where value is not null group by 1, 2""")
def facets_all_dims(spark, sf):
    return paging.facets(search.find(corpus.corpus_files(spark, sf), Pattern("tion")))


@query(f"with {_found('(?i)tion')} select count(*)::bigint as hits, count(distinct path)::bigint as matched_files, 96::bigint as preview_chars from found")
def matched_files_budget(spark, sf):
    """Hits, distinct files and the preview budget that follows from them."""
    one = search.find(corpus.corpus_files(spark, sf), Pattern("tion")).agg(F.count("*").alias("hits"), F.count_distinct("path").alias("matched_files"))
    return one.withColumn("preview_chars", paging.preview_chars_col(F.col("matched_files"), F.lit(0), F.col("hits")))


@query(f"with {FILES} select path, size from files where contains(lower(path), 'src1/f')")
def files_substring(spark, sf):
    return search.find_paths(corpus.corpus_files(spark, sf), Pattern("SRC1/F", target="path")).select("path", "size")


@query(f"with {FILES} select path, size from files where regexp_full_match(path, 'src[0-4]/.*1\\.txt')")
def files_glob(spark, sf):
    return search.find_paths(corpus.corpus_files(spark, sf), Pattern("src[0-4]/**1.txt", "glob", True, "path")).select("path", "size")


@query(f"with {FILES} select path, size from files where regexp_matches(path, 'de/.*5.\\.t')")
def files_wildcard(spark, sf):
    return search.find_paths(corpus.corpus_files(spark, sf), Pattern("de/*5?.t", "wildcard", True, "path")).select("path", "size")


PAGES = r"pages_ as (select regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '') || '/' || page_id::varchar || '.html' as path, html as content, strlen(html)::bigint as size, page_id from pages)"


@query(f"""with {PAGES}, parts as (select string_split(path, '/') as p from pages_), each as (select unnest(range(1, len(p) + 1)) as k, p from parts)
select distinct array_to_string(p[1:k], '/') as path, case when k = len(p) then 'file' else 'dir' end as kind, k::bigint as depth from each where k <= 2""")
def tree_depth(spark, sf):
    return browse(corpus.page_files(spark, sf), "", 2)


@query(f"""with {FILES}, parts as (select string_split(path, '/') as p from files where starts_with(path, 'src3/'))
select distinct array_to_string(p[1:2], '/') as path, 'dir' as kind, 1::bigint as depth from parts""")
def list_dir(spark, sf):
    return browse(corpus.corpus_files(spark, sf), "src3", 1)


@query(f"with {FILES} select path, array_to_string(string_split(content, chr(10))[2:4], chr(10)) as content from files where len(string_split(regexp_replace(content, chr(10) || '$', ''), chr(10))) >= 2")
def read_range(spark, sf):
    """Lines 2 to 4 of every file that has a second one, as the verb reads them."""
    f = corpus.corpus_files(spark, sf).where(F.size(text.lines(F.regexp_replace("content", r"\\n\\z", ""))) >= 2)
    return read_lines(f, 2, 4).select("path", "content")


@query(f"with {PAGES} select path, size, 'html' as language from pages_ where not regexp_matches(path, '(^|/)(dist|target|en)(/|$)')")
def catalog_scan(spark, sf):
    """Pages as a catalog; a directory named en stands in for a generated one."""
    own = corpus.page_files(spark, sf)
    own = own.withColumn("real", F.col("path")).withColumn("path", F.regexp_replace("path", r"(^|/)en(?=/|$)", "$1dist"))
    return catalog.included(catalog.scan(own)).select(F.col("real").alias("path"), "size", "language")


@query(f"with {PAGES} select path, 'scan' as stage, 'generated' as reason from pages_ where regexp_matches(path, '(^|/)(dist|target|en)(/|$)')")
def skipped_log(spark, sf):
    own = corpus.page_files(spark, sf).withColumn("path", F.concat_ws("|", F.regexp_replace("path", r"(^|/)en(?=/|$)", "$1dist"), F.col("path")))
    return catalog.skipped_log(catalog.scan(own)).withColumn("path", F.split_part("path", F.lit("|"), F.lit(2)))


@query(f"""with {PAGES}, s as (select regexp_matches(path, '(^|/)(dist|target|en)(/|$)') as gen from pages_)
select count(*)::bigint as seen, count(*) filter (not gen)::bigint as included, count(*) filter (gen)::bigint as skipped_generated, 0::bigint as skipped_binary, 0::bigint as skipped_unreadable from s""")
def scan_summary(spark, sf):
    own = corpus.page_files(spark, sf).withColumn("path", F.regexp_replace("path", r"(^|/)en(?=/|$)", "$1dist"))
    return catalog.summary(catalog.scan(own))


@query(f"""with {LINES}, sized as (select path, line, text, coalesce(sum(strlen(text) + 1) over (partition by path order by line rows between unbounded preceding and 1 preceding), 0)::bigint as pos from lines)
select path, line, pos from sized s where not (text = '' and line = (select max(line) from lines l where l.path = s.path) and line > 1)""")
def line_offsets(spark, sf):
    f = corpus.corpus_files(spark, sf).select("path", F.posexplode(text.line_offsets(F.col("content"))).alias("k", "pos"))
    return f.select("path", (F.col("k") + 1).cast("long").alias("line"), "pos")


@query(f"with {FILES} select path, sha256(content) as hash from files")
def content_proof(spark, sf):
    return catalog.proofs(corpus.corpus_files(spark, sf)).select("path", "hash")


@query("""with h as (select doc_id, lower(hex(encode(lower(text)))) as h, unnest(range(0, greatest(strlen(lower(text)) - 2, 0))) as i from documents)
select gram, count(*)::bigint as files from (select distinct doc_id, substr(h, 2 * i + 1, 6) as gram from h) group by 1""")
def trigram_df(spark, sf):
    """In how many files each trigram is."""
    return catalog.gram_index(corpus.corpus_files(spark, sf)).groupBy("gram").agg(F.count("*").alias("files"))


@query(f"with {FILES} select path from files where contains(lower(content), 'lle') and contains(lower(content), 'lec') and contains(lower(content), 'ech')")
def trigram_candidates(spark, sf):
    return search.candidates(catalog.gram_index(corpus.corpus_files(spark, sf)), text.query_trigrams("lLech"))


@query(f"with {_found('(?i)llech')} {_PLACE}")
def indexed_find(spark, sf):
    """The search behind the stored trigram index; equal to the scan's."""
    files, folder, snapshot = stored_index(spark, sf)
    grams = catalog.read_snapshot(spark, folder, "grams", snapshot)
    return _places(search.find(search.prefiltered(files, grams, Pattern("llech")), Pattern("llech")))


@query(f"with {FILES}, rows_ as (select 'catalog' as name, count(*)::bigint as n from files union all select 'proofs', count(*)::bigint from files) select name, n from rows_")
def index_build(spark, sf):
    """The corpus's index, built if there is none of these files yet; rows of the tables that one row for each file makes."""
    _, folder, snapshot = stored_index(spark, sf)
    count = lambda name: catalog.read_snapshot(spark, folder, name, snapshot).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("catalog").unionByName(count("proofs"))


SNAP = """base as (select doc_id, 'd/' || doc_id::varchar as path, text from documents),
a as (select path, strlen(text)::bigint as size, sha256(text) as hash from base),
b as (select path, strlen(case when doc_id % 5 = 0 then text || '!' else text end)::bigint as size, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as hash from base where doc_id % 7 <> 0
  union all select path || '.new', strlen(text)::bigint, sha256(text) from base where doc_id % 11 = 0)"""


@query(f"with {SNAP} select a.path, a.size, coalesce(b.hash, 'missing_proof') as hash from a left join b using (path)")
def catalog_with_proofs(spark, sf):
    a, b = corpus.snapshots(spark, sf)
    return catalog.with_proofs(a.select("path", "size"), b)


@query(f"""with {SNAP} select a.path, case when b.path is null then 'missing' when a.hash = b.hash then 'fresh' else 'stale' end as state,
  case when b.path is null then 'missing' when a.hash = b.hash then 'match' else 'hash_mismatch' end as reason from a left join b using (path)""")
def freshness_status(spark, sf):
    return catalog.freshness(*corpus.snapshots(spark, sf))


@query(f"with {SNAP} select b.path, b.size, b.hash, case when a.hash = b.hash then 'index' else 'live_overlay' end as source_reason from b left join a using (path)")
def overlay_union(spark, sf):
    return catalog.overlay(*corpus.snapshots(spark, sf)).select("path", "size", "hash", "source_reason")


@query(f"""with {SNAP} select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'dirty' end as change
from a full join b using (path) where a.hash is distinct from b.hash""")
def reconcile_diff(spark, sf):
    return catalog.reconcile(*corpus.snapshots(spark, sf))


STATUS = "s as (select case event_type when 'signup' then '??' when 'view' then 'M ' when 'click' then ' M' when 'purchase' then 'MM' else 'A ' end as xy from events)"


@query(f"""with {STATUS} select count(*) filter (xy in ('M ', 'MM', 'A '))::bigint as staged, count(*) filter (xy in (' M', 'MM'))::bigint as unstaged, count(*) filter (xy = '??')::bigint as untracked, count(*)::bigint as total from s""")
def changed_summary(spark, sf):
    """Events as status lines, parsed and counted."""
    e = corpus.table(spark, sf, "events")
    xy = F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "??", "view", "M ", "click", " M", "purchase", "MM", "error", "A "))), F.col("event_type"))
    return workspace.changed_summary(workspace.parse_status(e.select(F.concat(xy, F.lit(" p/"), F.col("event_id").cast("string")).alias("value"))))


def shared_dir(spark) -> str:
    """The folder that all machines share; spark.checkpoint.dir names it. Unset (tests), one below the warehouse is used."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged").rstrip("/")


def stored_index(spark, sf):
    """(files, folder, snapshot): the corpus and its stored index, built where these very files have none. A snapshot is named by the table's files, sizes and times."""
    import hashlib

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in fs.listStatus(path))
    files, folder, snapshot = corpus.corpus_files(spark, sf), f"{shared_dir(spark)}/corpus-index", "table:" + hashlib.sha256("\n".join([sf, *seen]).encode()).hexdigest()[:16]
    if catalog.manifest(spark, folder, snapshot) is None:
        Engine(files, snapshot=snapshot).build(folder)
    return files, folder, snapshot


def _engine(spark, sf):
    """Pages with their headings and links as a precise store."""
    return Engine(corpus.page_files(spark, sf), occurrences=_occurrences(spark, sf).withColumn("symbol", F.col("symbol_key")))


def _page_symbols(spark, sf):
    heads = corpus.page_headings(corpus.table(spark, sf, "pages"))
    return heads.select(F.format_string("p/%d", "page_id").alias("path"), "name", "pos", (F.col("pos") + F.col("width")).alias("until"))


TAGS = r"""heads as (select page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) as names, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>') as tags, string_split_regex(html, '<h[1-6][^>]*>[^<]*</h[1-6]>') as parts from pages),
hs as (select 'p/' || page_id::varchar as path, names[k] as name, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(tags[1:k - 1], lambda x: length(x))), 0))::bigint as pos, length(tags[k])::bigint as width
  from (select *, unnest(range(1, len(tags) + 1)) as k from heads))"""
LINKS = r"""links as (select page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) as names, regexp_extract_all(html, '<a [^>]*href="[^"]*"') as tags, string_split_regex(html, '<a [^>]*href="[^"]*"') as parts from pages),
ls as (select 'p/' || page_id::varchar as path, names[k] as target, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(tags[1:k - 1], lambda x: length(x))), 0))::bigint as pos, length(tags[k])::bigint as width
  from (select *, unnest(range(1, len(tags) + 1)) as k from links))"""


@query(f"with {TAGS} select path, name, pos, width from hs")
def html_symbols(spark, sf):
    """Headings with their offsets: definitions of a page."""
    return corpus.page_headings(corpus.table(spark, sf, "pages")).select(F.format_string("p/%d", "page_id").alias("path"), "name", "pos", "width")


@query(f"with {LINKS} select path, target, pos, width from ls")
def html_links(spark, sf):
    return corpus.page_links(corpus.table(spark, sf, "pages")).select(F.format_string("p/%d", "page_id").alias("path"), "target", "pos", "width")


@query(f"with {TAGS} select path, name, pos from hs where contains(lower(name), 'er')")
def symbols_contains(spark, sf):
    return _engine(spark, sf).symbols("ER", limit=0).results.select("path", "name", "pos")


@query(f"""with {TAGS}, one as (select min(name) as n from hs where regexp_full_match(name, '[A-Za-z]+')) select path, name, pos from hs, one where lower(name) = lower(n) or {STYLE.format('name')} = {STYLE.format('n')}""")
def defs_exact(spark, sf):
    """Precise definitions of the corpus's least plain name."""
    engine = _engine(spark, sf)
    least = engine.occurrences.where("role = 'definition' and name rlike '^[A-Za-z]+$'").agg(F.min("name")).first()[0]
    return engine.defs(least or "none", limit=0).results.select("path", "name", "pos")


@query("""with s as (select p_name as name, 'p/' || p_partkey::varchar as path, p_brand as kind, p_type as container from part),
many as (select *, count(*) over (partition by name) as total from s),
dims as (select name, 'kind' as dim, kind as value from many where total > 1 union all select name, 'container', container from many where total > 1 union all select name, 'topDir', 'p' from many where total > 1)
select name, dim, value, count(*)::bigint as n from dims where value is not null group by 1, 2, 3""")
def defs_ambiguous(spark, sf):
    """Counts by kind, container and top directory of every name that several parts share."""
    s = corpus.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.format_string("p/%d", "p_partkey").alias("path"), F.col("p_brand").alias("kind"), F.col("p_type").alias("container"))
    return paging.ambiguity(s)




@query(f"select distinct p_name as name, {STYLE.format('p_name')} as key, {STYLE.format('p_type')} as type_key from part")
def style_key(spark, sf):
    p = corpus.table(spark, sf, "part")
    return p.select(F.col("p_name").alias("name"), names.style_key_col(F.col("p_name")).alias("key"), names.style_key_col(F.col("p_type")).alias("type_key")).distinct()


@query("select p_partkey as id, case when lower(p_brand) = 'brand#11' then 'raw' else 'style_key' end as matched_by from part where lower(p_brand) = 'brand#11' or replace(lower(p_brand), '#', '_') = 'brand_11'")
def name_variants(spark, sf):
    p = corpus.table(spark, sf, "part").withColumn("m", names.match_variant("p_brand", "Brand#11"))
    return p.where("m is not null").select(F.col("p_partkey").alias("id"), F.col("m.kind").alias("matched_by"))


OCC = f"{TAGS}, {LINKS}, occ as (select path, 'definition' as role, lower(name) as symbol_key, name, pos from hs union all select path, 'reference', lower(regexp_replace(target, '^/', '')), target, pos from ls)"


def _occurrences(spark, sf):
    pages = corpus.table(spark, sf, "pages")
    path = F.format_string("p/%d", "page_id").alias("path")
    d = corpus.page_headings(pages).select(path, F.lit("definition").alias("role"), F.lower("name").alias("symbol_key"), "name", "pos")
    r = corpus.page_links(pages).select(path, F.lit("reference").alias("role"), F.lower(F.regexp_replace("target", "^/", "")).alias("symbol_key"), F.col("target").alias("name"), "pos")
    return d.unionByName(r)


@query(f"with {OCC}, syms as (select symbol_key, min(name) as name from occ where role = 'definition' group by 1) select o.path, o.symbol_key, s.name, o.pos from occ o join syms s using (symbol_key) group by all")
def occurrences_defs(spark, sf):
    """Occurrences joined with the symbols that some definition names; references to nothing go."""
    o = _occurrences(spark, sf)
    symbols = o.where("role = 'definition'").groupBy("symbol_key").agg(F.min("name").alias("name"), F.lit("heading").alias("kind"))
    return graph.joined_symbols(o, symbols).select("path", "symbol_key", "name", "pos").distinct()


@query(f"with {OCC}, s as (select symbol_key, count(*)::bigint as n from occ group by 1) select o.path, o.symbol_key, o.pos, s.n from occ o join s using (symbol_key) where o.role = 'reference'")
def occurrences_refs(spark, sf):
    """References joined with their symbols."""
    o = _occurrences(spark, sf)
    return o.where("role = 'reference'").join(o.groupBy("symbol_key").agg(F.count("*").alias("n")), "symbol_key").select("path", "symbol_key", "pos", "n")


@query("""with s as (select p_brand as symbol_key, case when p_size % 3 = 0 then '' else p_name end as name, case when p_size % 2 = 0 then 'symbol' else p_type end as kind, p_partkey as seq from part)
select symbol_key, arg_min(name, (case when name = '' then 1 else 0 end, seq)) as name, arg_min(kind, (case when kind in ('', 'symbol') then 1 else 0 end, seq)) as kind, arg_min('x', seq) as language from s group by 1""")
def symbol_upsert_merge(spark, sf):
    p = corpus.table(spark, sf, "part")
    s = p.select(F.col("p_brand").alias("symbol_key"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, "symbol").otherwise(F.col("p_type")).alias("kind"), F.lit("x").alias("language"), F.col("p_partkey").alias("seq"))
    return names.upsert_symbols(s)


@query(f"""with {LINES}, {TAGS}, pl as (select 'p/' || page_id::varchar as path, unnest(string_split(html, chr(10))) as text, unnest(range(1, len(string_split(html, chr(10))) + 1))::bigint as line, len(string_split(html, chr(10))) as n from pages),
toks as (select path, line, text, regexp_extract_all(text, '(?i)for') as hits, string_split_regex(text, '(?i)for') as parts from pl where regexp_matches(text, '(?i)for')),
found as (select path, line, text, (1 + list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::bigint as "column" from (select *, unnest(range(1, len(hits) + 1)) as k from toks)),
whole as (select * from found where not regexp_matches(coalesce(text["column" - 1:"column" - 1], ''), '[A-Za-z0-9_]') and not regexp_matches(coalesce(text["column" + 3:"column" + 3], ''), '[A-Za-z0-9_]'))
select w.path, w.line, w."column", case when count(h.pos) > 0 then 'definition' else 'reference_candidate' end as role from whole w left join hs h on h.path = w.path and w.line = 1 and h.pos + 1 <= w."column" and w."column" + 3 <= h.pos + h.width + 1 group by 1, 2, 3""")
def refs_with_role(spark, sf):
    """Whole words in pages; those within a heading on the first line count as its definition."""
    pages = corpus.table(spark, sf, "pages")
    files = pages.select(F.format_string("p/%d", "page_id").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    heads = _page_symbols(spark, sf)
    spots = heads.select("path", F.lit(1).cast("long").alias("line"), (F.col("pos") + 1).alias("column"), F.lit(1).cast("long").alias("end_line"), (F.col("until") + 1).alias("end_column"))
    return search.with_roles(search.find(files, Pattern("for"), boundary=True), spots).select("path", "line", "column", "role")


@query(f"""with {TAGS}, {LINKS} select l.path, l.target, l.pos, arg_max(h.name, (case when h.pos + 4000 >= l.pos then 1 else 0 end, h.pos, -(h.pos + 4000), h.name)) as enclosing
from ls l left join hs h on h.path = l.path and h.pos <= l.pos group by 1, 2, 3""")
def enclosing_symbol_asof(spark, sf):
    """The heading whose body, taken as 4000 characters, holds each link, else the latest before it."""
    pages = corpus.table(spark, sf, "pages")
    path = F.format_string("p/%d", "page_id").alias("path")
    refs = corpus.page_links(pages).select(path, "target", "pos")
    defs = corpus.page_headings(pages).select(path, "name", "pos", (F.col("pos") + 4000).alias("until"))
    return graph.enclosing(refs, defs)


SITES = "sites as (select 'supplier#' || l_suppkey::varchar as caller, 'part#' || l_partkey::varchar as callee, 'o/' || l_orderkey::varchar as path, l_linenumber::bigint as line, 1::bigint as \"column\", case when l_returnflag = 'N' then 'precise' else 'parser' end as source from lineitem)"


@query(f"""with {SITES}, named as (select distinct caller as id, lower(regexp_extract(caller, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1)) as last from sites),
m as (select id, case when lower(id) = 'supplier#7' then 'raw' when last = '7' then 'qualified_tail' end as matched_by from named)
select caller, callee, path, line, matched_by from sites join m on m.id = sites.caller where matched_by is not null group by all""")
def calls_of(spark, sf):
    """Outgoing edges of every node that a variant of the input matches, by whatever form."""
    page = Engine(corpus.corpus_files(spark, sf), edges=graph.edges_of(corpus.call_sites(spark, sf).withColumn("source", F.lit("precise")))).calls("supplier#7", limit=0)
    return page.results.select("caller", "callee", "path", "line", "matched_by")


@query(f"""with {SITES}, m as (select distinct callee as id, case when lower(callee) = 'part#15' then 'raw' when lower(regexp_extract(callee, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1)) = '15' then 'qualified_tail' end as matched_by from sites)
select caller, callee, path, line, matched_by from sites join m on m.id = sites.callee where matched_by is not null group by all""")
def callers_of(spark, sf):
    page = Engine(corpus.corpus_files(spark, sf), edges=graph.edges_of(corpus.call_sites(spark, sf).withColumn("source", F.lit("precise")))).callers("part#15", limit=0)
    return page.results.select("caller", "callee", "path", "line", "matched_by")


@query(f"with {SITES}, m as (select *, bool_or(source = 'precise') over (partition by path, caller) as p from sites) select caller, callee, path, line, source from m where source = 'precise' or not p")
def prefer_precise(spark, sf):
    return graph.prefer_precise(corpus.call_sites(spark, sf), ["path", "caller"]).drop("column")


@query(f'with {SITES} select caller, callee, path, line, "column", max(source) as source from sites group by all')
def edge_dedup(spark, sf):
    s = corpus.call_sites(spark, sf)
    return graph.edges_of(s.unionByName(s))


@query(f"with {SITES}, e as (select caller as id, 1 as o, 0 as i from sites union all select callee, 0, 1 from sites) select id, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from e group by 1")
def graph_degrees(spark, sf):
    return graph.degrees(corpus.call_sites(spark, sf))


@query("""with r as (select l_suppkey, l_orderkey, l_linenumber, count(*) over (partition by l_suppkey)::bigint as total, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber)::bigint as n from lineitem)
select l_suppkey, l_orderkey, l_linenumber, total, n from r where n <= 50""")
def root_budget(spark, sf):
    """The first 50 candidates of every root, with its total."""
    return graph.budget(corpus.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", ["l_orderkey", "l_linenumber"], 50)


ROOTS = "roots as (select distinct string_split(path, '/')[1] as dir from pages_ union select distinct array_to_string(string_split(path, '/')[1:2], '/') from pages_ where page_id % 3 = 0)"


@query(f"with {PAGES}, {ROOTS} select path, arg_max(dir, length(dir)) as dir from pages_ p left join roots r on starts_with(p.path, r.dir || '/') group by 1")
def owning_root_longest_prefix(spark, sf):
    """Each page's nearest root, of hosts and some of their directories."""
    files = corpus.page_files(spark, sf).select("path", "page_id")
    parts = F.split("path", "/")
    roots = files.select(parts[0].alias("dir")).union(files.where("page_id % 3 = 0").select(F.array_join(F.slice(parts, 1, 2), "/"))).distinct()
    return project.longest_prefix(files.select("path"), roots).select("path", F.col("owner.dir").alias("dir"))


#: Names of a workspace's files, dealt out over the documents' directories.
NAMES = ("go.mod", "Cargo.toml", "package.json", "pom.xml", "Dockerfile", "main.go", "Makefile", "go.sum", "yarn.lock", "app.yaml", ".env", "x.conf", "x.gen.go")


def _project_files(spark, sf):
    d = corpus.table(spark, sf, "documents")
    marker = F.element_at(F.array(*(F.lit(x) for x in NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return d.select(F.concat_ws("/", "source", "lang", marker).alias("path")).distinct().withColumn("language", text.language_of(F.col("path")))


PROJECT = """names as (select distinct source || '/' || lang as dir, (['go.mod', 'Cargo.toml', 'package.json', 'pom.xml', 'Dockerfile', 'main.go', 'Makefile', 'go.sum', 'yarn.lock', 'app.yaml', '.env', 'x.conf', 'x.gen.go'])[(doc_id % 13 + 1)::int] as name from documents),
lang_of as (select unnest(['go.mod', 'Cargo.toml', 'package.json', 'pom.xml', 'go.sum', 'yarn.lock']) as name, unnest(['go', 'rust', 'typescript', 'java', 'go', 'typescript']) as language),
roots as (select dir, case name when 'go.mod' then 'go' when 'Cargo.toml' then 'rust' when 'package.json' then 'typescript' else 'java' end as language, case name when 'go.mod' then 'go_module' when 'Cargo.toml' then 'cargo' when 'package.json' then 'node' else 'maven' end as kind
  from names where name in ('go.mod', 'Cargo.toml', 'package.json', 'pom.xml'))"""


@query(f"with {PROJECT} select language || ':' || dir as root_id, dir, language, kind from roots")
def project_roots(spark, sf):
    return project.discover_roots(_project_files(spark, sf)).select("root_id", "dir", "language", "kind")


@query(f"with {PROJECT} select n.dir || '/' || n.name as path, 'go' as language, case when r.dir is null then null else 'go:' || r.dir end as root_id, n.name = 'x.gen.go' as \"generated\" from names n left join roots r on r.dir = n.dir and r.language = 'go' where n.name in ('main.go', 'x.gen.go')")
def source_owners(spark, sf):
    files = _project_files(spark, sf)
    return project.owners(files.where("path like '%.go'"), project.discover_roots(files))


@query(f"""with {PROJECT}, near as (select n.dir, n.name, max(r.language || ':' || r.dir) as nearest, max(r.language || ':' || r.dir) filter (r.language = l.language) as own, max(l.language) as language
  from names n left join lang_of l using (name) left join roots r using (dir) group by 1, 2),
kinds as (select *, case when name in ('go.mod', 'Cargo.toml', 'package.json', 'pom.xml') then 'build' when name in ('go.sum', 'yarn.lock') then 'dependency' when name = 'Makefile' then 'automation'
  when name in ('app.yaml', 'x.conf') then 'runtime' end as kind from near)
select dir || '/' || name as path, kind, case kind when 'build' then own when 'dependency' then coalesce(own, nearest) when 'runtime' then nearest end as root_id, kind = 'automation' as all_roots,
  (kind <> 'automation' and case kind when 'build' then own when 'dependency' then coalesce(own, nearest) else nearest end is null) as unresolved from kinds where kind is not null""")
def config_affects_roots(spark, sf):
    """Build files concern their own root, lock files the root of their language, runtime files the nearest, scripts every root."""
    files = _project_files(spark, sf)
    return project.config_edges(files, project.discover_roots(files)).drop("affected")


@query(f"with {PROJECT} select dir || '/' || name as path, case name when 'Dockerfile' then 'container' else 'dot_env' end as kind, true as all_roots, false as unresolved from names where name in ('Dockerfile', '.env')")
def environment_edges(spark, sf):
    files = _project_files(spark, sf)
    return project.environment_edges(files, project.discover_roots(files))


@query(f"with {PROJECT} select n.dir || '/' || n.name as path, r.language || ':' || r.dir as root_id from names n, roots r where n.name in ('Makefile', 'Dockerfile') and n.dir = 'src1/de'")
def affected_roots(spark, sf):
    """Every root that the scripts and containers of one directory concern."""
    files = _project_files(spark, sf)
    roots = project.discover_roots(files)
    edges = project.config_edges(files, roots).select("path", "affected", "all_roots").unionByName(project.environment_edges(files, roots).select("path", F.array().cast("array<string>").alias("affected"), "all_roots"))
    return project.affected_roots(edges.where("path in ('src1/de/Makefile', 'src1/de/Dockerfile')"), roots)


@query("select event_id, 'k' as key_path, regexp_extract(props, '\"k\": *([0-9]+)', 1) as value from events")
def json_key_values(spark, sf):
    return config.json_leaves(corpus.table(spark, sf, "events"), "event_id", "props")


SECRETS = "('password', 'passwd', 'secret', 'token', 'apikey', 'api_key', 'accesskey', 'privatekey', 'credential', 'auth', 'bearer', 'clientsecret')"


@query(f"""with {LINES}, bare as (select path, line, text, lower(text) as low, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as b from lines where line <= 3),
shown as (select *, contains(low, 'secret') or contains(low, 'token') or contains(low, 'password') or contains(low, 'passwd') or contains(low, 'credential') or contains(b, 'secret') or contains(b, 'token') or contains(b, 'password')
  or contains(b, 'passwd') or contains(b, 'credential') or contains(b, 'apikey') or contains(b, 'privatekey') or contains(b, 'accesskey') or contains(b, 'authkey') as hidden, regexp_replace(regexp_replace(trim(text, ' '), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') as t from bare)
select path, line, case when hidden then '***' when length(t) > 160 then t[1:160] || '...' else t end as preview from shown""")
def masked_preview(spark, sf):
    """The first three lines of every file as previews of values: secret-like ones masked, long ones cut."""
    f = corpus.corpus_files(spark, sf).select("path", F.posexplode(F.slice(text.lines(F.col("content")), 1, 3)).alias("k", "text"))
    return f.select("path", (F.col("k") + 1).cast("long").alias("line"), text.masked_preview(F.lit(""), F.col("text")).alias("preview"))


@query("select p_partkey as id, 'part.' || replace(p_name, ' ', '.') as key_path from part where contains('part.' || replace(p_name, ' ', '.'), 'widget')")
def key_filter(spark, sf):
    """Parts' names as dotted keys; case counts, so nothing matches WIDGET."""
    p = corpus.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part."), F.regexp_replace("p_name", " ", ".")).alias("key_path"))
    return p.where(config.key_matches(F.col("key_path"), " widget ") & ~config.key_matches(F.col("key_path"), "WIDGET"))


PROBES = "probes as (select event_id as probe_id, user_id as root_id, event_type as provider, (event_id * 7 % 5)::bigint as priority, user_id % 10 as k from events)"


def _probes(spark, sf):
    e = corpus.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("root_id"), F.col("event_type").alias("provider"), (F.col("event_id") * 7 % 5).cast("long").alias("priority"), (F.col("user_id") % 10).alias("k"))


@query(f"with {PROBES}, r as (select *, row_number() over (partition by root_id, provider order by priority, probe_id) as n from probes) select probe_id, root_id, provider, priority, k from r where n = 1")
def probe_dedup_priority(spark, sf):
    return states.dedup_probes(_probes(spark, sf), ["root_id", "provider"])


@query(f"""with {PROBES}, r as (select *, dense_rank() over (partition by provider order by root_id) as r, row_number() over (partition by provider, root_id order by priority, probe_id) as p from probes)
select probe_id, root_id, provider, priority, k, case when r > 40 then 'deferred_roots' when p > 2 then 'deferred_probes' else 'run' end as decision from r""")
def probe_deferral(spark, sf):
    return states.schedule(_probes(spark, sf), 40, 2)


@query("""with h as (select source, sha256(doc_id::varchar || ':' || sha256(text)) as d from documents),
lanes as (select source, d, unnest(range(0, 8)) as k from h),
sums as (select source, k, sum(('0x' || d[8 * k + 1:8 * k + 8])::bigint)::hugeint % 2305843009213693952 as s from lanes group by 1, 2),
n as (select source, count(*)::bigint as n from documents group by 1)
select source, string_agg(lpad(lower(to_hex(s::bigint)), 16, '0'), '' order by k) as digest, any_value(n) as n from sums join n using (source) group by 1""")
def set_digest_per_source(spark, sf):
    d = corpus.table(spark, sf, "documents")
    return catalog.set_digest(d, ["source"], F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)))


FOLD = """recursive ev as (select 'u/' || user_id::varchar as path, event_id as seq, case event_type when 'signup' then 'create' when 'view' then 'modify' when 'click' then 'touch' when 'purchase' then (case when event_id % 3 = 0 then 'rename' else 'rename_from' end) else 'remove' end as kind, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as total from events),
fold as (
  select path, 0::bigint as n, any_value(total) as total, 0::bigint as seq, null::varchar as state, null::varchar as previous_path from ev group by 1
  union all
  select e.path, e.n, e.total, e.seq,
    case when e.kind = 'rename' then 'renamed' when f.state is null then case e.kind when 'create' then 'added' when 'remove' then 'deleted' when 'rename_from' then 'renamed' else 'modified' end
      when f.state = 'added' then case e.kind when 'modify' then 'modified' when 'remove' then null else 'added' end else f.state end,
    case when e.kind = 'rename' then e.path || '.old' else f.previous_path end
  from fold f join ev e on e.path = f.path and e.n = f.n + 1)"""


@query(f"with {FOLD} select path, state, previous_path, seq as last_seq from fold where n = total and state is not null")
def event_fold_batch(spark, sf):
    return ev.fold(corpus.change_events(corpus.table(spark, sf, "events")))


@query(f"with {FOLD} select path, state, previous_path, seq as last_seq from fold where n = total and state is not null")
def event_fold_stream(spark, sf):
    """The fold as a stream over the whole table, drained into files; the last row of each path."""
    import uuid

    source = spark.readStream.schema(corpus.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = ev.drain(ev.fold_stream(corpus.change_events(source)), f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}")
    last = rows.groupBy("path").agg(F.max_by(F.struct("state", "previous_path"), F.struct("last_seq", "batch")).alias("s"), F.max("last_seq").alias("last_seq"))
    return last.select("path", "s.state", "s.previous_path", "last_seq").where("state is not null")


MANIFEST = """recursive ev as (select user_id as root_id, event_id as seq, case event_type when 'signup' then 'built' when 'view' then 'source' when 'click' then 'reconcile' when 'purchase' then 'config' else 'other' end as event, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as total from events),
fold as (
  select root_id, 0::bigint as n, any_value(total) as total, 'fresh' as state from ev group by 1
  union all
  select f.root_id, e.n, f.total, case when e.event in ('source', 'config') then 'stale' when e.event = 'reconcile' and f.state = 'stale' then 'updating' when e.event = 'built' and f.state = 'updating' then 'fresh' else f.state end from fold f join ev e on e.root_id = f.root_id and e.n = f.n + 1)"""


@query(f"with {MANIFEST} select root_id, state from fold where n = total")
def manifest_state_machine(spark, sf):
    e = corpus.table(spark, sf, "events")
    event = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for x in ("signup", "built", "view", "source", "click", "reconcile", "purchase", "config"))), F.col("event_type")), F.lit("other"))
    return ev.manifest_states(e.select(F.col("user_id").alias("root_id"), F.col("event_id").alias("seq"), event.alias("event")))


@query("""select 'conv/' || conv_id::varchar as path, turn as line, role, (length(text) - length(regexp_replace(text, '(?i)the', '', 'g'))) // 3 as hits from conversations where regexp_matches(text, '(?i)the')""")
def conversation_turn_search(spark, sf):
    """Turns with a literal, and how often."""
    c = corpus.conversation_files(spark, sf)
    return c.where(F.col("content").rlike("(?iu)the")).select("path", "line", "role", F.regexp_count("content", F.lit("(?iu)the")).cast("long").alias("hits"))


@query("select doc_id, length(text)::bigint as code_points, strlen(text)::bigint as bytes, list_sum(list_transform(string_split(text, ''), lambda c: case when unicode(c) > 65535 then 2 else 1 end))::bigint as utf16 from documents")
def text_units(spark, sf):
    """Lengths in code points, bytes and UTF-16 units: what positions are counted in."""
    d = corpus.table(spark, sf, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("code_points"), F.octet_length("text").cast("long").alias("bytes"), text.utf16_units(F.col("text")).alias("utf16"))


#: Source in each language, %d being a number: path, and a definition, one inside it, and a call.
SOURCES = {
    "py": "class C%d:\n    def m%d(self):\n        return h%d(1)\n",
    "rs": "struct S%d { id: u32 }\nimpl S%d {\n  fn w%d(&self) -> u32 { t%d(self.id) }\n}\n",
    "go": "package main\ntype J%d struct { n int }\nfunc (j *J%d) R%d() { q%d(j.n) }\n",
    "java": "public class A%d {\n  void s%d() { u%d(1); }\n}\n",
    "ts": "export class V%d {\n  r%d() { return d%d(x); }\n}\n",
}


@query("""with f as (select p_partkey as k, (['py', 'rs', 'go', 'java', 'ts'])[(p_partkey % 5 + 1)::int] as ext from part),
t as (select * from (values ('py', 'class', 'C', 1), ('py', 'method', 'm', 2), ('py', 'call', 'h', 3), ('rs', 'type', 'S', 1), ('rs', 'method', 'w', 3), ('rs', 'call', 't', 3), ('go', 'type', 'J', 2), ('go', 'definition', 'R', 3), ('go', 'call', 'q', 3),
  ('java', 'class', 'A', 1), ('java', 'method', 's', 2), ('java', 'call', 'u', 2), ('ts', 'class', 'V', 1), ('ts', 'method', 'r', 2), ('ts', 'call', 'd', 2)) v(ext, candidate_kind, letter, line))
select 'f/' || k::varchar || '.' || ext as path, candidate_kind, letter || k::varchar as name, line::bigint as line from f join t using (ext)""")
def source_extract(spark, sf):
    """Symbols and calls of a source file for each part, in five languages."""
    p = corpus.table(spark, sf, "part")
    exts = F.array(*(F.lit(x) for x in SOURCES))
    own = p.select(F.col("p_partkey").alias("k"), F.element_at(exts, (F.col("p_partkey") % 5 + 1).cast("int")).alias("ext"))
    body = F.coalesce(*(F.when(F.col("ext") == e, F.regexp_replace(F.lit(t), "%d", F.col("k").cast("string"))) for e, t in SOURCES.items()))
    files = own.select(F.concat(F.lit("f/"), F.col("k").cast("string"), F.lit("."), F.col("ext")).alias("path"), body.alias("content")).withColumn("language", text.language_of(F.col("path")))
    return extract.candidates(files).select("path", "candidate_kind", "name", F.col("line").cast("long").alias("line"))


from . import queries_store  # noqa: E402, F401  registers more queries
