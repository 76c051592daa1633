"""Project roots, source ownership and the edges that configuration files make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, parent_dir

#: Marker file to (root kind, language, priority).
MARKERS = {
    "Cargo.toml": ("cargo", "rust", 0), "go.mod": ("go_module", "go", 0), "go.work": ("go_workspace", "go", 1), "package.json": ("node", "typescript", 1), "tsconfig.json": ("typescript", "typescript", 0),
    "jsconfig.json": ("typescript", "typescript", 2), "pom.xml": ("maven", "java", 0), "build.gradle": ("gradle", "java", 1), "build.gradle.kts": ("gradle", "java", 1), "settings.gradle": ("gradle", "java", 2), "settings.gradle.kts": ("gradle", "java", 2),
}
#: Lock files and the language whose roots they belong to.
LOCKS = {"Cargo.lock": "rust", "package-lock.json": "typescript", "pnpm-lock.yaml": "typescript", "yarn.lock": "typescript", "gradle.lockfile": "java", "go.sum": "go"}
#: Extensions of runtime configuration; scripts and pipelines; containers, compose files, dot-env files and cluster manifests, which are environment.
RUNTIME = ("env", "conf", "config", "properties", "yaml", "yml", "json", "toml", "ini")
AUTOMATION = r"(^|/)(Makefile|makefile|[^/]*\.mk|[^/]*\.sh)$|^(?i:\.github/workflows/|\.gitlab-ci)|/(?i:\.gitlab-ci\.ya?ml)$|(?i:jenkinsfile)$"
ENVIRONMENT = (("container", r"(^|/)Dockerfile(\.[^/]*)?$"), ("compose", r"(?i)compose\.ya?ml$"), ("dot_env", r"(^|/)\.env(\.[^/]*)?$"), ("kubernetes", r"(?i)(^(k8s|kubernetes)(/|$)|/(k8s|kubernetes)/)"))
#: Directories and file names of generated sources, in any case.
GENERATED = r"(?i)(^|/)(gen|generated|__generated__|dist)(/|$)|[^/]*\.(generated|gen)\.[^/]*$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def discover_roots(files: DataFrame) -> DataFrame:
    """root_id = language:dir, dir, language, kind (the least priority), markers, merged by directory and language."""
    rows = F.create_map(*(x for k, (kind, lang, rank) in MARKERS.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(lang).alias("language"), F.lit(rank).alias("rank")))))
    found = files.select(parent_dir(F.col("path")).alias("dir"), file_name(F.col("path")).alias("marker")).withColumn("m", F.try_element_at(rows, F.col("marker"))).where("m is not null")
    merged = found.groupBy("dir", F.col("m.language").alias("language")).agg(F.min_by("m.kind", F.struct("m.rank", "marker")).alias("kind"), F.array_sort(F.collect_set("marker")).alias("markers"))
    return merged.withColumn("root_id", F.concat_ws(":", "language", F.when(F.col("dir") == "", ".").otherwise(F.col("dir"))))


def under(path: Column, root_dir: Column) -> Column:
    return (root_dir == "") | (path == root_dir) | F.startswith(path, F.concat(root_dir, F.lit("/")))


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ('') included: prefix joins become equi-joins on these."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def longest_prefix(files: DataFrame, prefixes: DataFrame, *, same_language: bool = False, ties: bool = False) -> DataFrame:
    """files with the row of prefixes (dir, ...) whose dir is their nearest ancestor, the greatest of several, null if none. Each file's ancestors, as many as its depth, are joined by equality: no theta join.

    With ties every nearest row comes."""
    right = prefixes.select(F.struct(*prefixes.columns).alias("owner"))
    each = files.withColumn("up", F.explode(ancestors(F.col("path"))))
    cond = F.col("up") == F.col("owner.dir")
    if same_language:
        cond = cond & (F.col("language") == F.col("owner.language"))
    joined = each.join(right, cond, "left")
    own = files.columns
    if ties:
        best = joined.groupBy(*own).agg(F.max(F.when(F.col("owner").isNotNull(), F.length("up"))).alias("far"), F.collect_set(F.when(F.col("owner").isNotNull(), F.struct(F.length("up").alias("n"), "owner"))).alias("all"))
        return best.select(*own, F.explode_outer(F.filter("all", lambda x: x["n"] == F.col("far"))).alias("x")).select(*own, F.col("x.owner").alias("owner"))
    return joined.groupBy(*own).agg(F.max_by("owner", F.when(F.col("owner").isNotNull(), F.struct(F.length("up"), "owner"))).alias("owner"))


def owners(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, language, root_id (or null), generated."""
    own = longest_prefix(files.select("path", "language"), roots, same_language=True)
    return own.select("path", "language", F.col("owner.root_id").alias("root_id"), F.col("path").rlike(GENERATED).alias("generated"))


def environment_kind(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, regex in reversed(ENVIRONMENT):
        out = F.when(path.rlike(regex), kind).otherwise(out)
    return out


def config_kind(path: Column) -> Column:
    """build (a root's marker), dependency (a lock file), automation or runtime; environment files are none of these but where they are one of the first three."""
    name = file_name(path)
    runtime = F.lower(extension(path)).isin(*RUNTIME) & environment_kind(path).isNull()
    return F.when(name.isin(*MARKERS), "build").when(name.isin(*LOCKS), "dependency").when(path.rlike(AUTOMATION), "automation").when(runtime, "runtime")


def shared_config(path: Column) -> Column:
    """Files at the top or below config directories concern every root."""
    return ~path.contains("/") | F.split_part(path, F.lit("/"), F.lit(1)).isin("config", ".config")


def config_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, kind, root_id (the owner or null), affected (root ids, if few), all_roots (whether it concerns every root, as a link to the set of roots), unresolved.

    A marker concerns its own root; a lock file the nearest root of its language, else all if it is shared, else the nearest root; runtime files all if shared, else the nearest; automation all.
    Roots are never copied to a file: all_roots stands for them, and affected_roots() lists them where that is wanted.
    """
    conf = files.select("path", config_kind(F.col("path")).alias("kind"), file_name(F.col("path")).alias("name")).where("kind is not null")
    marker = F.create_map(*(F.lit(x) for k, (_, language, _) in MARKERS.items() for x in (k, language)))
    lock = F.create_map(*(F.lit(x) for kv in LOCKS.items() for x in kv))
    conf = conf.withColumn("language", F.coalesce(F.try_element_at(marker, F.col("name")), F.try_element_at(lock, F.col("name"))))
    near = longest_prefix(conf, roots.select("dir", "root_id")).withColumnRenamed("owner", "any_owner")
    near = longest_prefix(near, roots.select("dir", "root_id", "language"), same_language=True)
    some = F.broadcast(roots.agg((F.count("*") > 0).alias("some")))  # one row
    own, nearest, shared = F.col("owner.root_id"), F.col("any_owner.root_id"), shared_config(F.col("path"))
    kind = F.col("kind")
    every = F.col("some") & F.when(kind == "automation", True).when(kind == "runtime", shared).when(kind == "dependency", own.isNull() & shared).otherwise(F.lit(False))
    root = F.when(every, F.lit(None).cast("string")).when(kind.isin("build", "dependency"), F.coalesce(own, F.when(kind == "dependency", nearest))).when(kind == "runtime", nearest)
    out = near.crossJoin(some).withColumn("all_roots", every).withColumn("root_id", root)
    return out.select("path", "kind", "root_id", F.when(F.col("root_id").isNotNull(), F.array("root_id")).otherwise(F.array().cast("array<string>")).alias("affected"), "all_roots", (~F.col("all_roots") & F.col("root_id").isNull()).alias("unresolved"))


def environment_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, kind, all_roots, unresolved of container, compose, dot-env and cluster files, each of which concerns every root."""
    some = F.broadcast(roots.agg((F.count("*") > 0).alias("all_roots")))  # one row
    found = files.select("path", environment_kind(F.col("path")).alias("kind")).where("kind is not null")
    return found.crossJoin(some).withColumn("unresolved", ~F.col("all_roots"))


def affected_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root_id) of every root that a file concerns: as many rows as links, for few files."""
    ids = roots.select(F.col("root_id").alias("id"))
    own = edges.select("path", F.explode("affected").alias("root_id")) if "affected" in edges.columns else None
    every = edges.where("all_roots").select("path", F.lit(1).alias("k")).join(ids.withColumn("k", F.lit(1)), "k").select("path", F.col("id").alias("root_id"))
    return every if own is None else own.unionByName(every)


def dependency_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """kind, from_root, to_root (null with all_roots: every root), via_path, all_roots, unresolved: configuration, environment and root-to-root edges in one table."""
    none = F.lit(None).cast("string")
    conf = config_edges(files, roots).select(F.concat("kind", F.lit("_affects_root")).alias("kind"), F.col("root_id").alias("from_root"), F.col("root_id").alias("to_root"), F.col("path").alias("via_path"), "all_roots", "unresolved")
    env = environment_edges(files, roots).select(F.lit("environment_affects_root").alias("kind"), none.alias("from_root"), none.alias("to_root"), F.col("path").alias("via_path"), "all_roots", "unresolved")
    own = root_edges(files, roots).select(F.lit("root_depends_on_root").alias("kind"), "from_root", "to_root", F.col("path").alias("via_path"), F.lit(False).alias("all_roots"), F.lit(False).alias("unresolved"))
    return conf.unionByName(env).unionByName(own)


def caveats(edges: DataFrame) -> DataFrame:
    """A caveat for each file that belongs to no root."""
    return edges.where("unresolved").select(F.lit("config_edge_unresolved").alias("code"), "path", F.lit("config or automation file could not be mapped to a concrete project root").alias("message")).distinct()


def root_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Workspace files to the roots of their language below them: path, from_root, to_root."""
    work = files.where(file_name(F.col("path")) == "go.work").select("path", parent_dir(F.col("path")).alias("w_dir"))
    go = roots.where("language = 'go'").select("dir", "root_id", F.explode(F.transform(ancestors(F.concat("dir", F.lit("/x"))), lambda x: x)).alias("up"))
    return work.join(go, F.col("w_dir") == F.col("up")).where("dir <> w_dir").select("path", F.concat(F.lit("go:"), F.when(F.col("w_dir") == "", ".").otherwise(F.col("w_dir"))).alias("from_root"), F.col("root_id").alias("to_root")).distinct()
