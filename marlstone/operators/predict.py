"""Globs to index first for a query, by keywords and by feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import exprs as X

# Keywords, and the folders that a query with one of them is about.
KEYWORDS = (
    (("auth", "login", "logout", "session", "jwt", "oauth", "password", "credential"), ("auth", "login", "session", "authentication")),
    (("database", "db", "query", "sql", "orm", "repository", "migration"), ("db", "database", "repositories", "repo")),
    (("api", "endpoint", "route", "controller", "handler", "rest", "graphql"), ("api", "routes", "controllers", "handlers", "endpoints")),
    (("config", "configuration", "env", "settings", "options"), ("config", "settings", "conf")),
    (("middleware", "interceptor", "filter", "guard"), ("middleware", "middlewares", "interceptors", "guards")),
    (("workflow", "execution", "engine", "runner", "worker", "job", "queue"), ("workflow", "workflows", "execution", "engine", "workers", "jobs")),
    (("core", "shared", "common", "utils", "helpers", "lib"), ("core", "shared", "common", "utils", "lib")),
    (("service", "services"), ("services", "service")),
)
ENTRY_POINTS = ("main", "index", "app", "server")
ELSE_ROOTS = ("src", "packages")
USUAL_EXTENSIONS = ("ts", "js", "py", "rs")


def predicted_globs(queries: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """query, glob, place: for every row of queries(query) its distinct globs, in order."""
    low = F.lower("query")
    folders = [
        (F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), names) for words, names in KEYWORDS
    ]
    some = folders[0][0]
    for hit, _ in folders[1:]:
        some = some | hit
    of = lambda names, form: F.array(*(F.lit(form.format(n, e)) for n in names for e in extensions))
    none = F.array().cast("array<string>")
    parts = [F.when(hit, of(names, "**/{}/**/*.{}")).otherwise(none) for hit, names in folders]
    parts += [of(ENTRY_POINTS, "**/{}.{}"), F.when(~some, of(ELSE_ROOTS, "{}/**/*.{}")).otherwise(none)]
    globs = F.array_sort(F.array_distinct(F.concat(*parts)))
    return queries.select("query", F.posexplode(globs).alias("place", "glob"))


def reranked(predicted: DataFrame, scores: DataFrame) -> DataFrame:
    """predicted in order of the globs' scores, then of their places; without a score a glob has 0."""
    from pyspark.sql import Window

    joined = predicted.join(scores.select("glob", "score"), "glob", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "place"))
    return joined.select("query", "glob", "score", (order - 1).alias("place"))


def first_globs(paths: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """paths(file_path) with first_match_glob, the first of the globs of a query that a path fits; a projection, no join."""
    hits = (F.when(X.glob_match(F.col("file_path"), g), F.lit(g)) for g in globs)
    return paths.withColumn("first_match_glob", F.coalesce(*hits, F.lit(None).cast("string")))


def extensions(glob: Column) -> Column:
    """Extensions that a glob names: those in its braces, else the one it ends in, else the usual ones."""
    braces = F.regexp_extract(glob, r"\{([^}]*)\}", 1)
    last = F.regexp_extract(glob, r"(?s)^.*\*\.([^/*]*)$", 1)
    listed = F.transform(F.split(braces, ","), lambda x: F.trim(x))
    usual = F.array(*map(F.lit, USUAL_EXTENSIONS))
    return F.when(glob.rlike(r"\{[^}]*\}"), listed).when(last != "", F.array(last)).otherwise(usual)


def literal_queries(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, texts))).alias("query"))
