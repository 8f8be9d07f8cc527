"""Virtual file trees over the test tables, and the SQL that builds the same trees for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.classify import OWN_EXTENSION, PRECOMPRESSED

EXTENSIONS = [".txt", ".md", ".py", ".JPG", ".tar.gz", ".ts", ".zip", ""]
MODE_FILE, MODE_DIR, MODE_LINK = 0o100644, 0o40755, 0o120777

#: Paths that must be refused, or just pass, beside those of the tables, by the rule each tests.
HOSTILE = [
    "ok/plain.md", "é:drive/is/two/bytes", "dots..inside/..x",  # safe
    "",  # empty
    "/rooted", "\\rooted\\too", "/../rooted",  # absolute
    "D:relative", "z:/rooted", "q:",  # drive letters, and names that look so
    "..", "up/../../out", "in/..", "deep/er/../x",  # parents
    ".", "./here", "here/.", "two//slashes", "slash/at/end/",  # empty components and dots
    "back\\slash", "mixed/back\\slash/x",  # backslashes
    "a/./b\\c/../d", "x\\y/..", "..//\\",  # of several faults the first counts
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tree_path(doc_id: Column, source: Column, lang: Column) -> Column:
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (doc_id % 8).cast("int"))
    return F.concat(source, F.lit("/"), lang, F.lit("/"), F.lpad(doc_id.cast("string"), 8, "0"), ext)


def docs_tree(spark: SparkSession, sf: str, content: bool = False) -> DataFrame:
    """documents as files: doc_id, walk_id, path, size, hash (and content). Null text is an empty file."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select(
        "doc_id", tree_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"), text.alias("text")
    )
    out = d.select(
        "doc_id", F.col("doc_id").alias("walk_id"), "path", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("hash"),
        *([F.encode("text", "UTF-8").alias("content")] if content else []),
    )
    return out


def shared_paths(files: DataFrame) -> DataFrame:
    """The same files under few paths, as inputs of one base name give them: 40 names a folder."""
    name = F.concat(F.lpad((F.col("doc_id") % 40).cast("string"), 4, "0"), F.lit(".txt"))
    return files.withColumn("path", F.concat(F.regexp_replace("path", "[^/]*$", ""), name))


def archive_manifest(files: DataFrame) -> DataFrame:
    """Files with contents as write_container() takes them."""
    none = F.lit(None).cast("string").alias("link_target")
    stat = [F.lit("file").alias("kind"), F.lit(MODE_FILE).alias("mode"), F.lit(0).cast("bigint").alias("mtime"), F.lit(0).alias("mtime_nanos")]
    return files.select("walk_id", "path", *stat, "size", none, "content")


def pages_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def symlinks(spark: SparkSession, sf: str) -> DataFrame:
    """A link next to the document for each label with toxic = 1."""
    files = docs_tree(spark, sf).select("doc_id", "path")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    return files.join(toxic, "doc_id").select(F.concat("path", F.lit(".link")).alias("path"), F.col("path").alias("link_target"))


_LIST = ", ".join(f"'{e}'" for e in [*PRECOMPRESSED, OWN_EXTENSION])
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def key_sql(src: str) -> str:
    """src with name, dir, ext, lane derived from path."""
    return f"""(select *, case when ext in ({_LIST}) then 1 else 0 end as lane from (
      select *, case when instr(ltrim(name, '.'), '.') > 0 then nullif(translate(split_part(ltrim(name, '.'), '.', -1), {_AZ}), '') end as ext,
        case when instr(path, '/') > 0 then left(path, length(path) - length(name) - 1) else '' end as dir
      from (select *, split_part(path, '/', -1) as name from {src})))"""


_EXT = "case doc_id % 8 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(EXTENSIONS)) + " end"
FILES = f"""f as (select doc_id, path, cast(strlen(text) as bigint) as size, sha256(text) as hash, text, name, dir, ext, lane from {key_sql(f'''(
  select doc_id, source || '/' || lang || '/' || lpad(cast(doc_id as varchar), 8, '0') || {_EXT} as path, coalesce(text, '') as text from documents)''')}),
r as (select *, row_number() over (partition by hash order by lane, coalesce(ext, ''), dir, name) as rn from f)"""


#: The files of FILES under shared_paths().
SHARED = """s as (select doc_id, dir || '/' || lpad(cast(doc_id % 40 as varchar), 4, '0') || '.txt' as path, size, hash, text from f)"""


def blocks_sql(cap: int, dedup: bool = True, fast_lane: bool = True) -> str:
    """CTEs FILES + k, w, a: a has path, lane, size, block, "offset"."""
    lane = "lane" if fast_lane else "0"
    return f"""recursive {FILES},
k as (select path, hash, lane, {lane} as pl, size, row_number() over (order by lane, coalesce(ext, ''), dir, name) as i from r where {'rn = 1 and' if dedup else ''} size > 0),
w(i, pl, b, u) as (select i, pl, 0, size from k where i = 1 union all
  select k.i, k.pl, w.b + case when k.pl <> w.pl or w.u + k.size > {cap} then 1 else 0 end,
    case when k.pl <> w.pl or w.u + k.size > {cap} then k.size else w.u + k.size end from w join k on k.i = w.i + 1),
a as (select k.path, k.hash, k.lane, k.size, k.i, w.b as block, cast(w.u - k.size as bigint) as "offset" from k join w using (i))"""
