"""The reference queries: name -> (DataFrame function, oracle SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import classify, paths
from cairn.functions.format import human, ratio
from cairn.operators import bench, pack, reports
from cairn.operators.order import with_rank
from cairn.plans.trees import FILES, HOSTILE, MODE_DIR, MODE_FILE, MODE_LINK, SHARED, archive_manifest, blocks_sql, docs_tree, key_sql, pages_paths, shared_paths, symlinks, table
from cairn.schema import FOOTER_LEN, HEADER_LEN
from cairn.session import checkpoint, scratch
from cairn.sources.container import WriteOptions, block_frame, contents, decode_blocks, encode_blocks, read_footer, verify, write_container
from cairn.sources.extract import conflicts, entries_of

CAP, TINY = 65_536, 4_096
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"select * from values {rows} as t({columns})")


def lit_rows(items: list[str]) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


def sql_rows(items: list[str]) -> str:
    """For Spark, whose string literals treat backslashes as escapes."""
    return lit_rows([x.replace("\\", "\\\\") for x in items])


def b(c):
    return c.cast("bigint")


PATHS = "x/Y.PNG x/y.tar.xz .profile d/.hidden Rakefile pics/P_17.WEBP trip.mkv take.opus lib/mod.go Setup.pkg pack.zip memo.docx types.ts end. ..k.l .... q.Ö n/pic.avif y/k.go m/n.rb p/q.go".split()


# --- scans and manifests
@query("manifest_scan", f"with {FILES} select doc_id, path, size, hash from f")
def _(spark, sf):
    return docs_tree(spark, sf).drop("walk_id")


@query("raw_size", f"with {FILES} select count(*) as files, cast(sum(size) as bigint) as raw_bytes from f")
def _(spark, sf):
    return docs_tree(spark, sf).agg(F.count("*").alias("files"), b(F.sum("size")).alias("raw_bytes"))


@query("content_hash", f"with {FILES} select hash, count(*) as copies, min(path) as first_path from f group by hash")
def _(spark, sf):
    return docs_tree(spark, sf).groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))


# --- path and lane functions
@query("ext_of_path", f"with {FILES} select path, ext, lane from f union all select path, ext, lane from {key_sql(f'(select * from (values {lit_rows(PATHS)}) t(path))')}")
def _(spark, sf):
    p = docs_tree(spark, sf).select("path").unionByName(values(spark, sql_rows(PATHS), "path"))
    return p.select("path", paths.extension(F.col("path")).alias("ext"), classify.lane(F.col("path")).alias("lane"))


@query("lane_for_path", f"with {FILES} select path, lane from f")
def _(spark, sf):
    return docs_tree(spark, sf).select("path", classify.lane(F.col("path")).alias("lane"))


@query("lane_summary", f"with {FILES} select lane, coalesce(ext, '') as ext, count(*) as files, cast(sum(size) as bigint) as bytes from f group by all")
def _(spark, sf):
    d = pack.with_sort_key(docs_tree(spark, sf))
    return d.groupBy("lane", "ext").agg(F.count("*").alias("files"), b(F.sum("size")).alias("bytes"))


@query("sort_key_rank", f"with {FILES} select path, row_number() over (order by lane, coalesce(ext, ''), dir, name) as pack_rank from f")
def _(spark, sf):
    d = pack.with_sort_key(docs_tree(spark, sf))
    return with_rank(d.select("path", "lane", "ext", "dir", "name", "walk_id"), pack.order(), "pack_rank").select("path", "pack_rank")


@query("path_validate", f"""select path, case when path = '' then 'empty' when path[1] in ('/', '\\') then 'absolute'
  when substr(hex(encode(path)), 3, 2) = '3A' then 'drive'
  else list_filter(list_transform(string_split(path, '/'), lambda x: case when x = '..' then 'parent' when x in ('', '.') then 'component' when instr(x, '\\') > 0 then 'backslash' end), lambda x: x is not null)[1] end as reason
  from (select regexp_replace(url, '^[a-z]+://', '') as path from pages union all select * from (values {lit_rows(HOSTILE)}) t(path))""")
def _(spark, sf):
    p = pages_paths(spark, sf).select("path").unionByName(values(spark, sql_rows(HOSTILE), "path"))
    return p.select("path", paths.invalid_reason(F.col("path")).alias("reason"))


REGISTRY["path_validate_counts"] = (
    lambda spark, sf: REGISTRY["path_validate"][0](spark, sf).groupBy("reason").agg(F.count("*").alias("paths")),
    f"select reason, count(*) as paths from ({REGISTRY['path_validate'][1]}) group by reason",
)


@query("safe_join_depth", f"select path, reason is null as ok from ({REGISTRY['path_validate'][1]})")
def _(spark, sf):
    p = pages_paths(spark, sf).select("path").unionByName(values(spark, sql_rows(HOSTILE), "path"))
    return p.select("path", paths.join_depth_ok(F.col("path")).alias("ok"))


SELECTORS = ["src1/", "src2/en", "src3/fr/", "srcx", "src4/en/00000004.tar.gz"]
MATCH_SQL = "(rtrim(s.pattern, '/') <> '' and (f.path = rtrim(s.pattern, '/') or starts_with(f.path, rtrim(s.pattern, '/') || '/')))"


@query("select_one", f"with {FILES} select path, size from f where path = 'src1' or starts_with(path, 'src1/')")
def _(spark, sf):
    return docs_tree(spark, sf).filter(paths.matches(F.col("path"), F.lit("src1/"))).select("path", "size")


@query("select_many", f"with {FILES}, s as (select * from (values {lit_rows(SELECTORS)}) t(pattern)) select path, size from f where exists (select 1 from s where {MATCH_SQL})")
def _(spark, sf):
    return docs_tree(spark, sf).filter(paths.matches_any(F.col("path"), SELECTORS)).select("path", "size")


@query("selector_hits", f"with {FILES}, s as (select * from (values {lit_rows(SELECTORS)}) t(pattern)) select pattern, count(path) as files from s left join f on {MATCH_SQL} group by pattern")
def _(spark, sf):
    files = docs_tree(spark, sf).select("path")
    hits = [F.count_if(paths.matches(F.col("path"), F.lit(s))).alias(str(i)) for i, s in enumerate(SELECTORS)]
    pairs = F.array(*[F.struct(F.lit(s).alias("pattern"), F.col(str(i)).alias("files")) for i, s in enumerate(SELECTORS)])
    return files.agg(*hits).select(F.inline(pairs))


# --- codecs and levels
NAMES = ["store", "none", "ZSTD", "xz", "lzma", "LZMA2", "brotli", ""]


@query("codec_parse", f"select name, case lower(name) when 'store' then 0 when 'none' then 0 when 'zstd' then 1 when 'xz' then 2 when 'lzma' then 2 when 'lzma2' then 2 end as codec from (values {lit_rows(NAMES)}) t(name)")
def _(spark, sf):
    return values(spark, sql_rows(NAMES), "name").select("name", classify.codec_id(F.col("name")).alias("codec"))


@query("codec_name_join", f"with {blocks_sql(CAP)} select block, c.name as codec_name, rlen from (select block, max(lane) as lane, cast(sum(size) as bigint) as rlen from a group by block) join (values (0, 'xz'), (1, 'zstd')) c(lane, name) using (lane)")
def _(spark, sf):
    blocks = pack.block_table(_assigned(spark, sf))
    codec, _ = classify.lane_codec(F.col("lane"), 2, 9)
    return blocks.select("block", classify.codec_name(codec).alias("codec_name"), "rlen")


CHOICES = [("fast", None, None), ("balanced", None, None), ("max", None, None), ("best", None, None), ("max", "xz", None), ("fast", None, 3), (None, None, None), (None, "XZ", None), (None, "none", None), (None, "lzma2", 4), (None, None, 19), (None, "lz4", 1)]
_CHOICES = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in c) + ")" for c in CHOICES)


@query("preset_resolve", f"""with c as (select cast(preset as varchar) as preset, cast(codec as varchar) as codec, cast(level as integer) as level from (values {_CHOICES}) t(preset, codec, level)),
  k as (select *, case lower(coalesce(codec, 'zstd')) when 'store' then 0 when 'none' then 0 when 'zstd' then 1 when 'xz' then 2 when 'lzma' then 2 when 'lzma2' then 2 end as own from c)
  select preset, codec, level, case when preset is null then own when codec is not null or level is not null then null when preset = 'max' then 2 when preset in ('fast', 'balanced') then 1 end as codec_id,
    case when preset is null then case when own is null then null else coalesce(level, case own when 0 then 0 when 1 then 12 else 6 end) end
      when codec is not null or level is not null then null when preset = 'fast' then 3 when preset = 'balanced' then 12 when preset = 'max' then 9 end as codec_level from k""")
def _(spark, sf):
    c = spark.createDataFrame(CHOICES, "preset string, codec string, level int")
    codec, level = classify.resolved(F.col("preset"), F.col("codec"), F.col("level"))
    return c.select("*", codec.alias("codec_id"), level.alias("codec_level"))


@query("lane_codec", f"with {FILES} select path, case when lane = 1 then 1 else 2 end as codec, case when lane = 1 then 1 else 9 end as level from f")
def _(spark, sf):
    codec, level = classify.lane_codec(classify.lane(F.col("path")), 2, 9)
    return docs_tree(spark, sf).select("path", codec.alias("codec"), level.alias("level"))


@query("window_log", f"with {FILES} select path, size, (select min(l) from range(10, 28) t(l) where l = 27 or (1 << l) >= size * 4096) as window_log from f")
def _(spark, sf):
    return docs_tree(spark, sf).select("path", "size", b(classify.window_log(F.col("size") * 4096)).alias("window_log"))


@query("human_size", f"""with {FILES}, n as (select size * size * size as n from f union all select * from (values (cast(0 as bigint)), (1023), (1024), (1280), (1048576), (1363149), (1099511627776), (1125899906842624), (2000000000000000000)) t(n))
  select n, case when n < 1024 then n || ' B' else printf('%.1f %s', n / 1024.0 ** e, ['KB', 'MB', 'GB', 'TB', 'PB'][e]) end as text
  from (select n, case when n < 1048576 then 1 when n < 1073741824 then 2 when n < 1099511627776 then 3 when n < 1125899906842624 then 4 else 5 end as e from n)""")
def _(spark, sf):
    more = values(spark, "(0L), (1023L), (1024L), (1280L), (1048576L), (1363149L), (1099511627776L), (1125899906842624L), (2000000000000000000L)", "n")
    n = docs_tree(spark, sf).select((F.col("size") * F.col("size") * F.col("size")).alias("n")).unionByName(more)
    return n.select("n", human(F.col("n")).alias("text"))


# --- dedup and packing
@query("dedup_first", f"with {FILES} select r.path, hash, rn = 1 as first, k.path as kept_path from r join (select hash, path from r where rn = 1) k using (hash)")
def _(spark, sf):
    d = pack.first_copies(docs_tree(spark, sf))
    kept = d.filter(~pack.is_copy()).select("first_id", F.col("path").alias("kept_path"))
    return d.join(kept, "first_id").select("path", "hash", (~pack.is_copy()).alias("first"), "kept_path")


@query("dedup_stats", f"with {FILES} select count(*) filter (rn > 1) as deduped_files, cast(coalesce(sum(size) filter (rn > 1), 0) as bigint) as deduped_bytes from r")
def _(spark, sf):
    return reports.dedup_counts(pack.first_copies(docs_tree(spark, sf)))


@query("dedup_groups", f"with {FILES} select hash, count(*) as copies, count(distinct lane) as lanes, max(path) filter (rn = 1) as kept_path from r group by hash having count(*) > 1")
def _(spark, sf):
    d = pack.first_copies(docs_tree(spark, sf)).groupBy("hash")
    d = d.agg(F.count("*").alias("copies"), F.countDistinct("lane").alias("lanes"), F.max(F.when(~pack.is_copy(), F.col("path"))).alias("kept_path"))
    return d.filter("copies > 1")


def _assigned(spark, sf, cap=CAP, dedup=True, fast_lane=True, part_rows=None):
    return pack.assign_blocks(pack.survivors(docs_tree(spark, sf), dedup), cap, fast_lane, part_rows)


for _name, _args in {"block_assign": (CAP,), "block_assign_tiny": (TINY,), "block_assign_no_dedup": (CAP, False), "block_assign_no_fast_lane": (CAP, True, False), "block_assign_ranges": (CAP, True, True, 100), "block_assign_tiny_ranges": (TINY, True, True, 60)}.items():
    REGISTRY[_name] = (
        lambda spark, sf, a=_args: _assigned(spark, sf, *a).select("path", "lane", "size", b(F.col("block")).alias("block"), "offset"),
        f'with {blocks_sql(*_args[:3])} select path, lane, size, cast(block as bigint) as block, "offset" from a',
    )


@query("block_assign_shared_paths", f"""with recursive {FILES}, {SHARED},
k as (select path, size, doc_id, row_number() over (order by dir, name, doc_id) as i from (select *, left(path, length(path) - 9) as dir, right(path, 8) as name, row_number() over (partition by hash order by left(path, length(path) - 9), right(path, 8), doc_id) as rn from s) where rn = 1 and size > 0),
w(i, b, u) as (select i, 0, size from k where i = 1 union all select k.i, w.b + case when w.u + k.size > {CAP} then 1 else 0 end, case when w.u + k.size > {CAP} then k.size else w.u + k.size end from w join k on k.i = w.i + 1)
select doc_id, path, size, cast(w.b as bigint) as block, cast(w.u - size as bigint) as "offset" from k join w using (i)""")
def _(spark, sf):
    a = pack.assign_blocks(pack.survivors(shared_paths(docs_tree(spark, sf))), CAP)
    return a.select(F.col("walk_id").alias("doc_id"), "path", "size", b(F.col("block")).alias("block"), "offset")


@query("block_table", f"with {blocks_sql(CAP)} select cast(block as bigint) as block, min(lane) as lane, count(*) as files, cast(sum(size) as bigint) as rlen from a group by block")
def _(spark, sf):
    return pack.block_table(_assigned(spark, sf)).withColumn("block", b(F.col("block")))


@query("oversized_files", f"with {blocks_sql(TINY)} select path, size, cast(block as bigint) as block from a where size >= {TINY}")
def _(spark, sf):
    return _assigned(spark, sf, TINY).filter(F.col("size") >= TINY).select("path", "size", b(F.col("block")).alias("block"))


def _packed(spark, sf, cap=CAP):
    """(files with their segments, stored files with their places), both from one assignment."""
    files = checkpoint(pack.first_copies(docs_tree(spark, sf)))
    assigned = checkpoint(pack.assign_blocks(pack.survivors(files), cap))
    return pack.attach_segments(files, assigned), assigned


def _entries(spark, sf, cap=CAP):
    return _packed(spark, sf, cap)[0]


def _flat(entries):
    e = entries.select("path", "size", F.posexplode("segments").alias("pos", "s"))
    return e.select("path", "size", b(F.col("pos")).alias("pos"), b(F.col("s.block")).alias("block"), F.col("s.offset").alias("offset"), F.col("s.len").alias("len"))


_SEG = 'e as (select r.path, r.size, r.hash, a.block, a."offset", r.rn, r.lane from r left join a on a.hash = r.hash and r.size > 0)'


@query("segments_flat", f'with {blocks_sql(CAP)}, {_SEG} select path, cast(0 as bigint) as pos, cast(block as bigint) as block, "offset", size as len from e where block is not null')
def _(spark, sf):
    return _flat(_entries(spark, sf)).drop("size")


@query("segment_block_join", f'with {blocks_sql(CAP)}, {_SEG}, t as (select block, cast(sum(size) as bigint) as rlen from a group by block) select path, cast(block as bigint) as block, rlen, "offset" + size <= rlen as fits from e join t using (block)')
def _(spark, sf):
    entries, assigned = _packed(spark, sf)
    blocks = pack.block_table(assigned).select(b(F.col("block")).alias("block"), "rlen")
    j = _flat(entries).join(blocks, "block", "left")
    checked = F.coalesce("rlen", F.raise_error(F.concat(F.lit("no block "), F.col("block").cast("string"))).cast("bigint"))
    return j.select("path", "block", checked.alias("rlen"), (F.col("offset") + F.col("len") <= checked).alias("fits"))


# --- entries
_ALL = f"""{FILES}, dirs as (select distinct array_to_string(list_slice(string_split(path, '/'), 1, n), '/') as path from f, range(1, 10) t(n) where n < len(string_split(path, '/'))),
links as (select f.path || '.link' as path, f.path as link_target from f where doc_id in (select doc_id from labels where toxic = 1)),
entries as (select path, 'file' as kind, size, cast(null as varchar) as link_target, {MODE_FILE} as mode from f union all select path, 'dir', 0, null, {MODE_DIR} from dirs union all select path, 'symlink', 0, link_target, {MODE_LINK} from links)"""


def _all_entries(spark, sf):
    files = docs_tree(spark, sf).select("path", F.lit("file").alias("kind"), "size", F.lit(None).cast("string").alias("link_target"), F.lit(MODE_FILE).alias("mode"))
    dirs = reports.dir_tree(files).select("path", F.lit("dir").alias("kind"), b(F.lit(0)).alias("size"), F.lit(None).cast("string").alias("link_target"), F.lit(MODE_DIR).alias("mode"))
    links = symlinks(spark, sf).select("path", F.lit("symlink").alias("kind"), b(F.lit(0)).alias("size"), "link_target", F.lit(MODE_LINK).alias("mode"))
    return files.unionByName(dirs).unionByName(links)


@query("entries_union", f"with {_ALL} select * from entries")
def _(spark, sf):
    return _all_entries(spark, sf)


@query("dir_tree", f"with {_ALL} select * from dirs")
def _(spark, sf):
    return reports.dir_tree(docs_tree(spark, sf))


@query("index_order", f"with {_ALL} select path, kind, row_number() over (order by case kind when 'dir' then 0 when 'file' then 1 else 2 end, path) as index_rank from entries")
def _(spark, sf):
    e = _all_entries(spark, sf).select("path", "kind", reports.kind_rank().alias("k"))
    return with_rank(e, ["k", "path"], "index_rank").drop("k")


@query("list_plain", f"with {_ALL} select path from entries")
def _(spark, sf):
    return _all_entries(spark, sf).select("path")


_HUMAN = "case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0) else printf('%.1f MB', n / 1048576.0) end"


@query("list_long", f"""with {blocks_sql(CAP)}, {_SEG}, {_ALL.removeprefix(FILES + ", ")}, x as (select n.path, n.kind, n.size as n, e.block, n.link_target, n.mode from entries n left join e on e.path = n.path and n.kind = 'file')
  select path, case kind when 'symlink' then 'l' when 'dir' then 'd' else '-' end || to_base(mode & 511, 8) || ' ' || lpad({_HUMAN}, 10, ' ') || ' blk:' || rpad(coalesce(cast(block as varchar), '-'), 5, ' ') || ' ' || path || case when link_target is null then '' else ' -> ' || link_target end as line from x""")
def _(spark, sf):
    files = _entries(spark, sf).select("path", "segments")
    every = _all_entries(spark, sf).join(files, "path", "left")
    seg = F.when(F.col("kind") == "file", F.col("segments")).otherwise(F.array().cast(files.schema["segments"].dataType))
    return reports.listing(every.withColumn("segments", seg))


@query("info_contents", f"with {_ALL} select count(*) filter (kind = 'file') as files, count(*) filter (kind = 'dir') as dirs, count(*) filter (kind = 'symlink') as symlinks, cast(sum(size) as bigint) as bytes from entries")
def _(spark, sf):
    return reports.kind_counts(_all_entries(spark, sf))


@query("info_dedup", f"with {blocks_sql(CAP)} select logical, logical - stored as saved, case when logical = 0 then 0.0 else (logical - stored) / cast(logical as double) end as saved_ratio, true as smaller from (select (select cast(sum(size) as bigint) from f) as logical, cast(sum(size) as bigint) as stored from a)")
def _(spark, sf):
    blocks = _written(spark, sf, lambda at: checkpoint(block_frame(at, spark)))
    stored = blocks.agg(b(F.sum("rlen")).alias("stored"), (F.sum("clen") < F.sum("rlen")).alias("smaller"))  # one row each
    d = docs_tree(spark, sf).agg(b(F.sum("size")).alias("logical")).crossJoin(stored)
    saved = F.col("logical") - F.col("stored")
    return d.select("logical", saved.alias("saved"), ratio(saved, F.col("logical")).alias("saved_ratio"), "smaller")


@query("info_by_codec", f"with {blocks_sql(CAP)} select case lane when 1 then 'zstd' else 'xz' end as codec_name, count(*) as blocks, cast(sum(rlen) as bigint) as rlen, true as smaller, true as ratio_agrees from (select block, min(lane) as lane, sum(size) as rlen from a group by block) group by 1")
def _(spark, sf):
    found = reports.by_codec(_written(spark, sf, lambda at: checkpoint(block_frame(at, spark)), WriteOptions(2, 1, CAP, check_block_size=False)))
    agrees = F.col("ratio") == F.col("clen") / F.col("rlen")
    return found.select("codec_name", "blocks", "rlen", ((F.col("clen") > 0) & (F.col("clen") < F.col("rlen"))).alias("smaller"), agrees.alias("ratio_agrees"))


@query("total_size", f"with {FILES} select cast(sum(size) as bigint) as total_size from f")
def _(spark, sf):
    return docs_tree(spark, sf).agg(b(F.sum("size")).alias("total_size"))


@query("write_stats", f"""with {blocks_sql(CAP)}, {_ALL.removeprefix(FILES + ", ")} select (select count(*) from f) as files, (select count(*) from dirs) as dirs, (select count(*) from links) as symlinks, (select cast(sum(size) as bigint) from f) as input_bytes,
  (select count(*) from r where rn > 1) as deduped_files, (select cast(coalesce(sum(size), 0) as bigint) from r where rn > 1) as deduped_bytes, (select count(distinct block) from a) as blocks""")
def _(spark, sf):
    entries = reports.kind_counts(_all_entries(spark, sf)).select("files", "dirs", "symlinks", F.col("bytes").alias("input_bytes"))
    files = checkpoint(pack.first_copies(docs_tree(spark, sf)))
    copies = reports.dedup_counts(files)
    blocks = pack.assign_blocks(pack.survivors(files), CAP).agg(F.countDistinct("block").alias("blocks"))
    return entries.crossJoin(copies).crossJoin(blocks)  # one row each


# --- reading
@query("extract_order", f'with {blocks_sql(CAP)}, {_SEG} select path, row_number() over (order by block nulls last, "offset" nulls last, path) as read_rank from e')
def _(spark, sf):
    s = F.get("segments", F.lit(0))
    e = _entries(spark, sf).select("path", s["block"].alias("b"), s["offset"].alias("o"))
    return with_rank(e, [F.asc_nulls_last("b"), F.asc_nulls_last("o"), F.col("path")], "read_rank").select("path", "read_rank")


@query("extract_stats", f"with {_ALL} select count(*) filter (kind = 'file') as files, count(*) filter (kind = 'dir') as dirs, count(*) filter (kind = 'symlink') as symlinks, cast(coalesce(sum(size), 0) as bigint) as bytes from entries where path = 'src1' or starts_with(path, 'src1/')")
def _(spark, sf):
    return reports.kind_counts(_all_entries(spark, sf).filter(paths.matches(F.col("path"), F.lit("src1"))))


@query("implicit_parents", f"with {_ALL}, s as (select path from entries where starts_with(path, 'src2/en/')) select distinct d.path from dirs d where exists (select 1 from s where starts_with(s.path, d.path || '/')) and d.path not in (select path from s)")
def _(spark, sf):
    chosen = _all_entries(spark, sf).filter(F.col("path").startswith("src2/en/"))
    return reports.dir_tree(chosen).join(chosen.select("path"), "path", "left_anti")


def _written(spark, sf, read, o=None, files=None):
    """What `read` makes of the documents' container, which is gone afterwards."""
    with scratch(spark) as folder:
        at = os.path.join(folder, "docs.cairn")
        files = docs_tree(spark, sf, content=True) if files is None else files
        write_container(archive_manifest(files), at, o or WriteOptions(1, 3, CAP, check_block_size=False))
        return read(at)


def _status(spark, at):
    return checkpoint(verify(spark, at).select("path", F.when(F.col("ok"), "ok").otherwise("corrupt").alias("status")))


@query("verify_report", f"with {FILES} select path, 'ok' as status from f")
def _(spark, sf):
    return _written(spark, sf, lambda at: _status(spark, at))


@query("verify_corrupt", f'with {blocks_sql(CAP)}, {_SEG} select path, case when block = 0 and "offset" <= 100 and "offset" + size > 100 then \'corrupt\' else \'ok\' end as status from e')
def _(spark, sf):
    def damaged(at):
        with open(at, "r+b") as f:  # byte 100 of the first block, which is stored as it is
            f.seek(HEADER_LEN + 100)
            byte = f.read(1)
            f.seek(HEADER_LEN + 100)
            f.write(bytes([byte[0] ^ 1]))
        return _status(spark, at)

    return _written(spark, sf, damaged, WriteOptions(0, 0, CAP, check_block_size=False))


@query("archive_layout", f"with {blocks_sql(CAP)} select count(distinct block) as blocks, true as gapless, true as sizes_add_up from a")
def _(spark, sf):
    def layout(at):
        blocks = block_frame(at, spark)
        with open(at, "rb") as f:
            start, clen, _, _ = read_footer(f)
        total = start + clen + FOOTER_LEN == os.path.getsize(at)
        ends = blocks.select((F.col("block") + 1).alias("block"), (F.col("offset") + F.col("clen")).alias("before"))
        chained = F.col("offset") == F.coalesce("before", F.when(F.col("block") == 0, F.lit(HEADER_LEN)))
        whole = blocks.agg(F.sum("clen").alias("c"))
        per = blocks.join(ends, "block", "left").agg(F.count("*").alias("blocks"), F.bool_and(F.coalesce(chained, F.lit(False))).alias("gapless"))
        return checkpoint(per.crossJoin(whole).select("blocks", "gapless", ((F.col("c") + HEADER_LEN == start) & F.lit(total)).alias("sizes_add_up")))

    return _written(spark, sf, layout)


@query("cat_one", f"with {FILES} select path, text, size from f where doc_id = 7")
def _(spark, sf):
    files = checkpoint(docs_tree(spark, sf, content=True))
    name = files.filter(F.col("doc_id") == 7).first().path
    one = lambda at: checkpoint(contents(spark, at, [name]).select("path", F.decode("content", "UTF-8").alias("text"), "size"))
    return _written(spark, sf, one, files=files)


_READ = 'select \'storage\' as reader, cast(0 as bigint) as g, row_number() over (order by block, "offset", path) as t, block from e where block is not null'


@query("block_cache_decodes", f"""with {blocks_sql(CAP)}, {_SEG}, x as ({_READ} union all select 'access', 0, row_number() over (order by v.ts, v.event_id), e.block from events v join f on f.doc_id = v.user_id join e on e.path = f.path where e.block is not null)
  select reader, count(*) as n_reads, cast(sum(case when prev is null or prev <> block then 1 else 0 end) as bigint) as decodes, count(distinct block) as n_blocks from (select *, lag(block) over (partition by reader order by t) as prev from x) group by reader""")
def _(spark, sf):
    e = _entries(spark, sf).select("doc_id", "path", F.get("segments", F.lit(0)).alias("s")).filter("s is not null").select("doc_id", "path", "s.block", "s.offset")
    storage = reports.cache_decodes(e, ["block", "offset", "path"]).withColumn("reader", F.lit("storage"))
    log = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("doc_id")).join(e, "doc_id")
    access = reports.cache_decodes(log, ["ts", "event_id"]).withColumn("reader", F.lit("access"))
    return storage.unionByName(access)


@query("blocks_touched", f"""with {blocks_sql(CAP)}, {_SEG}, t as (select block, sum(size) as rlen from a group by block), s as (select * from (values ('src1'), ('src2/en'), ('src3')) t(pattern)),
  h as (select s.pattern, e.block, e.size from s join e on starts_with(e.path, s.pattern || '/') where e.block is not null)
  select pattern, count(*) as n_blocks, cast(sum(rlen) as bigint) as decoded_bytes, cast(sum(wanted) as bigint) as wanted_bytes from (select pattern, block, sum(size) as wanted from h group by pattern, block) join t using (block) group by pattern""")
def _(spark, sf):
    entries, assigned = _packed(spark, sf)
    e = entries.select("path", "size", F.explode("segments").alias("s")).select("path", "size", "s.block")
    hit = F.filter(F.array(*[F.when(paths.matches(F.col("path"), F.lit(p)), F.lit(p)) for p in ("src1", "src2/en", "src3")]), lambda x: x.isNotNull())
    per = e.select(F.explode(hit).alias("pattern"), "block", "size").groupBy("pattern", "block").agg(F.sum("size").alias("wanted"))
    blocks = pack.block_table(assigned).select("block", "rlen")
    return per.join(blocks, "block").groupBy("pattern").agg(F.count("*").alias("n_blocks"), b(F.sum("rlen")).alias("decoded_bytes"), b(F.sum("wanted")).alias("wanted_bytes"))


def _touch(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb"):
        pass


@query("overwrite_conflicts", f"with {FILES} select path from f where starts_with(path, 'src1/') and lane = 1")
def _(spark, sf):
    """src1 is asked for where the fast-lane files of all folders lie already."""
    with scratch(spark) as folder:

        def found(at):
            dest = os.path.join(folder, "tree")
            there = lambda rows: [_touch(os.path.join(dest, r.path)) for r in rows]
            entries_of(spark, at).filter(classify.lane(F.col("path")) == 1).select("path").foreachPartition(there)
            return checkpoint(conflicts(entries_of(spark, at, selectors=["src1"]), dest).select("path"))

        return _written(spark, sf, found)


# --- bench results and small ones
BENCH = """('lib', 'zip -9', 1000L, 300L, 4.0D, 1.0D), ('lib', 'ours fast', 1000L, 280L, 0.5D, 0.5D), ('lib', 'ours max', 1000L, 200L, 20.0D, 0.0D),
 ('bin', 'zip -9', 0L, 0L, 1.0D, 2.0D), ('bin', 'ours fast', 0L, 0L, 1.0D, 4.0D), ('img', 'ours fast', 50L, 60L, 1.0D, 1.0D)"""
BENCH_DUCK = "(select * from (values " + BENCH.replace("L,", ",").replace("D", "").replace(".0,", ".0::double,").replace("0.5,", "0.5::double,").replace("0.5)", "0.5::double)").replace(".0)", ".0::double)") + ") t(corpus, tool, raw_bytes, packed_bytes, compress_s, decompress_s))"
BENCH_COLS = "corpus, tool, raw_bytes, packed_bytes, compress_s, decompress_s"


@query("bench_ratio", f"select corpus, tool, case when raw_bytes = 0 then 0.0 else packed_bytes / cast(raw_bytes as double) end as ratio from {BENCH_DUCK}")
def _(spark, sf):
    return reports.bench_ratio(values(spark, BENCH, BENCH_COLS)).select("corpus", "tool", "ratio")


@query("bench_vs_zip", f"""with x as {BENCH_DUCK} select x.corpus, x.tool, case when z.packed_bytes = 0 then 0.0 else (1 - x.packed_bytes / cast(z.packed_bytes as double)) * 100 end as saved_pct,
  case when x.decompress_s = 0 then 0.0 else z.decompress_s / x.decompress_s end as extract_speedup from x join x z on z.corpus = x.corpus and z.tool = 'zip -9'""")
def _(spark, sf):
    return reports.bench_vs(values(spark, BENCH, BENCH_COLS))


TAKEN = ["photos", "photos 2", "photos 4", "docs 2", "music"]


@query("unique_output_name", f"""with t as (select * from (values {lit_rows(TAKEN)}) t(name)), w as (select * from (values ('photos'), ('docs'), ('music')) w(want))
  select want, min(n) as n, arg_min(case when n = 1 then want else want || ' ' || n end, n) as name from w, range(1, 100) g(n) where (case when n = 1 then want else want || ' ' || n end) not in (select name from t) group by want""")
def _(spark, sf):
    taken = values(spark, sql_rows(TAKEN), "name")
    want = values(spark, "('photos'), ('docs'), ('music')", "want").withColumn("n", F.explode(F.sequence(b(F.lit(1)), b(F.lit(len(TAKEN) + 1)))))
    named = want.withColumn("name", F.when(F.col("n") == 1, F.col("want")).otherwise(F.concat_ws(" ", "want", F.col("n").cast("string"))))
    return named.join(taken, "name", "left_anti").groupBy("want").agg(F.min("n").alias("n"), F.min_by("name", "n").alias("name"))


@query("rle_runs", """with c as (select o_custkey % 10 as y, o_orderkey as x, o_orderstatus as v from orders), g as (select *, row_number() over (partition by y order by x) - row_number() over (partition by y, v order by x) as run from c)
  select y, v, min(x) as start, count(*) as length from g group by y, v, run""")
def _(spark, sf):
    cells = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("y"), F.col("o_orderkey").alias("x"), F.col("o_orderstatus").alias("v"))
    return reports.islands(cells, ["y"], "x", "v")


@query("bench_json", f"select corpus, tool, cast(raw_bytes as bigint) as raw_bytes, cast(packed_bytes as bigint) as packed_bytes, compress_s, decompress_s from {BENCH_DUCK}")
def _(spark, sf):
    with scratch(spark) as folder:
        at = os.path.join(folder, "results")
        bench.write_results(values(spark, BENCH, BENCH_COLS), at)
        return checkpoint(bench.read_results(spark, at))


@query("bench_codecs", f"with {FILES} select 'docs' as corpus, tool, (select cast(sum(size) as bigint) from f) as raw_bytes, true as smaller from (values ('zip -9'), ('fast'), ('balanced'), ('max')) t(tool)")
def _(spark, sf):
    found = bench.measure(docs_tree(spark, sf, content=True), "docs")
    return found.select("corpus", "tool", "raw_bytes", ((F.col("packed_bytes") > 0) & (F.col("packed_bytes") < F.col("raw_bytes")) & (F.col("compress_s") > 0) & (F.col("decompress_s") > 0)).alias("smaller"))


# --- contents through codecs and the container
@query("encode_decode_roundtrip", f"with {blocks_sql(CAP)} select cast(block as bigint) as block, cast(sum(a.size) as bigint) as rlen, sha256(string_agg(text, '' order by a.i)) as raw_sha256 from a join f using (path) group by block")
def _(spark, sf):
    files = docs_tree(spark, sf, content=True)
    members = _assigned(spark, sf).join(files.select("walk_id", "content"), "walk_id")
    raw = decode_blocks(encode_blocks(members, CAP, 1, 3))
    return raw.select(b(F.col("block")).alias("block"), b(F.octet_length("raw")).alias("rlen"), F.sha2("raw", 256).alias("raw_sha256"))


def _read_back(spark, hash_name="sha256"):
    file = lambda c: c.select("path", b(F.octet_length("content")).alias("size"), F.sha2("content", 256).alias("sha256"))
    return lambda at: checkpoint(file(contents(spark, at, hash_name=hash_name)))


@query("archive_roundtrip", f"with {FILES} select path, size, hash as sha256 from f")
def _(spark, sf):
    return _written(spark, sf, _read_back(spark))


@query("archive_roundtrip_blake3", f"with {FILES} select path, size, hash as sha256 from f")
def _(spark, sf):
    return _written(spark, sf, _read_back(spark, "blake3"), WriteOptions(1, 3, CAP, check_block_size=False, hash_name="blake3"))


@query("archive_roundtrip_shared_paths", f"with {FILES}, {SHARED} select path, size, hash as sha256 from s")
def _(spark, sf):
    return _written(spark, sf, _read_back(spark), files=shared_paths(docs_tree(spark, sf, content=True)))


@query("archive_roundtrip_pieces", f"with {FILES} select path, size, hash as sha256 from f")
def _(spark, sf):
    """Files of more than 1,500 bytes in several segments, each piece a row of its own."""
    size, whole = 1_500, docs_tree(spark, sf, content=True)
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / size).cast("int"))
    cut = archive_manifest(whole).join(whole.select("walk_id", "hash"), "walk_id").withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("content", F.substring("content", F.col("piece") * size + 1, F.lit(size)))
    with scratch(spark) as folder:
        at = os.path.join(folder, "docs.cairn")
        write_container(cut, at, WriteOptions(1, 3, CAP, check_block_size=False, max_piece=size))
        return _read_back(spark)(at)


@query("extract_last_of_path", f"with {FILES}, {SHARED} select path, arg_max(hash, (place, doc_id)) as sha256 from (select s.*, case when size = 0 then 1 else 0 end as place from s) group by path")
def _(spark, sf):
    """Without dedup storage order is pack order, so of one path the last document stays; empty ones come after all."""
    files = shared_paths(docs_tree(spark, sf, content=True))
    last = lambda at: checkpoint(contents(spark, at, last=True).select("path", F.sha2("content", 256).alias("sha256")))
    return _written(spark, sf, last, WriteOptions(1, 3, CAP, dedup=False, check_block_size=False), files)
