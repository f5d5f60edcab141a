"""Incremental maintenance: change detection, file-wise replacement, content caches, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path, status (A, M, D) between two snapshots with one row a path."""
    both = old.select(path, F.col(digest).alias("_old")).join(new.select(path, F.col(digest).alias("_new")), path, "full")
    status = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").when(F.col("_old") != F.col("_new"), "M")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(path, "status")


def split_renames(feed: DataFrame) -> DataFrame:
    """A feed of (path, status, old_path) in which a rename is a deletion of the old path and a change of the new one."""
    moved = feed.where("status = 'R'")
    gone = moved.select(F.col("old_path").alias("path"), F.lit("D").alias("status"))
    return feed.where("status <> 'R'").select("path", "status").unionByName(gone).unionByName(moved.select("path", F.lit("M").alias("status")))


def replaced(table: DataFrame, fresh: DataFrame, file: str, deleted: DataFrame | None = None) -> DataFrame:
    """The table with all rows of the fresh files, and of deleted ones, replaced."""
    gone = fresh.select(file).distinct()
    gone = gone if deleted is None else gone.union(deleted.select(file)).distinct()
    return table.join(gone, file, "left_anti").unionByName(fresh)


def chunk_delta(old: DataFrame, new: DataFrame, digest: str) -> DataFrame:
    """Content hashes added and removed, as multisets: equal copies pair off one by one."""
    a = old.groupBy(digest).agg(F.count("*").alias("_a"))
    b = new.groupBy(digest).agg(F.count("*").alias("_b"))
    n = F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))
    out = a.join(b, digest, "full").withColumn("n", n).where("n <> 0")
    return out.select(digest, F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("copies"))


def delta_or_rebuild(delta: DataFrame, total: int, limit: float = 0.1) -> str:
    """``rebuild`` if nothing is there yet or more than ``limit`` of the rows change, else ``delta``."""
    changed = delta.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return "rebuild" if not total or changed / total > limit else "delta"


def cache_split(wanted: DataFrame, cache: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses) of a content-addressed cache."""
    return wanted.join(cache, digest), wanted.join(cache.select(digest), digest, "left_anti")


def pruned(cache: DataFrame, active: DataFrame, digest: str) -> DataFrame:
    return cache.join(active.select(digest).distinct(), digest, "left_semi")


def overlay(feed: DataFrame, key: str, order: Column, op: str = "op") -> DataFrame:
    """The state after a feed of upserts and deletes: each key's last row, unless that deletes it."""
    last = feed.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")
    return last.where(F.col(op) != "delete")


def differences(incremental: DataFrame, rebuilt: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status (missing, extra, changed): empty if both agree."""
    both = incremental.select(key, F.col(digest).alias("_i"), F.lit(1).alias("_in")).join(rebuilt.select(key, F.col(digest).alias("_r"), F.lit(1).alias("_out")), key, "full")
    status = F.when(F.col("_in").isNull(), "missing").when(F.col("_out").isNull(), "extra").when(~F.col("_i").eqNullSafe(F.col("_r")), "changed")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(key, "status")


def freshness(rows: DataFrame, age: Column, limit: Column) -> DataFrame:
    return rows.withColumn("state", F.when(age.isNull(), "missing").when(age <= limit, "fresh").otherwise("stale"))


def is_current(view: list[str], source: list[str]) -> Column:
    """All parts of a view's recorded identity equal the source's, null for null."""
    ok = F.lit(True)
    for v, s in zip(view, source):
        ok = ok & F.col(v).eqNullSafe(F.col(s))
    return ok


def latest(generations: DataFrame, key: str, generation: str) -> DataFrame:
    """The row a reference resolves to: the newest generation of each key."""
    return generations.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(generation).desc()))).where("_n = 1").drop("_n")


def fingerprint(files: DataFrame, path: str, content: str) -> DataFrame:
    """One digest over all paths and contents, whatever their order.

    Rows are hashed where they lie; per range of 4,096 the sorted digests are hashed, then the ranges, so no task
    gathers all files.
    """
    row = F.sha2(F.concat_ws("\n", F.length(path).cast("string"), F.col(path), F.sha2(F.coalesce(F.col(content), F.lit("")), 256)), 256)
    leaf = files.select(row.alias("h")).withColumn("range", F.substring("h", 1, 3))
    ranges = leaf.groupBy("range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "h"))), lambda x: F.concat(x["range"], x["h"])), ""), 256).alias("fingerprint"))


def shift_anchors(edges: DataFrame, file: str, after: int, by: int) -> DataFrame:
    moved = (F.col("anchor_file") == file) & (F.col("anchor_line") > after)
    return edges.withColumn("anchor_line", F.when(moved, F.col("anchor_line") + by).otherwise(F.col("anchor_line")))


def edges_outside(edges: DataFrame, ranges: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges whose anchor lies in none of the (file, first, last) ranges; both meet by file and bucket of lines."""
    r = ranges.where("first <= last").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))
    e = edges.withColumn("_bucket", F.floor(F.col("anchor_line") / bucket))
    hit = (e["anchor_file"] == r["file"]) & (e["_bucket"] == r["_bucket"]) & e["anchor_line"].between(r["first"], r["last"])
    return e.join(r, hit, "left_anti").drop("_bucket")


def changes_with_renames(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path, status (A, M, D, R), old_path: a path that went and one that came with the same content are a rename.

    Of several paths with one content the k-th that went is paired with the k-th that came, in path order.
    """
    plain = changes(old, new, path, digest)
    gone = plain.where("status = 'D'").join(old.select(path, digest), path).withColumn("_k", F.row_number().over(W.partitionBy(digest).orderBy(path))).select(digest, "_k", F.col(path).alias("old_path"))
    came = plain.where("status = 'A'").join(new.select(path, digest), path).withColumn("_k", F.row_number().over(W.partitionBy(digest).orderBy(path)))
    moved = came.join(gone, [digest, "_k"]).select(path, F.lit("R").alias("status"), "old_path")
    rest = plain.join(moved.select(path), path, "left_anti").join(moved.select(F.col("old_path").alias(path)), path, "left_anti")
    return rest.withColumn("old_path", F.lit(None).cast("string")).unionByName(moved)


def hunk_ranges(patches: DataFrame, patch: str) -> DataFrame:
    """The patches' columns with old_first, old_last, new_first, new_last of every hunk; an empty side has last = first - 1."""
    head = r"(?m)^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    part = lambda i: F.regexp_extract_all(patch, F.lit(head), F.lit(i))
    each = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("e"))
    rows = patches.withColumn("_h", F.explode(each))
    n = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(1))
    first = lambda c: F.col(c).cast("bigint")
    out = rows.withColumns({"old_first": first("_h.a"), "new_first": first("_h.c"), "old_last": first("_h.a") + n("_h.b") - 1, "new_last": first("_h.c") + n("_h.e") - 1})
    return out.drop("_h", patch)


def updated_chunks(chunks: DataFrame, fresh: DataFrame, changes_: DataFrame, file: str = "file") -> DataFrame:
    """The chunk table after a change feed (path, status): changed and added files from ``fresh``, deleted ones gone.

    A changed file without fresh chunks fails the whole update when the result is evaluated, so no half of it is published.
    """
    wanted = changes_.where("status <> 'D'").select(F.col("path").alias(file)).distinct()
    have = fresh.select(file).distinct().withColumn("_have", F.lit(1))
    lost = wanted.join(have, file, "left").agg(F.count_if(F.col("_have").isNull())).scalar()
    gone = changes_.select(F.col("path").alias(file)).distinct()
    out = chunks.join(gone, file, "left_anti").unionByName(fresh.join(wanted, file, "left_semi"))
    return out.where(F.when(lost > 0, F.raise_error(F.lit("changed files were not chunked"))).otherwise(F.lit(True)).cast("boolean"))


def rebuilt_vectors(chunks: DataFrame, cache: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with their cached vectors, chunks whose vector must be made)."""
    return chunks.join(cache, digest), chunks.join(cache.select(digest), digest, "left_anti")


def patched_index(index: DataFrame, rows: DataFrame, digest: str, vector: str, limit: float = 0.1) -> DataFrame:
    """The index (digest, vector) brought to ``rows`` (digest, vector) and how: rows kept, added or removed by content.

    Equal contents pair off one by one, so a copy more is one row added.  ``mode`` is rebuild if the index is empty or
    more than ``limit`` of its rows change, else delta; both give the same rows.
    """
    nth = F.row_number().over(W.partitionBy(digest).orderBy(F.lit(0)))
    a = index.withColumn("_k", nth).select(digest, "_k", F.col(vector).alias("_old"))
    b = rows.withColumn("_k", nth).select(digest, "_k", F.col(vector).alias("_new"))
    both = a.join(b, [digest, "_k"], "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    both = both.withColumn("change", change)
    total = both.agg(F.count("_old")).scalar()
    moved = both.agg(F.count_if(F.col("change") != "kept")).scalar()
    mode = F.when((total == 0) | (moved / F.greatest(total, F.lit(1)) > limit), "rebuild").otherwise("delta")
    return both.select(digest, F.coalesce("_old", "_new").alias(vector), "change", mode.alias("mode"))


def without_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, severed): the graph without a file's nodes, and the edges that crossed its border, by the names of their ends."""
    gone = nodes.where((F.col("file") == file) | ((F.col("type") == "file") & (F.col("name") == file))).select("vid")
    left = nodes.join(gone, "vid", "left_anti")
    marked = edges.join(gone.select(F.col("vid").alias("src"), F.lit(1).alias("_s")), "src", "left").join(gone.select(F.col("vid").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    kept = marked.where("_s IS NULL AND _d IS NULL").drop("_s", "_d")
    cut = marked.where("(_s IS NULL) <> (_d IS NULL)").drop("_s", "_d")
    name = nodes.select("vid", "name")
    cut = cut.join(name.select(F.col("vid").alias("src"), F.col("name").alias("src_name")), "src", "left").join(name.select(F.col("vid").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
    return left, kept, cut


def reconnected(nodes: DataFrame, edges: DataFrame, severed: DataFrame) -> DataFrame:
    """Edges with the severed ones whose ends stand in the rebuilt graph again, by name."""
    name = nodes.groupBy("name").agg(F.min("vid").alias("vid"))
    again = severed.drop("src", "dst").join(name.select(F.col("name").alias("src_name"), F.col("vid").alias("src")), "src_name").join(name.select(F.col("name").alias("dst_name"), F.col("vid").alias("dst")), "dst_name")
    return edges.unionByName(again.select(*edges.columns)).distinct()


def renamed_file(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The graph after a rename: files, file nodes, display names and anchors follow."""
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    head = F.col("unified_name").startswith(old + ":")
    own = nodes.withColumn("unified_name", F.when(head, F.concat(F.lit(new), F.substring("unified_name", F.lit(len(old) + 1), F.length("unified_name")))).otherwise(swap("unified_name")))
    own = own.withColumn("name", F.when(F.col("type") == "file", swap("name")).otherwise(F.col("name"))).withColumn("file", swap("file"))
    return own, edges.withColumn("anchor_file", swap("anchor_file"))


def generation_id(*parts: Column) -> Column:
    """A content-addressed id: sha256 over framed parts, null and "" apart."""
    framed = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


def staged(generations: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Generations with the new ones that are not there yet; staging again changes nothing.  ``key`` makes the id."""
    rows = new.withColumn("generation_id", generation_id(*[F.col(k) for k in key])).dropDuplicates(["generation_id"])
    return generations.unionByName(rows.join(generations.select("generation_id"), "generation_id", "left_anti").select(*generations.columns))


def published(refs: DataFrame, repository: str, ref: str, snapshot: str, expected: int) -> DataFrame:
    """The ref table (repository, ref, snapshot, generation) with a new row, if the ref is at the expected generation.

    Another generation raises an error when the result is evaluated; 0 stands for a ref that is not there.
    """
    own = refs.where((F.col("repository") == repository) & (F.col("ref") == ref))
    now = own.agg(F.coalesce(F.max("generation"), F.lit(0)).cast("bigint")).scalar()
    held = F.when(now == expected, F.lit(expected + 1).cast("bigint")).otherwise(F.raise_error(F.lit(f"{repository}/{ref} is not at generation {expected}")).cast("bigint"))
    row = refs.sparkSession.range(1).select(F.lit(repository).alias("repository"), F.lit(ref).alias("ref"), F.lit(snapshot).alias("snapshot"), held.alias("generation"))
    return refs.select("repository", "ref", "snapshot", "generation").unionByName(row)


def manifest(refs: DataFrame, snapshots: DataFrame, generations: DataFrame, profiles: DataFrame, objects: DataFrame) -> DataFrame:
    """What each ref resolves to: the views of its newest snapshot with their profile and object.

    refs: repository, ref, snapshot, generation; snapshots: snapshot, generation_id; generations: generation_id, view,
    profile_id, digest; profiles: profile_id, profile; objects: digest, size.
    """
    newest = latest(refs.withColumn("_key", F.struct("repository", "ref")), "_key", "generation").drop("_key")
    return newest.join(snapshots, "snapshot").join(generations, "generation_id").join(profiles, "profile_id").join(objects, "digest").select("repository", "ref", "snapshot", "generation", "view", "profile", "digest", "size")


def admitted(incremental: DataFrame, rebuilt: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: differences between an updated view and a clean build, and whether the update may be published."""
    return differences(incremental, rebuilt, key, digest).agg(F.count("*").alias("differences")).withColumn("admitted", F.col("differences") == 0)


def leases(requests: DataFrame, job: str = "job", at: str = "at", owner: str = "owner", lasts: str = "lasts") -> DataFrame:
    """Requests with ``granted`` and a fencing ``token``: a job goes to the first request after its last lease ended.

    The owner of a running lease renews it under its token.  What is granted depends on what was granted before, so a
    job's requests are folded in order; jobs are independent.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, owner], kind="stable").reset_index(drop=True)
        holder, until, token, granted, tokens = None, None, 0, [], []
        for row in pdf.itertuples():
            now, who, span = getattr(row, at), getattr(row, owner), getattr(row, lasts)
            if holder is None or now >= until:
                holder, token, ok = who, token + 1, True
            else:
                ok = who == holder
            if ok:
                until = now + span
            granted.append(ok)
            tokens.append(token if ok else 0)
        return pdf.assign(granted=granted, token=tokens)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.groupBy(job).applyInPandas(fold, f"{fields}, granted boolean, token bigint")


def benchmark_cases(cases: DataFrame, sources: DataFrame, key: str = "instance_id", require: bool = False) -> DataFrame:
    """Cases with their source rows by instance id, without a leading ``instance_``; ``require`` fails if one has none."""
    plain = lambda c: F.regexp_replace(F.trim(c), "^instance_", "")
    s = sources.withColumn(key, plain(F.col(key))).withColumn("_found", F.lit(True))
    out = cases.withColumn(key, plain(F.col(key))).join(s, key, "left" if require else "inner")
    if require:
        out = out.where(F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no source row for "), F.col(key)))).otherwise(F.lit(True)).cast("boolean"))
    return out.drop("_found")


def exclusive_subtrees(paths: list[str], root: str) -> list[str]:
    """Excluded paths relative to a root, without doubles and without those below another; paths outside of it are dropped."""
    base = root.rstrip("/") + "/"
    plain = sorted({(p[len(base):] if p.startswith(base) else p).strip("/") for p in paths if not p.startswith("/") or p.startswith(base)} - {"", "."})
    return [p for p in plain if ".." not in p.split("/") and not any(p.startswith(q + "/") for q in plain)]
