"""Directory trees: hashing bottom-up, listings, diff, merge, overlay, lookup, link groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..plans.durable import cut

#: Checksum of a directory's usual metadata: owner 0, group 0, mode 040755, no attributes.
ROOT_META = hashlib.sha256(bytes(8) + H.DIR_MODE.to_bytes(4, "big")).hexdigest()


def parent(path: Column) -> Column:
    """Directory of an absolute path; the root's entries have the empty string."""
    return F.regexp_replace(path, "/[^/]*$", "")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def below(path: Column | str, folder: str) -> Column:
    return F.startswith(path, F.lit(folder + "/"))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def normal_path(path: Column) -> Column:
    """Path components without empty ones and `.`."""
    return F.concat(F.lit("/"), F.concat_ws("/", F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))))


def directories(paths: DataFrame) -> DataFrame:
    """Every ancestor directory of the paths, the root as ''."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths.select(F.explode(up).alias("path")).distinct()


def _width(data: int, count: int) -> int:
    return next(z for z in (1, 2, 4, 8) if data + z * count < 1 << 8 * z)


class _Directory:
    """The serialised form of one directory, hashed as its sorted entries come; of a closed array only the ends are held."""

    def __init__(self, meta: bytes):
        self.meta, self.sha, self.counts, self.ends, self.size, self.closed = meta, hashlib.sha256(), [0, 0], [], 0, 0

    def close_array(self) -> None:
        if self.ends:
            z = _width(self.size, len(self.ends))
            self.sha.update(np.array(self.ends, np.uint64).astype(f"<u{z}").tobytes())
            self.size += z * len(self.ends)
        self.closed += self.size
        self.ends, self.size = [], 0

    def add(self, kind: int, name: str, checksum: bytes) -> None:
        if kind and not self.counts[1]:
            self.first = self.close_array() or self.closed
        raw = name.encode() + b"\0"
        if kind:
            z = _width(len(raw) + 64, 2)
            element = raw + checksum + self.meta + (len(raw) + 32).to_bytes(z, "little") + len(raw).to_bytes(z, "little")
        else:
            element = raw + checksum + len(raw).to_bytes(_width(len(raw) + 32, 1), "little")
        self.counts[kind] += 1
        self.sha.update(element)
        self.size += len(element)
        self.ends.append(self.size)

    def digest(self) -> bytes:
        self.close_array()
        first = self.first if self.counts[1] else self.closed
        self.sha.update(first.to_bytes(_width(self.closed, 1), "little"))
        return self.sha.digest()


def _hash_directories(meta: bytes):
    """Rows (dir, kind, name, checksum), sorted within the task -> (path, sum, files, dirs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["path", "sum", "files", "dirs"])

        for b in batches:
            for path, kind, name, checksum in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != now:
                    if open_:
                        out.append((now, open_.digest(), *open_.counts))
                    now, open_ = path, _Directory(meta)
                open_.add(kind, name, checksum)
            yield flush()
            out = []
        if open_:
            out.append((now, open_.digest(), *open_.counts))
            yield flush()

    return rows


def write_tree(files: DataFrame, meta: str = ROOT_META) -> DataFrame:
    """(path, checksum, files, dirs) of every directory of the files (path, checksum), deepest level first.

    Files come before directories, each in byte order of the name, as the serialised form asks. The files are read once; a level emits
    one row for each of its directories into the level above, so data shrinks by the fan-out at each step. A task streams over its sorted
    entries and holds a number for each entry of the directory it is in, so a giant directory needs little memory.
    """
    entries = cut(files.select(parent(F.col("path")).alias("dir"), F.lit(0).alias("kind"), base(F.col("path")).alias("name"), F.unhex("checksum").alias("sum")).withColumn("level", depth(F.col("dir"))))
    deepest = entries.agg(F.max("level")).first()[0]
    if deepest is None:
        return files.sparkSession.range(1).select(F.lit("").alias("path"), H.sha(F.lit("00")).alias("checksum"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("dirs"))
    done: list[DataFrame] = []
    for d in range(deepest, -1, -1):
        here = entries.where(F.col("level") == d).drop("level")
        if done:
            here = here.unionByName(done[-1].select(parent(F.col("path")).alias("dir"), F.lit(1).alias("kind"), base(F.col("path")).alias("name"), "sum"))
        sorted_ = here.repartition("dir").sortWithinPartitions("dir", "kind", "name")
        done.append(cut(sorted_.mapInArrow(_hash_directories(bytes.fromhex(meta)), "path string, sum binary, files long, dirs long")))
    return reduce(DataFrame.unionByName, done).select("path", F.lower(F.hex("sum")).alias("checksum"), "files", "dirs")


def content_root(trees: DataFrame, meta: Column | None = None) -> DataFrame:
    """Content checksum of the tree: sha256(root directory's checksum, root's metadata checksum)."""
    meta = H.dirmeta_checksum() if meta is None else meta
    return trees.where("path = ''").select("checksum", H.sha(F.concat("checksum", meta)).alias("content_checksum"))


def listing(files: DataFrame, trees: DataFrame) -> DataFrame:
    """(path, kind, checksum) of everything but the root."""
    return files.select("path", F.lit("f").alias("kind"), "checksum").unionByName(trees.where("path <> ''").select("path", F.lit("d").alias("kind"), "checksum"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, path) between two listings (path, kind, checksum[, meta]).

    M: a file's checksum, a directory's metadata or a type differs; a type change hides what is below it. D: a deleted directory is one line. A: every added
    entry has one. Only unequal rows go on to the search for hidden ones, so equal subtrees cost the join alone.
    """
    cols = lambda d, x: d.select("path", F.col("kind").alias(f"{x}k"), F.col("checksum").alias(f"{x}c"), (F.col("meta") if "meta" in d.columns else F.lit("")).alias(f"{x}m"))
    both = cols(a, "a").join(cols(b, "b"), "path", "full_outer")
    change = (
        F.when(F.col("ak").isNull(), "A").when(F.col("bk").isNull(), "D").when(F.col("ak") != F.col("bk"), "T")
        .when((F.col("ak") == "f") & ((F.col("ac") != F.col("bc")) | (F.col("am") != F.col("bm"))), "M").when((F.col("ak") == "d") & (F.col("am") != F.col("bm")), "M")
    )
    changed = both.select("path", change.alias("change"), "ak").where("change is not null")
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    below = changed.where("change in ('D', 'A')").select("path", "change", above.alias("up"))
    hides = changed.where("(change = 'D' and ak = 'd') or change = 'T'").select(F.col("path").alias("up"), F.col("change").alias("by"))
    hidden = below.join(hides, "up").where("by = 'T' or change = 'D'").select("path").distinct()
    return changed.join(hidden, "path", "left_anti").select(F.when(F.col("change") == "T", "M").otherwise(F.col("change")).alias("change"), "path")


def diff_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Object counts of two closures (checksum, size), what they share, and its bytes."""
    x, y = a.select("checksum", "size").distinct(), b.select("checksum", "size").distinct()
    both = x.join(y.select("checksum", F.lit(1).alias("in_b")), "checksum", "full_outer").select("checksum", "size", "in_b")
    in_a = F.col("size").isNotNull()
    return both.agg(F.count_if(in_a).alias("from_count"), F.count_if(F.col("in_b").isNotNull()).alias("to_count"), F.count_if(in_a & F.col("in_b").isNotNull()).alias("common_count"), F.coalesce(F.sum(F.when(F.col("in_b").isNotNull(), F.col("size"))), F.lit(0)).alias("common_bytes"))


def merge(left: DataFrame, right: DataFrame, right_wins: bool = False, keep_meta: bool = True) -> DataFrame:
    """Two listings (path, kind, checksum[, meta]) as one: equal entries once, directories united, other clashes marked or won by the right.

    A directory's metadata is the left's, or with keep_meta off the right's where both have it; a directory that the right replaces by a file loses what is below it.
    """
    cols = lambda d, x: d.select("path", F.col("kind").alias(f"{x}k"), F.col("checksum").alias(f"{x}c"), (F.col("meta") if "meta" in d.columns else F.lit(None).cast("string")).alias(f"{x}m"))
    both = cols(left, "l").join(cols(right, "r"), "path", "full_outer")
    united = (F.col("lk") == "d") & (F.col("rk") == "d")
    clash = F.col("lk").isNotNull() & F.col("rk").isNotNull() & ~united & ((F.col("lk") != F.col("rk")) | (F.col("lc") != F.col("rc")))
    take = (F.col("rk").isNotNull() & F.lit(right_wins)) | F.col("lk").isNull()
    pick = lambda c: F.when(take, F.col(f"r{c}")).otherwise(F.col(f"l{c}"))
    meta = F.when(united, F.coalesce(*(["lm", "rm"] if keep_meta else ["rm", "lm"]))).otherwise(pick("m"))
    out = both.select("path", pick("k").alias("kind"), pick("c").alias("checksum"), meta.alias("meta"), F.coalesce(clash & F.lit(not right_wins), F.lit(False)).alias("conflict"), F.coalesce(clash & (F.col("rk") != "d") & (F.col("lk") == "d") & F.lit(right_wins), F.lit(False)).alias("buries"), F.col("rk").isNotNull().alias("right"))
    buried = out.where("buries").select(F.col("path").alias("up"))
    parts = F.split("path", "/")
    below_ = out.where("not right").select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("up")).join(buried, "up").select("path").distinct() if right_wins else None
    out = out.join(below_, "path", "left_anti") if right_wins else out
    return out.select("path", "kind", "checksum", "meta", "conflict")


#: Edits of a staging tree; a row is (pos, op, path, target, checksum).
EDITS = ("mkdir", "mkdirs", "write", "symlink", "link", "remove", "clear", "rename")


def edit(tree: DataFrame, edits: list[tuple[str, str, str | None]]) -> tuple[DataFrame, list[str]]:
    """A staging tree (path, kind, checksum) after a short list of edits (op, path, argument) in their order, and each edit's outcome.

    mkdir needs the parent and nothing in its place; mkdirs makes parents too; write and symlink put a file or link (argument: checksum or target); link copies
    the file named by the argument; remove takes a path and all below it; clear all below it; rename moves to the argument, whose parent must be there. An edit that fails changes nothing.
    """
    outcomes = []
    for op, path, arg in edits:
        at = {r.path: r.kind for r in tree.where(F.col("path").isin([p for p in (path, path.rpartition("/")[0], arg, (arg or "").rpartition("/")[0]) if p])).select("path", "kind").collect()}
        at[""] = "d"
        up = path.rpartition("/")[0]
        under = (F.col("path") == path) | below(F.col("path"), path)
        one = lambda p, kind, value: tree.sparkSession.createDataFrame([(p, kind, value)], "path string, kind string, checksum string")
        outcome = "done"
        if op in ("mkdir", "write", "symlink", "link") and at.get(up) != "d":
            outcome = "no parent"
        elif op == "mkdir" and path in at:
            outcome = "there already"
        elif op in ("write", "symlink", "link") and at.get(path) == "d":
            outcome = "a directory"
        elif op == "link" and at.get(arg) != "f" or op in ("remove", "clear", "rename") and path not in at:
            outcome = "no such path"
        elif op == "clear" and at[path] != "d":
            outcome = "no directory"
        elif op == "rename" and at.get(arg.rpartition("/")[0]) != "d":
            outcome = "no parent"
        elif op == "rename" and (arg in at or arg.startswith(path + "/")):
            outcome = "there already"
        elif op == "mkdir":
            tree = tree.unionByName(one(path, "d", None))
        elif op == "mkdirs":
            names = path.split("/")[1:]
            ups = ["/" + "/".join(names[: i + 1]) for i in range(len(names))]
            there = {r.path: r.kind for r in tree.where(F.col("path").isin(ups)).select("path", "kind").collect()}
            if any(k != "d" for k in there.values()):
                outcome = "no directory"
            for p in ups if outcome == "done" else []:
                tree = tree if p in there else tree.unionByName(one(p, "d", None))
        elif op in ("write", "symlink"):
            tree = tree.where(F.col("path") != path).unionByName(one(path, "f" if op == "write" else "l", arg))
        elif op == "link":
            tree = tree.where(F.col("path") != path).unionByName(tree.where(F.col("path") == arg).withColumn("path", F.lit(path)))
        elif op in ("remove", "clear"):
            tree = tree.where(~under | ((F.col("path") == path) & F.lit(op == "clear")))
        else:
            tree = rename(tree, path, arg)
        outcomes.append(outcome)
    return tree, outcomes


def with_metadata(dirs: DataFrame, own: DataFrame, root: str = "default", default: Column | None = None) -> DataFrame:
    """(path, meta) of directories: their own (path, own) metadata, else the default for those that a file implies. The root's policy: `default`, or `required`, which leaves it null so that a caller can refuse."""
    default = H.dirmeta_checksum() if default is None else default
    both = dirs.join(own, "path", "left")
    return both.select("path", F.coalesce("own", F.when((F.col("path") != "") | F.lit(root == "default"), default)).alias("meta"))


def overlay(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Apply an upper layer (path, kind, checksum) to files (path, checksum): `w` deletes a path and all below, `o` clears below a directory, `f` replaces."""
    gone = upper.where("kind in ('w', 'o')").select(F.col("path").alias("up"), "kind")
    parts = F.split("path", "/")
    selfs = lower.select("path", "checksum", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("up"))
    dead = selfs.join(gone, "up").where("kind = 'w' or up <> path").select("path").distinct()
    kept = lower.join(dead, "path", "left_anti")
    new = upper.where("kind = 'f'").select("path", F.col("checksum").alias("new"))
    return kept.join(new, "path", "full_outer").select("path", F.coalesce("new", "checksum").alias("checksum"))


def link_groups(files: DataFrame) -> DataFrame:
    """Export order: a later file of the same content links to the first path of it. The first paths come from a map-side minimum, so a content that very many files share isn't gathered."""
    groups = files.groupBy("checksum").agg(F.min("path").alias("first"), F.count("*").alias("nlink"))
    return files.select("path", "checksum").join(groups, "checksum").select("path", "checksum", "nlink", F.when(F.col("first") != F.col("path"), F.col("first")).alias("link_to"))


def in_scope(paths: DataFrame, subpaths: list[str]) -> DataFrame:
    """Paths that a partial replication reaches: below a subpath or on the way to one."""
    hit = [F.startswith(F.concat(F.col("path"), F.lit("/")), F.lit(f"{s.rstrip('/')}/")) | F.startswith(F.lit(f"{s.rstrip('/')}/"), F.concat(F.col("path"), F.lit("/"))) for s in subpaths]
    return paths.where(reduce(Column.__or__, hit, F.lit(False)))


def rename(paths: DataFrame, old: str, new: str) -> DataFrame:
    """Move a path and all below it."""
    moved = F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))
    under = (F.col("path") == old) | F.startswith("path", F.lit(f"{old}/"))
    return paths.withColumn("path", F.when(under, moved).otherwise(F.col("path")))


def skip_subtrees(paths: DataFrame, skipped: DataFrame) -> DataFrame:
    """A filter that skips a path prunes all below it."""
    parts = F.split("path", "/")
    ups = paths.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("up"))
    dead = ups.join(skipped.select(F.col("path").alias("up")), "up").select("path").distinct()
    return paths.join(dead, "path", "left_anti")


def walk(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, path, kind, child) of everything below directory objects: roots (root, dirtree) and entries (dirtree, kind, name, child), kind d or f. A level is one join, so shared subtrees are stored once and listed for each place."""
    entries = cut(entries)
    now = cut(roots.select("root", F.lit("").alias("path"), F.col("dirtree").alias("at")))
    found = []
    while not now.isEmpty():
        here = cut(now.join(entries.withColumnRenamed("dirtree", "at"), "at").select("root", F.concat("path", F.lit("/"), "name").alias("path"), "kind", "child"))
        found.append(here)
        now = here.where("kind = 'd'").select("root", "path", F.col("child").alias("at"))
    return reduce(DataFrame.unionByName, found) if found else roots.select("root", F.lit("").alias("path"), F.lit("d").alias("kind"), F.col("dirtree").alias("child")).limit(0)


def tree_entries(files: DataFrame, trees: DataFrame) -> DataFrame:
    """(dirtree, kind, name, child): the distinct entries of directory objects, from files (path, checksum) and their directories (path, checksum)."""
    names = trees.select("path", F.col("checksum").alias("dirtree"))
    rows = files.select("path", F.lit("f").alias("kind"), "checksum").unionByName(trees.where("path <> ''").select("path", F.lit("d").alias("kind"), "checksum"))
    rows = rows.select(parent(F.col("path")).alias("up"), base(F.col("path")).alias("name"), "kind", F.col("checksum").alias("child"))
    return rows.join(names.withColumnRenamed("path", "up"), "up").select("dirtree", "kind", "name", "child").distinct()
