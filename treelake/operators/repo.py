"""Whole-repository operations: reading stored files, ingest, checkout decisions, detached metadata, listings, media, images."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from . import history as Hi
from . import trees as T

#: Most bytes of a metadata object that is read.
METADATA_CAP = 128 << 20


def read_objects(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(otype, checksum, payload, outcome) of the wanted (otype, checksum): found, absent, or too large for metadata (types 2 to 4)."""
    hit = wanted.select("otype", "checksum").distinct().join(objects, ["otype", "checksum"], "left")
    large = F.col("otype").between(2, 4) & (F.length("payload") > METADATA_CAP)
    outcome = F.when(F.col("payload").isNull(), "absent").when(large, "too large").otherwise("found")
    return hit.select("otype", "checksum", F.when(~large, F.col("payload")).alias("payload"), outcome.alias("outcome"))


def archive_bytes(payload: Column, deflated: Column, mode: Column | int = H.FILE_MODE, target: Column | str = "") -> Column:
    """A file as an archive stores it: header length, four zero bytes, the size and header, the deflated payload."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    end = 24 + F.octet_length(lit(target)) + 1
    size = F.lpad(F.hex(F.octet_length(payload).cast("long")), 16, "0")
    header = F.concat(size, H.be32(F.lit(0)), H.be32(F.lit(0)), H.be32(lit(mode)), F.lit("00000000"), H.text(lit(target)), H.le(end, H.offset_width(end, F.lit(1))))
    return F.concat(F.unhex(F.concat(H.be32((F.length(header) / 2).cast("long")), F.lit("00000000"), header)), deflated)


def parse_archive(data: bytes) -> tuple[int, int, int, str, bytes]:
    """(uid, gid, mode, target, payload) of an archive's file."""
    n = int.from_bytes(data[:4], "big")
    header, body = data[8 : 8 + n], data[8 + n :]
    size, (uid, gid, mode) = int.from_bytes(header[:8], "big"), (int.from_bytes(header[8 + 4 * i : 12 + 4 * i], "big") for i in range(3))
    payload = zlib.decompress(body, -15) if body else b""
    if len(payload) != size:
        raise ValueError("a payload of another size than its header says")
    return uid, gid, mode, header[24 : header.index(b"\0", 24)].decode(), payload


def parse_content(data: bytes) -> tuple[int, int, int, str, bytes]:
    """(uid, gid, mode, target, payload) of a content stream, as it is hashed and sent."""
    n = int.from_bytes(data[:4], "big")
    header = data[8 : 8 + n]
    uid, gid, mode = (int.from_bytes(header[4 * i : 4 * i + 4], "big") for i in range(3))
    return uid, gid, mode, header[16 : header.index(b"\0", 16)].decode(), data[8 + n :]


def read_files(objects: DataFrame) -> DataFrame:
    """(checksum, uid, gid, mode, target, payload) of stored files (checksum, layout, bytes): `archive`, `content` (header and payload as they are hashed) and `bare` (the payload alone)."""

    def rows(frames):
        readers = {"archive": parse_archive, "content": parse_content, "bare": lambda b: (0, 0, H.FILE_MODE, "", b)}
        for pdf in frames:
            out = [(c, *readers[layout](bytes(b))) for c, layout, b in zip(pdf["checksum"], pdf["layout"], pdf["bytes"], strict=True)]
            yield pd.DataFrame(out, columns=["checksum", "uid", "gid", "mode", "target", "payload"])

    return objects.select("checksum", "layout", "bytes").mapInPandas(rows, "checksum string, uid long, gid long, mode int, target string, payload binary")


def ingest(spark: SparkSession, path: str, keep: Column | None = None, mode: Column | int = H.FILE_MODE, label: Column | None = None) -> DataFrame:
    """(path, checksum, size, mode, label) of the files below a folder, any that Spark can read. keep, mode and label see path and size.

    Spark reads no rows from empty files; these come from the listing that the driver's file index holds in any case.
    """
    root = path.rstrip("/").split("/")[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.concat(F.lit("/"), F.substring_index("path", f"/{root}/", -1))
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    empty = listed.select(plain.alias("path")).join(files.select(plain.alias("path")), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    rows = files.select("path", "length", "content").unionByName(empty).select(below.alias("path"), F.col("length").alias("size"), "content")
    rows = rows.where(keep) if keep is not None else rows
    rows = rows.withColumn("mode", (mode if isinstance(mode, Column) else F.lit(mode)).cast("int")).withColumn("label", label if label is not None else F.lit(None).cast("string"))
    return rows.select("path", H.content_checksum(F.col("content"), mode=F.col("mode")).alias("checksum"), "size", "mode", "label")


#: How a checkout treats what is there already.
MODES = ("none", "union", "add", "identical")


def checkout(tree: DataFrame, there: DataFrame, mode: str = "none", whiteouts: bool = False, subpath: str = "", keep: Column | None = None) -> DataFrame:
    """(path, action) for a tree (path, kind, checksum) written over what is there: add, replace, keep, delete, error.

    none: every collision is an error. union: files are replaced. add: what is there stays. identical: what is there must match. Directories
    stay in all modes but none. A directory over another type is an error always, a file over a directory under union, unless whiteouts are processed there: then it goes
    with all below it. Whiteouts: `.wh.NAME` deletes NAME; one that names nothing is an error.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if subpath:
        tree = tree.where(F.startswith("path", F.lit(subpath + "/"))).withColumn("path", F.substr("path", F.lit(len(subpath) + 1)))
    tree = tree.where(keep) if keep is not None else tree
    marks = tree.where(T.base(F.col("path")).startswith(".wh.") & F.lit(whiteouts))
    doomed = marks.select(F.concat(T.parent(F.col("path")), F.lit("/"), F.substr(T.base(F.col("path")), F.lit(5))).alias("path"), F.lit(True).alias("marked"))
    new = tree.join(marks.select("path"), "path", "left_anti").select("path", F.col("kind").alias("nk"), F.col("checksum").alias("nc"))
    both = new.join(there.select("path", F.col("kind").alias("ok"), F.col("checksum").alias("oc")), "path", "full_outer").join(doomed, "path", "full_outer")
    clash = F.col("nk") != F.col("ok")
    file = {
        "none": F.lit("error"), "union": F.when(F.col("ok") == "d", "replace" if whiteouts else "error").otherwise("replace"),
        "add": F.lit("keep"), "identical": F.when(clash | (F.col("nc") != F.col("oc")), "error").otherwise("keep"),
    }[mode]
    directory = F.when(F.lit(mode == "none"), "error").when(~clash, "keep").when(F.lit(mode == "union" and whiteouts), "replace").otherwise("error")
    action = (
        F.when(F.col("marked") & F.col("ok").isNull() & F.col("nk").isNull(), "error").when(F.col("marked") & F.col("nk").isNull(), "delete")
        .when(F.col("ok").isNull(), "add").when(F.col("nk").isNull(), "stay").when(F.col("nk") == "d", directory).otherwise(file)
    )
    acted = both.select("path", action.alias("action"), (F.col("marked") | (clash & (F.col("ok") == "d"))).alias("clears"))
    gone = acted.where("clears and action in ('delete', 'replace')").select("path")
    below = T.skip_subtrees(there.select("path"), gone).withColumn("left", F.lit(True))
    acted = acted.join(below, "path", "left")
    cleared = F.col("left").isNull() & (F.col("action") == "stay")
    return acted.select("path", F.when(cleared, "delete").otherwise(F.col("action")).alias("action")).where("action <> 'stay'")


def merge_detached(stored: Column, incoming: Column, lists: list[str], kept: list[str]) -> Column:
    """Dictionaries as array<struct<key, values array<string>>>: stored order first; lists of signatures are united without repeating what is stored, other keys replaced in place, kept keys stay as stored; new keys follow."""
    of = lambda d, k: F.try_element_at(F.filter(d, lambda e: e["key"] == k), F.lit(1))["values"]

    def one(e):
        mine, theirs = e["values"], of(incoming, e["key"])
        united = F.concat(mine, F.array_except(theirs, mine))
        values = F.when(theirs.isNull() | e["key"].isin(kept), mine).when(e["key"].isin(lists), united).otherwise(theirs)
        return F.struct(e["key"].alias("key"), values.alias("values"))

    known = F.transform(stored, lambda e: e["key"])
    fresh = F.filter(incoming, lambda e: ~F.array_contains(known, e["key"]) & ~e["key"].isin(kept))
    return F.concat(F.transform(stored, one), fresh)


def drop_signatures(stored: Column, key: str, signature: Column) -> Column:
    """The dictionary without a signature; a key whose list becomes empty goes."""
    left = F.transform(stored, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == key, F.filter(e["values"], lambda v: v != signature)).otherwise(e["values"]).alias("values")))
    return F.filter(left, lambda e: F.size(e["values"]) > 0)


def add_related(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(commit, name, checksum) related entries after adding: a name's entry is replaced, other names stay; entries are sorted by name."""
    old = stored.join(new.select("commit", "name"), ["commit", "name"], "left_anti")
    return old.unionByName(new).distinct()


def split_related(entries: DataFrame) -> DataFrame:
    """(commit, field, index, name, checksum, defect) of entries as stored in fields `dependencies` and `sources`, arrays of (name, checksum bytes)."""
    each = lambda f: entries.select("commit", F.lit(f).alias("field"), F.posexplode(f).alias("index", "e"))
    both = each("dependencies").unionByName(each("sources"))
    n = F.length("e.checksum")
    defect = F.when(F.col("e.name") == "", "empty name").when(n != 32, F.concat(F.lit("checksum of "), n.cast("string"), F.lit(" bytes")))
    return both.select("commit", "field", "index", "e.name", F.when(n == 32, F.lower(F.hex("e.checksum"))).alias("checksum"), defect.alias("defect"))


def ref_listing(refs: DataFrame, selected: Column, readable: DataFrame, who: str, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one reader is told: the refs (name, space, checksum) that are selected and that the rights (who, ref, modes) let them read, and the deltas (src, dst) that lead to their commits, along the chain of indexes."""
    may = readable.where((F.col("who") == who) & (F.col("modes").bitwiseAND(1) != 0)).select(F.col("ref").alias("space"))
    listed = refs.where(selected).join(may.distinct(), "space", "left_semi")
    roots = listed.select(F.col("checksum").alias("node")).distinct().withColumn("bound", F.lit(Hi.ALL))
    reached = Hi.closure(roots, deltas.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("node").alias("dst"))
    return listed, deltas.join(reached, "dst", "left_semi")


def media_copy(refs: DataFrame, commits: DataFrame, content: DataFrame, there: DataFrame, depth: int) -> DataFrame:
    """(kind, checksum) that an export of these refs still has to copy to the media: their commits to a depth, and what those hold."""
    roots = refs.select(F.col("checksum").alias("node")).distinct().withColumn("bound", F.lit(depth))
    edges = commits.where("parent is not null").select(F.col("checksum").alias("src"), F.col("parent").alias("dst"))
    kept = Hi.closure(roots, edges).select(F.col("node").alias("checksum"))
    ks = commits.join(kept, "checksum", "left_semi").select("k")
    objects = content.join(ks, "k", "left_semi").select("checksum").distinct()
    whole = kept.select(F.lit("commit").alias("kind"), "checksum").unionByName(objects.select(F.lit("object").alias("kind"), "checksum"))
    return whole.join(there, "checksum", "left_anti")


def reconcile(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(checksum, finding) of stored keys (checksum, stray) against what refs reach: missing, unreachable, stray (a name that is no object), ok."""
    both = listing.join(wanted.select("checksum", F.lit(True).alias("wanted")).distinct(), "checksum", "full_outer")
    finding = F.when(F.col("stray"), "stray").when(F.col("stray").isNull(), "missing").when(F.col("wanted"), "ok").otherwise("unreachable")
    return both.select("checksum", finding.alias("finding"))


def receive(updates: DataFrame, rules: list[dict], hooks: list[Callable[[], Column]] = ()) -> DataFrame:
    """(outcome) for updates with rule, old, new, fast_forward, verified: the first refusal that holds, or what is done. Hooks are conditions that refuse when true, asked last."""
    of = lambda key: F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r[key])]), F.col("rule"))
    deletes = F.col("new").isNull()
    outcome = (
        F.when(F.col("rule").isNull(), "no rule").when(~of("accept"), "not accepted").when(deletes & ~of("delete"), "delete refused")
        .when(~deletes & of("verify") & ~F.col("verified"), "no valid signature")
        .when(~deletes & F.col("old").isNotNull() & ~F.col("fast_forward") & ~of("force"), "not a fast-forward")
    )
    for i, hook in enumerate(hooks):
        outcome = outcome.when(hook(), f"hook {i}")
    return updates.withColumn("outcome", outcome.when(deletes, "deleted").when(F.col("old").isNull(), "created").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated"))


def commit_metadata(entries: Column, refs: Column, collection: Column) -> Column:
    """The caller's entries (key, value array) in their order, then the binding to refs, sorted, and the collection's beside it; without refs neither."""
    binding = F.array(F.struct(F.lit(H.BINDING).alias("key"), F.array_sort(refs).alias("value")))
    beside = F.array(F.struct(F.lit("ostree.collection-binding").alias("key"), F.array(collection).alias("value")))
    return F.concat(entries, F.when(refs.isNull(), F.slice(binding, 1, 0)).when(collection.isNull(), binding).otherwise(F.concat(binding, beside)))


def import_reasons(wanted: DataFrame, volumes: DataFrame, trusted: DataFrame, held: DataFrame) -> DataFrame:
    """Why each wanted ref (k, collection, name) is taken from its volume or not: volumes and trusted list k, held lists (collection, name)."""
    mark = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    rows = wanted.join(mark(volumes, "volume"), "k", "left").join(mark(trusted, "trust"), "k", "left").join(mark(held, "there"), ["collection", "name"], "left")
    return rows.withColumn("reason", F.when(F.col("volume").isNull(), "no volume").when(F.col("trust").isNull(), "untrusted").when(F.col("there").isNull(), "no such ref").otherwise("ok"))


def remote_refs(catalogs: DataFrame, selector: list[str]) -> DataFrame:
    """(remote, id, name) of the collection refs in remotes' catalogs (remote, id, names) that a selector takes."""
    from .refs import selected

    rows = catalogs.select("remote", "id", F.explode("names").alias("name"))
    return rows.where(selected(F.col("name"), selector))


def check_images(recorded: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """(by, outcome): the digest that is recorded against the one of the image that is there."""
    both = recorded.join(stored, by, "left")
    return both.select(by, F.when(F.col("digest").isNull(), "absent").when(F.col("digest") != F.col("recorded"), "mismatch").otherwise("ok").alias("outcome"))


def finish_updates(judged: DataFrame, wraps: Column) -> DataFrame:
    """What stands behind an update that was let through: the commit itself, or one that the server makes around it."""
    done = F.col("outcome").isin("created", "updated")
    return judged.withColumn("outcome", F.when(done & wraps, "server commit").otherwise(F.col("outcome")))


def stage(offered: DataFrame, stored: DataFrame) -> DataFrame:
    """(otype, checksum, size, offered, written): each offered object (otype, checksum, size) once, and whether the store lacked it."""
    one = offered.groupBy("otype", "checksum").agg(F.max("size").alias("size"), F.count("*").alias("offered"))
    there = stored.select("otype", "checksum").distinct().withColumn("there", F.lit(True))
    return one.join(there, ["otype", "checksum"], "left").select("otype", "checksum", "size", "offered", F.col("there").isNull().alias("written"))


def publish(staged: DataFrame, refs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A transaction's end: (counts of what was offered and written, refs after it). Updates (name, checksum) whose commit is neither staged nor stored by name stay out; a null checksum drops the ref."""
    from . import refs as R

    stats = staged.agg(F.sum("offered").alias("offered"), F.count("*").alias("objects"), F.count_if("written").alias("written"), F.coalesce(F.sum(F.when(F.col("written"), F.col("size"))), F.lit(0)).alias("bytes"))
    asked = updates.join(refs.select("name", F.col("checksum").alias("expected")), "name", "left").select("name", "expected", F.col("checksum").alias("new"), F.lit(True).alias("asked"))
    return stats, R.compare_and_set(refs, asked).where("checksum is not null").select("name", "checksum")


def dump(files: DataFrame, digests: bool = True) -> DataFrame:
    """Dump rows (path, size, mode, nlink, uid, gid, rdev, mtime, payload, content, digest) of files (path, checksum, size, mode, digest) and the directories above them; links of a directory count its subdirectories."""
    dirs = T.directories(files)
    kids = dirs.where("path <> ''").groupBy(T.parent(F.col("path")).alias("path")).agg(F.count("*").alias("kids"))
    octal = lambda m: F.conv(m.cast("string"), 10, 8)
    same = [F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(0).alias("rdev"), F.lit("0.0").alias("mtime")]
    stored = F.when(F.col("size") == 0, "-").otherwise(F.concat(F.substring("checksum", 1, 2), F.lit("/"), F.substr("checksum", F.lit(3)), F.lit(".file")))
    regular = files.select("path", "size", octal(F.col("mode")).alias("mode"), F.lit(1).cast("long").alias("nlink"), *same, stored.alias("payload"), F.lit("-").alias("content"), F.when((F.col("size") == 0) | F.lit(not digests), "-").otherwise(F.col("digest")).alias("digest"))
    listed = dirs.join(kids, "path", "left").select(F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), F.lit(0).cast("long").alias("size"), octal(F.lit(H.DIR_MODE)).alias("mode"), (F.coalesce("kids", F.lit(0)) + 2).alias("nlink"), *same, F.lit("-").alias("payload"), F.lit("-").alias("content"), F.lit("-").alias("digest"))
    return regular.unionByName(listed)


def ls_line(kind: Column, mode: Column, uid: Column, gid: Column, size: Column, path: Column, checksum: Column | None = None, target: Column | None = None) -> Column:
    """A line of a listing: type and mode, owner, group, size, the checksum if asked for, path, and where a link leads."""
    parts = [F.concat(kind, F.lpad(F.conv(mode.cast("string"), 10, 8), 5, "0")), uid.cast("string"), gid.cast("string"), size.cast("string"), *([checksum] if checksum is not None else []), path]
    return F.concat(F.concat_ws(" ", *parts), F.coalesce(F.concat(F.lit(" -> "), target), F.lit("")) if target is not None else F.lit(""))


def completeness(wanted: DataFrame, there: DataFrame, most: int) -> DataFrame:
    """(missing, first): how many wanted objects are nowhere, and the first of them in checksum order, at most so many."""
    gone = wanted.select("checksum").distinct().join(there.select("checksum"), "checksum", "left_anti")
    listed = gone.orderBy("checksum").limit(most).agg(F.array_sort(F.collect_list("checksum")).alias("first"))
    return gone.agg(F.count("*").alias("missing")).join(listed)


#: Object types and their file endings.
ENDINGS = {1: "file", 2: "dirtree", 3: "dirmeta", 4: "commit"}


def loose_path(checksum: Column, otype: Column, mode: Column) -> Column:
    ending = F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair]), otype)
    packed = F.when((otype == 1) & (mode == "archive"), "z").otherwise("")
    return F.concat(F.substring(checksum, 1, 2), F.lit("/"), F.substr(checksum, F.lit(3)), F.lit("."), ending, packed)


def delta_path(src: Column, dst: Column) -> Column:
    """Fan-out path of a delta; one from nothing has no source."""
    a, b = H.modified_base64(src), H.modified_base64(dst)
    name = F.when(src.isNull(), b).otherwise(F.concat(a, F.lit("-"), b))
    return F.concat(F.lit("deltas/"), F.substring(name, 1, 2), F.lit("/"), F.substr(name, F.lit(3)))
