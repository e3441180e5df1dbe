"""Refs, patterns, access rules, config text: predicates and rules as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rights and their bits.
READ, WRITE, CREATE, DELETE, TAG = 1, 2, 4, 8, 16


def pattern_regex(pattern: str) -> str:
    """`*` is one part, `**` one or more, other parts literal."""
    part = {"*": "[^/]+", "**": "[^/]+(/[^/]+)*"}
    return "^" + "/".join(part.get(p, re.escape(p)) for p in pattern.split("/")) + "$"


def matches(name: Column, pattern: str) -> Column:
    return name.rlike(pattern_regex(pattern))


def selected(name: Column, selector: list[str]) -> Column:
    """(no positive pattern, or one matches) and no negative one (`!`) matches; order doesn't matter."""
    yes, no = [p for p in selector if p[0] != "!"], [p[1:] for p in selector if p[0] == "!"]
    out = F.lit(not yes)
    for p in yes:
        out = out | matches(name, p)
    for p in no:
        out = out & ~matches(name, p)
    return out


def below(name: Column, prefix: str) -> Column:
    return (name == prefix) | F.startswith(name, F.lit(prefix + "/"))


def valid_ref(name: Column) -> Column:
    """Components behind an optional remote, a component too, and one colon. A component has letters, numbers, nonspacing marks, `_`, and behind the first of them `.` and `-`."""
    part = r"[_\p{L}\p{N}\p{Mn}][-._\p{L}\p{N}\p{Mn}]*"
    return name.rlike(f"^({part}:)?{part}(/{part})*$")


def valid_collection(name: Column) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)+$") & (F.octet_length(name) <= 255)


def checksum_shaped(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def rights(rules: DataFrame) -> DataFrame:
    """(who, ref, modes): the union of matching allow rules unless a rule denies; write, create and tag imply read, delete doesn't."""
    got = rules.groupBy("who", "ref").agg(F.bit_or(F.when(F.col("effect") == "allow", F.col("modes")).otherwise(0)).alias("modes"), F.bool_or(F.col("effect") == "deny").alias("denied"))
    implied = F.when(F.col("modes").bitwiseAND(WRITE | CREATE | TAG) != 0, F.col("modes").bitwiseOR(READ)).otherwise(F.col("modes"))
    return got.select("who", "ref", F.when(F.col("denied"), 0).otherwise(implied).alias("modes"))


def specificity(pattern: Column) -> Column:
    """Sorts patterns: part by part literal over `*` over `**`, then the longer; larger is more specific."""
    return F.array_join(F.transform(F.split(pattern, "/"), lambda p: F.when(p == "**", "1").when(p == "*", "2").otherwise("3")), "")


def rule_for(pairs: DataFrame, key: str, pattern: str, pos: str) -> DataFrame:
    """Of matching (key, pattern, pos) rows the most specific pattern of each key; the first listed on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc(specificity(F.col(pattern))), pos)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ip_number(text: Column) -> Column:
    p = F.split(text, "\\.")
    return sum((F.element_at(p, i + 1).cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.element_at(p, 1).cast("long") * (1 << 24))


def in_network(ip: Column, network: Column) -> Column:
    bits = F.lit(32) - F.substring_index(network, "/", -1).cast("int")
    size = F.pow(F.lit(2.0), bits).cast("long")
    return F.floor(ip_number(ip) / size) == F.floor(ip_number(F.substring_index(network, "/", 1)) / size)


def parse_config(lines: DataFrame, keep_pos: bool = False) -> DataFrame:
    """(file, grp, key, value[, pos]) of keyfile lines (file, pos, line): the last group header above a line is its group."""
    text = F.trim(F.col("line"))
    header = F.nullif(F.regexp_extract(text, "^\\[([^\\]]+)\\]$", 1), F.lit(""))
    grp = F.last(header, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    rows = lines.withColumn("grp", grp).where(text.rlike("^[^#\\[=][^=]*="))
    return rows.select("file", "grp", F.trim(F.substring_index(text, "=", 1)).alias("key"), F.trim(F.regexp_replace(text, "^[^=]*=", "")).alias("value"), *["pos"] * keep_pos)


def parse_ref(text: Column) -> tuple[Column, Column, Column]:
    """(space, qualifier, name) of `NAME`, `REMOTE:NAME` and `(ID, NAME)`."""
    whole = r"^\(([^,()]+), ([^()]+)\)$"
    collection, head = F.regexp_extract(text, whole, 1), F.regexp_extract(text, "^([^:()]+):([^:]+)$", 1)
    space = F.when(collection != "", "collection").when(head != "", "remote").otherwise("local")
    name = F.when(collection != "", F.regexp_extract(text, whole, 2)).when(head != "", F.regexp_extract(text, "^[^:]+:(.+)$", 1)).otherwise(text)
    return space, F.coalesce(F.nullif(collection, F.lit("")), F.nullif(head, F.lit(""))), name


def canonical_ref(space: Column, qualifier: Column, name: Column, own: str) -> Column:
    """One spelling: own collection's refs are local."""
    return F.when((space == "local") | ((space == "collection") & (qualifier == own)), name).when(space == "remote", F.concat(qualifier, F.lit(":"), name)).otherwise(F.concat(F.lit("("), qualifier, F.lit(", "), name, F.lit(")")))


def collection_refs(heads: DataFrame, mirrors: DataFrame, remotes: DataFrame, own: str) -> DataFrame:
    """(id, name, checksum, space): heads under the own id, mirrors of other ids, refs of remotes (remote, id, name, checksum) of other, valid ids; of an id's name a mirror wins over remotes, and the first remote over others."""
    local = heads.select(F.lit(own).alias("id"), "name", "checksum", F.lit("local").alias("space"), F.lit("").alias("remote"))
    mirrored = mirrors.where(F.col("id") != own).select("id", "name", "checksum", F.lit("mirror").alias("space"), F.lit("").alias("remote"))
    others = remotes.where((F.col("id") != own) & valid_collection(F.col("id"))).select("id", "name", "checksum", F.lit("remote").alias("space"), "remote")
    every = local.unionByName(mirrored).unionByName(others)
    first = F.min_by(F.struct("checksum", "space"), F.struct(F.col("space") == "remote", "remote")).alias("first")
    return every.groupBy("id", "name").agg(first).select("id", "name", "first.checksum", "first.space")


def resolve_revisions(asked: DataFrame, commits: DataFrame, refs: DataFrame, back: list[DataFrame]) -> DataFrame:
    """(asked, checksum, outcome) of revisions: a full checksum, a unique beginning of at least four digits of one, or a ref, each with `^` for parents. A beginning that several commits have is ambiguous."""
    from .history import climb

    plain = F.regexp_replace("asked", r"\^+$", "")
    rows = asked.withColumn("plain", plain).withColumn("steps", (F.length("asked") - F.length("plain")).cast("long"))
    short = rows.where(F.col("plain").rlike("^[0-9a-f]{4,64}$"))
    hits = short.withColumn("key", F.substring("plain", 1, 4)).join(commits.select(F.col("checksum").alias("found"), F.substring("checksum", 1, 4).alias("key")), "key").where(F.startswith("found", "plain"))
    found = hits.groupBy("asked").agg(F.count_distinct("found").alias("n"), F.min("found").alias("found"))
    named = rows.join(refs.select(F.col("name").alias("plain"), F.col("checksum").alias("tip")), "plain", "left").join(found, "asked", "left")
    start = climb(named.withColumn("at", F.when(F.col("n") == 1, F.col("found")).when(F.col("n").isNull(), F.col("tip"))), "at", "steps", back)
    outcome = F.when(F.col("n") > 1, "ambiguous").when(F.col("at").isNull(), "no such revision").when(F.col("up").isNull(), "no parent").otherwise("found")
    return start.select("asked", F.when(outcome == "found", F.col("up")).alias("checksum"), outcome.alias("outcome"))


def auth_matches(items: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, item) pairs: an item (item, kind, value) is anonymous, tls, token, basic, ssh or net; a client (client, tls, token, user, key, ip) matches by what it shows."""
    few = F.broadcast(items)
    c, i = F.col, F.col("kind")
    hit = (
        (i == "anonymous") | ((i == "tls") & c("tls")) | ((i == "token") & (c("token") == c("value"))) | ((i == "basic") & (c("user") == c("value")))
        | ((i == "ssh") & (c("key") == c("value"))) | ((i == "net") & F.coalesce(in_network(c("ip"), F.when(i == "net", c("value"))), F.lit(False)))
    )
    return clients.join(few, F.coalesce(hit, F.lit(False))).select("client", "item")


def newest(rows: DataFrame, key: str, ts: str, pos: str) -> DataFrame:
    """For each key the row with the newest time; the earlier position on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), pos)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def size_spec(text: Column) -> Column:
    """Bytes of sizes such as `5GB` (G, M or T, powers of 1024); null where it is none."""
    n, unit = F.regexp_extract(text, "^([0-9]+)[GMT]B$", 1), F.regexp_extract(text, "^[0-9]+([GMT])B$", 1)
    return F.when(unit != "", F.try_to_number(n, F.lit("9" * 18)).cast("long") * F.when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1 << 40))


def percent_spec(text: Column) -> Column:
    """A whole percentage from 0 to 100; null where it is none."""
    n = F.regexp_extract(text, "^([0-9]{1,3})%$", 1).try_cast("int")
    return F.when(n <= 100, n)


def free_space_refused(planned: Column, free: Column, total: Column, size: Column, percent: Column) -> Column:
    """Whether a write would leave less than the least free space: a size if one is set, else a percentage of the whole, 3 if none is set."""
    least = F.coalesce(size_spec(size), F.floor(total * F.coalesce(percent_spec(percent), F.lit(3)) / 100))
    return free - planned < least


def receive_pattern(text: str) -> tuple[str, str | None, str]:
    """(scope, qualifier, name pattern) of `NAME`, `REMOTE:NAME`, `*:NAME` or `@ID:NAME`."""
    head, colon, name = text.rpartition(":")
    if not colon:
        return "local", None, text
    if head == "*":
        return "remote", None, name
    return ("collection", head[1:], name) if head.startswith("@") else ("remote", head, name)


def receives(space: Column, qualifier: Column, name: Column, pattern: str, own: str | None = None) -> Column:
    """Whether a pattern covers a ref: namespaces must agree; the own collection's refs and patterns are local."""
    scope, wanted, names = receive_pattern(pattern)
    local = (space == "local") | ((space == "collection") & (qualifier == F.lit(own)) if own else F.lit(False))
    if scope == "local" or scope == "collection" and wanted == own:
        there = local
    elif scope == "collection":
        there = (space == "collection") & (qualifier == wanted)
    else:
        there = (space == "remote") & (F.lit(wanted is None) | (qualifier == F.lit(wanted)))
    return F.coalesce(there, F.lit(False)) & matches(name, names)


def receive_selected(space: Column, qualifier: Column, name: Column, selector: list[str], own: str | None = None) -> Column:
    yes, no = [p for p in selector if p[0] != "!"], [p[1:] for p in selector if p[0] == "!"]
    out = F.lit(not yes)
    for p in yes:
        out = out | receives(space, qualifier, name, p, own)
    for p in no:
        out = out & ~receives(space, qualifier, name, p, own)
    return out


def strength(pattern: str) -> str:
    """Sorts patterns that match one ref: a literal remote over `*:`, then part by part literal over `*` over `**`, then the longer."""
    scope, wanted, names = receive_pattern(pattern)
    return str(int(scope == "remote" and wanted is not None)) + "".join({"**": "1", "*": "2"}.get(p, "3") for p in names.split("/"))


def receive_rule(refs: DataFrame, patterns: list[str], own: str | None = None) -> DataFrame:
    """Adds `rule`, the place of the strongest pattern that covers (space, qualifier, name); the first of equals; null if none does."""
    order = sorted(range(len(patterns)), key=lambda i: (strength(patterns[i]), -i), reverse=True)
    hit = [F.when(receives(F.col("space"), F.col("qualifier"), F.col("name"), patterns[i], own), i) for i in order]
    return refs.withColumn("rule", F.coalesce(*hit) if hit else F.lit(None).cast("int"))


def claimed_rights(rules: DataFrame, claims: DataFrame) -> DataFrame:
    """(who, namespace, ref, modes, source): of a namespace that a certificate's claims name, only the claims count, else the groups' rules. Both are (who, namespace, ref, effect, modes)."""
    named = claims.select("who", "namespace").distinct().withColumn("named", F.lit(True))
    left = rules.join(named, ["who", "namespace"], "left").where("named is null").drop("named").withColumn("source", F.lit("group"))
    both = claims.withColumn("source", F.lit("claim")).unionByName(left)
    key = F.struct("who", "namespace", "source")
    got = rights(both.select(key.alias("who"), "ref", "effect", "modes"))
    return got.select("who.who", "who.namespace", "ref", "modes", "who.source")


def resolved_settings(lines: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """One row for each group of settings (key, name, value), a column for each known name with its default; the last of repeated names counts. Rows must carry `pos`."""
    last = [F.coalesce(F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("pos"))), F.lit(d)).alias(n.replace("-", "_")) for n, d in defaults.items()]
    return lines.groupBy(key).agg(*last)


def edit_config(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Keyfile lines (file, pos, grp, key, text) after edits (file, grp, key, text), in their order: a set key stays in its place, a new one follows its group's last line, a new group the file's last line.

    A null text removes the key, a null key the group. Lines of a null key are headers and comments.
    """
    gone = edits.where("key is null").select("file", "grp")
    sets = edits.where("key is not null").select("file", "grp", "key", F.col("text").alias("new"), F.lit(True).alias("edited"))
    kept = lines.join(gone, ["file", "grp"], "left_anti")
    both = kept.join(sets, ["file", "grp", "key"], "left").where("edited is null or new is not null").select("file", "grp", "pos", F.lit(0).alias("sub"), "key", F.coalesce("new", "text").alias("text"))
    places = kept.groupBy("file", "grp").agg(F.max("pos").alias("pos"))
    fresh = sets.where("new is not null").join(lines.select("file", "grp", "key"), ["file", "grp", "key"], "left_anti").join(places, ["file", "grp"], "left")
    header = fresh.where("pos is null").select("file", "grp").distinct().select("file", "grp", F.lit(1 << 40).alias("pos"), F.lit(1).alias("sub"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("["), "grp", F.lit("]")).alias("text"))
    added = fresh.select("file", "grp", F.coalesce("pos", F.lit(1 << 40)).alias("pos"), F.lit(2).alias("sub"), "key", F.col("new").alias("text"))
    out = both.unionByName(header).unionByName(added)
    at = F.row_number().over(Window.partitionBy("file").orderBy("pos", "grp", "sub", "key"))
    return out.select("file", at.cast("long").alias("pos"), "grp", "key", "text")


def verified(rows: DataFrame, trusted: DataFrame, by: str) -> DataFrame:
    """(by, valid, signatures) of signatures (by, engine, signature): valid if any engine trusts one; all are listed, sorted. The plain engine's signature is the key itself."""
    keys = trusted.select("engine", "signature").distinct().withColumn("known", F.lit(True))
    hit = rows.join(keys, ["engine", "signature"], "left")
    return hit.groupBy(by).agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("valid"), F.array_sort(F.collect_list("signature")).alias("signatures"))


def compare_and_set(refs: DataFrame, updates: DataFrame) -> DataFrame:
    """Refs (name, checksum) after updates (name, expected, new): a row for each ref and each update, with its outcome."""
    both = refs.join(updates, "name", "full_outer")
    asked = F.col("asked").isNotNull()
    ok = asked & F.col("expected").eqNullSafe(F.col("checksum"))
    outcome = F.when(~F.coalesce(asked, F.lit(False)), "kept").when(~ok, "refused").when(F.col("new").isNull(), "deleted").otherwise("set")
    return both.select("name", F.when(ok, F.col("new")).otherwise(F.col("checksum")).alias("checksum"), outcome.alias("outcome"))


def resolve(asked: DataFrame, refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(asked, checksum): a ref's own value, else that of the ref that an alias (name, target) names; null if there is neither."""
    own = asked.join(refs.select(F.col("name").alias("asked"), "checksum"), "asked", "left")
    through = aliases.join(refs.select(F.col("name").alias("target"), F.col("checksum").alias("via")), "target").select(F.col("name").alias("asked"), "via")
    return own.join(through, "asked", "left").select("asked", F.coalesce("checksum", "via").alias("checksum"))


def check_bindings(refs: DataFrame, metadata: DataFrame, own: str, named: str = "name") -> DataFrame:
    """Adds `outcome` to refs (checksum, ...): whether the tip's metadata (key, value array) binds it to the ref and to the collection."""
    of = lambda key: F.try_element_at(F.filter("metadata", lambda e: e["key"] == key), F.lit(1))["value"]
    both = refs.join(metadata, "checksum", "left")
    bound = F.coalesce(F.array_contains(of("ref-binding"), F.col(named)), F.lit(False))
    same = F.coalesce(of("collection-binding") == F.array(F.lit(own)), F.lit(True))
    return both.withColumn("outcome", F.when(F.col("metadata").isNull(), "no commit").when(~bound, "not bound").when(~same, "other collection").otherwise("ok"))


def canonical_mode(mode: Column) -> Column:
    """Whether nobody but the owner may write, and there is no set-id bit (the sticky bit may be there)."""
    return mode.bitwiseAND(0o6022) == 0


def unprivileged_mode(mode: Column) -> Column:
    """Whether a store without privileges takes the mode: no set-id bit."""
    return mode.bitwiseAND(0o6000) == 0


def canonical_permissions(kind: Column, mode: Column) -> tuple[Column, Column]:
    """(mode, owner) under canonical permissions: files readable by all, writable by the owner, without set-id, owned by 0; links are left alone."""
    return F.when(kind == "l", 0o777).otherwise(mode.bitwiseAND(0o755).bitwiseOR(0o644)), F.when(kind != "l", 0)


def commit_time(explicit: Column, environment: Column, clock: Column) -> tuple[Column, Column]:
    """(time, error): the explicit one, else the environment's if it is set (white space trimmed; no time but an error if it is no count of seconds), else the clock."""
    trimmed = F.regexp_replace(environment, "^\\s+|\\s+$", "")
    count = F.when(trimmed.rlike("^[0-9]+$"), trimmed.try_cast("long"))
    return F.coalesce(explicit, F.when(environment.isNull(), clock).otherwise(count)), explicit.isNull() & environment.isNotNull() & count.isNull()


def sign(rows: DataFrame, key: Column) -> DataFrame:
    """Adds the signature of `payload`: a digest of the key and the payload's digest. Any engine that is a column expression can take its place."""
    return rows.withColumn("signature", F.sha2(F.concat(key, F.sha2("payload", 256)).cast("binary"), 256))


def signature_outcome(payload: Column, signature: Column, key: Column) -> Column:
    again = F.sha2(F.concat(key, F.sha2(payload, 256)).cast("binary"), 256)
    return F.when(signature.isNull(), "unsigned").when(signature != again, "changed").otherwise("ok")


def refspec(spec: Column) -> tuple[Column, Column, Column, Column]:
    """(source, destination, collection, valid) of `SRC`, `SRC:DST`, `:DST` (a delete); `@ID:` before the destination names a collection."""
    whole = "^([^:@]*)(?::(?:@([^:]+):)?([^:@]+))?$"
    src, collection, dst = (F.nullif(F.regexp_extract(spec, whole, i), F.lit("")) for i in (1, 2, 3))
    valid = spec.rlike(whole) & (src.isNotNull() | dst.isNotNull())
    return F.when(valid, src), F.when(valid, F.coalesce(dst, src)), F.when(valid, collection), valid


def prefix_groups(refs: DataFrame, prefixes: list[str]) -> DataFrame:
    """(row, pos, name, below) of refs at or below prefixes, numbered in the order of the prefixes and names; below is the part behind the prefix. Counts of name heads come first, so no task numbers all."""
    groups = [refs.where(below(F.col("name"), p)).select(F.lit(i).alias("pos"), "name", F.when(F.col("name") == p, F.col("name")).otherwise(F.substr("name", F.lit(len(p) + 2))).alias("below")) for i, p in enumerate(prefixes)]
    rows = groups[0]
    for g in groups[1:]:
        rows = rows.unionByName(g)
    rows = rows.withColumn("head", F.substring_index("name", "/", 2))
    before = rows.groupBy("pos", "head").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("pos", "head").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    at = F.row_number().over(Window.partitionBy("pos", "head").orderBy("name")) + F.coalesce("before", F.lit(0))
    return rows.join(before, ["pos", "head"]).select(at.cast("long").alias("row"), "pos", "name", "below")
