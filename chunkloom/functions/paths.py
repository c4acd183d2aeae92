"""Path patterns as regular expressions: single globs, exclude files (the last matching rule wins) and selections."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = r"(?!)"


def glob_regex(pattern: str) -> str:
    """A shell glob as an unanchored regular expression: * and ? stay within a path segment, [..] are classes, \\ quotes. Invalid globs match nothing."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == n:
                return NEVER
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            m = re.compile(r"(\^?)((?:\\.|[^\]\\])(?:\\.|[^\]\\])*)\]", re.S).match(pattern, i)
            if m is None or re.search(r"(?:^|[^\\])-$|^-", m[2]):
                return NEVER
            body = re.sub(r"\\(.)|([\[&~^])", lambda x: "\\" + (x[1] or x[2]), m[2])
            out.append(f"(?!/)[{m[1]}{body}]" if m[1] else f"[{body}]")
            i = m.end()
        else:
            out.append(re.escape(c))
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    regex: str  # matches the whole path
    negate: bool
    dirs_only: bool


def parse_rule(raw: str) -> Rule | None:
    """One line of an exclude file; None for blanks and # comments.

    !re-includes, a trailing / is for directories alone. With a slash elsewhere the rule is anchored at the root and
    holds for everything beneath; a single segment fits any basename; ** spans segments and needs the whole path.
    """
    s = raw.strip()
    if not s or s[0] == "#":
        return None
    negate = s[0] == "!"
    s = s[1:] if negate else s
    dirs_only = s.endswith("/")
    s = s.removesuffix("/")
    anchored = "/" in s
    segments = s.removeprefix("/").split("/")
    if "**" in segments:
        out = ""
        for i, seg in enumerate(segments):
            last = i == len(segments) - 1
            if seg == "**":
                out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
            else:
                out += glob_regex(seg) + ("" if last else "/")
        # "a/**" holds for a itself, too
        regex = re.sub(r"/\(\?:\[\^/\]\+\(\?:/\[\^/\]\+\)\*\)\?$", lambda _: "(?:/[^/]+)*", out)
    elif anchored:
        regex = "/".join(map(glob_regex, segments)) + "(?:/.*)?"
    else:
        regex = "(?:.*/)?" + glob_regex(segments[0])
    return Rule(regex, negate, dirs_only)


def excluded(path: Column, is_dir: Column, patterns: list[str]) -> Column:
    """Whether the last rule that fits excludes the path."""
    out = F.lit(False)
    for rule in filter(None, map(parse_rule, patterns)):
        fits = path.rlike(f"^(?:{rule.regex})$") & (is_dir if rule.dirs_only else F.lit(True))
        out = F.when(fits, F.lit(not rule.negate)).otherwise(out)
    return out


def ancestors(path: Column) -> Column:
    """Every directory above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def walk(tree: DataFrame, patterns: list[str]) -> DataFrame:
    """What a walk of (source_index, path, size, is_dir) visits: nothing excluded, and nothing beneath an excluded directory even if re-included."""
    marked = tree.withColumn("gone", excluded(F.col("path"), F.col("is_dir"), patterns))
    cut = marked.where("gone and is_dir").select("source_index", F.col("path").alias("above"))
    beneath = marked.where("not gone").withColumn("above", F.explode(ancestors(F.col("path")))).join(cut, ["source_index", "above"], "left_semi").select("source_index", "path").distinct()
    return marked.where("not gone").drop("gone").join(beneath, ["source_index", "path"], "left_anti")


def stream_offsets(tree: DataFrame) -> DataFrame:
    """Adds stream_offset: the bytes before each non-empty regular file in order of (source_index, path); others have null.

    Sizes are summed within hashed-out ranges first: a range's rows and the ranges' totals each run in a window of their own.
    """
    from pyspark.sql import Window as W

    size = F.when(~F.col("is_dir") & (F.col("size") > 0), F.col("size")).otherwise(F.lit(0))
    whole = W.orderBy("source_index").rowsBetween(W.unboundedPreceding, -1)
    totals = tree.groupBy("source_index").agg(F.sum(size).alias("total"))
    totals = totals.select("source_index", F.coalesce(F.sum("total").over(whole), F.lit(0)).alias("base"))
    inside = W.partitionBy("source_index").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    out = tree.withColumn("before", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(totals, "source_index")
    return out.withColumn("stream_offset", F.when(size > 0, F.col("base") + F.col("before"))).drop("before", "base")


def matches(path: Column, pattern: str) -> Column:
    """A restore selection: the basename or the whole path fits the glob; with ** a directory prefix and a suffix glob at any depth."""
    if "**" in pattern:
        prefix, suffix = pattern.split("**", 1)
        prefix, suffix = prefix.removesuffix("/"), suffix.removeprefix("/")
        under = (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)
        return under & path.rlike(f"^(?:.*/)?(?:{glob_regex(suffix)})$") if suffix else under
    g = glob_regex(pattern)
    return path.rlike(f"^(?:[\\s\\S]*/)?(?:{g})$") if "/" not in pattern else path.rlike(f"^(?:{g})$")


def select_files(catalog: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that fit any pattern and the directories needed to hold them."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | matches(F.col("path"), p)
    files = catalog.where(~F.col("is_dir") & fits)
    needed = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return catalog.where("is_dir").join(needed, "path", "left_semi").select(*catalog.columns).unionByName(files)


def under_prefix(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix + "/")


def covering_exclusion(path: Column, configured: list[str]) -> Column:
    """The first configured path that is the path or above it, whatever the case; null if none."""
    out = F.lit(None).cast("string")
    low = F.lower(path)
    for p in reversed(configured):
        out = F.when(under_prefix(low, p.lower().rstrip("/")), F.lit(p)).otherwise(out)
    return out


def parse_exclusion(raw: Column) -> Column:
    r"""An operator's exclusion as struct(drive, rel, reason): a drive-qualified path without wildcards but a trailing \*; reason is null if it is valid."""
    s = F.regexp_replace(F.translate(F.trim(raw), "/", "\\"), r"\\\*$", "")
    rel = F.regexp_replace(F.substring(s, 3, 1 << 20), r"^\\+|\\+$", "")
    reason = (
        F.when(F.trim(raw) == "", "empty")
        .when(~s.rlike("^[A-Za-z]:"), "no drive letter")
        .when(s.rlike(r'[*?<>"|]'), "wildcard")
        .when(rel == "", "whole volume")
        .when(F.exists(F.split(rel, r"\\"), lambda x: x.isin("", ".", "..")), "relative segment")
    )
    ok = reason.isNull()
    return F.struct(F.when(ok, F.upper(F.substring(s, 1, 2))).alias("drive"), F.when(ok, F.translate(rel, "\\", "/")).alias("rel"), reason.alias("reason"))


def repository_pattern(repository: Column, source: Column) -> Column:
    """The anchored pattern that keeps a store out of a backup of the folder it lies in; null if it lies elsewhere or is that folder. Both are absolute paths."""
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, "/+", "/"), "(.)/$", "$1")
    r, s = clean(repository), F.regexp_replace(clean(source), "/$", "")
    return F.when(F.startswith(r, F.concat(s, F.lit("/"))) & (F.length(r) > F.length(s) + 1), F.concat(F.substr(r, F.length(s) + 1), F.lit("/")))
