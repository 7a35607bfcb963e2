"""Path keys `<source>:<native path>` as column expressions. A bare path is a key without source."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"(?s)^([a-z0-9][a-z0-9_-]{1,31}):(.*)$"
#: Drive, share or leading separator.
ROOT = r"^(?:[A-Za-z]:[\\/]?|(?:\\\\|//)[^\\/]*(?:[\\/][^\\/]*)?[\\/]?|[\\/])"


def is_key(key: Column) -> Column:
    return key.rlike(KEY)


def source(key: Column) -> Column:
    """The source, or empty."""
    return F.regexp_extract(key, KEY, 1)


def native(key: Column) -> Column:
    return F.when(is_key(key), F.regexp_extract(key, KEY, 2)).otherwise(key)


def make(source_id: Column, path: Column) -> Column:
    return F.concat(source_id, F.lit(":"), path)


def separator(key: Column) -> Column:
    """Backslash where the path has one or starts with a drive, else slash."""
    text = native(key)
    return F.when(text.contains("\\") | text.rlike("^[A-Za-z]:"), F.lit("\\")).otherwise(F.lit("/"))


def root(key: Column) -> Column:
    """The root of the native path; a bare drive is given its separator."""
    found = F.regexp_extract(native(key), ROOT, 0)
    return F.when(found.rlike(r"^[A-Za-z]:$"), F.concat(found, F.lit("\\"))).otherwise(found)


def body(key: Column) -> Column:
    """The native path after its root, without trailing separators."""
    return F.regexp_replace(F.regexp_replace(native(key), ROOT, ""), r"[\\/]+$", "")


def _keyed(key: Column, path: Column) -> Column:
    return F.when(is_key(key), F.concat(source(key), F.lit(":"), path)).otherwise(path)


def trimmed(key: Column) -> Column:
    """Without trailing separators; a root stays a root."""
    path = F.concat(root(key), body(key))
    return _keyed(key, F.when(path == "", native(key)).otherwise(path))


def is_root(key: Column) -> Column:
    return body(key) == ""


def parts(key: Column) -> Column:
    return F.filter(F.split(body(key), r"[\\/]"), lambda x: x != "")


def name(key: Column) -> Column:
    """Last element; of a root the root itself."""
    return F.when(is_root(key), root(key)).otherwise(F.regexp_extract(body(key), r"[^\\/]*$", 0))


def parent(key: Column) -> Column:
    """The folder of an element; a root is its own."""
    up = F.regexp_extract(body(key), r"^(.*)[\\/][^\\/]*$", 1)
    path = F.concat(root(key), up)
    return F.when(is_root(key), trimmed(key)).otherwise(_keyed(key, F.when(path == "", F.lit(".")).otherwise(path)))


def suffix(key: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot is none."""
    return F.lower(F.regexp_extract(name(key), r"^.+(\.[^.]*)$", 1))


def stem(key: Column) -> Column:
    last = name(key)
    return F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_extract(last, r"^(.+)\.[^.]*$", 1)).otherwise(last)


def joined(key: Column, *names: Column) -> Column:
    """The path with further elements; empty ones add nothing."""
    def add(path: Column, item: Column) -> Column:
        item = F.regexp_replace(item, r"^[\\/]+|[\\/]+$", "")
        glue = F.when(path.rlike(r"[\\/:]$"), F.lit("")).otherwise(separator(key))
        return F.when(item == "", path).otherwise(F.concat(path, glue, item))

    return reduce(add, names, trimmed(key))


def chain(key: Column) -> Column:
    """Every folder from the root to the path itself, with the path's own separator."""
    items = parts(key)
    start = F.when(root(key) == "", F.array().cast("array<string>")).otherwise(F.array(_keyed(key, root(key))))
    steps = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items))).otherwise(F.array().cast("array<int>"))
    glued = lambda i: F.when(separator(key) == "\\", F.array_join(F.slice(items, 1, i), "\\")).otherwise(F.array_join(F.slice(items, 1, i), "/"))
    return F.concat(start, F.transform(steps, lambda i: _keyed(key, F.concat(root(key), glued(i)))))


def prefix(folder: str) -> str:
    """What every path inside a folder starts with, for a pushed-down startswith."""
    return folder if folder.endswith(("/", "\\")) else folder + ("\\" if "\\" in folder or re.match(r"^(?:[a-z0-9][a-z0-9_-]{1,31}:)?[A-Za-z]:", folder) else "/")


def inside(key: Column, folder: str) -> Column:
    """Whether the path is the folder or lies in it."""
    return (key == folder.rstrip("/\\")) | key.startswith(prefix(folder))


def short_source(key: Column) -> Column:
    """Source as far as a colon after the second character tells."""
    return F.when(F.instr(key, ":") > 2, F.substring_index(key, ":", 1)).otherwise(F.lit(""))


def is_legacy(key: Column) -> Column:
    return F.instr(key, ":") <= 2


def clean_title(text: Column) -> Column:
    """White space collapsed, 120 characters at most."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 120)


def salvaged_json(text: Column) -> Column:
    """From the first brace to the last, whatever stands around; null without both."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def slot_name(key: Column, ending: str = ".jpg") -> Column:
    """aa/aabb....jpg from the key's SHA-1."""
    digest = F.sha1(key)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(ending))


def normal_rule(rule: str) -> str:
    """A rule in one form: trimmed, unquoted, lower case, forward slashes, no trailing slash."""
    text = rule.strip().strip('"').replace("\\", "/").lower()
    return re.sub(r"(?<=.)/+$", "", text)


def normal_path(key: Column) -> Column:
    """The same form for paths."""
    text = F.translate(F.lower(F.trim(key)), "\\", "/")
    return F.regexp_replace(text, r"(?<=.)/+$", "")


def glob_regex(rule: str) -> str:
    """A glob (* ? [..]) as an anchored expression."""
    out, at = [], 0
    while at < len(rule):
        c = rule[at]
        end = rule.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = rule[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            at = end
        else:
            out.append(re.escape(c))
        at += 1
    return "(?s)^" + "".join(out) + "$"


def matches_rule(key: Column, rule: str) -> Column:
    """Whether a normal path falls under a normal rule; a rule without source holds in every source."""
    keyed = re.match(r"^[a-z0-9][a-z0-9_-]{1,31}:", rule) is not None
    path = key if keyed else native(key)
    if any(c in rule for c in "*?["):
        return path.rlike(glob_regex(rule))
    return (path == rule) | path.startswith(rule + "/")


def blocked(key: Column, block: list[str], allow: list[str] = []) -> Column:  # noqa: B006
    """A block rule decides, an allow rule overrides."""
    path = normal_path(key)
    under = lambda rules: reduce(lambda a, b: a | b, (matches_rule(path, normal_rule(r)) for r in rules), F.lit(False))
    return under(block) & ~under(allow)


def enterable(folder: Column, block: list[str], allow: list[str] = []) -> Column:  # noqa: B006
    """Whether a walk enters a folder: it isn't blocked, or an allow rule lies at or below it."""
    path = normal_path(folder)
    deeper = lambda rule: (F.lit(rule) == path) | F.lit(rule).startswith(F.concat(path, F.lit("/"))) | (F.lit(rule) == native(path)) | F.lit(rule).startswith(F.concat(native(path), F.lit("/")))
    return ~blocked(folder, block, allow) | reduce(lambda a, b: a | b, (deeper(normal_rule(r)) for r in allow), F.lit(False))
