"""Scalar functions on names, paths, URLs and messages. All are plain Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codehist.schemas import (
    ALL_CLASSES,
    CLASS_RENAMES,
    LABEL_TYPES,
    LEGACY_TYPES,
    LEVEL_CODES,
    NO_FILE,
)

# A message with one of these words marks a bug fix.
BUG_WORDS = ["bug", "error", "mistake", "fault", "wrong", "fail", "fix"]


def _trim(text: Column) -> Column:
    """Strip every character up to U+0020, as the mining tools do."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def _last_part(text: Column, sep: str) -> Column:
    """Last part after ``sep``; separators at the end do not count."""
    cut = F.regexp_replace(text, f"[{sep}]+\\z" if sep != "." else r"\.+\z", "")
    return F.substring_index(cut, sep, -1)


# --- messages, ids -----------------------------------------------------------


def is_bug_fix(message: Column) -> Column:
    return F.lower(message).rlike("|".join(BUG_WORDS))


def trimmed(text: Column) -> Column:
    return _trim(text)


def parent_id(parents: Column) -> Column:
    """First parent, or the word ``Null`` for a root commit."""
    return F.when(F.size(parents) == 0, F.lit("Null")).otherwise(_trim(F.get(parents, 0)))


def short_summary(summary: Column) -> Column:
    return F.substring(summary, 1, 20)


def error_state(commit_id: Column, project: Column) -> Column:
    # fixed value: the format of the log
    return F.format_string("\n{commit: %s from project: %s", commit_id, project)


def csv_escape(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def parse_thresholds(text: Column) -> Column:
    """``"6, 3, 5"`` or ``"[6,3,5]"`` to an ascending array of ints."""
    digits = F.regexp_replace(F.regexp_replace(text, r"[^\d,.]", ""), r",+\z", "")
    return F.array_sort(F.transform(F.split(digits, ","), lambda x: x.cast("int")))


def elapsed_minutes(millis: Column) -> Column:
    return millis / F.lit(1000.0) / F.lit(60.0)


def scale_cohesion(ratio: Column) -> Column:
    """A ratio as a whole number of 1/1024 parts, cut towards zero; NaN is 0."""
    return (F.nanvl(ratio.cast("float"), F.lit(0.0).cast("float")) * 1024).cast("int")


# --- paths -------------------------------------------------------------------


def is_java_file(path: Column) -> Column:
    return F.lower(path).endswith(".java")


def is_test_file(path: Column) -> Column:
    return is_java_file(path) & F.lower(path).contains("test")


def file_is_missing(path: Column) -> Column:
    return path == NO_FILE


def unix_path(path: Column, windows: bool = False) -> Column:
    return F.translate(path, "\\", "/") if windows else path


def class_from_file(path: Column) -> Column:
    return F.replace(_last_part(F.translate(path, "\\", "/"), "/"), F.lit(".java"), F.lit(""))


def _clean_path(path: Column) -> Column:
    one = F.regexp_replace(path, "/+", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, r"/\z", "")).otherwise(one)


def dirs_only(path: Column) -> Column:
    """Parent folder; null when there is none."""
    p = _clean_path(path)
    parent = F.regexp_extract(p, r"(?s)^(.*)/[^/]*\z", 1)
    return F.when(parent != "", parent).when(p.startswith("/") & (F.length(p) > 1), F.lit("/"))


def file_name_only(path: Column) -> Column:
    return F.substring_index(_clean_path(path), "/", -1)


def last_slash_dir(path: Column) -> Column:
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


# --- URLs --------------------------------------------------------------------


def is_local_url(url: Column) -> Column:
    return ~(url.startswith("https") | url.startswith("git"))


def project_name(url: Column) -> Column:
    return F.replace(_last_part(url, "/"), F.lit(".git"), F.lit(""))


def commit_url(url: Column, commit_id: Column, strict_suffix: bool = False) -> Column:
    """Web page of a commit. ``.git`` goes everywhere in the URL, or only at its end."""
    if strict_suffix:
        base = F.regexp_replace(url, r"\.git\z", "")
    else:
        base = F.replace(url, F.lit(".git"), F.lit(""))
    return F.when(
        is_local_url(url), F.concat(F.lit("@local/"), url, F.lit("/"), commit_id)
    ).otherwise(F.concat(base, F.lit("/commit/"), commit_id))


# --- class and method names --------------------------------------------------


def clean_dollar(name: Column) -> Column:
    return F.translate(name, "$", ".")


def class_from_full_name(name: Column) -> Column:
    return _last_part(name, ".")


def is_anonymous_class(name: Column) -> Column:
    """The last part starts in lower case; null when there is no last part."""
    last = class_from_full_name(name)
    return F.when(last != "", last.rlike(r"^\p{javaLowerCase}"))


def is_inner_class(class_type: Column) -> Column:
    return class_type == "innerclass"


def clean_method_name(name: Column) -> Column:
    return F.substring_index(name, "/", 1)


def method_name_or_empty(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def full_method_name(name: Column, types: Column, dims: Column) -> Column:
    """``name/n[T1,T2[]]`` from parameter types and their array dimensions."""
    params = F.array_join(
        F.zip_with(types, dims, lambda t, d: F.concat(t, F.repeat(F.lit("[]"), F.greatest(d, F.lit(0))))),
        ",",
    )
    brackets = F.when(F.size(types) > 0, F.concat(F.lit("["), params, F.lit("]"))).otherwise("")
    return F.concat(name, F.lit("/"), F.size(types).cast("string"), brackets)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _without_generics(text: Column) -> Column:
    """Remove ``<...>`` pairs, innermost first; null if one stays open."""
    depth = F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit("")))
    flat = F.reduce(
        F.array_repeat(F.lit(0), depth), text, lambda t, _: F.regexp_replace(t, "<[^<>]*>", "")
    )
    return F.when(text.contains("<"), _let(flat, lambda t: F.when(~t.contains("<"), t))).otherwise(text)


def _simple_parameter(p: Column) -> Column:
    return F.when(p.contains("."), F.nullif(_last_part(p, "."), F.lit(""))).otherwise(p)


def simplify_method_name(name: Column) -> Column:
    """``m/2[a.b.C,Map<K,V>]`` to ``m/2[C,Map]``.

    Packages, generics and annotations of the parameters go. Null when the
    generics are not closed, a parameter is nothing but dots, or nothing follows
    the bracket.
    """
    left = F.substring_index(name, "[", 1)
    at = F.instr(name, "[")
    right = clean_dollar(F.substring(name, at + 1, F.length(name) - at - 1))
    bare = F.regexp_replace(_trim(_let(right, _without_generics)), "@.* ", "")

    def brackets(bare: Column) -> Column:
        # empty parameters at the end do not count, unless the list is empty anyway
        kept = F.regexp_replace(bare, r",+\z", "")
        params = F.transform(F.split(kept, ","), _simple_parameter)
        listed = _let(
            params,
            lambda ps: F.when(
                ~F.exists(ps, lambda p: p.isNull()), F.concat(F.lit("["), F.array_join(ps, ","), F.lit("]"))
            ),
        )
        return F.when((bare != "") & (kept == ""), F.lit("")).otherwise(listed)

    readable = F.when(at < F.length(name), F.concat(left, _let(bare, brackets)))
    return F.when(~name.contains("["), name).otherwise(readable)


# --- label types -------------------------------------------------------------


def refactoring_level(label_type: Column) -> Column:
    """Level code of a label type, -1 when it is not studied."""
    level = F.lit(-1)
    for name, types in LABEL_TYPES.items():
        level = F.when(label_type.isin(types), LEVEL_CODES[name]).otherwise(level)
    return level.cast("int")


def is_studied(label_type: Column) -> Column:
    return label_type.isin([t for types in LABEL_TYPES.values() for t in types])


def is_class_rename(label_type: Column) -> Column:
    return label_type.isin(CLASS_RENAMES)


def takes_all_classes(label_type: Column) -> Column:
    return label_type.isin(ALL_CLASSES)


def is_legacy_type(label_type: Column) -> Column:
    return label_type.isin(LEGACY_TYPES)
