"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends; null: empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def exact_match(a: Column, b: Column) -> Column:
    return (normalize(a) == normalize(b)).cast("double")


def overlap(a: Column, b: Column) -> Column:
    """Size of the common multiset of two arrays."""
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))


def multiset_scores(a: Column, b: Column) -> Column:
    """struct(precision, recall, f1) of predictions a against references b; both empty: 1."""

    def of(x: Column) -> Column:
        p, r, n = x["a"], x["b"], x["n"].cast("double")
        both = (F.size(p) == 0) & (F.size(r) == 0)
        precision = F.when(both, 1.0).when(F.size(p) == 0, 0.0).otherwise(n / F.greatest(F.size(p), F.lit(1)))
        recall = F.when(both, 1.0).when(F.size(r) == 0, 0.0).otherwise(n / F.greatest(F.size(r), F.lit(1)))
        return let(F.struct(precision.alias("precision"), recall.alias("recall")), with_f1)

    def with_f1(s: Column) -> Column:
        total = s["precision"] + s["recall"]
        f1 = F.when(total > 0, 2 * s["precision"] * s["recall"] / total).otherwise(0.0)
        return F.struct(s["precision"].alias("precision"), s["recall"].alias("recall"), f1.alias("f1"))

    return let(F.struct(a.alias("a"), b.alias("b"), overlap(a, b).alias("n")), of)


def token_f1(a: Column, b: Column) -> Column:
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda s: multiset_scores(s["a"], s["b"])["f1"])


def label_key(label: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{Nd}\p{Nl}\p{No}]", "")


def strong_normalize(text: Column) -> Column:
    """Lower case; white space, underscores and hyphens as one blank; only letters, digits and blanks stay."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, r"(?U)[\s_\-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{Nd}\p{Nl}\p{No} ]", ""), " +", " "))


def characters(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, SPACE, ""), ""), lambda c: c != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Common share of the distinct words; none on either side: 0."""

    def of(s: Column) -> Column:
        union = F.size(F.array_union(s["a"], s["b"]))
        return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(union, F.lit(1)))

    words = lambda t: F.filter(F.split(t, " "), lambda x: x != "")
    return let(F.struct(words(a).alias("a"), words(b).alias("b")), of)


def character_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of characters without white space; one side empty: 0."""

    def of(s: Column) -> Column:
        total = F.size(s["a"]) + F.size(s["b"])
        empty = (F.size(s["a"]) == 0) | (F.size(s["b"]) == 0)
        return F.when(empty, 0.0).otherwise(2.0 * overlap(s["a"], s["b"]) / F.greatest(total, F.lit(1)))

    return let(F.struct(characters(a).alias("a"), characters(b).alias("b")), of)


def name_similarity(a: Column, b: Column) -> Column:
    """Equal 1, one inside the other 0.9, else the better of word Jaccard and character F1; an empty name 0."""

    def of(s: Column) -> Column:
        x, y = s["a"], s["b"]
        return (
            F.when((x == "") | (y == ""), 0.0)
            .when(x == y, 1.0)
            .when(F.contains(x, y) | F.contains(y, x), 0.9)
            .otherwise(F.greatest(token_jaccard(x, y), character_f1(x, y)))
        )

    return let(F.struct(strong_normalize(a).alias("a"), strong_normalize(b).alias("b")), of)


def image_path(path: Column) -> Column:
    """Slashes only, without empty and '.' segments."""
    parts = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def raw_preview(text: Column, limit: int = 200) -> Column:
    """White space collapsed; longer than the limit: cut, with three dots."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def strip_special(text: Column) -> Column:
    """Without chat control tokens <|...|>, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|[^|>]+\|>", ""))


def looks_degenerate(text: Column) -> Column:
    """Empty, more than 60 % of the characters neither letters, digits nor blanks, or filler punctuation only."""
    t = F.trim(F.coalesce(text, F.lit("")))
    marks = F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{Nd}\p{Nl}\p{No}\s]", ""))
    return (t == "") | (marks > 0.6 * F.length(t)) | t.rlike(r"^[!?.`~_\-=\s]+$")


def safe_name(text: Column, fallback: str = "model") -> Column:
    """Runs of other than ASCII letters and digits as one underscore, lower case, none at the ends."""
    t = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(t == "", F.lit(fallback)).otherwise(t)


def experiment_name(text: Column) -> Column:
    """Runs of white space as one underscore, none at the ends."""
    t = F.array_join(F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), " "), lambda x: x != ""), "_")
    return F.when(t == "", F.lit("experiment")).otherwise(t)


def file_part(text: Column) -> Column:
    """Runs of other than ASCII letters, digits, dots, underscores and hyphens as one underscore."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]+$", "")


def identity_path(path: Column, root: str = "/") -> Column:
    """An absolute path without empty, '.' and '..' segments, below ``root`` where it is relative; links are not followed.
    An empty path fails the query."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    full = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    out = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(F.coalesce(p, F.lit("")) == "", F.raise_error(F.lit("an identity must be a non-empty path")).cast("string")).otherwise(out)


def utc_now() -> Column:
    """Seconds of the current time in UTC, as ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_lines(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def family_key(name: Column) -> Column:
    """Lower case without underscores, hyphens and dots."""
    return F.translate(F.lower(name), "_-.", "")


def line_prefix_stripped(line: Column) -> Column:
    """Without a leading bullet or number."""
    return F.regexp_replace(F.trim(line), r"^(?:[-*•]\s*|\d+[.)]\s*)", "")


def mock_confidence(key: Column, question: Column, answer: Column) -> Column:
    """0.55 to 0.95, drawn from the hash of id, question and answer."""
    text = F.concat_ws(":", F.coalesce(key, F.lit("None")), F.coalesce(question, F.lit("None")), F.coalesce(answer, F.lit("None")))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 4), 16, 10).cast("long") / 65535.0
    return F.bround(F.lit(0.55) + drawn * 0.4, 4)


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers; array of struct(kind, number, text)."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    digit = lambda p: p.rlike(r"^\d+$")
    return F.transform(parts, lambda p: F.struct(F.when(digit(p), 0).otherwise(1).alias("kind"), F.when(digit(p), p.cast("decimal(38,0)")).alias("number"), F.when(~digit(p), p).alias("text")))


def natural_text(name: Column) -> Column:
    """A string that sorts as ``natural_key`` does, then by the name itself."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lit("0"), F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))
    each = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(F.concat(F.lit("1"), p)))
    return F.concat(F.array_join(each, "\u0000"), F.lit("\u0000\u0000"), name)


#: How lines begin that introduce a list rather than name an object.
EXPLANATION_PREFIXES = (
    "here are", "objects:", "object names:", "visible objects:", "visible ui elements:", "ui elements:", "elements:", "output:", "answer:", "explanation:", "note:",
)


def object_text(names: Column) -> Column:
    """A list of object names as text: their number, then one a line."""
    lines = F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("(none)")
    return F.concat(F.lit("Object count: "), F.size(names).cast("string"), F.lit("\nObjects:\n"), lines, F.lit("\n"))


def object_lines(text: Column) -> Column:
    """Distinct object names of a plain list, in order: one a line, without bullets; headings, code, tables and sentences are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]+|\d+[.)]|[A-Za-z][.)])\s*", "")))

    def named(x: Column) -> Column:
        low = F.lower(x)
        heading = F.lit(False)
        for p in (*EXPLANATION_PREFIXES, "json", "{", "[", "```"):
            heading = heading | F.startswith(low, F.lit(p))
        return (x != "") & ~heading & ~F.contains(x, F.lit("|")) & (F.size(F.split(x, r"\s+")) <= 12)

    def first(a: Column) -> Column:
        return let(F.transform(a, lambda x: F.lower(x)), lambda k: F.filter(a, lambda x, i: F.array_position(k, F.lower(x)) == i + 1))

    return let(F.filter(lines, named), first)


def draw_label(nth: Column, text: Column, kind: Column, focused: Column, most: int = 160) -> Column:
    """``#n | text | type | FOCUSED``, cut with an ellipsis."""
    full = F.concat_ws(" | ", F.concat(F.lit("#"), nth.cast("string")), F.nullif(text, F.lit("")), F.nullif(kind, F.lit("")), F.when(focused, "FOCUSED"))
    return F.when(F.length(full) > most, F.concat(F.substring(full, 1, most - 1), F.lit("…"))).otherwise(full)


def file_profile(path: Column) -> Column:
    """struct(stem, resolution, quantisation) of a file name: tokens like 720p and 4bit."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]+$", "")
    tokens = F.split(F.lower(stem), r"[_\-]")
    one = lambda pattern: F.get(F.filter(tokens, lambda t: t.rlike(pattern)), F.lit(0))
    return F.struct(stem.alias("stem"), one(r"^\d{3,4}p$").alias("resolution"), one(r"^\d+bit$").alias("quantization"))
